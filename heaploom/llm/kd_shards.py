"""Sharding by a k-d tree: weighted medians along the widest metadata dimension until leaves reach the target bytes.

Rows of equal texts are one point.  All nodes of a level are split together.  A weighted median is found without moving a point: its
place along its node's dimension is a 62-bit key (coordinate, then a hash of the text, so a source that holds a third of all
rows can be split inside), and a histogram of weights over equal key ranges is refined around the wanted weight
until the range is one key.  A pass brings nodes x BINS sums to the driver, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, meet, partitions, written

#: Histogram bins of a node in one pass.
BINS = 1024
TIE_BITS = 31
_TOP = 1 << 31


@dataclass
class Node:
    """A k-d tree node that holds shards first .. first + count - 1; split: rows with key <= at along dim go left."""

    first: int
    count: int
    dim: str | None = None
    at: int = 0
    children: list[Node] = field(default_factory=list)


def hashed(col: str) -> Column:
    """Equal values get equal coordinates; null gets 0."""
    return F.shiftright(F.crc32(F.col(col).cast("string").cast("binary")), 1)


def clipped(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0)), F.lit(_TOP - 1))


def leaf_of(node: Node) -> Column:
    """The first shard of the open or closed leaf that a row falls in: one comparison for each split on its way."""
    if not node.children:
        return F.lit(node.first)
    left, right = node.children
    return F.when(F.col(node.dim) <= F.lit(node.at), leaf_of(left)).otherwise(leaf_of(right))


def kd_tree(points: DataFrame, dims: list[str], shards: int, bins: int = BINS) -> Node:
    """Build the tree over points: dims as 62-bit keys (coordinate, tie) and a weight."""
    root = Node(0, shards)
    level = [root]
    spread0: dict[str, int] = {}
    while open_nodes := {n.first: n for n in level if n.count > 1}:
        placed = points.withColumn("__node", leaf_of(root)).where(F.col("__node").isin(list(open_nodes)))
        ends = [f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]
        weight: dict[int, int] = {}
        for r in placed.groupBy("__node").agg(F.sum("weight").alias("w"), *ends).collect():  # a row per node
            node = open_nodes[r["__node"]]
            spread = {d: (r[f"hi_{d}"] >> TIE_BITS) - (r[f"lo_{d}"] >> TIE_BITS) for d in dims}
            spread0 = spread0 or {d: max(1, s) for d, s in spread.items()}
            node.dim = max(dims, key=lambda d: (spread[d] / spread0[d], -dims.index(d)))
            weight[node.first] = r["w"]
        for n in open_nodes.values():  # a node without rows
            n.dim = n.dim or dims[0]
        _split(placed, open_nodes, weight, bins)
        for first, n in open_nodes.items():
            left = n.count // 2
            n.children = [Node(first, left), Node(first + left, n.count - left)]
        level = [c for n in level for c in (n.children or [n])]
    return root


def _case(values: dict[int, Column], otherwise: Column) -> Column:
    out = otherwise
    for k, v in values.items():
        out = F.when(F.col("__node") == k, v).otherwise(out)
    return out


def _split(placed: DataFrame, nodes: dict[int, Node], weight: dict[int, int], bins: int) -> None:
    """Set node.at to the key after which the left side's weight is nearest to its share (count // 2 of count)."""
    top = (1 << 62) - 1
    for n in nodes.values():
        n.at = top
    open_ = {k: (0, top, 0) for k in weight}  # lowest and highest candidate key, weight below the lowest
    goal = {k: weight[k] * (nodes[k].count // 2) / nodes[k].count for k in weight}
    keyed = placed.withColumn("__key", _case({k: F.col(nodes[k].dim) for k in weight}, F.lit(None).cast("long")))
    while open_:
        width = {k: -(-(hi - lo + 1) // bins) for k, (lo, hi, _) in open_.items()}
        low = _case({k: F.lit(v[0]) for k, v in open_.items()}, F.lit(None).cast("long"))
        high = _case({k: F.lit(v[1]) for k, v in open_.items()}, F.lit(None).cast("long"))
        step = _case({k: F.lit(w).cast("long") for k, w in width.items()}, F.lit(1).cast("long"))
        cells = keyed.where(F.col("__key").between(low, high)).withColumn("__bin", F.call_function("div", F.col("__key") - low, step))
        by: dict[int, list] = {}
        for r in cells.groupBy("__node", "__bin").agg(F.sum("weight").alias("w")).collect():  # nodes x bins at most
            by.setdefault(r["__node"], []).append((r["__bin"], r["w"]))
        for k, (lo, _, below) in list(open_.items()):
            del open_[k]
            for b, w in sorted(by.get(k, [])):
                if below + w >= goal[k]:
                    at = lo + b * width[k]
                    if width[k] > 1:
                        open_[k] = (at, at + width[k] - 1, below)
                    else:  # the key at the boundary goes to the side that leaves less error
                        nodes[k].at = at if below + w - goal[k] <= goal[k] - below else at - 1
                    break
                below += w


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps, without gathering a group in one task.

    Rows are dealt by ranges of (group, order), so a large group spans many tasks; each task's count per group is
    summed up before it, and rows are numbered inside their task.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    dealt = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    dealt = written(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "dealt")
    counts = dealt.groupBy(group, "__part").agg(F.count("*").alias("c"), F.min("__at").alias("__first"))
    # one row per task and group that it holds: bounded by tasks + groups
    before = counts.select(
        group,
        "__part",
        "__first",
        F.expr(f"coalesce(sum(c) over (partition by {group} order by __part rows between unbounded preceding and 1 preceding), 0)").alias("__before"),
    )
    # ids rise by one from row to row of a sorted task, and a group's rows there lie together
    return dealt.join(F.broadcast(before), [group, "__part"]).select(
        *[c for c in dealt.columns if not c.startswith("__")],
        (F.col("__before") + F.col("__at") - F.col("__first")).cast("long").alias(name),
    )


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row of docs into one of `shards` leaves of a k-d tree: (key, size, text_crc32, shard, slot).

    size is the text's UTF-8 bytes plus 8 (null text: 8); leaves get equal bytes up to about a group.  A group are the rows of one
    text (null texts are one): it is a point with the bytes of all its rows and never cut apart, so a leaf may exceed its
    share of bytes by what the largest group in it has, at every split on its way half of that.  The dimensions are the group's
    smallest source, its smallest language, and size; null metadata lies at 0, and the hash of the text breaks ties.  With
    fewer groups than shards some shards are empty; an empty table gives an empty result.  Rows with null or equal keys are rows
    like any other; other columns are ignored.
    """
    octets = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    meta = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")}
    rows = docs.select(
        F.col(key).alias("__key"),
        (octets + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("t1"),
        F.when(F.col(text).isNull(), 1).otherwise(0).alias("t2"),
        *[c.alias(k) for k, c in meta.items()],
    )
    rows = written(rows, "shard-rows")
    group = ["t1", "t2", "text_crc32", "size"]
    points = rows.groupBy(*group).agg(F.sum("size").alias("weight"), F.count("*").alias("c"), *[F.min(c).alias(c) for c in meta])
    coordinate = {"k_source": hashed("source"), "k_lang": hashed("lang"), "k_size": clipped(F.col("size") - 8)}
    tie = F.shiftrightunsigned(F.col("t1"), 64 - TIE_BITS)
    keys = [F.shiftleft(F.coalesce(c, F.lit(0)).cast("long"), TIE_BITS).bitwiseOR(tie).alias(d) for d, c in coordinate.items()]
    points = written(points.select(*group, "weight", "c", *keys), "shard-points")
    root = kd_tree(points, list(coordinate), shards)
    total = points.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    placed = meet(rows.select("__key", *group), points.select(*group, "c", leaf_of(root).cast("int").alias("shard")), group, total)
    out = numbered(placed.select(F.col("__key").alias(key), "size", "text_crc32", "shard"), "shard", [key, "size", "text_crc32"])
    discard(rows, points)
    return out
