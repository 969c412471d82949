"""N-gram Jaccard join with count-vector R-trees.

A document is its set of hashed 5-word shingles.  Shingles fall into groups by the low bits of their hash and the
group counts make the document a point; the overlap of two sets is at most the sum over groups of the smaller count, and of
a set and all sets below a node of an R-tree at most the sum of the minima of its counts and the node's upper
corner.  What survives the bound is verified on the sets.

The trees are distributed by tiles.  Two sets of the wanted similarity share a shingle among the first
n - ceil(t n) + 1 of either in any one order, so each document stands in the tile of each of these, and tiles of one document
vanish.  The order is that of the hashes, but shingles that are common in a sample of documents come last: a passage of many
documents makes tiles only where a set has little else.  Documents with equal sets are one from the start.  So that a group of thousands of near copies does not
become all its pairs, each document is first compared with the best of its tiles' smallest documents, then with the
best of its neighbours in large tiles, and the components of these links are found; trees then search only tiles
with more than one component, and pairs between components.  Tiles of more than TILE documents are cut into chunks by size, searched chunk by chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, discard, flat_words, give_back, hashed_words, mix64, partitions, text_slices, written

WORDS = 5
#: Similarity as a percentage, so that the test is one of whole numbers.
PERCENT = 75
#: Documents, about, whose shingles say which ones are common, and how many of these a common one is in.  Only the order of
#: shingles depends on it; at most SAMPLE / COMMON times a document's shingles are common.
SAMPLE = 20_000
COMMON = 40
#: Documents of a tile that one search holds at most.
TILE = 4096
LEAF = 16
#: Neighbours on each side that a document is first compared with in its large tiles, and pairs of it that are verified then.
NEAR = 6
BEST = 3
#: Ids of documents to verify that are sent to every worker at most; more are joined by a shuffle.
SENT_IDS = 1_000_000
#: Smallest documents of tiles dealt out again that are sent to every worker at most; more are joined by a shuffle.
SENT_LEADS = 100_000
#: Earlier tiles of a document that a tile is compared with, to find it superfluous.
BEHIND = 8
#: Rows of tiles that one call in a worker gets, about, and of one smallest document in their tiles at most.  With fewer rows to a
#: call, each call finds the best pairs of its own tiles, and a group of near copies makes more of them.
ROWS = 40_000
ONE = 40_000


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (a text with fewer words: its whole sequence; none: empty)."""
    flat, starts = flat_words(texts)
    h = hashed_words(flat)
    n = np.diff(starts)
    width = max(0, len(h) - words + 1)
    run = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            run[:width] = mix64(run[:width] * np.uint64(0x9E3779B97F4A7C15) + h[j : j + width])
    out = []
    for i, (a, k) in enumerate(zip(starts[:-1].tolist(), n.tolist())):
        if k >= words:
            s = np.sort(run[a : a + k - words + 1])  # faster than np.unique, which hashes
            out.append(s[np.append(s[1:] != s[:-1], True)])
        elif k:
            x = np.uint64(k)
            with np.errstate(over="ignore"):
                for w in h[a : a + k]:
                    x = mix64(np.array([x * np.uint64(0x9E3779B97F4A7C15) + w]))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Group counts: a power of two of groups, by the low bits of the hash: as many as shingles, of large sets a quarter."""
    size = 32
    while size < min(len(shingles), max(1024, len(shingles) / 4)):
        size *= 2
    while True:
        v = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
        if v.max(initial=0) < 256:
            return v.astype(np.uint8)
        size *= 2


def folded(v: np.ndarray, size: int) -> np.ndarray:
    """The counts of fewer groups."""
    return v if len(v) == size else v.reshape(-1, size).sum(0, dtype=np.uint16)


def stacked(vectors: list[np.ndarray], rows: np.ndarray, size: int) -> np.ndarray:
    return np.stack([folded(vectors[i], size) for i in rows])


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """An R-tree over count vectors, bulk-loaded by halving along the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, ids: np.ndarray | None = None):
        self.ids = np.arange(len(points)) if ids is None else ids
        self.top = points.max(0)
        self.least = int(sizes.min())
        self.most = int(sizes.max())
        self.children: list[CountTree] = []
        if len(points) > LEAF:
            wide = int((self.top - points.min(0)).argmax())
            order = np.lexsort((self.ids, points[:, wide]))
            half = len(order) // 2
            for part in (order[:half], order[half:]):
                self.children.append(CountTree(points[part], sizes[part], self.ids[part]))
        else:
            self.points, self.sizes = points, sizes

    def search(self, probes: np.ndarray, sizes: np.ndarray, rows: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe row, point id) arrays whose bound allows the similarity; sizes must allow it too."""
        near = (100 * self.most >= percent * sizes) & (100 * sizes >= percent * self.least)
        bound = np.minimum(probes, self.top).sum(1)
        near &= bound >= least_overlap(sizes, np.maximum(self.least, -(-percent * sizes // 100)), percent)
        if not near.any():
            return
        probes, sizes, rows = probes[near], sizes[near], rows[near]
        if self.children:
            for child in self.children:
                yield from child.search(probes, sizes, rows, percent)
            return
        for i in range(len(self.ids)):
            n = int(self.sizes[i])
            ok = np.minimum(probes, self.points[i]).sum(1) >= least_overlap(sizes, n, percent)
            ok &= (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
            if ok.any():
                yield rows[ok], np.full(int(ok.sum()), self.ids[i])


def like_sizes(sizes: np.ndarray, percent: int) -> list[np.ndarray]:
    """Rows by size, cut into runs of like size, so that one number of groups fits a run."""
    order = np.argsort(sizes, kind="stable")
    blocks, begin = [], 0
    for k in range(1, len(order) + 1):
        if k == len(order) or k - begin >= 512 or 100 * sizes[order[begin]] < percent * sizes[order[k]]:
            blocks.append(order[begin:k])
            begin = k
    return blocks


def tile_pairs(sizes: np.ndarray, comps: np.ndarray, vectors: list[np.ndarray], probe: np.ndarray, point: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """(2, pairs): probes and points of a tile's rows, of different components, whose bound allows the similarity."""
    out = [np.zeros((2, 0), np.int64)]
    blocks = like_sizes(sizes, percent)
    # of two documents of different components one at least is outside the largest component: it probes for the other
    names, times = np.unique(comps, return_counts=True)
    outside = comps != names[times.argmax()]
    turns = [(probe & outside, point)]
    if not (probe == point).all():
        turns.append((probe & ~outside, point & outside))
    for probing, pointed in turns:
        for b in (x[pointed[x]] for x in blocks):
            trees: dict[int, CountTree] = {}
            near = [x for x in (x[probing[x]] for x in blocks) if len(x)] if len(b) else []
            near = [a for a in near if 100 * sizes[a].max() >= percent * sizes[b].min() and 100 * sizes[b].max() >= percent * sizes[a].min()]
            for a in near:
                g = min(len(vectors[i]) for x in (a, b) for i in x)
                if g not in trees:
                    trees[g] = CountTree(stacked(vectors, b, g), sizes[b].astype(np.int64), b)
                for p, q in trees[g].search(stacked(vectors, a, g), sizes[a].astype(np.int64), a, percent):
                    keep = comps[p] != comps[q]
                    out.append(np.stack([p[keep], q[keep]]))
    return np.concatenate(out, axis=1)


def common_shingles(docs: DataFrame, key: str, text: str, words: int) -> np.ndarray:
    """Shingles in COMMON or more of about SAMPLE documents that a hash picks, sorted."""
    n = docs.count()
    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 40))
    chosen = docs.where(F.pmod(F.xxhash64(key, text), F.lit(1 << 40)) < share).select(F.col(text).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text"):
            s = np.sort(np.concatenate(shingle_sets(batch.column("__text"), words)))
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
            c = np.diff(np.append(first, len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(s[first].view(np.int64)), pa.array(c)], names=["s", "c"])

    seen = chosen.mapInArrow(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON)
    return np.sort(np.array([r["s"] for r in seen.select("s").collect()], np.int64).view(np.uint64))


def prefix(s: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set, as signed numbers that rise in their order: common ones come last."""
    at = np.minimum(np.searchsorted(often, s), max(0, len(often) - 1))
    late = often[at] == s if len(often) else np.zeros(len(s), bool)
    first = np.concatenate([s[~late], s[late]])[: prefix_length(len(s), percent)]
    rare = min(len(s) - int(late.sum()), len(first))
    keys = first >> np.uint64(1)
    keys[rare:] |= np.uint64(1 << 63)
    return (keys ^ np.uint64(1 << 63)).view(np.int64)  # with the highest bit turned, signed order is that of unsigned numbers


def shingled(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(doc, n, fp, vec, keys) of every row: set size, hash of the set, count vector, prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, key, text, words))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in text_slices(batches, "__text"):
            sets = shingle_sets(batch.column("__text"), words)
            keys = [prefix(s, sent.value, percent) for s in sets]
            cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([count_vector(s).tobytes() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))),
                ],
                names=["doc", "n", "fp", "vec", "keys"],
            )

    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("__text"))
    return rows.mapInArrow(apply, f"doc {dict(docs.dtypes)[key]}, n long, fp binary, vec binary, keys array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) that have the similarity.  Only the documents of pairs are shingled again."""
    wanted = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    kind = dict(docs.dtypes)[key]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text"):
            sets = shingle_sets(batch.column("__text"), words)
            cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], names=["doc", "s"])

    wanted = written(wanted, "wanted")
    few = wanted.count() <= SENT_IDS  # else the texts are shuffled
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("__text")).join(F.broadcast(wanted) if few else wanted, "doc", "left_semi")
    sets = rows.mapInArrow(apply, f"doc {kind}, s array<long>").groupBy("doc").agg(F.first("s").alias("s"))
    sets = written(sets, "sets")
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a")
    both = both.join(sets.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")
    o = F.size(F.array_intersect("sa", "sb"))
    out = written(both.where(100 * o >= percent * (F.size("sa") + F.size("sb") - o)).select("a", "b"), "links")
    discard(sets, wanted)
    return out


def _bounded(pairs: DataFrame, vecs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with bound / union as __bound, without those that the bound rules out."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            bound = np.empty(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist())):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                g = min(len(x), len(y))
                bound[i] = np.minimum(folded(x, g), folded(y, g)).sum()
            ok = bound >= least_overlap(na, nb, percent)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(bound / (na + nb - bound))], names=["a", "b", "__bound"])
            yield out.filter(pa.array(ok))

    rows = pairs.join(vecs.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va")), "a")
    rows = rows.join(vecs.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb")), "b")
    kind = dict(pairs.dtypes)["a"]
    return rows.select("a", "b", "na", "nb", "va", "vb").mapInArrow(apply, f"a {kind}, b {kind}, __bound double")


def _small_tile_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components and like sizes of tiles of at most LEAF documents: a tree over one would be one leaf."""
    lists = rows.groupBy("key").agg(F.collect_list(F.struct("doc", "n", "comp")).alias("m"))
    near = (
        f"y.doc > x.doc and y.comp != x.comp and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    )
    pairs = F.expr(f"flatten(transform(m, x -> transform(filter(m, y -> {near}), y -> struct(x.doc as a, y.doc as b))))")
    return lists.select(pairs.alias("all")).select(F.explode("all").alias("p")).select("p.a", "p.b").distinct()


def _not_subsumed(rows: DataFrame) -> DataFrame:
    """Rows of tiles whose documents do not all stand together in one earlier tile as well.

    The shingles of a passage that many documents share make many tiles of the same documents; prefixes are closed downwards, so
    all stand in the tile of the first of them.  Each document's last BEHIND tiles are compared.
    """
    w = Window.partitionBy("doc").orderBy("key").rowsBetween(-BEHIND, -1)
    before = rows.select("key", F.collect_list("key").over(w).alias("all")).select("key", F.explode("all").alias("earlier"))
    met = before.groupBy("key", "earlier").agg(F.count("*").alias("met"))
    size = rows.groupBy("key").agg(F.count("*").alias("size"))
    gone = met.join(size, "key").where("met = size").select("key").distinct()
    return rows.join(gone, "key", "left_anti")


def near_pairs(sizes: np.ndarray, comps: np.ndarray, vectors: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(2, pairs) of different components among neighbours by size and by place, with bound / union: where a link is likeliest."""
    pairs, values = [np.zeros((2, 0), np.int64)], [np.zeros(0)]
    for block in like_sizes(sizes, percent):
        if len(block) < 2 or (comps[block] == comps[block[0]]).all():
            continue
        points = stacked(vectors, block, min(len(vectors[i]) for i in block))
        for order in (np.arange(len(block)), np.argsort(block)):
            for off in range(1, min(NEAR, len(block) - 1) + 1):
                i, j = order[:-off], order[off:]
                bound = np.minimum(points[i], points[j]).sum(1).astype(np.int64)
                i, j = block[i], block[j]
                good = (comps[i] != comps[j]) & (bound >= least_overlap(sizes[i], sizes[j], percent))
                pairs.append(np.stack([i[good], j[good]]))
                values.append((bound / (sizes[i] + sizes[j] - bound))[good])
    return np.concatenate(pairs, axis=1), np.concatenate(values)


def _searched(tiles: DataFrame, vecs: DataFrame, percent: int, kind: str, near: bool) -> DataFrame:
    """Candidate pairs of large tiles (key, doc, n, comp), by R-trees; in chunks of like sizes.

    near: only, for each document, the BEST pairs with neighbours, to join components before all pairs between them are sought.
    """
    spark = tiles.sparkSession
    w = Window.partitionBy("key").orderBy("n", "doc")
    rows = tiles.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / TILE).cast("int"))
    # a document without another of like size in its tile has no partner there
    alike = 100 * F.lag("n").over(w) >= percent * F.col("n")
    alike = F.coalesce(alike, F.lit(False)) | F.coalesce(100 * F.col("n") >= percent * F.lead("n").over(w), F.lit(False))
    lead = F.min("doc").over(Window.partitionBy("key"))
    rows = rows.withColumn("alike", alike).withColumn("lead", lead).where("alike").drop("alike")
    rows = written(rows, "tiles")
    chunks = rows.groupBy("key", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("c"))
    i, j = chunks.alias("i"), chunks.alias("j")
    large = chunks.where("chunk > 0").select("key").distinct()
    many = i.join(large, "key", "left_semi").alias("i").join(j, F.expr("i.key = j.key and i.chunk <= j.chunk and 100 * i.hi >= %d * j.lo" % percent))
    plan = many.select("i.key", F.col("i.chunk").alias("ci"), F.col("j.chunk").alias("cj"))
    # tiles of one chunk need no plan: the chunk is searched against itself
    single = rows.join(large, "key", "left_anti").select("*", F.lit(0).alias("ci"), F.lit(0).alias("cj"), F.lit(True).alias("probe"), F.lit(True).alias("point"))
    cut = rows.join(large, "key", "left_semi")
    probes = cut.join(plan, "key").where("chunk = ci or chunk = cj").withColumn("probe", F.col("chunk") == F.col("ci")).withColumn("point", F.col("chunk") == F.col("cj"))
    both = single.unionByName(probes.select(single.columns))
    # tiles with the same smallest document hold much the same documents: together they need each vector once.  Tiles of
    # one such document that have more than ONE rows together are dealt out again by their keys
    groups = max(partitions(spark), -(-rows.count() // ROWS))
    one = ["lead", "ci", "cj"]
    many = both.groupBy(*one).agg(F.ceil(F.count("*") / ONE).alias("parts")).where("parts > 1")
    many = written(many, "many")
    many = F.broadcast(many) if many.count() <= SENT_LEADS else many.hint("merge")
    part = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))
    both = both.join(many, one, "left").withColumn("__bin", F.pmod(F.xxhash64(*one, part), F.lit(groups))).drop("lead", "chunk", "parts")
    both = written(both, "searches")
    each = both.select((F.col("__bin") + 0).alias("bin"), F.col("doc").alias("d")).distinct()
    own = each.join(vecs.select(F.col("doc").alias("d"), "vec"), "d")

    def search(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        place = dict(zip(known["d"], known["vec"]))
        part = part.sort_values(["key", "ci", "cj", "doc"], kind="stable").reset_index(drop=True)
        n, comp, doc = part["n"].to_numpy(), part["comp"].to_numpy(), part["doc"].to_numpy()
        probe, point = part["probe"].to_numpy(), part["point"].to_numpy()
        ids = part[["key", "ci", "cj"]].to_numpy()
        edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(part)]
        found, waiting = [pd.DataFrame({"a": doc[:0], "b": doc[:0], "v": np.zeros(0)})], 0
        for a, b in zip(edges, edges[1:]):
            s = slice(a, b)
            vectors = [np.frombuffer(place[d], np.uint8) for d in doc[s]]
            if near:
                (p, q), value = near_pairs(n[s], comp[s], vectors, percent)
            else:
                (p, q), value = tile_pairs(n[s], comp[s], vectors, probe[s], point[s], percent), 0.0
            x, y = doc[s][p], doc[s][q]
            found.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "v": value}))
            waiting += len(p)
            if waiting > 200_000:
                found, waiting = [pd.concat(found).drop_duplicates()], 0
        out = pd.concat(found).drop_duplicates().sort_values(["v", "a", "b"], ascending=[False, True, True])
        if near:
            out = pd.concat([out.groupby("a").head(BEST), out.groupby("b").head(BEST)]).drop_duplicates()
        out = out[["a", "b"]].copy()
        del place, found
        give_back()
        return out

    found = both.groupBy("__bin").cogroup(own.groupBy("bin")).applyInPandas(search, f"a {kind}, b {kind}")
    found = written(found.distinct(), "pairs")
    discard(rows, both)
    return found


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Link documents with 100 * intersection >= percent * union of shingle sets: (key, n_shingles, component_id).

    component_id is the smallest key that links reach.  A null or wordless text has an empty set and links with nothing; a text
    with fewer than `words` words is one shingle.  Equal sets (but empty ones) link whatever their number.
    Rows with a null key keep a null component; rows with equal keys are taken for one document, whose text is
    any of theirs, and each gets a row.  Other columns are ignored; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[key]
    known = docs.where(F.col(key).isNotNull())
    table = written(shingled(docs, key, text, words, percent), "shingled")
    rows = table.where("n > 0 and doc is not null")
    reps = rows.groupBy("fp").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    keyed = reps.select("doc", "n", F.explode("keys").alias("key"))
    w = Window.partitionBy("key")
    live = keyed.withColumn("c0", F.min("doc").over(w)).withColumn("c1", F.max("doc").over(w)).where("c0 != c1")
    # the smallest set of like size in a tile: what a group of altered copies has in common weighs most in it
    reach = f"partition by key order by ln(n) range between {-math.log(percent / 100) + 1e-9}D preceding and current row"
    lead = F.expr(f"min(struct(n, doc)) over ({reach})")["doc"]
    live = written(live.select("key", "doc", "n", lead.alias("lead")), "live")
    vecs = written(table.where("n > 0 and doc is not null").select("doc", "n", "vec").dropDuplicates(["doc"]), "vecs")

    stars = live.where("doc != lead").select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
    # each document with the best and the worst of these whose bound allows a link
    best = _bounded(stars, vecs, percent).groupBy("b").agg(F.max_by(F.struct("a"), F.struct("__bound", "a")).alias("x"), F.min_by(F.struct("a"), F.struct("__bound", "a")).alias("y"))
    tested = best.select(F.explode(F.array_distinct(F.array("x.a", "y.a"))).alias("a"), "b")
    tested = written(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tested")
    links = _verified(tested, known, key, text, words, percent)

    for near in (True, False):
        joined = components(links).select(F.col("node").alias("doc"), F.col("component").alias("comp"))
        mine = live.join(joined, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        w = Window.partitionBy("key")
        mine = mine.withColumn("c0", F.min("comp").over(w)).withColumn("c1", F.max("comp").over(w)).withColumn("size", F.count("*").over(w))
        mine = written(mine.where("c0 != c1").select("key", "doc", "n", "comp", "size"), "mixed")
        large = written(_not_subsumed(mine.where(F.col("size") > LEAF).drop("size")), "large")
        pairs = found = _searched(large, vecs, percent, kind, near)
        if not near:
            leaves = _bounded(_small_tile_pairs(mine.where(F.col("size") <= LEAF), percent), vecs, percent).select("a", "b")
            pairs = pairs.unionByName(leaves).distinct()
        fresh = written(_without(pairs, tested), "fresh")
        discard(mine, large, found)
        links = links.unionByName(_verified(fresh, known, key, text, words, percent))
        tested = tested.unionByName(fresh)

    copies = rows.join(reps.select("fp", F.col("doc").alias("rep")), "fp").where("doc != rep")
    every = written(links.unionByName(copies.select(F.col("doc").alias("a"), F.col("rep").alias("b"))), "links")
    final = components(every).select(F.col("node").alias("doc"), F.col("component").alias("comp"))
    out = table.select("doc", "n").join(final, "doc", "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("comp", "doc").alias("component_id"))


def _without(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """pairs (a < b) less those tested already."""
    t = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(t, ["a", "b"], "left_anti")
