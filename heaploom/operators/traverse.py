"""Level-synchronous traversals: reachability, shortest root paths with weak maps, path extraction, cycle collection.

A driver loop runs one small plan per level and counts the new rows; every level is written to the shared folder.  Spark
chooses a broadcast or a shuffle of the frontier by its size; edges are written once, deduplicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DumpTables
from ..plans.cut import written
from .census import internal_counts


def reach(edges: DataFrame, start: DataFrame, within: DataFrame | None = None, ignored: list[str] | None = None) -> DataFrame:
    """(addr): nodes that can be reached from start(addr) along edges(src, dst), start included.

    within(addr) limits the flood to a set of nodes; ignored addresses are never entered.
    """
    e = edges.select("src", "dst").distinct()
    if within is not None:
        e = e.join(within.select(F.col("addr").alias("dst")).distinct(), "dst", "left_semi")
        start = start.join(within.select("addr").distinct(), "addr", "left_semi")
    if ignored:
        e, start = e.where(~F.col("dst").isin(ignored)), start.where(~F.col("addr").isin(ignored))
    e = written(e.select("src", "dst"), "edges")
    front = written(start.select("addr").distinct(), "reach")
    levels = [front]
    seen = front
    while True:
        new = e.join(front.withColumnRenamed("addr", "src"), "src", "left_semi").select(F.col("dst").alias("addr")).distinct()
        front = written(new.join(seen, "addr", "left_anti"), "reach")
        if front.isEmpty():
            return seen
        levels.append(front)
        seen = _union(levels)
        if len(levels) > 20:
            seen = written(seen, "reach")
            levels = [seen]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reverse_reach(edges: DataFrame, start: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(addr): nodes that reach start, start included (ancestors)."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, within)


def distances(
    edges: DataFrame, roots: DataFrame, weak_maps: DataFrame | None = None, targets: DataFrame | None = None,
    expandable: DataFrame | None = None, max_depth: int | None = None, stop_early: bool = False,
) -> DataFrame:
    """(addr, d, parent, via_map): multi-source shortest paths.

    A weak map's value gets max(d(map), d(key)) + 1 with the key as parent, its key max(d(map), d(delegate)) + 1 with
    the delegate; null parts are never reached.  Of several parents at the same distance a plain edge goes before a weak one, then the
    smallest address.  targets(addr) are not expanded, nor are nodes outside expandable(addr), which still get a distance.  stop_early
    ends when all targets are reached.
    """
    e = written(edges.select("src", "dst").distinct(), "edges")
    dist = roots.select("addr").distinct().select(
        "addr", F.lit(0).alias("d"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("via_map")
    )
    levels = [written(dist, "dist")]
    level = 0
    wanted = targets.select("addr").distinct() if targets is not None else None
    while max_depth is None or level < max_depth:
        seen = _union(levels)
        front = levels[-1] if level else levels[0]
        front = front.where(F.col("d") == level).select(F.col("addr").alias("src"))
        if wanted is not None:
            front = front.join(wanted.withColumnRenamed("addr", "src"), "src", "left_anti")
        if expandable is not None:
            front = front.join(expandable.select(F.col("addr").alias("src")), "src", "left_semi")
        steps = e.join(front, "src").select(
            F.col("dst").alias("addr"), F.struct(F.lit(0).alias("rank"), F.col("src").alias("parent"), F.lit(None).cast("string").alias("via_map")).alias("p")
        )
        if weak_maps is not None:
            for rank, (by, to) in enumerate((("key", "value"), ("key_delegate", "key")), 1):
                m = seen.select(F.col("addr").alias("map"), F.col("d").alias("dm"))
                k = seen.select(F.col("addr").alias(by), F.col("d").alias("dk"))
                met = weak_maps.where(F.col(to).isNotNull()).join(m, "map").join(k, by).where(F.greatest("dm", "dk") == level)
                steps = steps.unionByName(
                    met.select(F.col(to).alias("addr"), F.struct(F.lit(rank).alias("rank"), F.col(by).alias("parent"), F.col("map").alias("via_map")).alias("p"))
                )
        new = steps.join(seen.select("addr"), "addr", "left_anti").groupBy("addr").agg(F.min("p").alias("p"))
        new = written(new.select("addr", F.lit(level + 1).alias("d"), "p.parent", "p.via_map"), "dist")
        if new.isEmpty():
            break
        level += 1
        levels.append(new)
        if len(levels) > 20:
            merged = written(_union(levels[:-1]), "dist")
            levels = [merged, new]
        if stop_early and wanted is not None and wanted.join(_union(levels).select("addr"), "addr", "left_anti").isEmpty():
            break
    return _union(levels)


def root_paths(dist: DataFrame, targets: DataFrame, max_hops: int = 10_000) -> DataFrame:
    """(target, hop, addr, via_map): the path to each reached target, hop 0 being the root.  Parents form a forest, so the climb ends."""
    climb = targets.select("addr").distinct().join(dist, "addr").select(F.col("addr").alias("target"), "addr", "d", "parent", "via_map")
    front = written(climb, "path")
    parts = [front]
    up = dist.select(F.col("addr").alias("parent"), F.col("d").alias("d2"), F.col("parent").alias("p2"), F.col("via_map").alias("v2"))
    for _ in range(max_hops):
        nxt = front.where("parent is not null").join(up, "parent")
        front = written(nxt.select("target", F.col("parent").alias("addr"), F.col("d2").alias("d"), F.col("p2").alias("parent"), F.col("v2").alias("via_map")), "path")
        if front.isEmpty():
            break
        parts.append(front)
    every = _union(parts)
    # a weak parent may be more than one level up: hops count the nodes of the path, not distances
    order = F.row_number().over(_by_target()) - 1
    return every.withColumn("hop", order.cast("int")).select("target", "hop", "addr", "via_map")


def _by_target():
    from pyspark.sql.window import Window

    return Window.partitionBy("target").orderBy("d")


def path_weak_maps(paths: DataFrame) -> DataFrame:
    """(target, map): the weak maps that a path crosses, each of which needs a path of its own."""
    return paths.where("via_map is not null").select("target", F.col("via_map").alias("map")).distinct()


def roots_reaching(edges: DataFrame, roots: DataFrame, target: DataFrame, stop_at_roots: bool = True) -> DataFrame:
    """(addr, d, parent): every root that reaches the target, its distance, and the next node on a shortest way.

    With stop_at_roots a way does not lead on beyond a root (cycle-collector logs); without, it does (GC logs).
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if stop_at_roots:
        own = roots.select("addr").join(target.select("addr"), "addr", "left_anti")
        dist = distances(back, target, targets=own)
    else:
        dist = distances(back, target)
    return dist.join(roots.select("addr").distinct(), "addr", "left_semi").select("addr", "d", "parent")


def weak_maps_as_edges(weak_maps: DataFrame, maps_live: bool = False) -> DataFrame:
    """(src, dst): key to value where there is no delegate; of black maps only, or of all if maps count as live."""
    ok = F.col("key_delegate").isNull() & F.col("key").isNotNull() & F.col("value").isNotNull()
    if not maps_live:
        ok = ok & F.col("map").isNull()
    return weak_maps.where(ok).select(F.col("key").alias("src"), F.col("value").alias("dst"))


def known_edges(g: DumpTables, addr: str) -> DataFrame:
    """(addr, label, edge_label): what points at a node."""
    e = g.edges.where(F.col("dst") == addr).select(F.col("src").alias("addr"), F.col("label").alias("edge_label"))
    return e.join(g.nodes.select("addr", "label"), "addr", "left")


def explain_roots(g: DumpTables, roots: DataFrame) -> DataFrame:
    """(addr, root, unknown_edges, is_incremental): unknown edges are rc less the known count; 0 for an incremental
    root without one; null for roots that are not counted."""
    known = g.results.where("tag = 'known'").groupBy("addr").agg(F.max("known").alias("known"))
    incr = g.incr_roots.select("addr").distinct().withColumn("i", F.lit(True))
    r = roots.join(g.nodes.select("addr", "rc"), "addr").join(known, "addr", "left").join(incr, "addr", "left")
    unknown = F.when(F.col("root") == "rcRoot", F.coalesce(F.col("rc") - F.col("known"), F.lit(0)))
    return r.select("addr", "root", unknown.alias("unknown_edges"), F.coalesce("i", F.lit(False)).alias("is_incremental"))


def collect_cycles(g: DumpTables) -> tuple[DataFrame, DataFrame]:
    """(garbage(addr), known(addr, known)): what a collector finds from reference counts and marks alone."""
    counts = written(internal_counts(g), "counts")
    roots = counts.where("rc > ic").select("addr", F.col("ic").alias("known"))
    start = roots.select("addr").unionByName(g.nodes.where("kind = 'gc' and marked").select("addr"))
    live = reach(g.edges, start)
    return g.nodes.select("addr").join(live, "addr", "left_anti"), roots


def check_results(garbage: DataFrame, known: DataFrame, results: DataFrame) -> DataFrame:
    """(addr, problem): where a log's results and ours differ."""
    theirs = results.groupBy("addr").agg(F.max(F.col("tag") == "garbage").alias("their_garbage"), F.max("known").alias("their_known"))
    ours = garbage.select("addr", F.lit(True).alias("our_garbage")).join(known.select("addr", F.col("known").alias("our_known")), "addr", "full_outer")
    both = ours.join(theirs, "addr", "full_outer")
    og, tg = F.coalesce("our_garbage", F.lit(False)), F.coalesce("their_garbage", F.lit(False))
    ok_, tk = F.col("our_known"), F.col("their_known")
    problem = (
        F.when(og & ~tg, "garbage_only_ours").when(~og & tg, "garbage_only_logged").when(ok_.isNotNull() & tk.isNull(), "root_only_ours")
        .when(ok_.isNull() & tk.isNotNull(), "root_only_logged").when(ok_ != tk, "counts_differ")
    )
    return both.select("addr", problem.alias("problem")).where("problem is not null")


def cycle_friends(edges: DataFrame, addr: str, within: DataFrame | None = None) -> DataFrame:
    """(addr): the strongly connected component of one node."""
    start = edges.sparkSession.createDataFrame([(addr,)], "addr string")
    return reach(edges, start, within).intersect(reverse_reach(edges, start, within))


def js_flood(g: DumpTables, holders: DataFrame) -> DataFrame:
    """(addr): reference-counted nodes that a flood from the holders' wrappers over unmarked GC nodes meets and that are no holders."""
    gc = g.nodes.where("kind = 'gc' and not marked").select("addr")
    js = reach(g.edges, holders.select(F.col("dst").alias("addr")), within=gc)
    met = g.edges.join(js.withColumnRenamed("addr", "src"), "src", "left_semi").select(F.col("dst").alias("addr")).distinct()
    return met.join(g.nodes.where("kind = 'rc'").select("addr"), "addr", "left_semi").join(holders.select("addr"), "addr", "left_anti")


def unreached_js(g: DumpTables, reached: DataFrame) -> DataFrame:
    return g.nodes.where("kind = 'gc' and not marked").join(reached.select("addr"), "addr", "left_anti").agg(F.count("*").alias("n"))


def green_nodes(g: DumpTables) -> DataFrame:
    """(addr): GC nodes that reach no reference-counted node."""
    rc = g.nodes.where("kind = 'rc'").select("addr")
    return g.nodes.where("kind = 'gc'").select("addr").join(reverse_reach(g.edges, rc), "addr", "left_anti")


def neighbourhood(g: DumpTables, prefix: str, k: int, most_edges: int = 10) -> DataFrame:
    """(addr, d): nodes at most k steps from a class; nodes with more than most_edges out-edges are not expanded."""
    degree = g.single().groupBy("src").agg(F.count("*").alias("n"))
    small = g.nodes.select("addr").join(degree.where(F.col("n") > most_edges).select(F.col("src").alias("addr")), "addr", "left_anti")
    start = g.nodes.where(F.col("label").startswith(prefix)).select("addr")
    return distances(g.edges, start, expandable=small, max_depth=k).select("addr", "d")
