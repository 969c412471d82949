"""The search for what keeps objects alive, as one call: roots, targets, paths, weak maps on the way, and what has no path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DumpTables
from ..plans.cut import written
from . import predicates, traverse


@dataclass(frozen=True)
class RootSearch:
    """paths: (target, hop, addr, via_map), hop 0 being the root; of weak maps on the paths too, each a target of its own.
    unreached: (target, addr, edge_label), targets without a path and what points at them (null: nothing does).
    roots: (addr, root) or whatever columns the given roots had.
    """

    paths: DataFrame
    unreached: DataFrame
    roots: DataFrame


def find_roots(
    g: DumpTables, target: str, roots: DataFrame | None = None, every_root: bool = False, weak_map_paths: bool = True,
    maps_live: bool = False, ignore_rc: bool = False, ignore_js: bool = False, extra_class: str | None = None,
) -> RootSearch:
    """What keeps the target (an address, or all nodes whose label starts with it) alive.

    A shortest path from any root to each target; weak maps that a path crosses keep it alive as well, so each gets its path,
    once, unless weak_map_paths is off.  every_root: a shortest way from each root that reaches a target to the nearest one
    (target names the root's own way then); ways end at roots, and weak maps count as edges (weak_maps_as_edges).
    roots(addr) replaces the roots that the dump itself tells.
    """
    if roots is None:
        roots = predicates.select_roots(g, ignore_rc, ignore_js, extra_class)
    roots = written(roots, "roots")
    targets = written(predicates.select_targets(g, target), "targets")
    if every_root:
        edges = g.edges.select("src", "dst")
        if g.weak_maps is not None:
            edges = edges.unionByName(traverse.weak_maps_as_edges(g.weak_maps, maps_live))
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        own = roots.select("addr").join(targets, "addr", "left_anti")
        dist = written(traverse.distances(back, targets, targets=own), "dist")
        ways = traverse.root_paths(dist, roots.select("addr"))  # from the target to the root
        last = ways.groupBy("target").agg(F.max("hop").alias("last"))
        paths = ways.join(last, "target").select("target", (F.col("last") - F.col("hop")).alias("hop"), "addr", "via_map")
        reached = dist.join(roots.select("addr"), "addr", "left_semi").limit(1)
        unreached = targets.join(reached.select(F.lit(1).alias("any")), F.lit(True), "left_anti")
    else:
        dist = written(traverse.distances(g.edges, roots, g.weak_maps), "dist")
        paths = written(traverse.root_paths(dist, targets), "paths")
        told, new = targets, paths
        while weak_map_paths and g.weak_maps is not None:
            maps = traverse.path_weak_maps(new).select(F.col("map").alias("addr")).distinct()
            maps = written(maps.join(told, "addr", "left_anti"), "maps")
            if maps.isEmpty():
                break
            new = written(traverse.root_paths(dist, maps), "paths")
            told, paths = told.unionByName(maps), paths.unionByName(new)
        unreached = targets.join(dist.select("addr"), "addr", "left_anti")
    into = g.edges.select(F.col("dst").alias("target"), F.col("src").alias("addr"), F.col("label").alias("edge_label"))
    unreached = unreached.select(F.col("addr").alias("target")).join(into, "target", "left")
    return RootSearch(paths, unreached, roots)


def first_paths(paths: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The paths of the `most` smallest targets, and how many there are in all."""
    targets = paths.select("target").distinct()
    return paths.join(F.broadcast(targets.orderBy("target").limit(most)), "target", "left_semi"), targets.count()
