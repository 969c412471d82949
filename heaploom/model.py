"""The property graph of a heap dump."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DumpTables:
    """Typed tables of one dump; a table that the format does not have is None.

    nodes: addr, kind ('rc' or 'gc'), rc, marked, label, ord (GC dumps: addr, color, label, ord).  edges: src, dst, label,
    ord, a row for each physical edge.
    """

    nodes: DataFrame
    edges: DataFrame
    weak_maps: DataFrame | None = None
    incr_roots: DataFrame | None = None
    results: DataFrame | None = None
    roots: DataFrame | None = None
    corrupt: DataFrame | None = None

    def multigraph(self) -> DataFrame:
        """(src, dst, n): parallel edges counted."""
        return self.edges.groupBy("src", "dst").agg(F.count("*").alias("n"))

    def single(self) -> DataFrame:
        """(src, dst): parallel edges once."""
        return self.edges.select("src", "dst").distinct()

    def reversed(self) -> DumpTables:
        """Every edge turned round, counts and labels kept; nodes without edges stay nodes."""
        e = self.edges
        rest = [c for c in e.columns if c not in ("src", "dst")]
        return replace(self, edges=e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))

    def edge_labels(self) -> DataFrame:
        """(src, dst, labels): labels of parallel edges in file order, empty ones left out."""
        some = F.when(F.col("label") != "", F.struct("ord", "label"))
        lists = F.array_sort(F.collect_list(some))
        return self.edges.groupBy("src", "dst").agg(F.transform(lists, lambda x: x["label"]).alias("labels"))

    def without(self, gone: DataFrame) -> DumpTables:
        """The graph without the nodes in gone(addr) and all edges that touch them."""
        g = gone.select("addr").distinct()
        return replace(
            self,
            nodes=self.nodes.join(g, "addr", "left_anti"),
            edges=self.edges.join(g.withColumnRenamed("addr", "src"), "src", "left_anti").join(
                g.withColumnRenamed("addr", "dst"), "dst", "left_anti"
            ).select(self.edges.columns),
        )

    def first_nodes(self, n: int) -> DataFrame:
        """The first n nodes in file order (positional roots)."""
        return self.nodes.orderBy("ord").limit(n)
