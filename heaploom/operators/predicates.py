"""Selection of roots, targets and live or dead nodes; well-formedness; pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import PRESERVED_WRAPPER_CLASSES, is_address
from ..model import DumpTables


def select_roots(g: DumpTables, ignore_rc: bool = False, ignore_js: bool = False, extra_class: str | None = None) -> DataFrame:
    """(addr, root): rcRoot (a known count or an incremental root), before gcRoot (marked or incremental), before
    stopNodeLabel (the label is extra_class, exactly)."""
    none = g.nodes.select("addr").limit(0)  # a dump without results or incremental roots
    known = g.results.where("tag = 'known'").select("addr") if g.results is not None else none
    incr = g.incr_roots.select("addr") if g.incr_roots is not None else none
    known = known.distinct().withColumn("is_known", F.lit(True))
    incr = incr.distinct().withColumn("is_incr", F.lit(True))
    n = g.nodes.join(known, "addr", "left").join(incr, "addr", "left")
    touched = F.coalesce("is_incr", F.lit(False))
    rc = (F.col("kind") == "rc") & (F.coalesce("is_known", F.lit(False)) | touched) & F.lit(not ignore_rc)
    gc = (F.col("kind") == "gc") & (F.coalesce("marked", F.lit(False)) | touched) & F.lit(not ignore_js)
    extra = F.coalesce(F.col("label") == extra_class, F.lit(False)) if extra_class is not None else F.lit(False)
    kind = F.when(rc, "rcRoot").when(gc, "gcRoot").when(extra, "stopNodeLabel")
    return n.select("addr", kind.alias("root")).where("root is not null")


def gc_roots(g: DumpTables, only_black: bool = False) -> DataFrame:
    return g.roots.where("is_black") if only_black else g.roots


def select_targets(g: DumpTables, target: str) -> DataFrame:
    """(addr): the object of an address, or all whose label starts with a class name.

    nsFrameLoader1 stands for frame loaders with a reference count of one.  An upper-case hexadecimal class name counts as an address.
    """
    if is_address(target):
        return g.nodes.where(F.col("addr") == target).select("addr")
    if target == "nsFrameLoader1":
        return g.nodes.where(F.col("label").startswith("nsFrameLoader") & (F.col("rc") == 1)).select("addr")
    return g.nodes.where(F.col("label").startswith(target)).select("addr")


def select_strings(g: DumpTables, prefix: str) -> DataFrame:
    """(addr) of strings whose label, after `string `, starts with prefix."""
    return g.nodes.where(F.col("label").startswith("string ") & F.col("label").substr(F.lit(8), F.length("label")).startswith(prefix)).select("addr")


def live_or_dead(nodes: DataFrame, garbage: DataFrame, which: str = "both") -> DataFrame:
    """Nodes that are live, dead, or both, by a garbage(addr) table."""
    if which == "both":
        return nodes
    return nodes.join(garbage.select("addr").distinct(), "addr", "left_anti" if which == "live" else "left_semi")


def wellformed(g: DumpTables) -> DataFrame:
    """(violation, addr): nodes of both kinds, counts that are not positive, edge targets and weak map parts
    that are no nodes, nodes of neither kind, nodes logged more than once."""
    rc, gc = g.nodes.where("kind = 'rc'"), g.nodes.where("kind = 'gc'")
    parts = [
        rc.select("addr").intersect(gc.select("addr")).select(F.lit("rc_and_gc").alias("violation"), "addr"),
        rc.where("rc is null or rc <= 0").select(F.lit("rc_not_positive").alias("violation"), "addr"),
        g.edges.select(F.col("dst").alias("addr")).distinct().join(g.nodes.select("addr"), "addr", "left_anti").select(F.lit("range_outside_domain").alias("violation"), "addr"),
        g.nodes.where("kind is null or kind not in ('rc', 'gc')").select(F.lit("neither_kind").alias("violation"), "addr"),
    ]
    parts.append(g.nodes.groupBy("addr").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("logged_twice").alias("violation"), "addr"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prune(g: DumpTables, gone: Column) -> DumpTables:
    """Without the nodes for which a condition over node columns holds, and their edges."""
    return g.without(g.nodes.where(F.coalesce(gone, F.lit(False))))


def prune_js(g: DumpTables) -> DumpTables:
    return prune(g, F.col("kind") == "gc")


def prune_non_js(g: DumpTables) -> DumpTables:
    return prune(g, F.col("kind") == "rc")


def prune_marked(g: DumpTables) -> DumpTables:
    return prune(g, F.col("marked"))


def prune_listeners(g: DumpTables) -> DumpTables:
    return prune(g, F.col("label").startswith("nsXPCWrappedJS[nsIDOMEventListener"))


def prune_garbage(g: DumpTables, garbage: DataFrame) -> DumpTables:
    return g.without(garbage)


def prune_non_js_border(g: DumpTables) -> DumpTables:
    """Without reference-counted nodes that no edge joins to a GC node."""
    gc = g.nodes.where("kind = 'gc'").select("addr")
    near = g.edges.join(gc.withColumnRenamed("addr", "dst"), "dst", "left_semi").select(F.col("src").alias("addr"))
    near = near.union(g.edges.join(gc.withColumnRenamed("addr", "src"), "src", "left_semi").select(F.col("dst").alias("addr"))).distinct()
    return g.without(g.nodes.where("kind = 'rc'").join(near, "addr", "left_anti"))


def prune_childless(g: DumpTables) -> DumpTables:
    """Without nodes that have no out-edges."""
    return g.without(g.nodes.join(g.edges.select(F.col("src").alias("addr")).distinct(), "addr", "left_anti"))


#: Edge labels of no interest in drawings.
PRUNED_LABELS = ["mNodeInfo", "GetParent()", "mOwnerManager"]


def prune_edge_labels(g: DumpTables, labels: list[str] = PRUNED_LABELS) -> DataFrame:
    """(src, dst) pairs whose first label is none of labels."""
    order = "ord" if "ord" in g.edges.columns else "label"
    first = g.edges.groupBy("src", "dst").agg(F.min_by("label", order).alias("first_label"))
    return first.where(~F.coalesce(F.col("first_label").isin(labels), F.lit(False)))


def pruned_label_counts(g: DumpTables, labels: list[str] = PRUNED_LABELS) -> DataFrame:
    """(label, n): how many pairs of nodes prune_edge_labels() takes out, by their first label."""
    order = "ord" if "ord" in g.edges.columns else "label"
    first = g.edges.groupBy("src", "dst").agg(F.min_by("label", order).alias("label"))
    return first.where(F.col("label").isin(labels)).groupBy("label").agg(F.count("*").alias("n"))


def components_with_garbage(components: DataFrame, garbage: DataFrame) -> DataFrame:
    """(addr, rep) of the components that hold at least one garbage(addr) node."""
    return components.join(components.join(garbage.select("addr"), "addr", "left_semi").select("rep").distinct(), "rep", "left_semi").select("addr", "rep")


def wrapper_holders(g: DumpTables, classes: list[str] = PRESERVED_WRAPPER_CLASSES) -> DataFrame:
    """(addr, dst): nodes of the classes whose only edge is one preserved wrapper."""
    order = "ord" if "ord" in g.edges.columns else "label"
    one = g.edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst"), F.min_by("label", order).alias("label"))
    one = one.where("n = 1 and label = 'Preserved wrapper'").select(F.col("src").alias("addr"), "dst")
    fits = F.lit(False)
    for c in classes:
        fits = fits | F.col("label").startswith(c)
    return g.nodes.where((F.col("kind") == "rc") & fits).select("addr").join(one, "addr")


def class_holders(g: DumpTables, held: str) -> DataFrame:
    """(addr): nodes with an edge to a node whose label starts with held."""
    to = g.nodes.where(F.col("label").startswith(held)).select(F.col("addr").alias("dst"))
    return g.edges.join(to, "dst", "left_semi").select(F.col("src").alias("addr")).distinct()
