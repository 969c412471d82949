"""Text sinks: logs, merge files, path explanations, trees and Graphviz drawings, as DataFrames of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import display_label, edge_line, gc_display_label, gc_shape, masked, node_line, style, without_private
from ..model import DumpTables
from ..plans.cut import written

SEPARATOR = "=========="


def log_lines(g: DumpTables) -> DataFrame:
    """(ord, value): a cycle-collector log of the graph: each node with its edges, weak maps, incremental roots, the
    separator, results.  Lines sort by ord, a struct."""
    key = lambda a, b, c, d: F.struct(F.lit(a).alias("part"), b.cast("string").alias("owner"), F.lit(c).alias("kind"), d.cast("string").alias("at"))
    none = F.lit("")
    at = F.format_string("%020d", F.col("ord")) if "ord" in g.edges.columns else F.concat_ws(" ", "dst", "label")
    parts = [
        g.nodes.select(key(0, F.col("addr"), 0, none).alias("ord"), node_line().alias("value")),
        g.edges.select(key(0, F.col("src"), 1, at).alias("ord"), edge_line().alias("value")),
    ]
    nil = lambda c: F.coalesce(c, F.lit("(nil)"))
    if g.weak_maps is not None:
        line = F.concat(*[x for n, c in (("WeakMapEntry map=", "map"), (" key=", "key"), (" keyDelegate=", "key_delegate"), (" value=", "value")) for x in (F.lit(n), nil(F.col(c)))])
        parts.append(g.weak_maps.select(key(1, line, 0, none).alias("ord"), line.alias("value")))
    if g.incr_roots is not None:
        parts.append(g.incr_roots.select(key(2, F.col("addr"), 0, none).alias("ord"), F.concat(F.lit("IncrementalRoot "), "addr").alias("value")))
    parts.append(g.nodes.sparkSession.range(1).select(key(3, none, 0, none).alias("ord"), F.lit(SEPARATOR).alias("value")))
    if g.results is not None:
        tag = F.when(F.col("tag") == "garbage", "garbage").otherwise(F.concat(F.lit("known="), F.col("known").cast("string")))
        parts.append(g.results.select(key(4, F.col("addr"), 0, F.col("tag")).alias("ord"), F.concat(F.col("addr"), F.lit(" ["), tag, F.lit("]")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_lines(lines: DataFrame, path: str, single_file: bool = False) -> None:
    """Write lines(ord, value) in order.  Range partitions keep the order over part files; one file only if asked for."""
    ordered = lines.repartitionByRange(1 if single_file else int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ord").sortWithinPartitions("ord")
    ordered.select("value").write.text(path)


def reversed_log(g: DumpTables) -> DataFrame:
    return log_lines(g.reversed())


def log_without_marked(g: DumpTables) -> DataFrame:
    """The log without marked nodes, edges into them, and results."""
    gone = g.without(g.nodes.where("marked"))
    return log_lines(DumpTables(gone.nodes, gone.edges))


def merge_lines(components: DataFrame) -> DataFrame:
    """(value): `rep m1 m2 ...` of components with more than one member."""
    m = components.where("addr != rep").groupBy("rep").agg(F.array_sort(F.collect_list("addr")).alias("m"))
    return m.select(F.concat_ws(" ", "rep", F.array_join("m", " ")).alias("value"))


def path_table(paths: DataFrame, g: DumpTables) -> DataFrame:
    """(target, hop, addr, label, in_labels): paths(target, hop, addr) with labels of nodes and of the edges that lead to them."""
    w = Window.partitionBy("target").orderBy("hop")
    step = paths.withColumn("src", F.lag("addr").over(w)).join(g.nodes.select("addr", "label"), "addr", "left")
    order = "ord" if "ord" in g.edges.columns else "label"
    e = g.edges.groupBy("src", F.col("dst").alias("addr")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("label").alias("l")))), lambda x: x["l"]).alias("in_labels"))
    return step.join(e, ["src", "addr"], "left").select("target", "hop", "addr", "label", F.filter("in_labels", lambda x: x != "").alias("in_labels"))


def path_lines(table: DataFrame, reverse: bool = False) -> DataFrame:
    """(target, hop, value): one line per node, `    --[labels]--> addr [label]` below the root; reversed, from the target back to
    the root, with arrows that point back."""
    node = F.concat(F.col("addr"), F.lit(" ["), F.coalesce("label", F.lit("")), F.lit("]"))
    w = Window.partitionBy("target")
    if reverse:
        # the edge between a node and the one that follows it on the path
        table = table.withColumn("in_labels", F.lead("in_labels").over(w.orderBy("hop"))).withColumn("hop", F.max("hop").over(w) - F.col("hop"))
    labels = F.array_join(F.coalesce("in_labels", F.array().cast("array<string>")), ", ")
    arrow = F.concat(F.lit("<--["), labels, F.lit("]--")) if reverse else F.concat(F.lit("--["), labels, F.lit("]-->"))
    return table.select("target", "hop", F.when(F.col("hop") == 0, node).otherwise(F.concat(F.lit("    "), arrow, F.lit(" "), node)).alias("value"))


def simple_paths(table: DataFrame, gc: bool = False) -> DataFrame:
    """(target, value): a path as one line of labels, fit to be grouped; GC labels lose ` <no private>`, root labels their addresses."""
    label = F.coalesce("label", F.lit(""))
    if gc:
        label = without_private(masked(label))
    labels = F.array_join(F.coalesce("in_labels", F.array().cast("array<string>")), ", ")
    piece = F.when(F.col("hop") == 0, F.concat(F.lit("["), label, F.lit("]"))).otherwise(F.concat(F.lit(" --["), labels, F.lit("]--> ["), label, F.lit("]")))
    each = table.select("target", F.struct("hop", piece.alias("p")).alias("x"))
    return each.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "").alias("value"))


def roots_only(paths: DataFrame) -> DataFrame:
    return paths.where("hop = 0").select(F.col("addr").alias("value")).distinct()


def root_lines(explained: DataFrame) -> DataFrame:
    """(addr, value): why a root is a root."""
    kind = (
        F.when(F.col("root") == "gcRoot", F.lit("is a marked GC object."))
        .when(F.col("root") == "stopNodeLabel", F.lit("is an extra root class."))
        .otherwise(F.concat(F.lit("is a ref counted object with "), F.col("unknown_edges").cast("string"), F.lit(" unknown edge(s).")))
    )
    note = F.when(F.col("is_incremental"), F.lit(" It is an incremental root, which means it was touched during an incremental CC.")).otherwise(F.lit(""))
    return explained.select("addr", F.concat(F.lit("    Root "), F.col("addr"), F.lit(" "), kind, note).alias("value"))


def dot_lines(g: DumpTables, roots: DataFrame | None = None, garbage: DataFrame | None = None, gc: bool = False, name: str = "heap") -> DataFrame:
    """(ord, value): a Graphviz drawing: nodes styled by kind, fate and class, dashed edges between counted and GC nodes."""
    n = g.nodes
    flag = lambda t, c: n.select("addr").join(t.select("addr").distinct().withColumn(c, F.lit(True)), "addr", "left") if t is not None else n.select("addr", F.lit(False).alias(c))
    n = n.join(flag(roots, "is_root"), "addr").join(flag(garbage, "is_garbage"), "addr")
    root, dead = F.coalesce("is_root", F.lit(False)), F.coalesce("is_garbage", F.lit(False))
    if gc:
        attributes, text = F.concat(F.lit('shape="'), gc_shape("label"), F.lit('"')), gc_display_label("label")
        kinds = None
    else:
        attributes, text = style(F.col("kind"), F.col("label"), root, dead), display_label("label")
        kinds = g.nodes.select("addr", "kind")
    escaped = F.regexp_replace(text, r'(["\\])', r"\\$1")
    q = F.lit('"')
    node = n.select(F.struct(F.lit(1).alias("p"), F.col("addr").alias("a"), F.lit("").alias("b")).alias("ord"), F.concat(F.lit("  "), q, "addr", q, F.lit(" ["), attributes, F.lit(', label="'), escaped, F.lit('"];')).alias("value"))
    e = g.single()
    dashed = F.lit("")
    if kinds is not None:
        e = e.join(kinds.select(F.col("addr").alias("src"), F.col("kind").alias("ks")), "src", "left").join(kinds.select(F.col("addr").alias("dst"), F.col("kind").alias("kd")), "dst", "left")
        dashed = F.when(F.col("ks") != F.col("kd"), F.lit(' [style="dashed"]')).otherwise(F.lit(""))
    edge = e.select(F.struct(F.lit(2).alias("p"), F.col("src").alias("a"), F.col("dst").alias("b")).alias("ord"), F.concat(F.lit("  "), q, "src", q, F.lit(" -> "), q, "dst", q, dashed, F.lit(";")).alias("value"))
    spark = g.nodes.sparkSession
    frame = spark.createDataFrame([(0, f"digraph {name} {{"), (3, "}")], "p int, value string").select(F.struct(F.col("p"), F.lit("").alias("a"), F.lit("").alias("b")).alias("ord"), "value")
    return frame.unionByName(node).unionByName(edge)


def path_set_dot(paths: DataFrame, g: DumpTables) -> DataFrame:
    """A drawing of a set of paths, runs of shapes drawn as one."""
    from ..operators.components import contract, topmost_parent

    w = Window.partitionBy("target").orderBy("hop")
    on = paths.select("addr").distinct()
    nodes = g.nodes.join(on, "addr", "left_semi")
    steps = paths.withColumn("dst", F.lead("addr").over(w)).where("dst is not null").select(F.col("addr").alias("src"), "dst").distinct()
    shapes = nodes.where(F.col("label").startswith("shape")).select("addr")
    chain = steps.join(shapes.withColumnRenamed("addr", "src"), "src", "left_semi").join(shapes.withColumnRenamed("addr", "dst"), "dst", "left_semi")
    merged = topmost_parent(shapes, chain.select(F.col("src").alias("addr"), F.col("dst").alias("parent"))).select("addr", F.col("top").alias("rep"))
    edges = contract(steps, merged)
    gone = merged.where("addr != rep").select("addr")
    return dot_lines(DumpTables(nodes.join(gone, "addr", "left_anti"), edges.withColumn("label", F.lit(""))), gc=True, name="paths")


def tree_lines(tree: DataFrame, retained: DataFrame, labels: DataFrame, at_least: int = 1000, root: str = "root") -> DataFrame:
    """(ord, value): the dominator tree as indented text, children by retained bytes, subtrees below at_least left out."""
    n = tree.join(retained, "addr").join(labels.select("addr", "label"), "addr", "left").where(F.col("retained") >= at_least)
    n = written(n.select("addr", "idom", "retained", "label"), "tree")
    key = F.struct((-F.col("retained")).alias("r"), F.col("addr").alias("a"))
    level = written(n.where(F.col("idom") == root).select("addr", "retained", "label", F.array(key).alias("ord")), "tree")
    parts = [level]
    while True:
        level = n.join(level.select(F.col("addr").alias("idom"), F.col("ord").alias("up")), "idom").select("addr", "retained", "label", F.concat("up", F.array(key)).alias("ord"))
        level = written(level, "tree")
        if level.isEmpty():
            break
        parts.append(level)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    indent = F.expr("repeat('  ', size(ord) - 1)")
    return out.select("ord", F.concat(indent, F.col("retained").cast("string"), F.lit(" "), F.col("addr"), F.lit(" "), F.coalesce("label", F.lit(""))).alias("value"))


def tree_dot(tree: DataFrame, retained: DataFrame, nodes: DataFrame, at_least: int = 20, name: str = "dominators") -> DataFrame:
    """The dominator tree of nodes that dominate at least so many others, without shapes."""
    big = retained.where(F.col("dominated") >= at_least).select("addr")
    keep = nodes.where(~F.coalesce(F.col("label").startswith("shape"), F.lit(False))).join(big, "addr", "left_semi")
    e = tree.select(F.col("idom").alias("src"), F.col("addr").alias("dst"), F.lit("").alias("label"))
    e = e.join(keep.select(F.col("addr").alias("src")), "src", "left_semi").join(keep.select(F.col("addr").alias("dst")), "dst", "left_semi")
    return dot_lines(DumpTables(keep, e), gc=True, name=name)


def group_report(groups: DataFrame, totals: DataFrame) -> DataFrame:
    """(value): groups by size, then the three totals."""
    where = F.when(F.col("is_garbage"), "garbage").when(F.col("doc").isNull(), "orphan").otherwise(F.concat(F.lit("in "), "doc"))
    rows = groups.select(F.struct(F.lit(0).alias("p"), (-F.col("n")).alias("n"), "top").alias("ord"), F.concat_ws(" ", F.col("n").cast("string"), "top", where).alias("value"))
    t = totals.select(F.struct(F.lit(1).alias("p"), F.lit(0).cast("long").alias("n"), F.lit("").alias("top")).alias("ord"), F.format_string("orphan %d, in documents %d, garbage %d", "orphan", "in_doc", "garbage").alias("value"))
    return rows.unionByName(t)
