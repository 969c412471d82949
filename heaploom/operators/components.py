"""Components, strongly connected components, contraction, parents, ranks, duplicates, motifs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DumpTables
from ..plans.cut import written


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(addr, rep): weakly connected components, rep the smallest address; isolated nodes stand alone.

    Large-star and small-star steps until nothing changes: logarithmically many rounds, no node's edges in one row.
    """
    x = edges.select("src", "dst").where("src != dst")
    e = written(x.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.select("addr").join(e.select(F.col("u").alias("addr"), "v"), "addr", "left").select("addr", F.coalesce("v", "addr").alias("rep"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(addr, rep): strongly connected components, rep the smallest address.

    Nodes without in- or out-edges among the open ones are components of their own and are trimmed.  Then the
    smallest address that reaches a node is its colour (pointers jump along to halve the rounds); what reaches the colour's
    own node within the colour is that node's component.  Repeat on the rest.
    """
    open_ = written(nodes.select("addr").distinct(), "scc")
    e = edges.select("src", "dst").where("src != dst").distinct()
    e = e.join(open_.withColumnRenamed("addr", "src"), "src", "left_semi").join(open_.withColumnRenamed("addr", "dst"), "dst", "left_semi").select("src", "dst")
    e = written(e, "scc")
    done: list[DataFrame] = []
    while True:
        # trim
        while True:
            ends = e.select(F.col("src").alias("addr")).distinct().intersect(e.select(F.col("dst").alias("addr")).distinct())
            ends = written(ends, "scc")
            alone = written(open_.join(ends, "addr", "left_anti"), "scc")
            if alone.isEmpty():
                break
            done.append(alone.select("addr", F.col("addr").alias("rep")))
            open_ = ends
            e = e.join(open_.withColumnRenamed("addr", "src"), "src", "left_semi").join(open_.withColumnRenamed("addr", "dst"), "dst", "left_semi").select("src", "dst")
            e = written(e, "scc")
        if open_.isEmpty():
            break
        color = written(_least_reaching(open_, e), "scc")
        # backward from each pivot within its colour
        same = e.join(color.select(F.col("addr").alias("src"), F.col("c").alias("cs")), "src").join(color.select(F.col("addr").alias("dst"), F.col("c").alias("cd")), "dst")
        same = written(same.where("cs = cd").select("src", "dst", "cs"), "scc")
        front = written(color.where("addr = c").select("addr", F.col("c").alias("rep")), "scc")
        mine = [front]
        while True:
            seen = _all(mine)
            step = same.join(front.select(F.col("addr").alias("dst"), "rep"), "dst").where("cs = rep").select(F.col("src").alias("addr"), "rep").distinct()
            front = written(step.join(seen.select("addr"), "addr", "left_anti"), "scc")
            if front.isEmpty():
                break
            mine.append(front)
        found = written(_all(mine), "scc")
        done.append(found)
        open_ = written(open_.join(found.select("addr"), "addr", "left_anti"), "scc")
        e = e.join(open_.withColumnRenamed("addr", "src"), "src", "left_semi").join(open_.withColumnRenamed("addr", "dst"), "dst", "left_semi").select("src", "dst")
        e = written(e, "scc")
    return _all(done) if done else nodes.select("addr", F.col("addr").alias("rep"))


def _least_reaching(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """(addr, c): the smallest address from which a node can be reached, itself included."""
    color = written(nodes.select("addr", F.col("addr").alias("c")), "color")
    before = None
    while True:
        pushed = e.join(color.select(F.col("addr").alias("src"), "c"), "src").groupBy(F.col("dst").alias("addr")).agg(F.min("c").alias("n"))
        color = color.join(pushed, "addr", "left").select("addr", F.least("c", F.coalesce("n", "c")).alias("c"))
        # what reaches my colour reaches me
        jump = color.select(F.col("addr").alias("c"), F.col("c").alias("cc"))
        color = written(color.join(jump, "c", "left").select("addr", F.least("c", F.coalesce("cc", "c")).alias("c")), "color")
        now = color.agg(F.sum(F.xxhash64("addr", "c").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return color
        before = now


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gc_components(g: DumpTables) -> DataFrame:
    """Strongly connected components of the GC nodes among themselves."""
    return strong_components(g.nodes.where("kind = 'gc'"), g.edges)


def class_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("rep").agg(F.count("*").alias("n"))


def size_histogram(components: DataFrame) -> DataFrame:
    return class_sizes(components).groupBy(F.col("n").alias("size")).agg(F.count("*").alias("n")).orderBy("size")


def purity(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, n): components of counted nodes only, GC nodes only, or both."""
    c = components.join(nodes.select("addr", "kind"), "addr").groupBy("rep").agg(F.count_if(F.col("kind") == "rc").alias("rc"), F.count_if(F.col("kind") == "gc").alias("gc"))
    kind = F.when(F.col("gc") == 0, "pure_rc").when(F.col("rc") == 0, "pure_gc").otherwise("mixed")
    return c.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def contract(edges: DataFrame, merged: DataFrame, drop_loops: bool = True) -> DataFrame:
    """(src, dst): edges with both ends replaced by their representative in merged(addr, rep), once each."""
    m = merged.select("addr", "rep")
    out = edges.select("src", "dst").join(m.select(F.col("addr").alias("src"), F.col("rep").alias("rs")), "src", "left")
    out = out.join(m.select(F.col("addr").alias("dst"), F.col("rep").alias("rd")), "dst", "left")
    out = out.select(F.coalesce("rs", "src").alias("src"), F.coalesce("rd", "dst").alias("dst")).distinct()
    return out.where("src != dst") if drop_loops else out


def topmost_parent(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(addr, top): the end of each node's chain of parents(addr, parent), by pointer jumping; a node on a cycle of
    parents has the cycle's smallest address for its top."""
    p = parents.groupBy("addr").agg(F.min("parent").alias("parent")).where("addr != parent")
    up = written(nodes.select("addr").distinct().join(p, "addr", "left").select("addr", F.coalesce("parent", "addr").alias("top")), "top")
    parent = up
    rounds = max(1, up.count()).bit_length() + 1
    for _ in range(rounds):
        nxt = up.select(F.col("addr").alias("top"), F.col("top").alias("t2"))
        jumped = written(up.join(nxt, "top", "left").select("addr", F.coalesce("t2", "top").alias("top"), F.coalesce(F.col("t2") != F.col("top"), F.lit(False)).alias("moved")), "top")
        up = jumped.select("addr", "top")
        if jumped.where("moved").isEmpty():
            break
    # a top that has a parent is on a cycle, and by now every node of a cycle is some node's top
    heads = up.select(F.col("top").alias("addr")).distinct()
    ring = written(parent.join(heads, "addr", "left_semi").where("addr != top").select("addr", "top", F.col("addr").alias("low")), "ring")
    if ring.isEmpty():
        return up
    for _ in range(rounds):
        nxt = ring.select(F.col("addr").alias("top"), F.col("top").alias("t2"), F.col("low").alias("l2"))
        ring = written(ring.join(nxt, "top", "left").select("addr", F.coalesce("t2", "top").alias("top"), F.least("low", F.coalesce("l2", "low")).alias("low")), "ring")
    return up.join(ring.select(F.col("addr").alias("top"), "low"), "top", "left").select("addr", F.coalesce("low", "top").alias("top"))


def first_parents(edges: DataFrame, label: str = "GetParent()") -> DataFrame:
    """(addr, parent): a node's first edge of this label."""
    order = "ord" if "ord" in edges.columns else "dst"
    return edges.where(F.col("label") == label).groupBy(F.col("src").alias("addr")).agg(F.min_by("dst", order).alias("parent"))


def dom_groups(g: DumpTables, garbage: DataFrame) -> DataFrame:
    """(top, n, doc, is_garbage): groups of nodes by topmost parent; doc is the document whose child the top is, else null."""
    tops = topmost_parent(g.nodes, first_parents(g.edges))
    groups = tops.groupBy("top").agg(F.count("*").alias("n"))
    docs = g.nodes.where(F.col("label").startswith("nsDocument")).select(F.col("addr").alias("src"))
    child = g.edges.where(F.col("label").startswith("mChildren[")).join(docs, "src", "left_semi").groupBy(F.col("dst").alias("top")).agg(F.min("src").alias("doc"))
    dead = garbage.select(F.col("addr").alias("top")).distinct().withColumn("is_garbage", F.lit(True))
    out = groups.join(child, "top", "left").join(dead, "top", "left")
    return out.select("top", "n", "doc", F.coalesce("is_garbage", F.lit(False)).alias("is_garbage"))


def dom_group_totals(groups: DataFrame) -> DataFrame:
    """(orphan, in_doc, garbage): nodes by the fate of their group."""
    n = F.col("n")
    live = ~F.col("is_garbage")
    return groups.agg(
        F.coalesce(F.sum(F.when(live & F.col("doc").isNull(), n)), F.lit(0)).alias("orphan"),
        F.coalesce(F.sum(F.when(live & F.col("doc").isNotNull(), n)), F.lit(0)).alias("in_doc"),
        F.coalesce(F.sum(F.when(~live, n)), F.lit(0)).alias("garbage"),
    )


#: Classes of objects that stand for a DOM node, with the label of the edge that leads to it.
DOM_PARENTS = {"nsDOMCSSAttributeDeclaration": "mElement", "XPCWrappedNative": "mIdentity"}
LISTENER_EDGE, LISTENER_CLASS = "[via hash] mListenerManager", "nsEventListenerManager"
# End of fixed values.


def dom_merge_classes(g: DumpTables) -> DataFrame:
    """(rep, member): nodes that merge because they hang on one DOM node, the DOM node being its topmost parent.

    Parents of one class (DOM_PARENTS) of a DOM node merge, rep being the first of them; of one, with itself.  So do the listener managers
    of a DOM node, if it has several children by LISTENER_EDGE.
    """
    tops = topmost_parent(g.nodes, first_parents(g.edges)).select("addr", "top")
    order = "ord" if "ord" in g.edges.columns else "dst"
    held = []
    for klass, field in DOM_PARENTS.items():
        fits = F.col("label") == klass if klass != "XPCWrappedNative" else F.col("label").startswith(klass)
        own = g.nodes.where(fits).select(F.col("addr").alias("src"))
        first = g.edges.where(F.col("label") == field).join(own, "src", "left_semi").groupBy("src").agg(F.min_by("dst", order).alias("addr"))
        held.append(first.select(F.lit(klass).alias("klass"), "src", "addr"))
    groups = held[0].unionByName(held[1]).join(tops, "addr")
    low = groups.groupBy("klass", "top").agg(F.min("src").alias("rep"))
    parents = groups.join(low, ["klass", "top"]).select("rep", F.col("src").alias("member"))
    child = g.edges.where(F.col("label") == LISTENER_EDGE).join(tops.withColumnRenamed("addr", "src"), "src").select("top", "dst")
    several = child.groupBy("top").agg(F.count("*").alias("n")).where("n > 1").select("top")
    managers = g.nodes.where(F.col("label") == LISTENER_CLASS).select(F.col("addr").alias("dst"))
    child = child.join(several, "top", "left_semi").join(managers, "dst", "left_semi")
    low = child.groupBy("top").agg(F.min("dst").alias("rep"))
    return parents.unionByName(child.join(low, "top").select("rep", F.col("dst").alias("member"))).distinct()


def acyclic_ranks(g: DumpTables, rounds: int | None = None) -> DataFrame:
    """(addr, rank): 0 without out-edges, k where all successors have smaller ranks; nodes that reach a cycle have none."""
    e = written(g.single(), "rank")
    left = written(g.nodes.select("addr").distinct(), "rank")
    done, k = [], 0
    while rounds is None or k < rounds:
        leaf = written(left.join(e.select(F.col("src").alias("addr")).distinct(), "addr", "left_anti"), "rank")
        if leaf.isEmpty():
            break
        done.append(leaf.withColumn("rank", F.lit(k)))
        left = written(left.join(leaf, "addr", "left_anti"), "rank")
        e = written(e.join(leaf.withColumnRenamed("addr", "dst"), "dst", "left_anti").select("src", "dst"), "rank")
        k += 1
    return _all(done) if done else g.nodes.select("addr", F.lit(0).alias("rank")).limit(0)


def acyclic_nodes(g: DumpTables) -> DataFrame:
    return acyclic_ranks(g).select("addr")


def tiny_loops(g: DumpTables) -> DataFrame:
    """(a, b): pairs of nodes whose only edges to others lead to each other."""
    s = written(g.single().where("src != dst"), "loops")
    one = s.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1")
    a, b = one.select(F.col("src").alias("a"), F.col("dst").alias("b")), one.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return a.join(b, ["a", "b"]).where("a < b")


def duplicate_nodes(g: DumpTables) -> DataFrame:
    """(rep, n): nodes of the same kind and label with the same sets of successors and predecessors.

    Sets are compared by size and two sums of 64-bit hashes, which any number of neighbours adds to, so a hub is no long row.
    """
    s = written(g.single(), "dup")

    def side(own: str, other: str, name: str) -> DataFrame:
        sums = [F.sum(F.xxhash64(other, F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
        return s.groupBy(F.col(own).alias("addr")).agg(F.struct(F.count("*").alias("n"), *[x.alias(f"h{i}") for i, x in enumerate(sums)]).alias(name))

    n = g.nodes.select("addr", "kind", "label").join(side("src", "dst", "o"), "addr", "left").join(side("dst", "src", "i"), "addr", "left")
    c = n.where("o is not null or i is not null").groupBy("kind", "label", "o", "i").agg(F.min("addr").alias("rep"), F.count("*").alias("n"))
    return c.where("n > 1").select("rep", "n")


def motifs(g: DumpTables, components: DataFrame, klass, most: int = 3) -> DataFrame:
    """(motif, n): components of up to `most` nodes by their sorted class labels and number of edges, with how many copies there are."""
    small = class_sizes(components).where(F.col("n") <= most).select("rep")
    member = components.join(small, "rep", "left_semi").join(g.nodes.select("addr", klass.alias("k")), "addr")
    keys = member.groupBy("rep").agg(F.array_join(F.array_sort(F.collect_list("k")), " + ").alias("keys"))
    e = g.single().join(member.select(F.col("addr").alias("src"), "rep"), "src").groupBy("rep").agg(F.count("*").alias("e"))
    shape = keys.join(e, "rep", "left").select(F.concat("keys", F.lit(" / "), F.coalesce("e", F.lit(0)).cast("string")).alias("motif"))
    return shape.groupBy("motif").agg(F.count("*").alias("n"))


def copies_between(motif_counts: DataFrame, min_copies: int = 0) -> DataFrame:
    return motif_counts.where(F.col("n") > min_copies)


def components_between(components: DataFrame, smallest: int = 0, largest: int = 1 << 40) -> DataFrame:
    keep = class_sizes(components).where(F.col("n").between(smallest, largest)).select("rep")
    return components.join(keep, "rep", "left_semi")
