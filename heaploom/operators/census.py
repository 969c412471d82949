"""Counts: class, function, string, scope and script censuses, degrees, refcount audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import cc_class, function_name, holder_class, percent_bucket, strip_global, url_in, without_line
from ..model import DumpTables
from .predicates import live_or_dead


def class_census(nodes: DataFrame, min_times: int = 5, top: int = 5, klass: Column | None = None) -> DataFrame:
    """(class, n): the most frequent classes; ties by name."""
    klass = cc_class("label") if klass is None else klass
    return nodes.groupBy(klass.alias("class")).agg(F.count("*").alias("n")).where(F.col("n") >= min_times).orderBy(F.desc("n"), "class").limit(top)


def cc_census(g: DumpTables, which: str = "both", min_times: int = 5, top: int = 5) -> DataFrame:
    garbage = g.results.where("tag = 'garbage'") if g.results is not None else g.nodes.limit(0)
    return class_census(live_or_dead(g.nodes, garbage, which), min_times, top)


def function_census(nodes: DataFrame, min_times: int = 1, top: int = 40) -> DataFrame:
    return class_census(nodes.where(F.col("label").startswith("JS Object (Function")), min_times, top, function_name("label"))


def top_refcounts(nodes: DataFrame, min_rc: int = 0, top: int = 5) -> DataFrame:
    return nodes.where((F.col("kind") == "rc") & (F.col("rc") >= min_rc)).select("addr", "rc").orderBy(F.desc("rc"), "addr").limit(top)


def rc_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'rc'").groupBy("rc").agg(F.count("*").alias("n"))


def class_alert(nodes: DataFrame, prefix: str = "ContentParent", limit: int = 10) -> DataFrame:
    """(n, alert): how many labels start with prefix, and whether that is more than limit."""
    return nodes.agg(F.count_if(F.col("label").startswith(prefix)).alias("n")).withColumn("alert", F.col("n") > limit)


def holders_of_class(g: DumpTables, label: str) -> DataFrame:
    """(class, n): distinct (holder, held) pairs by the holder's label, for nodes of exactly this label."""
    held = g.nodes.where(F.col("label") == label).select(F.col("addr").alias("dst"))
    pairs = g.edges.join(held, "dst", "left_semi").select("src", "dst").distinct()
    named = pairs.join(g.nodes.select(F.col("addr").alias("src"), strip_global("label").alias("class")), "src")
    return named.groupBy("class").agg(F.count("*").alias("n"))


def js_holders(g: DumpTables) -> DataFrame:
    """(addr, label): reference-counted nodes with at least one GC child."""
    gc = g.nodes.where("kind = 'gc'").select(F.col("addr").alias("dst"))
    src = g.edges.join(gc, "dst", "left_semi").select(F.col("src").alias("addr")).distinct()
    return g.nodes.where("kind = 'rc'").join(src, "addr", "left_semi").select("addr", "label")


def js_holder_census(g: DumpTables, canonical: bool = True, min_times: int = 1) -> DataFrame:
    klass = holder_class("label") if canonical else F.col("label")
    return js_holders(g).groupBy(klass.alias("class")).agg(F.count("*").alias("n")).where(F.col("n") >= min_times)


def out_degrees(g: DumpTables, label: str | None = None) -> DataFrame:
    """(addr, degree): physical out-edges, of nodes of exactly this label or of all."""
    n = g.nodes if label is None else g.nodes.where(F.col("label") == label)
    d = g.edges.groupBy(F.col("src").alias("addr")).agg(F.count("*").alias("degree"))
    return n.select("addr").join(d, "addr", "left").select("addr", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_histogram(g: DumpTables, label: str | None = None, above: int = -1) -> DataFrame:
    return out_degrees(g, label).where(F.col("degree") > above).groupBy("degree").agg(F.count("*").alias("n"))


def label_dup_histogram(g: DumpTables, label: str = "parent") -> DataFrame:
    """(extra, n): nodes by how many edges of this label they have above one."""
    c = g.edges.where(F.col("label") == label).groupBy(F.col("src").alias("addr")).agg(F.count("*").alias("c"))
    extra = F.greatest(F.lit(0), F.coalesce("c", F.lit(0)) - 1)
    return g.nodes.select("addr").join(c, "addr", "left").groupBy(extra.alias("extra")).agg(F.count("*").alias("n"))


def internal_counts(g: DumpTables, rc_sources_only: bool = False) -> DataFrame:
    """(addr, rc, ic): counted references into each reference-counted node from the nodes of the dump."""
    e = g.edges
    if rc_sources_only:
        e = e.join(g.nodes.where("kind = 'rc'").select(F.col("addr").alias("src")), "src", "left_semi")
    c = e.groupBy(F.col("dst").alias("addr")).agg(F.count("*").alias("c"))
    n = g.nodes.where("kind = 'rc'").select("addr", "rc").join(c, "addr", "left")
    return n.select("addr", "rc", F.coalesce("c", F.lit(0)).alias("ic"))


def refcount_audit(g: DumpTables, rc_sources_only: bool = False) -> DataFrame:
    """Nodes with more references in the dump than their count says."""
    return internal_counts(g, rc_sources_only).where("rc < ic")


def rc_roots(g: DumpTables) -> DataFrame:
    """Nodes with references from outside the dump; see refcount_audit for impossible counts."""
    return internal_counts(g).where("rc > ic")


def graph_counts(g: DumpTables) -> DataFrame:
    return g.edges.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def node_set_sides(g: DumpTables) -> DataFrame:
    """(side, n): nodes that are only sources, only targets, or both."""
    s = g.edges.select(F.col("src").alias("addr")).distinct().withColumn("s", F.lit(1))
    d = g.edges.select(F.col("dst").alias("addr")).distinct().withColumn("d", F.lit(1))
    side = F.when(F.col("d").isNull(), "source_only").when(F.col("s").isNull(), "target_only").otherwise("both")
    return s.join(d, "addr", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def single_parents(g: DumpTables) -> DataFrame:
    """(addr): reference-counted nodes without outside references that one edge points at."""
    return internal_counts(g).where("rc <= ic and ic = 1").select("addr")


def string_census(strings: DataFrame, top: int = 20, width: int = 100) -> DataFrame:
    """(type, length, text, n, total) of strings(type, length, text), by total length; text cut to width."""
    c = strings.groupBy("type", "length", "text").agg(F.count("*").alias("n")).withColumn("total", F.col("n") * F.col("length"))
    best = c.orderBy(F.desc("total"), F.desc("n"), F.desc("text")).limit(top)
    return best.withColumn("text", F.substring("text", 1, width))


def atoms(strings: DataFrame) -> DataFrame:
    return strings.where("type = 'atom'").select("text", "length")


#: Exact labels that are categories of their own in a GC census, and how many names each breakdown shows.
GC_EXACT = ["jitcode", "shape", "base_shape", "lazyscript", "object_group", "reg_exp_shared"]
GC_TOP = {"strings": 5, "functions": 40, "scripts": 10, "scopes": 10}


def gc_categories(g: DumpTables) -> DataFrame:
    """(addr, category, name): the first category that fits a node's label, and its key in a breakdown."""
    label = F.coalesce("label", F.lit(""))

    def rest(prefix: str) -> Column:
        r = F.trim(label.substr(F.lit(len(prefix) + 1), F.length(label)))
        return F.when(r == "", label).otherwise(r)

    kind = F.when(label.rlike("^string <[^:]*:"), "strings").when(label.startswith("symbol "), "symbols")
    for x in GC_EXACT:
        kind = kind.when(label == x, x)
    kind = (
        kind.when(label.startswith("scope"), "scopes")
        .when(label == "INVALID", "invalid")
        .when(label == "Array <no private>", "arrays")
        .when(label == "Call <no private>", "calls")
        .when(label.startswith("Function"), "functions")
        .when(label.startswith("Object"), "objects")
        .when(label.startswith("script"), "scripts")
        .otherwise("other")
    )
    n = g.nodes.select("addr", label.alias("label"), kind.alias("category"))
    url = function_scripts(g).select("addr", "url")
    name = (
        F.when(F.col("category") == "strings", F.regexp_extract("label", "^string <([^:]*):", 1))
        .when(F.col("category") == "scopes", F.when(F.trim(F.substring("label", 6, 1 << 20)) == "", F.col("label")).otherwise(F.trim(F.substring("label", 6, 1 << 20))))
        .when(F.col("category") == "scripts", without_line(F.when(F.trim(F.substring("label", 7, 1 << 20)) == "", F.col("label")).otherwise(F.trim(F.substring("label", 7, 1 << 20)))))
        .when(
            F.col("category") == "functions",
            F.concat(F.when(F.trim(F.substring("label", 9, 1 << 20)) == "", F.col("label")).otherwise(F.trim(F.substring("label", 9, 1 << 20))), F.lit(" "), F.coalesce("url", F.lit("NONE"))),
        )
    )
    return n.join(url, "addr", "left").select("addr", "category", name.alias("name"))


def function_scripts(g: DumpTables) -> DataFrame:
    """(addr, script, url) of functions: the last `script` edge counts; NONE without a script, ??? without its node."""
    fn = g.nodes.where(F.col("label").startswith("Function")).select("addr")
    order = "ord" if "ord" in g.edges.columns else "dst"
    last = g.edges.where("label = 'script'").groupBy(F.col("src").alias("addr")).agg(F.max_by("dst", order).alias("script"))
    names = g.nodes.where(F.col("label").startswith("script")).select(
        F.col("addr").alias("script"), without_line(F.trim(F.substring("label", 7, 1 << 20))).alias("u")
    )
    out = fn.join(last, "addr", "left").join(names, "script", "left")
    return out.select("addr", "script", F.when(F.col("script").isNull(), "NONE").otherwise(F.coalesce("u", F.lit("???"))).alias("url"))


def gc_census(g: DumpTables, top: dict[str, int] = GC_TOP) -> DataFrame:
    """(category, total, name, n, rank): totals of categories, and the most frequent names of those with a breakdown."""
    c = gc_categories(g)
    totals = c.groupBy("category").agg(F.count("*").alias("total"))
    names = c.where("name is not null").groupBy("category", "name").agg(F.count("*").alias("n"))
    names = top_n_per(names, "category", "n", "name", max(top.values()))
    limit = F.create_map(*[x for k, v in top.items() for x in (F.lit(k), F.lit(v))])
    names = names.where(F.col("rank") <= limit[F.col("category")])
    return totals.join(names, "category", "left").orderBy(F.desc("total"), "category", "rank")


def top_n_per(counts: DataFrame, group: str, n: str, name: str, top: int) -> DataFrame:
    """The top rows of each group, with their rank; ties by name.  counts has a row per (group, name)."""
    w = Window.partitionBy(group).orderBy(F.desc(n), name)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def root_label_counts(roots: DataFrame) -> DataFrame:
    return roots.groupBy("label").agg(F.count("*").alias("n"))


def scopes_by_script(g: DumpTables, url: str | None = None) -> DataFrame:
    """(scope, fn, url): each scope's canonical function and its script, of one URL or of all."""
    scopes = g.nodes.where(F.col("label").startswith("scope")).select(F.col("addr").alias("scope"))
    fn = g.edges.where("label = 'canonical function'").groupBy(F.col("src").alias("scope")).agg(F.max("dst").alias("fn"))
    out = scopes.join(fn, "scope", "left").join(function_scripts(g).select(F.col("addr").alias("fn"), "url"), "fn", "left")
    return out.select("scope", "fn", "url") if url is None else out.where(F.col("url") == url).select("scope", "fn", "url")


def scope_name_lists(g: DumpTables) -> DataFrame:
    """(names, n): scopes by their sorted, comma-joined name strings."""
    scopes = g.nodes.where(F.col("label").startswith("scope")).select(F.col("addr").alias("src"))
    strings = g.nodes.where(F.col("label").startswith("string <")).select(F.col("addr").alias("dst"), F.regexp_extract("label", r"^string <[^>]*> (.*)$", 1).alias("s"))
    named = g.edges.where("label like 'name%'").join(scopes, "src", "left_semi").join(strings, "dst")
    lists = named.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("s")), ", ").alias("names"))
    return lists.groupBy("names").agg(F.count("*").alias("n"))


def listener_counts(g: DumpTables, above: int = 100) -> tuple[DataFrame, DataFrame]:
    """(gray, black) counts of event listener roots, and labels of their nodes met more than `above` times."""
    roots = g.roots.where(F.col("label").startswith("nsXPCWrappedJS[nsIDOMEventListener"))
    counts = roots.agg(F.count_if(~F.col("is_black")).alias("gray"), F.count_if("is_black").alias("black"))
    named = g.nodes.select("addr", F.col("label").alias("node_label")).join(F.broadcast(roots.select("addr")), "addr")
    return counts, named.groupBy("node_label").agg(F.count("*").alias("n")).where(F.col("n") > above)


def arena_utilisation(arenas: DataFrame, size: int = 4096) -> DataFrame:
    """(zone, unused_percent, n): arenas by their unused share in steps of 5 per cent."""
    used = F.col("thing_size") * F.col("num_things")
    return arenas.groupBy("zone", percent_bucket(used, size).alias("unused_percent")).agg(F.count("*").alias("n"))


def compartment_root_refs(g: DumpTables, comp: str) -> DataFrame:
    """(addr, root_label): roots that point into a compartment."""
    n = g.nodes.where(F.col("compartment") == comp).select("addr", "label")
    return n.join(g.roots.select("addr", F.col("label").alias("root_label")), "addr")


def cross_compartment_edges(g: DumpTables, comp: str) -> DataFrame:
    """Edges into a compartment from others."""
    src = g.nodes.select(F.col("addr").alias("src"), F.col("compartment").alias("src_comp"))
    dst = g.nodes.where(F.col("compartment") == comp).select(F.col("addr").alias("dst"))
    return g.edges.join(dst, "dst", "left_semi").join(src, "src").where(F.col("src_comp") != comp)


def document_urls(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").startswith("nsDocument")).select("addr", url_in("label").alias("url"))
