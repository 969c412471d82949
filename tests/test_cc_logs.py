"""Own toy logs of the format, with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from heaploom.model import DumpTables
from heaploom.operators import census, components, dominators, predicates, search, traverse
from heaploom.sinks import text as sinks
from heaploom.sources import cc_log

YARD = """# a shed, a cart and what hangs on them
0x5ed0 [rc=12] Shed
> 0xca57 door
> 0xca57 hatch
> 0x70015 shelf
0xca57 [rc=2] Cart
> 0x70015 load
0x70015 [rc=2] Tools
0xfe9ce [rc=4] Fence
0x0000000000000000000ba11 [rc=2] Ball on a string
> 0x0000000000000000000ba11 bounce
0x9 [rc=1] Pin
IncrementalRoot 0xfe9ce
==========
0x5ed0 [known=0]
0x0000000000000000000ba11 [known=1]"""

RINGS = """0xd1 [rc=1] ring of two, kept open
> 0xd2 next
0xd2 [rc=1] ring of two, other half
> 0xd1 next
# three in a row, held from outside once
0xe1 [rc=2] outer ring
> 0xe2 step
0xe2 [rc=1] inner ring
> 0xe3 step
0xe3 [rc=1] inner ring
> 0xe1 close
> 0xf0 tail
0xf0 [rc=1] inner tail
IncrementalRoot 0xd2
IncrementalRoot 0xe1
==========
0xe1 [known=1]
"""

WEAK = """0xa [rc=2] root
> 0xm map
> 0xk key
0xm [gc] map
0xk [gc.marked] key
0xv [gc] value
0xd [gc] delegate
0xw [gc] other
WeakMapEntry map=0xm key=0xk keyDelegate=(nil) value=0xv
WeakMapEntry map=0xm key=0xw keyDelegate=0xd value=0xz
WeakMapEntry map=0x0 key=0xk keyDelegate=(nil) value=0xw
odd line
==========
0xa [known=1]
0xv [garbage]
"""


def log(tmp_path, text, name="cc-edges.log"):
    p = tmp_path / name
    p.write_text(text)
    return "file://" + str(p)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_yard(spark, tmp_path):
    g = cc_log.read_log(spark, log(tmp_path, YARD))
    ball = "0x0000000000000000000ba11"
    assert g.nodes.count() == 6 and g.edges.count() == 5
    assert rows(g.results, "addr", "known") == [(ball, 1), ("0x5ed0", 0)]
    assert rows(g.incr_roots, "addr") == [("0xfe9ce",)]
    assert g.corrupt.count() == 0
    roots = predicates.select_roots(g)
    assert rows(roots, "addr", "root") == [(a, "rcRoot") for a in (ball, "0x5ed0", "0xfe9ce")]
    dist = traverse.distances(g.edges, roots)
    table = sinks.path_table(traverse.root_paths(dist, predicates.select_targets(g, "0xca57")), g)
    lines = [r["value"] for r in sinks.path_lines(table).orderBy("hop").collect()]
    assert lines == ["0x5ed0 [Shed]", "    --[door, hatch]--> 0xca57 [Cart]"]
    assert sinks.simple_paths(table).first()["value"] == "[Shed] --[door, hatch]--> [Cart]"
    told = {r["addr"]: (r["unknown_edges"], r["is_incremental"]) for r in traverse.explain_roots(g, roots).collect()}
    assert told == {"0x5ed0": (12, False), "0xfe9ce": (0, True), ball: (1, False)}
    assert traverse.root_paths(dist, predicates.select_targets(g, "0x9")).count() == 0
    assert [r["d"] for r in dist.where("addr = '0x70015'").collect()] == [1]
    assert rows(traverse.known_edges(g, "0x70015"), "addr", "edge_label") == [("0x5ed0", "shelf"), ("0xca57", "load")]


def test_incremental_roots(spark, tmp_path):
    g = cc_log.read_cc_log(spark, log(tmp_path, RINGS))
    roots = predicates.select_roots(g)
    assert rows(roots, "addr") == [("0xd2",), ("0xe1",)]
    paths = traverse.root_paths(traverse.distances(g.edges, roots), predicates.select_targets(g, "inner tail"))
    assert rows(paths, "target", "hop", "addr") == [("0xf0", k, a) for k, a in enumerate(["0xe1", "0xe2", "0xe3", "0xf0"])]
    garbage, known = traverse.collect_cycles(g)
    assert rows(garbage, "addr") == [("0xd1",), ("0xd2",)] and rows(known, "addr", "known") == [("0xe1", 1)]
    assert rows(traverse.check_results(garbage, known, g.results), "addr", "problem") == [("0xd1", "garbage_only_ours"), ("0xd2", "garbage_only_ours")]
    scc = components.strong_components(g.nodes, g.edges)
    assert rows(scc, "addr", "rep") == [("0xd1", "0xd1"), ("0xd2", "0xd1"), ("0xe1", "0xe1"), ("0xe2", "0xe1"), ("0xe3", "0xe1"), ("0xf0", "0xf0")]
    assert rows(sinks.merge_lines(scc), "value") == [("0xd1 0xd2",), ("0xe1 0xe2 0xe3",)]
    assert rows(traverse.cycle_friends(g.edges, "0xe2"), "addr") == [("0xe1",), ("0xe2",), ("0xe3",)]
    assert rows(traverse.roots_reaching(g.edges, roots, predicates.select_targets(g, "0xe3")), "addr", "d") == [("0xe1", 2)]


def test_weak_maps(spark, tmp_path):
    g = cc_log.read_cc_log(spark, log(tmp_path, WEAK))
    assert rows(g.corrupt, "value") == [("odd line",)]
    assert g.weak_maps.where("map is null").count() == 1
    roots = predicates.select_roots(g, ignore_js=True)
    assert rows(roots, "addr", "root") == [("0xa", "rcRoot")]
    d = {r["addr"]: (r["d"], r["parent"], r["via_map"]) for r in traverse.distances(g.edges, roots, g.weak_maps).collect()}
    assert d["0xv"] == (2, "0xk", "0xm") and "0xw" not in d and "0xd" not in d
    assert rows(traverse.weak_maps_as_edges(g.weak_maps), "src", "dst") == [("0xk", "0xw")]
    assert rows(traverse.weak_maps_as_edges(g.weak_maps, True), "src", "dst") == [("0xk", "0xv"), ("0xk", "0xw")]


def test_render_and_parse(spark, tmp_path):
    g = cc_log.read_cc_log(spark, log(tmp_path, WEAK))
    out = "file://" + str(tmp_path / "again")
    sinks.write_lines(sinks.log_lines(g), out, single_file=True)
    h = cc_log.read_cc_log(spark, out)
    assert rows(h.nodes.fillna({"rc": -1, "marked": False}), "addr", "kind", "rc", "marked", "label") == rows(g.nodes.fillna({"rc": -1, "marked": False}), "addr", "kind", "rc", "marked", "label")
    assert rows(h.edges, "src", "dst", "label") == rows(g.edges, "src", "dst", "label")
    assert h.weak_maps.count() == 3 and rows(h.results.fillna({"known": -1}), "addr", "known") == rows(g.results.fillna({"known": -1}), "addr", "known")
    back = g.reversed().reversed()
    assert rows(back.edges, "src", "dst", "label") == rows(g.edges, "src", "dst", "label")
    kept = [r["value"] for r in sinks.log_without_marked(g).collect()]
    assert not any("0xk" in v for v in kept)


def test_projections(spark, tmp_path):
    path = log(tmp_path, YARD)
    assert cc_log.read_cc_nodes(spark, path).edges.count() == 0
    assert cc_log.read_cc_fast(spark, path).edges.where("label is not null").count() == 0
    (tmp_path / "m").write_text("a b c\n\nd e\n")
    assert rows(cc_log.read_merge_file(spark, str(tmp_path / "m")), "rep", "member") == [("a", "b"), ("a", "c"), ("d", "e")]


def test_many_splits_keep_order(spark, tmp_path):
    text = "".join(f"0x{i:x} [rc=1] n{i}\n" + "".join(f"> 0x{(i * 7 + j) % 500:x} e{j}\n" for j in range(i % 4)) for i in range(500))
    path = log(tmp_path, text + "==========\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        got = {(r["src"], r["dst"], r["label"]) for r in cc_log.read_cc_log(spark, path).edges.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(f"0x{i:x}", f"0x{(i * 7 + j) % 500:x}", f"e{j}") for i in range(500) for j in range(i % 4)}


def test_wrappers_and_flood(spark):
    nodes = spark.createDataFrame(
        [("a", "rc", 1, None, "nsDocument x"), ("b", "gc", None, False, "JS"), ("c", "rc", 1, None, "Other"), ("d", "gc", None, False, "JS2")],
        "addr string, kind string, rc int, marked boolean, label string",
    )
    edges = spark.createDataFrame([("a", "b", "Preserved wrapper", 0), ("b", "c", "x", 1)], "src string, dst string, label string, ord long")
    g = DumpTables(nodes, edges)
    holders = predicates.wrapper_holders(g)
    assert rows(holders, "addr", "dst") == [("a", "b")]
    assert rows(traverse.js_flood(g, holders), "addr") == [("c",)]
    assert traverse.unreached_js(g, spark.createDataFrame([("b",)], "addr string")).first()["n"] == 1
    assert g.edge_labels().where(F.size("labels") == 1).count() == 2


def test_bad_name(spark):
    with pytest.raises(ValueError):
        cc_log.read_log(spark, "/tmp/other.log")


def test_find_roots(spark, tmp_path):
    g = cc_log.read_cc_log(spark, log(tmp_path, WEAK))
    found = search.find_roots(g, "value")
    assert rows(found.paths, "target", "hop", "addr") == [("0xm", 0, "0xa"), ("0xm", 1, "0xm"), ("0xv", 0, "0xk"), ("0xv", 1, "0xv")]
    assert found.unreached.count() == 0
    alone = search.find_roots(g, "value", weak_map_paths=False, ignore_js=True)
    assert rows(alone.paths, "target", "hop", "addr") == [("0xv", 0, "0xa"), ("0xv", 1, "0xk"), ("0xv", 2, "0xv")]
    assert [tuple(r) for r in search.find_roots(g, "0xd").unreached.collect()] == [("0xd", None, None)]
    yard = cc_log.read_cc_log(spark, log(tmp_path, YARD, "cc-2.log"))
    every = search.find_roots(yard, "Tools", every_root=True)
    assert rows(every.paths, "target", "hop", "addr") == [("0x5ed0", 0, "0x5ed0"), ("0x5ed0", 1, "0x70015")] and every.unreached.count() == 0
    assert search.find_roots(yard, "Pin", every_root=True).unreached.count() == 1
    table = sinks.path_table(traverse.root_paths(traverse.distances(yard.edges, every.roots), predicates.select_targets(yard, "Cart")), yard)
    back = [r["value"] for r in sinks.path_lines(table, reverse=True).orderBy("hop").collect()]
    assert back == ["0xca57 [Cart]", "    <--[door, hatch]-- 0x5ed0 [Shed]"]
    some, n = search.first_paths(search.find_roots(yard, "0x70015").paths, 0)
    assert n == 1 and some.count() == 0


def test_garbage_subtrees_and_dom_merges(spark):
    comps = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "addr string, rep string")
    assert rows(predicates.components_with_garbage(comps, spark.createDataFrame([("b",)], "addr string")), "addr") == [("a",), ("b",)]
    tree = spark.createDataFrame([("a", "root", 1), ("b", "a", 2), ("c", "b", 3), ("d", "root", 1)], "addr string, idom string, depth int")
    assert rows(dominators.subtree(tree, spark.createDataFrame([("b",)], "addr string")), "addr") == [("b",), ("c",)]
    nodes = [("t", "nsDocument"), ("e", "nsGenericElement"), ("s1", "nsDOMCSSAttributeDeclaration"), ("s2", "nsDOMCSSAttributeDeclaration"), ("w", "XPCWrappedNative (X)")]
    nodes += [("l1", "nsEventListenerManager"), ("l2", "nsEventListenerManager"), ("l3", "nsEventListenerManager"), ("o", "Other")]
    edges = [("e", "t", "GetParent()"), ("s1", "e", "mElement"), ("s2", "t", "mElement"), ("w", "e", "mIdentity"), ("w", "o", "mIdentity"), ("t", "l1", "[via hash] mListenerManager"), ("e", "l2", "[via hash] mListenerManager"), ("o", "l3", "[via hash] mListenerManager")]
    g = DumpTables(
        spark.createDataFrame([(a, "rc", 1, None, x) for a, x in nodes] + [("o", "rc", 1, None, "Other")], "addr string, kind string, rc int, marked boolean, label string"),
        spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, label string, ord long"),
    )
    assert rows(components.dom_merge_classes(g), "rep", "member") == [("l1", "l1"), ("l1", "l2"), ("s1", "s1"), ("s1", "s2"), ("w", "w")]
    assert rows(predicates.wellformed(g).where("violation = 'logged_twice'"), "addr") == [("o",)]
