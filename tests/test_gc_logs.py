"""Garbage-collector logs, compartments, arenas, strings: own fixtures."""

from heaploom.operators import census, predicates, traverse
from heaploom.sinks import text as sinks
from heaploom.sources import gc_log

GC = """0x1 B stack
0x2 W global one
0x1 G again
0x3 G XPCWrappedNative x
0x4 B nsXPCWrappedJS[nsIDOMEventListener] y
WeakMapEntry map=0x5 key=0x6 keyDelegate=(nil) value=0x7
==========
0x1 B Function f
> 0x5 B script
> 0x6 B other
> 0x8 B script
0x5 B script http://a/b.js:12
0x8 B script http://a/c.js:3
0x6 W string <atom: length 3> abc
0x7 G string <rope: length 13>
0x2 W string <atom: length 3> abc
0x3 G scope lexical
> 0x1 G canonical function
> 0x6 G name one
0x4 B Object caf\xe9
# comment
0x9 B shape
"""

COMP = """0xc1 one
0xc2 two
==========
0xa XPC global object
0xb later
0xa again
==========
0xa 0xc1 Window
> 0xb x
0xb 0xc2 Object
> 0xa y
"""

ARENA = """0x1 B root
==========
# zone 0xz1
# zone 0xa1
# compartment main [in zone 0xa1]
# arena allockind=1 size=64
0x10 B thing
> 0x11 B edge
0x11 B thing
# arena allockind=2 size=32
# zone 0xa2
# compartment other [in zone 0xa2]
# arena allockind=3 size=4096
0x20 W thing
"""


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def write(tmp_path, text, name):
    p = tmp_path / name
    p.write_bytes(text.encode("latin-1"))
    return "file://" + str(p)


def test_gc(spark, tmp_path):
    path = write(tmp_path, GC, "gc-edges.log")
    g = gc_log.read_gc_log(spark, path)
    assert rows(g.roots, "addr", "is_black") == [("0x1", True), ("0x2", True), ("0x3", False), ("0x4", False)]
    assert g.weak_maps.count() == 1 and g.corrupt.count() == 0
    assert {r["label"] for r in g.nodes.collect() if r["addr"] == "0x4"} == {"Object caf\xe9"}
    assert rows(predicates.gc_roots(g, True), "addr") == [("0x1",), ("0x2",)]
    assert rows(census.function_scripts(g), "addr", "url") == [("0x1", "http://a/c.js")]
    c = {(r["category"], r["name"]): (r["total"], r["n"]) for r in census.gc_census(g).collect()}
    assert c["strings", "atom"] == (3, 2) and c["strings", "rope"] == (3, 1) and c["functions", "f http://a/c.js"] == (1, 1)
    assert c["shape", None] == (1, None) and c["scopes", "lexical"] == (1, 1)
    assert rows(census.scopes_by_script(g), "scope", "url") == [("0x3", "http://a/c.js")]
    assert rows(census.scope_name_lists(g), "names", "n") == [("abc", 1)]
    counts, _ = census.listener_counts(g)
    assert tuple(counts.first()) == (1, 0)
    strings = gc_log.read_strings(spark, path)
    assert rows(census.string_census(strings), "type", "text", "n", "total") == [("atom", "abc", 2, 6)]
    black = g.nodes.where("color = 'B'")
    d = {r["addr"]: r["d"] for r in traverse.distances(g.edges, predicates.gc_roots(g, True), expandable=black).collect()}
    assert d["0x5"] == 1 and d["0x6"] == 1 and "0x3" not in d
    assert rows(predicates.select_strings(g, "<atom"), "addr") == [("0x2",), ("0x6",)]
    dot = [r["value"] for r in sinks.dot_lines(g, gc=True).orderBy("ord").collect()]
    assert dot[0].startswith("digraph") and dot[-1] == "}"
    paths = traverse.root_paths(traverse.distances(g.edges, g.roots), predicates.select_targets(g, "0x8"))
    assert sinks.path_set_dot(paths, g).count() > 2


def test_compartments(spark, tmp_path):
    path = write(tmp_path, COMP, "gc-comp.log")
    g = gc_log.read_gc_compartment_log(spark, path)
    assert rows(g.roots, "addr", "is_black", "label") == [("0xa", False, "again"), ("0xb", False, "later")]
    assert rows(gc_log.compartment_names(spark, path), "compartment", "name") == [("0xc1", "one"), ("0xc2", "two")]
    assert rows(census.cross_compartment_edges(g, "0xc2"), "src", "dst") == [("0xa", "0xb")]
    assert rows(census.compartment_root_refs(g, "0xc1"), "addr") == [("0xa",)]


def test_arenas(spark, tmp_path):
    z = gc_log.read_zones(spark, write(tmp_path, ARENA.replace("# zone 0xz1\n", ""), "gc-arena.log"))
    assert rows(z["zones"], "zone") == [("0xa1",), ("0xa2",)]
    assert rows(z["compartments"], "zone", "compartment") == [("0xa1", "main"), ("0xa2", "other")]
    assert rows(z["arenas"], "zone", "thing_size", "num_things") == [("0xa1", 32, 0), ("0xa1", 64, 2), ("0xa2", 4096, 1)]
    assert rows(census.arena_utilisation(z["arenas"]), "zone", "unused_percent", "n") == [("0xa1", 95, 1), ("0xa1", 100, 1), ("0xa2", 0, 1)]
