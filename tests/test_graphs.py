"""Seeded random graphs against plain Python."""

import random

import pytest

from heaploom import queries
from heaploom.model import DumpTables
from heaploom.operators import components, dominators, traverse
from heaploom.sinks import text as sinks


def graph(spark, seed, n=18, m=30):
    rng = random.Random(seed)
    e = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}", f"l{i}", i) for i in range(m)]
    nodes = spark.createDataFrame([(f"n{i:02}", "gc" if i % 3 else "rc", "x") for i in range(n)], "addr string, kind string, label string")
    return DumpTables(nodes, spark.createDataFrame(e, "src string, dst string, label string, ord long")), e, [f"n{i:02}" for i in range(n)]


def flood(start, e, gone=None):
    seen, todo = set(), [s for s in start if s != gone]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [y for x, y, *_ in e if x == v and y != gone]
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_against_python(spark, seed):
    g, e, names = graph(spark, seed)
    roots = spark.createDataFrame([("n00",), ("n03",)], "addr string")
    start = ["n00", "n03"]
    assert {r["addr"] for r in traverse.reach(g.edges, roots).collect()} == flood(start, e)
    dist = {r["addr"]: r["d"] for r in traverse.distances(g.edges, roots).collect()}
    want, level, k = {}, set(start), 0
    while level:
        want |= dict.fromkeys(level, k)
        level, k = {y for x, y, *_ in e if x in level} - set(want), k + 1
    assert dist == want
    assert all(dist[y] <= dist[x] + 1 for x, y, *_ in e if x in dist)
    scc = {r["addr"]: r["rep"] for r in components.strong_components(g.nodes, g.edges).collect()}
    reach = {v: flood([v], e) for v in names}
    assert scc == {v: min(w for w in names if w in reach[v] and v in reach[w]) for v in names}
    und = e + [(y, x) for x, y, *_ in e]
    cc = {r["addr"]: r["rep"] for r in components.connected_components(g.nodes, g.edges).collect()}
    assert cc == {v: min(flood([v], und)) for v in names}
    dom = dominators.dominator_sets(g.edges, roots)
    got = {r["addr"]: set(r["dom"]) for r in dom.collect()}
    full = [("root", "n00"), ("root", "n03"), *e]
    live = flood(["root"], full)
    assert got == {v: {u for u in live if u in (v, "root") or v not in flood(["root"], full, u)} for v in live}
    idom = {r["addr"]: r["idom"] for r in dominators.dominator_tree(dom).collect()}
    comp = spark.createDataFrame([(v, "all") for v in names], "addr string, rep string")
    assert {r["addr"]: r["idom"] for r in dominators.per_component(g.edges, roots, comp).collect()} == idom
    sizes = {r["addr"]: r["retained"] for r in dominators.retained_sizes(dom, g.nodes).collect()}
    assert sizes["root"] == 8 * (len(live) - 1)


def test_reference_counterexample(spark):
    e = spark.createDataFrame([("0", "1"), ("1", "2"), ("1", "3"), ("2", "3"), ("2", "4"), ("3", "4")], "src string, dst string")
    dom = dominators.dominator_sets(e, spark.createDataFrame([("0",)], "addr string"))
    assert {r["addr"]: r["idom"] for r in dominators.dominator_tree(dom).collect()}["4"] == "1"
    assert [r["addr"] for r in dominators.dominator_path(dom, "4").collect()] == ["root", "0", "1", "4"]


def test_parents(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "addr string")
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("e", "f"), ("f", "e")], "addr string, parent string")
    got = {r["addr"]: r["top"] for r in components.topmost_parent(nodes, p).collect()}
    assert got == {"a": "d", "b": "d", "c": "d", "d": "d", "e": "e", "f": "e", "g": "g"}


def test_ranks_and_duplicates(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("a2", "b")], "src string, dst string")
    nodes = spark.createDataFrame([(x, "rc", "l") for x in ("a", "a2", "b", "c", "d", "x", "y")], "addr string, kind string, label string")
    g = DumpTables(nodes, e)
    assert {r["addr"]: r["rank"] for r in components.acyclic_ranks(g).collect()} == {"c": 0, "b": 1, "d": 1, "a": 2, "a2": 2}
    assert [(r["a"], r["b"]) for r in components.tiny_loops(g).collect()] == [("x", "y")]
    assert [(r["rep"], r["n"]) for r in components.duplicate_nodes(g).collect()] == [("a", 2)]


def test_no_limit_of_depth(spark, monkeypatch):
    """Ranks above 2 are in the query; lines below 65 levels are in the tree."""
    nodes = spark.createDataFrame([(f"n{i}", "rc", "x") for i in range(6)], "addr string, kind string, label string")
    g = DumpTables(nodes, spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)], "src string, dst string"))
    monkeypatch.setattr(queries, "heap_view", lambda *_: g)
    assert {r["addr"]: r["rank"] for r in queries.QUERIES["acyclic_rank"](spark, "").collect()} == {f"n{i}": 5 - i for i in range(6)}
    names = ["root", *(f"a{i:02}" for i in range(68))]
    tree = spark.createDataFrame(list(zip(names[1:], names)), "addr string, idom string").coalesce(1)
    retained = spark.createDataFrame([(x, 8 * (68 - i)) for i, x in enumerate(names[1:])], "addr string, retained long").coalesce(1)
    got = sinks.tree_lines(tree, retained, tree.selectExpr("addr", "'x' as label"), at_least=8).orderBy("ord").collect()
    assert [r["value"] for r in got] == [f"{'  ' * i}{8 * (68 - i)} {x} x" for i, x in enumerate(names[1:])]
