"""A share of the registered queries against their SQL on the smallest tables, the scalar functions, the stream."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heaploom import queries
from heaploom.functions import labels

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, cols):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize(
    "name",
    ["class_census", "fn_census", "js_holders", "dup_edge_histogram", "root_classification", "prune_non_js_border", "class_path_nodes",
     "distances_with_weak_maps", "report_diff", "roots_reaching_target", "arena_buckets"],
)
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = connection().execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert normal([tuple(r[c] for c in cols) for r in got.collect()], cols) == normal([tuple(r[i] for i in order) for r in want.fetchall()], cols)


def test_arenas_that_hold_more_than_their_size(spark, tmp_path):
    """Where parts repeat, arenas of the query hold more than 4096 bytes: shares below zero are those of the SQL."""
    con = connection()
    con.execute(f"COPY (SELECT p_partkey + 1000000 * k AS p_partkey, * EXCLUDE p_partkey FROM part, range(150) t(k)) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = [tuple(r) for r in queries.QUERIES["arena_buckets"](spark, str(tmp_path)).select("zone", "unused_percent", "n").collect()]
    assert sorted(got) == sorted(con.execute(queries.ORACLES["arena_buckets"]).fetchall())
    assert min(r[1] for r in got) < 0


def heap():
    """Successors of each address, root's being the roots, of the heap view over the smallest tables, and labels."""
    con = connection()
    succ = {}
    for x, y in con.execute(queries.HR + " SELECT src, dst FROM edges UNION SELECT 'root', addr FROM roots").fetchall():
        succ.setdefault(x, set()).add(y)
    return succ, dict(con.execute(queries.H + " SELECT addr, label FROM nodes").fetchall())


def flood(succ, gone=None):
    seen, todo = {"root"}, ["root"]
    while todo:
        new = succ.get(todo.pop(), set()) - seen - {gone}
        seen |= new
        todo += new
    return seen


def test_heap_dominators(spark):
    """Dominators of the whole heap against the removal of every node."""
    succ, _ = heap()
    live = flood(succ)
    assert {x[0] for x in live} >= set("rNSCOP")
    under = {u: live - flood(succ, u) if u != "root" else live for u in live}
    got = {(r["addr"], r["dominator"]) for r in queries.QUERIES["heap_dominators"](spark, SF).collect()}
    assert got == {(v, u) for u in live for v in under[u]}
    sizes = {r["addr"]: (r["retained"], r["dominated"]) for r in queries.QUERIES["heap_retained_sizes"](spark, SF).collect()}
    assert sizes == {u: (8 * len(vs - {"root"}), len(vs) - 1) for u, vs in under.items()}
    depth = dict.fromkeys(live, 0)
    for vs in under.values():
        for v in vs:
            depth[v] += 1
    tree = {r["addr"]: (r["idom"], r["depth"]) for r in queries.QUERIES["heap_dominator_tree"](spark, SF).collect()}
    idom = {}
    for u in sorted(live, key=depth.get):
        idom |= {v: (u, depth[u]) for v in under[u] if v != u}
    assert tree == idom


def test_class_paths(spark):
    """Shortest root paths to every part and supplier against breadth-first search; of equal parents the smallest."""
    succ, labels_ = heap()
    parent, level = {}, dict.fromkeys(succ["root"])
    while level:
        parent |= level
        following = {}
        for x in sorted(level, reverse=True):
            following |= dict.fromkeys(succ.get(x, set()) - set(parent), x)
        level = following
    want = set()
    for target in (v for v in parent if labels_[v].startswith("JS Object (")):
        path = [target]
        while parent[path[-1]]:
            path.append(parent[path[-1]])
        want |= {(target, hop, v) for hop, v in enumerate(reversed(path))}
    assert len({t for t, *_ in want if t[0] == "P"}) > 100
    got = queries.QUERIES["class_path_nodes"](spark, SF).collect()
    assert len(got) == len(want) and {(r["target"], r["hop"], r["addr"]) for r in got} == want
    assert queries.QUERIES["root_path_lines"](spark, SF).select("target").distinct().count() == len({t for t, *_ in want})


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_functions(spark):
    one = spark.range(1)
    say = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    assert say(labels.strip_global(lit("JS Object (Proxy) (global=1a2b)"))) == "JS Object (Proxy)"
    assert say(labels.function_name(lit("JS Object (Function)"))) == "(no name in log)"
    assert say(labels.function_name(lit("JS Object (Function - f)"))) == "f"
    assert say(labels.url_in(lit("nsDocument about:x http://y"))) == "http://y"
    assert say(labels.masked(lit("at 0x1234abcd end"))) == "at * end"
    assert say(labels.without_private(lit("Call <no private>"))) == "Call"
    assert say(labels.own_size(lit("x SIZE:: 48"))) == 48 and say(labels.own_size(lit("x"))) == 8
    assert say(labels.script_name(lit("script http://a/b/c.js:12"))) == "c.js"
    assert say(labels.plain_int(lit("1,024"))) == 1024
    assert say(labels.hex_number(lit("ffffffffffffffff"))) == 18446744073709551615
    assert say(labels.address(lit("0x00Ab"))) == "ab" and say(labels.address(lit("0x0"))) == "0"
    assert say(labels.null_address(lit("(nil)"))) is None
    assert say(labels.frame_path(lit("f /local/a.cpp:1"))) == "f"
    assert [tuple(x) for x in say(labels.block_list(lit("blocks (requested bytes / slop bytes): 0xa (16 / 0) 0xb (8 / 8)")))] == [("0xa", 16), ("0xb", 8)]
    assert labels.is_address("DEAD") and labels.is_address("0x1f") and not labels.is_address("nsDocument")
    assert say(labels.string_text(lit("string <atom: length 5 (truncated)> a b"))) == "a b"


def test_stream(spark, tmp_path):
    from heaploom.streaming.census import stream_class_census

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cc-1.log").write_text("0x1 [rc=1] nsDocument a\n> 0x2 e\n0x2 [gc] JS Object (Function - f)\n==========\n")
    q = stream_class_census(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("census").trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert {(r["class"], r["n"]) for r in spark.table("census").collect()} == {("nsDocument", 1), ("JS Object (Function)", 1)}
