"""Registered queries that render the tables as logs and reports of each format, parse these and analyse what was read.

Each log is a DataFrame of lines (ord, value), written over many part files and read back by the sources.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks, census
from .plans.cut import shared_dir
from .plans.heap_view import TABLES
from .queries import query
from .sinks.text import write_lines
from .sources import cc_log, dmd, gc_log


def _tables(spark: SparkSession, d: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)


def _rendered(spark: SparkSession, d: str, name: str, sql: str) -> str:
    """The path of a log whose lines are `value` of sql, in the order of its other columns."""
    _tables(spark, d)
    lines = spark.sql(sql)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_lines(lines.select(F.struct(*[c for c in lines.columns if c != "value"]).alias("ord"), "value"), path)
    return path


#: Roots: every supplier twice, the second time with another label; gray ones begin with a label of the wrapper kind.
ROOTS = """SELECT 0 AS part, s_suppkey AS a, 0 AS b, 0 AS c, '0xa' || s_suppkey || ' B ' || CASE WHEN s_suppkey % 40 = 39 THEN 'XPCWrappedNative ' ELSE 'Root ' END || s_name AS value FROM supplier
UNION ALL SELECT 1, s_suppkey, 0, 0, '0xa' || s_suppkey || ' B again' FROM supplier"""
#: Nodes: suppliers are functions with scripts (of two the last counts), nations scripts, parts strings, customers scopes, orders objects.
GC_LOG = f"""{ROOTS}
UNION ALL SELECT 2, c_custkey, 0, 0, 'WeakMapEntry map=0xd' || c_custkey || ' key=0xa' || c_nationkey || ' keyDelegate=' || CASE WHEN c_custkey % 2 = 0 THEN '(nil)' ELSE '0x0' END || ' value=0xc' || c_custkey FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 3, 0, 0, 0, '=========='
UNION ALL SELECT 4, s_suppkey, 0, 0, '0xa' || s_suppkey || ' B Function ' || s_name FROM supplier
UNION ALL SELECT 4, s_suppkey, 1, k, '> 0xe' || ((s_nationkey + k) % 30) || ' B script' FROM supplier CROSS JOIN (SELECT explode(array(1, 2)) AS k) WHERE s_suppkey % 5 > 0
UNION ALL SELECT 5, n_nationkey, 0, 0, '0xe' || n_nationkey || ' G script http://x/' || n_name || '.js:' || n_regionkey FROM nation
UNION ALL SELECT 6, p_partkey, 0, 0, '0xb' || p_partkey || ' W string <' || CASE WHEN p_size % 2 = 0 THEN 'atom' ELSE 'linear' END || ': length ' || length(p_name) || CASE WHEN p_size % 7 = 0 THEN ' (truncated)' ELSE '' END || '> ' || p_name FROM part
UNION ALL SELECT 7, c_custkey, 0, 0, '0xd' || c_custkey || ' B scope ' || c_mktsegment FROM customer
UNION ALL SELECT 7, c_custkey, 1, 0, '> 0xa' || (c_custkey % 200) || ' B canonical function' FROM customer
UNION ALL SELECT 8, o_orderkey, 0, 0, '0xc' || o_orderkey || ' B Object <no private>' FROM orders
UNION ALL SELECT 8, l_orderkey, 1, l_linenumber, '> 0xb' || l_partkey || ' W name ' || l_linenumber FROM lineitem"""
FUNCTIONS = """SELECT '0xa' || s_suppkey AS addr, CASE WHEN s_suppkey % 5 > 0 THEN '0xe' || ((s_nationkey + 2) % 30) END AS script,
 CASE WHEN s_suppkey % 5 = 0 THEN 'NONE' ELSE coalesce('http://x/' || n_name || '.js', '???') END AS url
FROM supplier LEFT JOIN nation ON n_nationkey = (s_nationkey + 2) % 30"""
GC_NODES = """SELECT '0xa' || s_suppkey AS addr, 'B' AS color, 'Function ' || s_name AS label FROM supplier
UNION ALL SELECT '0xe' || n_nationkey, 'G', 'script http://x/' || n_name || '.js:' || n_regionkey FROM nation
UNION ALL SELECT '0xb' || p_partkey, 'W', 'string <' || CASE WHEN p_size % 2 = 0 THEN 'atom' ELSE 'linear' END || ': length ' || length(p_name) || CASE WHEN p_size % 7 = 0 THEN ' (truncated)' ELSE '' END || '> ' || p_name FROM part
UNION ALL SELECT '0xd' || c_custkey, 'B', 'scope ' || c_mktsegment FROM customer
UNION ALL SELECT '0xc' || o_orderkey, 'B', 'Object <no private>' FROM orders"""
GC_EDGES = """SELECT '0xa' || s_suppkey AS src, '0xe' || ((s_nationkey + k) % 30) AS dst, 'script' AS label FROM supplier, (SELECT unnest([1, 2]) AS k) WHERE s_suppkey % 5 > 0
UNION ALL SELECT '0xd' || c_custkey, '0xa' || (c_custkey % 200), 'canonical function' FROM customer
UNION ALL SELECT '0xc' || l_orderkey, '0xb' || l_partkey, 'name ' || l_linenumber FROM lineitem"""


def _gc(spark: SparkSession, d: str):
    return gc_log.read_gc_log(spark, _rendered(spark, d, "gc", GC_LOG))


@query(GC_NODES)
def gc_log_nodes(spark, d):
    return _gc(spark, d).nodes.select("addr", "color", "label")


@query(GC_EDGES)
def gc_log_edges(spark, d):
    return _gc(spark, d).edges.select("src", "dst", "label")


@query("""SELECT '0xa' || s_suppkey AS addr, s_suppkey < coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 40 = 39), 1 << 40) AS is_black,
 CASE WHEN s_suppkey % 40 = 39 THEN 'XPCWrappedNative ' ELSE 'Root ' END || s_name AS label FROM supplier""")
def gc_log_roots(spark, d):
    return _gc(spark, d).roots.select("addr", "is_black", "label")


@query("""SELECT '0xd' || c_custkey AS map, '0xa' || c_nationkey AS key, CAST(NULL AS VARCHAR) AS key_delegate, '0xc' || c_custkey AS value FROM customer WHERE c_acctbal < 0""")
def gc_log_weak_maps(spark, d):
    return _gc(spark, d).weak_maps.select("map", "key", "key_delegate", "value")


@query("""SELECT '0xb' || p_partkey AS addr, 'W' AS color, CASE WHEN p_size % 2 = 0 THEN 'atom' ELSE 'linear' END AS type, CAST(length(p_name) AS INT) AS length,
 p_size % 7 = 0 AS truncated, p_name AS text FROM part""")
def gc_log_strings(spark, d):
    return gc_log.read_strings(spark, _rendered(spark, d, "gc", GC_LOG))


@query("""SELECT p_name AS text, CAST(length(p_name) AS INT) AS length FROM part WHERE p_size % 2 = 0""")
def gc_log_atoms(spark, d):
    return census.atoms(gc_log.read_strings(spark, _rendered(spark, d, "gc", GC_LOG)))


@query(FUNCTIONS)
def gc_function_scripts(spark, d):
    return census.function_scripts(_gc(spark, d))


@query(f"""WITH fn AS ({FUNCTIONS}) SELECT '0xd' || c_custkey AS scope, '0xa' || (c_custkey % 200) AS fn, fn.url
FROM customer LEFT JOIN fn ON fn.addr = '0xa' || (c_custkey % 200)""")
def gc_scope_scripts(spark, d):
    return census.scopes_by_script(_gc(spark, d))


@query(f"""WITH fn AS ({FUNCTIONS}), names AS (
 SELECT 'functions' AS category, s_name || ' ' || url AS name FROM supplier JOIN fn ON fn.addr = '0xa' || s_suppkey
 UNION ALL SELECT 'scripts', 'http://x/' || n_name || '.js' FROM nation
 UNION ALL SELECT 'strings', CASE WHEN p_size % 2 = 0 THEN 'atom' ELSE 'linear' END FROM part
 UNION ALL SELECT 'scopes', c_mktsegment FROM customer
 UNION ALL SELECT 'objects', NULL FROM orders
), total AS (SELECT category, count(*) AS total FROM names GROUP BY category),
ranked AS (SELECT category, name, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, name) AS rank FROM names WHERE name IS NOT NULL GROUP BY category, name)
SELECT total.category, total, name, n, CAST(rank AS INT) AS rank FROM total LEFT JOIN ranked ON ranked.category = total.category
 AND rank <= CASE total.category WHEN 'strings' THEN 5 WHEN 'functions' THEN 40 ELSE 10 END""")
def gc_log_census(spark, d):
    return census.gc_census(_gc(spark, d))


#: The older format: regions are compartments; the last root of an address counts.
COMP_LOG = """SELECT 0 AS part, r_regionkey AS a, 0 AS b, 0 AS c, '0xf' || r_regionkey || ' ' || r_name AS value FROM region
UNION ALL SELECT 1, 0, 0, 0, '=========='
UNION ALL SELECT 2, s_suppkey, k, 0, '0xa' || s_suppkey || ' root ' || k FROM supplier CROSS JOIN (SELECT explode(array(1, 2)) AS k)
UNION ALL SELECT 3, 0, 0, 0, '=========='
UNION ALL SELECT 4, s_suppkey, 0, 0, '0xa' || s_suppkey || ' 0xf' || n_regionkey || ' Object ' || s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 5, c_custkey, 0, 0, '0xd' || c_custkey || ' 0xf' || n_regionkey || ' Object' FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 5, c_custkey, 1, 0, '> 0xa' || (c_custkey % 90) || ' held' FROM customer"""


def _comp(spark, d):
    return gc_log.read_gc_compartment_log(spark, _rendered(spark, d, "gc-comp", COMP_LOG))


@query("""SELECT '0xa' || s_suppkey AS addr, '0xf' || n_regionkey AS compartment, 'Object ' || s_name AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT '0xd' || c_custkey, '0xf' || n_regionkey, 'Object' FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def compartment_nodes(spark, d):
    return _comp(spark, d).nodes.select("addr", "compartment", "label")


@query("SELECT '0xf' || r_regionkey AS compartment, r_name AS name FROM region")
def compartment_names(spark, d):
    return gc_log.compartment_names(spark, _rendered(spark, d, "gc-comp", COMP_LOG))


@query("""SELECT '0xa' || s_suppkey AS addr, 'Object ' || s_name AS label, 'root 2' AS root_label FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1""")
def compartment_roots(spark, d):
    """The roots that point into one compartment."""
    return census.compartment_root_refs(_comp(spark, d), "0xf1").select("addr", "label", "root_label")


#: Zones are regions, arenas nations, things their suppliers; some arenas are empty.
ARENA_LOG = """SELECT 0 AS part, 0 AS a, 0 AS b, 0 AS c, '0xa1 B root' AS value
UNION ALL SELECT 1, 0, 0, 0, '=========='
UNION ALL SELECT 2, r_regionkey, -2, 0, '# zone 0xf' || r_regionkey FROM region
UNION ALL SELECT 2, r_regionkey, -1, 0, '# compartment ' || r_name || ' [in zone 0xf' || r_regionkey || ']' FROM region
UNION ALL SELECT 2, n_regionkey, n_nationkey, 0, '# arena allockind=' || n_nationkey || ' size=' || (8 * (1 + n_nationkey)) FROM nation
UNION ALL SELECT 2, n_regionkey, n_nationkey, 1 + s_suppkey, '0xa' || s_suppkey || ' B Object' FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 2, n_regionkey, n_nationkey, 1 + s_suppkey, '> 0xb' || s_suppkey || ' B x' FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


@query("""SELECT '0xf' || n_regionkey AS zone, n_nationkey AS alloc_kind, 8 * (1 + n_nationkey) AS thing_size, count(s_suppkey) AS num_things
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def arena_things(spark, d):
    z = gc_log.read_zones(spark, _rendered(spark, d, "gc-arena", ARENA_LOG))
    return z["arenas"].select("zone", "alloc_kind", "thing_size", "num_things")


@query("SELECT '0xf' || r_regionkey AS zone, r_name AS compartment FROM region")
def zone_compartments(spark, d):
    return gc_log.read_zones(spark, _rendered(spark, d, "gc-arena", ARENA_LOG))["compartments"]


#: A collector's log with results: negative customers are garbage, the others known.
CC_LOG = """SELECT 0 AS part, c_custkey AS a, 0 AS b, 0 AS c, '0xd' || c_custkey || ' [rc=' || (1 + c_custkey % 5) || '] nsDocument ' || c_mktsegment AS value FROM customer
UNION ALL SELECT 0, o_custkey, 1, o_orderkey, '> 0xc' || o_orderkey || ' mOrders[' || o_orderkey || ']' FROM orders
UNION ALL SELECT 1, o_orderkey, 0, 0, '0xc' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ' [gc.marked] ' ELSE ' [gc] ' END || 'JS Object' FROM orders
UNION ALL SELECT 2, c_custkey, 0, 0, 'IncrementalRoot 0xd' || c_custkey FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT 3, 0, 0, 0, '=========='
UNION ALL SELECT 4, c_custkey, 0, 0, '0xd' || c_custkey || CASE WHEN c_acctbal < 0 THEN ' [garbage]' ELSE ' [known=' || (c_custkey % 5) || ']' END FROM customer"""


@query("""SELECT '0xd' || c_custkey AS addr, CASE WHEN c_acctbal < 0 THEN 'garbage' ELSE 'known' END AS tag,
 CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey % 5 AS INT) END AS known FROM customer""")
def cc_log_results(spark, d):
    return cc_log.read_cc_log(spark, _rendered(spark, d, "cc", CC_LOG)).results.select("addr", "tag", "known")


@query("""SELECT '0xd' || c_custkey AS addr, 'rc' AS kind, CAST(1 + c_custkey % 5 AS INT) AS rc, CAST(NULL AS BOOLEAN) AS marked, 'nsDocument ' || c_mktsegment AS label FROM customer
UNION ALL SELECT '0xc' || o_orderkey, 'gc', NULL, o_orderkey % 3 = 0, 'JS Object' FROM orders""")
def cc_log_nodes(spark, d):
    """The projection that leaves out edges."""
    return cc_log.read_cc_nodes(spark, _rendered(spark, d, "cc", CC_LOG)).nodes.select("addr", "kind", "rc", "marked", "label")


@query("SELECT '0xd' || o_custkey AS src, '0xc' || o_orderkey AS dst, CAST(NULL AS VARCHAR) AS label FROM orders")
def cc_log_fast_edges(spark, d):
    return cc_log.read_cc_fast(spark, _rendered(spark, d, "cc", CC_LOG)).edges.select("src", "dst", "label")


@query("SELECT '0xd' || c_custkey AS addr FROM customer WHERE c_custkey % 11 = 0")
def cc_log_incremental_roots(spark, d):
    return cc_log.read_cc_log(spark, _rendered(spark, d, "cc", CC_LOG)).incr_roots.select("addr")


@query("SELECT 'N' || c_nationkey AS rep, 'C' || c_custkey AS member FROM customer")
def merge_file_members(spark, d):
    sql = "SELECT c_nationkey AS a, 'N' || c_nationkey || ' ' || array_join(array_sort(collect_list('C' || c_custkey)), ' ') AS value FROM customer GROUP BY c_nationkey"
    return cc_log.read_merge_file(spark, _rendered(spark, d, "merge", sql))


#: Records of both report formats: one per customer, its frames the segment and the nation.
BRACE = """SELECT c_custkey AS a, k AS b, CASE k WHEN 0 THEN 'Unreported {' WHEN 1 THEN '  ' || CASE WHEN c_custkey % 2 = 0 THEN '~' ELSE '' END || (2 + c_custkey) || ' blocks in heap block record ' || c_custkey || ' of 9'
 WHEN 2 THEN '  ~' || format_number(1000 * c_custkey, 0) || ' bytes (~5 requested / ~0 slop)' WHEN 3 THEN '  Allocated at {' WHEN 4 THEN '    in ' || c_mktsegment WHEN 5 THEN '    at nation ' || c_nationkey
 WHEN 6 THEN '  }' ELSE '}' END AS value FROM customer CROSS JOIN (SELECT explode(sequence(0, 7)) AS k)"""
RECORDS = """SELECT CAST(2 + c_custkey AS BIGINT) AS num_blocks, CAST(1000 * c_custkey AS BIGINT) AS num_bytes, 'in ' || c_mktsegment || '|at nation ' || c_nationkey AS frames FROM customer"""
DIVIDER = """SELECT 0 AS a, k AS b, CASE k WHEN 1 THEN 'Unreported stack trace records' ELSE '-----------------' END AS value FROM (SELECT explode(sequence(0, 2)) AS k)
UNION ALL SELECT 1 + c_custkey, k, CASE k WHEN 0 THEN 'Unreported: ' || (2 + c_custkey) || ' blocks in stack trace record ' || c_custkey || ' of 9'
 WHEN 1 THEN ' ~' || format_number(1000 * c_custkey, 0) || ' bytes (5 requested / 0 slop)' WHEN 2 THEN ' Allocated at' WHEN 3 THEN '   in ' || c_mktsegment ELSE '   at nation ' || c_nationkey END
 FROM customer CROSS JOIN (SELECT explode(sequence(0, 4)) AS k)"""


def _flat(records: DataFrame) -> DataFrame:
    return records.select("num_blocks", "num_bytes", F.array_join("frames", "|").alias("frames"))


@query(RECORDS)
def brace_report(spark, d):
    return _flat(dmd.read_diff_report(spark, _rendered(spark, d, "dmd", BRACE)))


@query(RECORDS)
def divider_report(spark, d):
    return _flat(dmd.read_divider_report(spark, _rendered(spark, d, "dmd", DIVIDER)))


@query("""SELECT 'C' || o_custkey AS block, string_agg('O' || o_orderkey, ' ' ORDER BY o_orderkey) AS contents FROM orders GROUP BY o_custkey""")
def block_graph_lines(spark, d):
    sql = "SELECT o_custkey AS a, 'C' || o_custkey || ' ' || array_join(transform(array_sort(collect_list(o_orderkey)), x -> 'O' || x), ' ') AS value FROM orders GROUP BY o_custkey"
    graph = dmd.read_block_graph(spark, _rendered(spark, d, "blocks", sql))
    return graph.select("block", F.array_join("contents", " ").alias("contents"))


@query("""SELECT n_name AS type, string_agg('S' || s_suppkey, ' ' ORDER BY s_suppkey) AS patterns FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name""")
def stack_types(spark, d):
    sql = """SELECT n_nationkey AS a, -1 AS b, '<' || n_name || '>' AS value FROM nation UNION ALL SELECT s_nationkey, s_suppkey, 'S' || s_suppkey FROM supplier"""
    return dmd.read_stack_types(spark, _rendered(spark, d, "types", sql)).select("type", F.array_join("patterns", " ").alias("patterns"))


def _block_report(spark, d) -> dict[str, DataFrame]:
    """One JSON document: blocks are orders, which hold the addresses of their parts; traces are customers' segments and nations."""
    parts = "SELECT l_orderkey AS k, transform(array_sort(collect_list(struct(l_linenumber, l_partkey))), x -> 'b' || x.l_partkey) AS contents FROM lineitem GROUP BY l_orderkey"
    sql = f"""SELECT 0 AS a, CAST(0 AS BIGINT) AS b, '{{"version":4,"invocation":{{"sampleBelowSize":1}},"blockList":[' AS value
UNION ALL SELECT 1, o_orderkey, CASE WHEN o_orderkey > (SELECT min(o_orderkey) FROM orders) THEN ',' ELSE '' END ||
 to_json(named_struct('addr', '0xC' || o_orderkey, 'req', 8 + o_orderkey, 'alloc', 'T' || (o_custkey % 25), 'contents', contents)) FROM orders LEFT JOIN ({parts}) ON k = o_orderkey
UNION ALL SELECT 2, 0, '],"traceTable":' || to_json(map_from_entries(collect_list(struct('T' || n_nationkey, array('F' || n_regionkey, 'G'))))) FROM nation
UNION ALL SELECT 3, 0, ',"frameTable":' || to_json(map_concat(map_from_entries(collect_list(struct('F' || r_regionkey, '#01: ' || r_name || ' (x.cpp:1)'))), map('G', '#02: main (y.cpp:2)'))) || '}}' FROM region"""
    return dmd.read_dmd_json(spark, _rendered(spark, d, "dmd-json", sql))


@query("""SELECT 'c' || o_orderkey AS addr, CAST(8 + o_orderkey AS BIGINT) AS req, 'T' || (o_custkey % 25) AS alloc,
 coalesce((SELECT string_agg('b' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS contents FROM orders""")
def block_report_blocks(spark, d):
    return _block_report(spark, d)["blocks"].select("addr", "req", "alloc", F.array_join("contents", " ").alias("contents"))


@query("SELECT 'T' || n_nationkey AS trace, r_name || ' (x.cpp:1)|main (y.cpp:2)' AS frames FROM nation JOIN region ON r_regionkey = n_regionkey")
def block_report_traces(spark, d):
    r = _block_report(spark, d)
    return blocks.trace_frames(r["traces"], r["frames"]).select("trace", F.array_join("frames", "|").alias("frames"))
