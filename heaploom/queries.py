"""Registered queries over the heap view and the other tables, each with the SQL that says the same."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.labels import CC_CLASS_PREFIXES, HOLDER_CLASS_PREFIXES, cc_class, url_in
from .model import DumpTables
from .operators import blocks, census, components, dominators, predicates, search, traverse
from .plans.cut import shared_dir, written
from .plans.heap_view import HEAP_CTES, ROOTS_CTE, WEAK_CTE, heap_roots, heap_view
from .sinks import text as sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
H = "WITH " + HEAP_CTES
HR = "WITH RECURSIVE " + HEAP_CTES + ",\n" + ROOTS_CTE
LIVE = HR + """,
live(addr) AS (SELECT addr FROM roots UNION SELECT e.dst FROM live l JOIN edges e ON e.src = l.addr)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prefix_case(prefixes: list[str], label: str = "label") -> str:
    return " ".join(f"WHEN starts_with({label}, '{p}') THEN '{p}'" for p in prefixes)


CLASS_SQL = (
    "CASE WHEN starts_with(label, 'JS ObjectGroup') THEN 'JS ObjectGroup' "
    "WHEN starts_with(label, 'JS Object (Function') THEN 'JS Object (Function)' "
    "WHEN starts_with(label, 'JS Object (Object)') THEN 'JS Object (Object)' "
    "WHEN starts_with(label, 'JS Object') THEN 'JS Object (other)' " + _prefix_case(CC_CLASS_PREFIXES) + " ELSE label END"
)
HOLDER_SQL = "CASE " + _prefix_case(HOLDER_CLASS_PREFIXES) + " ELSE label END"


@query(H + f" SELECT {CLASS_SQL} AS class, count(*) AS n FROM nodes GROUP BY ALL HAVING count(*) >= 5 ORDER BY n DESC, class LIMIT 5")
def class_census(spark, d):
    return census.class_census(heap_view(spark, d).nodes)


@query(LIVE + f" SELECT {CLASS_SQL} AS class, count(*) AS n FROM nodes JOIN live USING (addr) GROUP BY ALL HAVING count(*) >= 5 ORDER BY n DESC, class LIMIT 5")
def live_class_census(spark, d):
    g = heap_view(spark, d)
    return census.class_census(g.nodes.join(traverse.reach(g.edges, heap_roots(g)), "addr", "left_semi"))


@query(H + r""" SELECT regexp_extract(label, '^JS Object \(Function - (.*)\)$', 1) AS class, count(*) AS n FROM nodes
WHERE starts_with(label, 'JS Object (Function') GROUP BY ALL ORDER BY n DESC, class LIMIT 40""")
def fn_census(spark, d):
    return census.function_census(heap_view(spark, d).nodes)


@query(H + " SELECT addr, CAST(rc AS INT) AS rc FROM nodes WHERE kind = 'rc' ORDER BY rc DESC, addr LIMIT 5")
def top_refcounts(spark, d):
    return census.top_refcounts(heap_view(spark, d).nodes)


@query(H + " SELECT CAST(rc AS INT) AS rc, count(*) AS n FROM nodes WHERE kind = 'rc' GROUP BY ALL")
def rc_histogram(spark, d):
    return census.rc_histogram(heap_view(spark, d).nodes)


@query(H + " SELECT count(*) FILTER (WHERE starts_with(label, 'nsDocument')) AS n, count(*) FILTER (WHERE starts_with(label, 'nsDocument')) > 10 AS alert FROM nodes")
def class_alert(spark, d):
    return census.class_alert(heap_view(spark, d).nodes, "nsDocument")


@query(H + """ SELECT s.label AS class, count(DISTINCT (e.src, e.dst)) AS n FROM edges e JOIN nodes t ON t.addr = e.dst JOIN nodes s ON s.addr = e.src
WHERE t.label = 'nsDocument BUILDING' GROUP BY ALL""")
def holders_of_class(spark, d):
    return census.holders_of_class(heap_view(spark, d), "nsDocument BUILDING")


@query(H + f""" SELECT {HOLDER_SQL} AS class, count(*) AS n FROM nodes n WHERE kind = 'rc' AND EXISTS (
SELECT 1 FROM edges e JOIN nodes t ON t.addr = e.dst WHERE e.src = n.addr AND t.kind = 'gc') GROUP BY ALL""")
def js_holders(spark, d):
    return census.js_holder_census(heap_view(spark, d))


@query(H + """ SELECT degree, count(*) AS n FROM (SELECT n.addr, count(e.dst) AS degree FROM nodes n LEFT JOIN edges e ON e.src = n.addr
WHERE n.label = 'nsDocument BUILDING' GROUP BY n.addr) GROUP BY degree""")
def degree_histogram(spark, d):
    return census.degree_histogram(heap_view(spark, d), "nsDocument BUILDING")


@query(H + """ SELECT greatest(0, c - 1) AS extra, count(*) AS n FROM (SELECT n.addr, count(e.dst) FILTER (WHERE e.label = 'mParts[i]') AS c
FROM nodes n LEFT JOIN edges e ON e.src = n.addr GROUP BY n.addr) GROUP BY ALL""")
def dup_edge_histogram(spark, d):
    return census.label_dup_histogram(heap_view(spark, d), "mParts[i]")


@query(H + " SELECT src, dst, count(*) AS n FROM edges GROUP BY src, dst")
def multigraph_counts(spark, d):
    return heap_view(spark, d).multigraph()


@query(H + " SELECT DISTINCT dst AS src, src AS dst FROM edges")
def single_graph_reverse(spark, d):
    return heap_view(spark, d).reversed().single()


@query(H + " SELECT count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges")
def graph_counts(spark, d):
    return census.graph_counts(heap_view(spark, d))


@query(H + """, s AS (SELECT DISTINCT src AS addr FROM edges), t AS (SELECT DISTINCT dst AS addr FROM edges)
SELECT 'source_only' AS side, count(*) AS n FROM s WHERE addr NOT IN (SELECT addr FROM t) HAVING count(*) > 0
UNION ALL SELECT 'target_only', count(*) FROM t WHERE addr NOT IN (SELECT addr FROM s) HAVING count(*) > 0
UNION ALL SELECT 'both', count(*) FROM s JOIN t USING (addr) HAVING count(*) > 0""")
def node_set_sides(spark, d):
    return census.node_set_sides(heap_view(spark, d))


@query(H + " SELECT addr, CAST(rc AS INT) AS rc, CAST(ic AS BIGINT) AS ic FROM nodes WHERE kind = 'rc'")
def internal_counts(spark, d):
    return census.internal_counts(heap_view(spark, d))


@query(H + " SELECT addr, CAST(rc AS INT) AS rc, CAST(ic AS BIGINT) AS ic FROM nodes WHERE kind = 'rc' AND rc > ic")
def rc_roots(spark, d):
    return census.rc_roots(heap_view(spark, d))


def _one_less(g: DumpTables) -> DumpTables:
    """Counts lowered by one, so that audits find something."""
    return DumpTables(g.nodes.withColumn("rc", (F.col("rc") - 1).cast("int")), g.edges)


@query(H + " SELECT addr, CAST(rc - 1 AS INT) AS rc, CAST(ic AS BIGINT) AS ic FROM nodes WHERE kind = 'rc' AND rc - 1 < ic")
def refcount_audit_all(spark, d):
    return census.refcount_audit(_one_less(heap_view(spark, d)))


@query(H + """ SELECT n.addr, CAST(n.rc - 1 AS INT) AS rc, CAST(count(s.addr) AS BIGINT) AS ic FROM nodes n
LEFT JOIN edges e ON e.dst = n.addr LEFT JOIN nodes s ON s.addr = e.src AND s.kind = 'rc'
WHERE n.kind = 'rc' GROUP BY n.addr, n.rc HAVING n.rc - 1 < count(s.addr)""")
def refcount_audit_rc_sources(spark, d):
    return census.refcount_audit(_one_less(heap_view(spark, d)), rc_sources_only=True)


@query(H + " SELECT addr FROM nodes WHERE kind = 'rc' AND rc <= ic AND ic = 1")
def single_parents(spark, d):
    return census.single_parents(heap_view(spark, d))


def _with_results(g: DumpTables) -> DumpTables:
    """Every fifth counted node has a known count, every seventh node is an incremental root."""
    results = g.nodes.where("kind = 'rc' and k % 5 = 0").select("addr", F.lit("known").alias("tag"), F.lit(1).alias("known"))
    return DumpTables(g.nodes, g.edges, incr_roots=g.nodes.where("k % 7 = 0").select("addr"), results=results)


@query(H + """ SELECT addr, CASE WHEN kind = 'rc' AND (k % 5 = 0 OR k % 7 = 0) THEN 'rcRoot' WHEN kind = 'gc' AND (marked OR k % 7 = 0) THEN 'gcRoot' ELSE 'stopNodeLabel' END AS root
FROM nodes WHERE (kind = 'rc' AND (k % 5 = 0 OR k % 7 = 0)) OR (kind = 'gc' AND (marked OR k % 7 = 0)) OR label = 'region'""")
def root_classification(spark, d):
    return predicates.select_roots(_with_results(heap_view(spark, d)), extra_class="region")


@query(H + """ SELECT addr, CASE WHEN kind = 'rc' THEN 'rcRoot' ELSE 'gcRoot' END AS root,
CASE WHEN kind = 'rc' THEN CASE WHEN k % 5 = 0 THEN CAST(rc - 1 AS INT) ELSE 0 END END AS unknown_edges, k % 7 = 0 AS is_incremental
FROM nodes WHERE (kind = 'rc' AND (k % 5 = 0 OR k % 7 = 0)) OR (kind = 'gc' AND (marked OR k % 7 = 0))""")
def root_explanations(spark, d):
    g = _with_results(heap_view(spark, d))
    return traverse.explain_roots(g, predicates.select_roots(g))


@query(H + """ SELECT 'rc_not_positive' AS violation, addr FROM nodes WHERE kind = 'rc' AND rc - 1 <= 0
UNION ALL SELECT DISTINCT 'range_outside_domain', dst FROM edges WHERE dst NOT IN (SELECT addr FROM nodes)""")
def wellformed_violations(spark, d):
    return predicates.wellformed(_one_less(heap_view(spark, d)))


@query(H + " SELECT addr FROM nodes WHERE starts_with(label, 'nsDocument A')")
def targets_by_prefix(spark, d):
    return predicates.select_targets(heap_view(spark, d), "nsDocument A")


def _edges_of(g: DumpTables) -> DataFrame:
    return g.edges.select("src", "dst", "label")


@query(H + """ SELECT src, dst, label FROM edges WHERE src NOT IN (SELECT addr FROM nodes WHERE marked) AND dst NOT IN (SELECT addr FROM nodes WHERE marked)""")
def prune_marked(spark, d):
    return _edges_of(predicates.prune_marked(heap_view(spark, d)))


@query(H + """ SELECT src, dst, label FROM edges WHERE src NOT IN (SELECT addr FROM nodes WHERE kind = 'gc') AND dst NOT IN (SELECT addr FROM nodes WHERE kind = 'gc')""")
def prune_js(spark, d):
    return _edges_of(predicates.prune_js(heap_view(spark, d)))


@query(H + """ SELECT src, dst, label FROM edges WHERE src NOT IN (SELECT addr FROM nodes WHERE kind = 'rc') AND dst NOT IN (SELECT addr FROM nodes WHERE kind = 'rc')""")
def prune_non_js(spark, d):
    return _edges_of(predicates.prune_non_js(heap_view(spark, d)))


@query(H + """, near AS (SELECT src AS addr FROM edges JOIN nodes ON addr = dst WHERE kind = 'gc' UNION SELECT dst FROM edges JOIN nodes ON addr = src WHERE kind = 'gc')
SELECT addr FROM nodes WHERE kind = 'gc' OR addr IN (SELECT addr FROM near)""")
def prune_non_js_border(spark, d):
    return predicates.prune_non_js_border(heap_view(spark, d)).nodes.select("addr")


@query(H + " SELECT addr FROM nodes WHERE addr IN (SELECT src FROM edges)")
def prune_childless(spark, d):
    return predicates.prune_childless(heap_view(spark, d)).nodes.select("addr")


@query(H + """ SELECT src, dst, min(label) AS first_label FROM edges GROUP BY src, dst HAVING min(label) NOT IN ('mNodeInfo', 'GetParent()', 'mOwnerManager')""")
def prune_edge_labels(spark, d):
    return predicates.prune_edge_labels(heap_view(spark, d))


@query(LIVE + " SELECT addr FROM live")
def live_nodes(spark, d):
    g = heap_view(spark, d)
    return traverse.reach(g.edges, heap_roots(g))


@query(LIVE + " SELECT addr FROM nodes WHERE addr NOT IN (SELECT addr FROM live)")
def garbage_nodes(spark, d):
    return traverse.collect_cycles(heap_view(spark, d))[0]


@query(LIVE + """, garbage AS (SELECT addr FROM nodes WHERE addr NOT IN (SELECT addr FROM live)),
logged AS (SELECT addr FROM nodes WHERE k % 3 = 0 AND kind = 'rc'), known AS (SELECT addr FROM nodes WHERE kind = 'rc' AND rc > ic)
SELECT n.addr, CASE WHEN g.addr IS NOT NULL AND l.addr IS NULL THEN 'garbage_only_ours' WHEN g.addr IS NULL AND l.addr IS NOT NULL THEN 'garbage_only_logged'
 ELSE 'root_only_ours' END AS problem
FROM nodes n LEFT JOIN garbage g USING (addr) LEFT JOIN logged l USING (addr) LEFT JOIN known k USING (addr)
WHERE (g.addr IS NULL) <> (l.addr IS NULL) OR k.addr IS NOT NULL""")
def collector_check(spark, d):
    g = heap_view(spark, d)
    garbage, known = traverse.collect_cycles(g)
    logged = g.nodes.where("k % 3 = 0 and kind = 'rc'").select("addr", F.lit("garbage").alias("tag"), F.lit(None).cast("int").alias("known"))
    return traverse.check_results(garbage, known, logged)


DIST = HR + """,
dist(addr, d) USING KEY (addr) AS (
  SELECT addr, 0 FROM roots
  UNION
  SELECT e.dst, min(x.d + 1) FROM dist x JOIN edges e ON e.src = x.addr LEFT JOIN recurring.dist r ON r.addr = e.dst WHERE r.addr IS NULL GROUP BY e.dst
)"""


@query(DIST + " SELECT addr, CAST(d AS INT) AS d FROM dist")
def root_distances(spark, d):
    g = heap_view(spark, d)
    return traverse.distances(g.edges, heap_roots(g)).select("addr", "d")


WEAK_DIST = HR + ",\n" + WEAK_CTE + """,
dist(addr, d) USING KEY (addr) AS (
  SELECT addr, 0 FROM roots
  UNION
  SELECT s.addr, min(s.d) FROM (
    SELECT e.dst AS addr, x.d + 1 AS d FROM dist x JOIN edges e ON e.src = x.addr
    UNION ALL
    SELECT w.value, greatest(m.d, k.d) + 1 FROM weak w JOIN recurring.dist m ON m.addr = w.map JOIN recurring.dist k ON k.addr = w.key
    UNION ALL
    SELECT w.key, greatest(m.d, k.d) + 1 FROM weak w JOIN recurring.dist m ON m.addr = w.map JOIN recurring.dist k ON k.addr = w.key_delegate
  ) s LEFT JOIN recurring.dist r ON r.addr = s.addr WHERE r.addr IS NULL GROUP BY s.addr
)"""


@query(WEAK_DIST + " SELECT addr, CAST(d AS INT) AS d FROM dist")
def distances_with_weak_maps(spark, d):
    g = heap_view(spark, d, weak=True)
    return traverse.distances(g.edges, heap_roots(g), g.weak_maps).select("addr", "d")


@query(DIST + """,
parent AS (SELECT e.dst AS addr, min(e.src) AS parent FROM edges e JOIN dist a ON a.addr = e.src JOIN dist b ON b.addr = e.dst WHERE b.d = a.d + 1 GROUP BY e.dst),
climb(target, addr, d) AS (
  SELECT addr, addr, d FROM dist JOIN nodes USING (addr) WHERE starts_with(label, 'JS Object (')
  UNION ALL SELECT c.target, p.parent, c.d - 1 FROM climb c JOIN parent p ON p.addr = c.addr WHERE c.d > 0
)
SELECT target, CAST(d AS INT) AS hop, addr FROM climb""")
def class_path_nodes(spark, d):
    """Shortest root paths to a whole class."""
    return _class_paths(heap_view(spark, d)).select("target", "hop", "addr")


def _class_paths(g: DumpTables, target: str = "JS Object (") -> DataFrame:
    dist = written(traverse.distances(g.edges, heap_roots(g)), "dist")
    return traverse.root_paths(dist, predicates.select_targets(g, target))


PARENT = WEAK_DIST + """,
steps AS (
  SELECT e.dst AS addr, 0 AS rank, e.src AS parent, CAST(NULL AS VARCHAR) AS map FROM edges e JOIN dist a ON a.addr = e.src JOIN dist b ON b.addr = e.dst WHERE b.d = a.d + 1
  UNION ALL SELECT w.value, 1, w.key, w.map FROM weak w JOIN dist m ON m.addr = w.map JOIN dist k ON k.addr = w.key JOIN dist v ON v.addr = w.value WHERE v.d = greatest(m.d, k.d) + 1
  UNION ALL SELECT w.key, 2, w.key_delegate, w.map FROM weak w JOIN dist m ON m.addr = w.map JOIN dist k ON k.addr = w.key_delegate JOIN dist v ON v.addr = w.key WHERE v.d = greatest(m.d, k.d) + 1
), parent AS (
  SELECT s.addr, s.parent, s.map FROM (SELECT *, row_number() OVER (PARTITION BY addr ORDER BY rank, parent, map) AS r FROM steps) s JOIN dist USING (addr) WHERE r = 1 AND d > 0
)"""


@query(PARENT + """,
climb(target, addr) AS (
  SELECT addr, addr FROM dist JOIN nodes USING (addr) WHERE starts_with(label, 'nsDocument')
  UNION
  SELECT CASE WHEN k = 0 THEN c.target ELSE p.map END, CASE WHEN k = 0 THEN p.parent ELSE p.map END
  FROM climb c JOIN parent p ON p.addr = c.addr, (VALUES (0), (1)) two(k) WHERE k = 0 OR p.map IS NOT NULL
)
SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY d) - 1 AS INT) AS hop, c.addr, CASE WHEN d > 0 THEN p.map END AS via_map
FROM climb c JOIN dist USING (addr) LEFT JOIN parent p ON p.addr = c.addr""")
def find_roots_with_weak_maps(spark, d):
    """Shortest root paths of all documents, and of the weak maps that keep them alive."""
    g = heap_view(spark, d, weak=True)
    return search.find_roots(g, "nsDocument", heap_roots(g)).paths


@query(DIST + """ SELECT n.addr AS target, e.src AS addr, e.label AS edge_label FROM nodes n LEFT JOIN edges e ON e.dst = n.addr
WHERE starts_with(n.label, 'nsDocument') AND n.addr NOT IN (SELECT addr FROM dist)""")
def find_roots_unreached(spark, d):
    """Documents without a root path, and what points at them."""
    g = heap_view(spark, d)
    return search.find_roots(g, "nsDocument", heap_roots(g)).unreached


@query(HR + """,
back(addr, d) USING KEY (addr) AS (
  SELECT addr, 0 FROM nodes WHERE starts_with(label, 'JS Object (Function')
  UNION
  SELECT e.src, min(x.d + 1) FROM back x JOIN edges e ON e.dst = x.addr LEFT JOIN recurring.back r ON r.addr = e.src
  WHERE r.addr IS NULL AND (x.d = 0 OR x.addr NOT IN (SELECT addr FROM roots)) GROUP BY e.src
),
next AS (SELECT e.src AS addr, min(e.dst) AS next FROM edges e JOIN back a ON a.addr = e.src JOIN back b ON b.addr = e.dst
  WHERE a.d = b.d + 1 AND (b.d = 0 OR b.addr NOT IN (SELECT addr FROM roots)) GROUP BY e.src),
way(target, addr, hop) AS (
  SELECT addr, addr, 0 FROM back JOIN roots USING (addr)
  UNION ALL SELECT w.target, n.next, w.hop + 1 FROM way w JOIN next n ON n.addr = w.addr JOIN back b ON b.addr = w.addr WHERE b.d > 0
)
SELECT target, CAST(hop AS INT) AS hop, addr FROM way""")
def find_every_root(spark, d):
    """A way from every root that reaches a function."""
    g = heap_view(spark, d)
    return search.find_roots(g, "JS Object (Function", heap_roots(g), every_root=True).paths.select("target", "hop", "addr")


@query(H + """ SELECT label, count(*) AS n FROM (SELECT src, dst, min(label) AS label FROM edges GROUP BY src, dst) WHERE label IN ('mNodeInfo', 'GetParent()', 'mOwnerManager') GROUP BY label""")
def pruned_label_counts(spark, d):
    return predicates.pruned_label_counts(heap_view(spark, d))


@query(HR + """,
back(addr) AS (SELECT 'S1' UNION SELECT e.src FROM back b JOIN edges e ON e.dst = b.addr)
SELECT addr FROM back JOIN roots USING (addr)""")
def roots_reaching_target(spark, d):
    g = heap_view(spark, d)
    target = spark.createDataFrame([("S1",)], "addr string")
    return traverse.roots_reaching(g.edges, heap_roots(g), target, stop_at_roots=False).select("addr")


@query(HR + """,
fore(addr) AS (SELECT 'S1' UNION SELECT e.dst FROM fore b JOIN edges e ON e.src = b.addr),
back(addr) AS (SELECT 'S1' UNION SELECT e.src FROM back b JOIN edges e ON e.dst = b.addr)
SELECT addr FROM fore JOIN back USING (addr)""")
def cycle_friends(spark, d):
    return traverse.cycle_friends(heap_view(spark, d).edges, "S1")


SCC = HR + """,
ge AS (SELECT DISTINCT e.src, e.dst FROM edges e JOIN nodes s ON s.addr = e.src AND s.kind = 'gc' JOIN nodes t ON t.addr = e.dst AND t.kind = 'gc'),
pairs(a, b) AS (SELECT src, dst FROM ge UNION SELECT p.a, e.dst FROM pairs p JOIN ge e ON e.src = p.b),
scc AS (SELECT n.addr, least(n.addr, coalesce(min(p.b), n.addr)) AS rep FROM nodes n
  LEFT JOIN (SELECT x.a, x.b FROM pairs x JOIN pairs y ON y.a = x.b AND y.b = x.a) p ON p.a = n.addr WHERE n.kind = 'gc' GROUP BY n.addr)"""


@query(SCC + " SELECT addr, rep FROM scc")
def gc_scc(spark, d):
    return components.gc_components(heap_view(spark, d))


@query(SCC + " SELECT size, count(*) AS n FROM (SELECT rep, count(*) AS size FROM scc GROUP BY rep) GROUP BY size")
def scc_size_histogram(spark, d):
    return components.size_histogram(components.gc_components(heap_view(spark, d)))


@query(SCC + """ SELECT DISTINCT coalesce(a.rep, e.src) AS src, coalesce(b.rep, e.dst) AS dst FROM edges e LEFT JOIN scc a ON a.addr = e.src LEFT JOIN scc b ON b.addr = e.dst
WHERE coalesce(a.rep, e.src) <> coalesce(b.rep, e.dst)""")
def contracted_edges(spark, d):
    g = heap_view(spark, d)
    return components.contract(g.edges, components.gc_components(g))


GARBAGE_GRAPH = LIVE + """,
gn AS (SELECT * FROM nodes WHERE addr NOT IN (SELECT addr FROM live)),
ge AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT addr FROM gn) AND dst IN (SELECT addr FROM gn) AND src <> dst),
und AS (SELECT src AS a, dst AS b FROM ge UNION SELECT dst, src FROM ge),
flood(addr, r) AS (SELECT addr, addr FROM gn UNION SELECT u.b, f.r FROM flood f JOIN und u ON u.a = f.addr),
comp AS (SELECT addr, min(r) AS rep FROM flood GROUP BY addr)"""


def _garbage_graph(spark, d) -> DumpTables:
    g = heap_view(spark, d)
    live = traverse.reach(g.edges, heap_roots(g))
    return g.without(live)


@query(GARBAGE_GRAPH + " SELECT addr, rep FROM comp")
def garbage_components(spark, d):
    g = _garbage_graph(spark, d)
    return components.connected_components(g.nodes, g.edges)


@query(GARBAGE_GRAPH + f""", k AS (SELECT rep, array_to_string(list_sort(list({CLASS_SQL})), ' + ') AS keys FROM comp JOIN gn USING (addr)
 GROUP BY rep HAVING count(*) <= 3), e AS (SELECT rep, count(*) AS n FROM ge JOIN comp ON comp.addr = ge.src GROUP BY rep)
SELECT keys || ' / ' || coalesce(e.n, 0) AS motif, count(*) AS n FROM k LEFT JOIN e USING (rep) GROUP BY ALL""")
def component_motifs(spark, d):
    g = _garbage_graph(spark, d)
    return components.motifs(g, components.connected_components(g.nodes, g.edges), cc_class("label"))


@query(HR + """,
parent AS (SELECT src AS addr, min(dst) AS parent FROM edges WHERE label = 'GetParent()' GROUP BY src),
climb(addr, top) AS (SELECT addr, addr FROM nodes UNION ALL SELECT c.addr, p.parent FROM climb c JOIN parent p ON p.addr = c.top)
SELECT addr, top FROM climb WHERE top NOT IN (SELECT addr FROM parent)""")
def topmost_parent(spark, d):
    g = heap_view(spark, d)
    return components.topmost_parent(g.nodes, components.first_parents(g.edges))


@query(LIVE + """,
parent AS (SELECT src AS addr, min(dst) AS parent FROM edges WHERE label = 'GetParent()' GROUP BY src),
tops AS (SELECT addr, coalesce(parent, addr) AS top FROM nodes LEFT JOIN parent USING (addr))
SELECT t.top, count(*) AS n, CAST(NULL AS VARCHAR) AS doc, t.top NOT IN (SELECT addr FROM live) AS is_garbage FROM tops t GROUP BY t.top""")
def dom_groups(spark, d):
    g = heap_view(spark, d)
    garbage, _ = traverse.collect_cycles(g)
    return components.dom_groups(g, garbage)


@query(HR + """,
back(addr) AS (SELECT addr FROM nodes WHERE kind = 'rc' UNION SELECT e.src FROM back b JOIN edges e ON e.dst = b.addr)
SELECT addr FROM nodes WHERE kind = 'gc' AND addr NOT IN (SELECT addr FROM back)""")
def green_nodes(spark, d):
    return traverse.green_nodes(heap_view(spark, d))


@query(H + """, s AS (SELECT DISTINCT src, dst FROM edges),
r0 AS (SELECT addr FROM nodes WHERE addr NOT IN (SELECT src FROM s)), e1 AS (SELECT * FROM s WHERE dst NOT IN (SELECT addr FROM r0)),
r1 AS (SELECT addr FROM nodes WHERE addr NOT IN (SELECT addr FROM r0) AND addr NOT IN (SELECT src FROM e1)), e2 AS (SELECT * FROM e1 WHERE dst NOT IN (SELECT addr FROM r1)),
r2 AS (SELECT addr FROM nodes WHERE addr NOT IN (SELECT addr FROM r0) AND addr NOT IN (SELECT addr FROM r1) AND addr NOT IN (SELECT src FROM e2))
SELECT addr, 0 AS rank FROM r0 UNION ALL SELECT addr, 1 FROM r1 UNION ALL SELECT addr, 2 FROM r2""")
def acyclic_rank(spark, d):
    return components.acyclic_ranks(heap_view(spark, d))


@query(H + """, s AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), one AS (SELECT src, min(dst) AS dst FROM s GROUP BY src HAVING count(*) = 1)
SELECT a.src AS a, a.dst AS b FROM one a JOIN one b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst""")
def tiny_loops(spark, d):
    return components.tiny_loops(heap_view(spark, d))


@query(H + """, s AS (SELECT DISTINCT src, dst FROM edges), o AS (SELECT src AS addr, list_sort(list(dst)) AS o FROM s GROUP BY src),
i AS (SELECT dst AS addr, list_sort(list(src)) AS i FROM s GROUP BY dst)
SELECT min(addr) AS rep, count(*) AS n FROM nodes LEFT JOIN o USING (addr) LEFT JOIN i USING (addr) WHERE o IS NOT NULL OR i IS NOT NULL
GROUP BY kind, label, o, i HAVING count(*) > 1""")
def dup_nodes(spark, d):
    return components.duplicate_nodes(heap_view(spark, d))


@query("""SELECT vec_id, value, CAST(8 * (pos - 1) AS BIGINT) AS "offset" FROM (SELECT vec_id, unnest(embedding) AS value, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)""")
def neighbour_offsets(spark, d):
    return blocks.element_offsets(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("""SELECT lang AS type, n_chars AS length, text, n, total FROM (SELECT lang, n_chars, text AS whole, substr(text, 1, 100) AS text, count(*) AS n, count(*) * n_chars AS total
FROM documents GROUP BY lang, n_chars, text ORDER BY total DESC, n DESC, whole DESC LIMIT 20)""")
def string_dups(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("type"), F.col("n_chars").alias("length"), "text")
    return census.string_census(docs)


@query(H + " SELECT src, dst, label FROM edges")
def log_roundtrip_edges(spark, d):
    """The heap view written as a log and parsed again."""
    from .sources.cc_log import read_cc_log

    g = heap_view(spark, d)
    path = f"{shared_dir(spark)}/log-{tempfile.mktemp(dir='', prefix='').strip('/')}"
    sinks.write_lines(sinks.log_lines(g), path)
    return read_cc_log(spark, path).edges.select("src", "dst", "label")


@query("""SELECT user_id, arg_min(event_type, event_id) AS label, min(event_id) AS ord,
 min(event_id) < (SELECT min(event_id) FROM events WHERE event_type = 'error') AS is_black FROM events GROUP BY user_id""")
def first_root_wins(spark, d):
    """Roots from the event stream: the first event of a user counts; black until the first error."""
    from .sources.gc_log import ordered_roots

    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("addr"), F.when(F.col("event_type") == "error", "mCallback").otherwise(F.col("event_type")).alias("label"), F.col("event_id").alias("ord"))
    out = ordered_roots(rows)
    return out.select(F.col("addr").cast("long").alias("user_id"), F.when(F.col("label") == "mCallback", "error").otherwise(F.col("label")).alias("label"), "ord", "is_black")


@query("""SELECT p_brand, p_type, n, rank FROM (SELECT p_brand, p_type, count(*) AS n, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS INT) AS rank
FROM part GROUP BY p_brand, p_type) WHERE rank <= 3""")
def topn_per_category(spark, d):
    c = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return census.top_n_per(c, "p_brand", "n", "p_type", 3)


def _report(spark, d, later: bool) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    half = F.col("l_shipdate") >= F.lit("1995-06-01").cast("timestamp")
    r = li.where(half if later else ~half).groupBy("l_returnflag", "l_linestatus", "p_type").agg(F.count("*").alias("num_blocks"), F.sum(F.col("l_quantity").cast("long")).alias("num_bytes"))
    return r.select("num_blocks", "num_bytes", F.array("l_returnflag", "l_linestatus", "p_type").alias("frames"))


@query("""WITH r AS (SELECT l_shipdate >= TIMESTAMP '1995-06-01' AS later, l_returnflag || '{' || l_linestatus || '{' || p_type AS stack, count(*) AS b, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT n.stack, CAST(n.b - coalesce(o.b, 0) AS BIGINT) AS blocks, CAST(n.q - coalesce(o.q, 0) AS BIGINT) AS bytes FROM r n LEFT JOIN r o ON o.stack = n.stack AND NOT o.later
WHERE n.later AND n.q - coalesce(o.q, 0) > 0 ORDER BY bytes DESC, n.stack LIMIT 4""")
def report_diff(spark, d):
    out = blocks.report_diff(_report(spark, d, False), _report(spark, d, True))
    return out.select(F.array_join("frames", "{").alias("stack"), "blocks", "bytes")


@query("""SELECT p_brand AS zone, CAST((100 * (4096 - p_size * c)) // 4096 // 5 * 5 AS BIGINT) AS unused_percent, count(*) AS n
FROM (SELECT p_brand, p_size, p_type, count(*) AS c FROM part GROUP BY ALL) GROUP BY ALL""")
def arena_buckets(spark, d):
    arenas = table(spark, d, "part").groupBy(F.col("p_brand").alias("zone"), F.col("p_size").alias("thing_size"), "p_type").agg(F.count("*").alias("num_things"))
    return census.arena_utilisation(arenas)


@query("""SELECT page_id, CASE WHEN contains(url, 'http') THEN substr(url, strpos(url, 'http')) WHEN contains(url, 'chrome') THEN substr(url, strpos(url, 'chrome'))
WHEN contains(url, 'about') THEN substr(url, strpos(url, 'about')) ELSE url END AS url FROM (SELECT page_id, 'nsDocument normal ' || url AS url FROM pages)""")
def url_extract(spark, d):
    return table(spark, d, "pages").select("page_id", url_in(F.concat(F.lit("nsDocument normal "), "url")).alias("url"))


@query(H + f", {WEAK_CTE} SELECT DISTINCT key AS src, value AS dst FROM weak WHERE key_delegate IS NULL AND key IS NOT NULL AND value IS NOT NULL AND map IS NULL")
def weak_maps_as_edges(spark, d):
    return traverse.weak_maps_as_edges(heap_view(spark, d, weak=True).weak_maps).distinct()


@query(H + """, gc AS (SELECT addr FROM nodes WHERE kind = 'gc'), c AS (SELECT 'R' || (k % 5) AS comp, addr FROM nodes)
SELECT e.src, e.dst, a.comp AS src_comp FROM edges e JOIN c a ON a.addr = e.src JOIN c b ON b.addr = e.dst WHERE b.comp = 'R1' AND a.comp <> 'R1'""")
def cross_compartment_edges(spark, d):
    g = heap_view(spark, d)
    n = g.nodes.withColumn("compartment", F.concat(F.lit("R"), (F.col("k") % 5).cast("string")))
    return census.cross_compartment_edges(DumpTables(n, g.edges), "R1").select("src", "dst", "src_comp")


@query(HR + """,
near(addr, d) USING KEY (addr) AS (
  SELECT addr, 0 FROM nodes WHERE label = 'nation ' || 'FRANCE' OR starts_with(label, 'region')
  UNION
  SELECT e.dst, min(x.d + 1) FROM near x JOIN edges e ON e.src = x.addr LEFT JOIN recurring.near r ON r.addr = e.dst WHERE r.addr IS NULL AND x.d < 2 GROUP BY e.dst
) SELECT addr, CAST(d AS INT) AS d FROM near""")
def neighbourhood(spark, d):
    g = heap_view(spark, d)
    start = g.nodes.where("label = 'nation FRANCE' or label like 'region%'").select("addr")
    return traverse.distances(g.edges, start, max_depth=2).select("addr", "d")


@query()
def root_path_lines(spark, d):
    """Rendered paths (text has no SQL twin; its nodes are class_path_nodes)."""
    g = heap_view(spark, d)
    paths = written(_class_paths(g), "paths")
    return sinks.path_lines(sinks.path_table(paths, g))


@query()
def garbage_dot(spark, d):
    g = _garbage_graph(spark, d)
    return sinks.dot_lines(g, garbage=g.nodes.select("addr")).select("value")


def _heap_dominators(spark, d) -> tuple[DumpTables, DataFrame]:
    g = heap_view(spark, d)
    return g, dominators.dominator_sets(g.edges, heap_roots(g))


@query()
def heap_dominators(spark, d):
    """Dominators in the whole heap (removing every node is too slow in SQL; tests do it)."""
    return _heap_dominators(spark, d)[1].select("addr", F.explode("dom").alias("dominator"))


@query()
def heap_retained_sizes(spark, d):
    g, dom = _heap_dominators(spark, d)
    return dominators.retained_sizes(dom, g.nodes)


@query()
def heap_dominator_tree(spark, d):
    return dominators.dominator_tree(_heap_dominators(spark, d)[1])


@query()
def dominator_lines(spark, d):
    g, dom = _heap_dominators(spark, d)
    return sinks.tree_lines(dominators.dominator_tree(dom), dominators.retained_sizes(dom, g.nodes), g.nodes, at_least=16).select("value")
