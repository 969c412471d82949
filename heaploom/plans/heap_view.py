"""A deterministic object graph over the star schema, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import DumpTables

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

HEAP_CTES = """edges AS (
  SELECT 'R'||n_regionkey AS src, 'N'||n_nationkey AS dst, 'mNations[i]' AS label FROM nation
  UNION ALL SELECT 'N'||s_nationkey, 'S'||s_suppkey, 'mSuppliers[i]' FROM supplier
  UNION ALL SELECT 'N'||c_nationkey, 'C'||c_custkey, 'mCustomers[i]' FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'C'||o_custkey, 'O'||o_orderkey, 'mOrders[i]' FROM orders
  UNION ALL SELECT 'O'||o_orderkey, 'C'||o_custkey, 'GetParent()' FROM orders
  UNION ALL SELECT 'O'||l_orderkey, 'P'||l_partkey, 'mParts[i]' FROM lineitem WHERE l_quantity <= 10
  UNION ALL SELECT 'P'||l_partkey, 'S'||l_suppkey, 'mSupplier' FROM lineitem WHERE l_quantity <= 2
  UNION ALL SELECT 'S'||l_suppkey, 'P'||l_partkey, 'mPart' FROM lineitem WHERE l_quantity = 1 AND l_linestatus = 'F'
),
objs AS (
  SELECT 'R'||r_regionkey AS addr, CAST(r_regionkey AS BIGINT) AS k, 'rc' AS kind, 'region' AS label FROM region
  UNION ALL SELECT 'N'||n_nationkey, CAST(n_nationkey AS BIGINT), 'rc', 'nation '||n_name FROM nation
  UNION ALL SELECT 'S'||s_suppkey, s_suppkey, 'gc', 'JS Object (Function - '||s_name||')' FROM supplier
  UNION ALL SELECT 'C'||c_custkey, c_custkey, 'rc', 'nsDocument '||c_mktsegment FROM customer
  UNION ALL SELECT 'P'||p_partkey, p_partkey, 'gc', 'JS Object ('||p_type||')' FROM part
  UNION ALL SELECT 'O'||o_orderkey, o_orderkey, 'rc', 'nsGenericElement (xhtml) '||o_orderpriority FROM orders
),
indeg AS (SELECT dst, COUNT(*) AS ic FROM edges GROUP BY dst),
nodes AS (
  SELECT addr, k, kind, label, COALESCE(ic, 0) AS ic,
         CASE WHEN kind = 'rc' THEN GREATEST(1, COALESCE(ic, 0) + CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END) END AS rc,
         CASE WHEN kind = 'gc' THEN k % 97 = 0 END AS marked
  FROM objs LEFT JOIN indeg ON indeg.dst = addr
)"""

WEAK_CTE = """weak AS (
  SELECT 'N'||c_nationkey AS map, 'S'||(c_custkey % 10) AS key,
         CASE WHEN c_custkey % 4 = 0 THEN 'R'||(c_custkey % 5) END AS key_delegate, 'C'||c_custkey AS value
  FROM customer WHERE c_acctbal < 0 AND c_custkey % 3 = 0
  UNION ALL SELECT 'N'||c_nationkey, 'C'||c_custkey, 'S'||(c_custkey % 10), 'P'||(c_custkey % 200)
  FROM customer WHERE c_acctbal < 0 AND c_custkey % 3 = 1
  UNION ALL SELECT NULL, 'S'||(c_custkey % 10), NULL, 'C'||c_custkey
  FROM customer WHERE c_acctbal < 0 AND c_custkey % 3 = 2
)"""

ROOTS_CTE = "roots AS (SELECT addr FROM nodes WHERE (kind = 'rc' AND rc > ic) OR marked)"


def sql_over(spark: SparkSession, sf_dir: str, ctes: str, tail: str) -> DataFrame:
    """Run SQL over the tables of sf_dir; tables are bound by path, so no view outlives the call."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"WITH {ctes} {tail}")


def heap_view(spark: SparkSession, sf_dir: str, weak: bool = False) -> DumpTables:
    """The graph: nodes (addr, k, kind, label, ic, rc, marked), edges (src, dst, label)."""
    return DumpTables(
        nodes=sql_over(spark, sf_dir, HEAP_CTES, "SELECT addr, k, kind, label, CAST(ic AS BIGINT) ic, CAST(rc AS INT) rc, marked FROM nodes"),
        edges=sql_over(spark, sf_dir, HEAP_CTES, "SELECT src, dst, label FROM edges"),
        weak_maps=sql_over(spark, sf_dir, WEAK_CTE, "SELECT map, key, key_delegate, value FROM weak") if weak else None,
    )


def heap_roots(g: DumpTables) -> DataFrame:
    return g.nodes.where("(kind = 'rc' AND rc > ic) OR marked").select("addr")
