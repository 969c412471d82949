"""Cycle-collector logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import null_address
from ..model import DumpTables
from ..plans.cut import written
from .lines import fill_down, read_lines, sections

# The line formats of cycle-collector logs.
NODE = r"^([a-zA-Z0-9]+) \[(rc=[0-9]+|gc(?:\.marked)?)\] (.*)$"
EDGE = r"^> ([a-zA-Z0-9]+) (.*)$"
WEAK = (
    r"^WeakMapEntry map=([a-zA-Z0-9]+|\(nil\)) key=([a-zA-Z0-9]+|\(nil\)) "
    r"keyDelegate=([a-zA-Z0-9]+|\(nil\)) value=([a-zA-Z0-9]+)$"
)
INCREMENTAL = r"^IncrementalRoot ([a-zA-Z0-9]+)$"
RESULT = r"^([a-zA-Z0-9]+) \[([a-z0-9=]+)\]\w*"
# End of fixed values.


def weak_maps_of(lines: DataFrame) -> DataFrame:
    """(map, key, key_delegate, value, ord) of weak map lines, null addresses as null."""
    part = [F.regexp_extract("value", WEAK, i) for i in range(1, 5)]
    names = ["map", "key", "key_delegate", "value"]
    return lines.where(F.col("value").rlike(WEAK)).select(*[null_address(p).alias(n) for p, n in zip(part, names)], "ord")


def read_cc_log(spark: SparkSession, path: str, labels: bool = True, edges: bool = True, positional_roots: bool = False) -> DumpTables:
    """Parse a log (a file, gzipped or not).  labels=False and edges=False prune what an analysis doesn't need.

    Lines that no format fits, comments apart, are in corrupt.  With positional_roots, the first two lines hold root counts
    and are no corrupt lines (root_counts reads them).
    """
    lines = sections(read_lines(spark, path))
    body = lines.where((F.col("section") == 0) & ~F.col("is_mark"))
    if positional_roots:
        body = body.where("ord >= 2")
    tag = F.regexp_extract("value", NODE, 2)
    nodes = body.where(F.col("value").rlike(NODE) & ~F.col("value").startswith(">")).select(
        F.regexp_extract("value", NODE, 1).alias("addr"),
        F.when(tag.startswith("rc="), "rc").otherwise("gc").alias("kind"),
        F.when(tag.startswith("rc="), F.substring(tag, 4, 12).try_cast("int")).alias("rc"),
        F.when(~tag.startswith("rc="), tag == "gc.marked").alias("marked"),
        F.regexp_extract("value", NODE, 3).alias("label"),
        "ord",
    )
    header = F.when(~F.col("value").startswith(">") & F.col("value").rlike(NODE), F.regexp_extract("value", NODE, 1))
    if edges:
        owned = fill_down(body, {"src": header})
        found = owned.where(F.col("value").startswith(">") & F.col("value").rlike(EDGE)).select(
            "src",
            F.regexp_extract("value", EDGE, 1).alias("dst"),
            (F.regexp_extract("value", EDGE, 2) if labels else F.lit(None).cast("string")).alias("label"),
            "ord",
        )
        found = written(found, "edges")
    else:
        found = spark.createDataFrame([], "src string, dst string, label string, ord long")
    value = F.col("value")
    known = value.rlike(NODE) | value.rlike(EDGE) | value.rlike(WEAK) | value.rlike(INCREMENTAL) | value.startswith("#")
    return DumpTables(
        nodes=written(nodes, "nodes"),
        edges=found,
        weak_maps=weak_maps_of(body),
        incr_roots=body.where(value.rlike(INCREMENTAL)).select(F.regexp_extract("value", INCREMENTAL, 1).alias("addr"), "ord"),
        results=results_of(lines.where("section >= 1 and not is_mark")),
        corrupt=body.where(~known & (value != "")).select("ord", "value"),
    )


def read_cc_nodes(spark: SparkSession, path: str) -> DumpTables:
    """The projection without edges."""
    return read_cc_log(spark, path, edges=False)


def read_cc_fast(spark: SparkSession, path: str) -> DumpTables:
    """The projection without edge labels."""
    return read_cc_log(spark, path, labels=False)


def results_of(lines: DataFrame) -> DataFrame:
    """(addr, tag, known, ord) of the result section; the null address may repeat."""
    tag = F.regexp_extract("value", RESULT, 2)
    rows = lines.where(F.col("value").rlike(RESULT)).where((tag == "garbage") | tag.rlike("^known=[0-9]+$"))
    return rows.select(
        F.regexp_extract("value", RESULT, 1).alias("addr"),
        F.when(tag == "garbage", "garbage").otherwise("known").alias("tag"),
        F.when(tag != "garbage", F.substring(tag, 7, 12).try_cast("int")).alias("known"),
        "ord",
    )


def root_counts(spark: SparkSession, path: str) -> DataFrame:
    """(purple, xpc): the two counts that the experimental header holds."""
    first = read_lines(spark, path).where("ord < 2").select("ord", F.regexp_extract("value", "([0-9]+)", 1).try_cast("int").alias("n"))
    return first.agg(F.max(F.when(F.col("ord") == 0, F.col("n"))).alias("purple"), F.max(F.when(F.col("ord") == 1, F.col("n"))).alias("xpc"))


def read_merge_file(spark: SparkSession, path: str) -> DataFrame:
    """(rep, member) of `rep m1 m2 ...` lines."""
    words = F.split(F.trim("value"), r"\s+")
    rows = read_lines(spark, path).where(F.trim("value") != "").select(words.alias("w"))
    return rows.select(F.col("w")[0].alias("rep"), F.explode(F.slice("w", 2, F.size("w"))).alias("member"))


def read_log(spark: SparkSession, path: str) -> DumpTables:
    """Dispatch by the file's name: cc... and incomplete-cc..., gc... and incomplete-gc..."""
    from .gc_log import read_gc_log

    name = path.rstrip("/").rpartition("/")[2].removeprefix("incomplete-")
    if name.startswith("cc"):
        return read_cc_log(spark, path)
    if name.startswith("gc"):
        return read_gc_log(spark, path)
    raise ValueError(f"neither a cc nor a gc log: {path}")
