"""Ordered lines of log files, without a single task that sees a whole file.

A line's place is the block of the file it was read in and its place there.  What belongs to the last header above a
line is filled in within blocks; the last header of each block, one row per block, is carried into the
blocks that follow and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.cut import written


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", start: str | None = None) -> DataFrame:
    """(log_id, block, ord, value): lines of files, ord counting from 0 within a file.

    The part files of a folder that Spark wrote (write_lines) are one log, in the order of their names.  Gzip files are one block.  latin-1 files are read through the csv source, which drops blank lines.

    With start, UTF-8 text is cut before each such character instead of at line ends.
    """
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        raw = spark.read.text(path, lineSep=start)
    else:
        raw = (
            spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").schema("value string").csv(path)
        )
    raw = raw.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    )
    raw = written(raw, "lines")
    # ids rise by one within a block: a row per block is enough to number all lines
    blocks = raw.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    blocks = blocks.withColumn("log_id", F.regexp_replace("file", "/part-[0-9]{5,}-[^/]*$", ""))
    w = Window.partitionBy("log_id").orderBy("file", "start")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("log_id", "file", "start", "first", F.row_number().over(w).alias("block"), before.alias("before"))
    joined = raw.join(F.broadcast(blocks), ["file", "start"])
    value = F.regexp_replace("value", "\r$", "")
    if start:
        value = F.when((F.col("start") == 0) & (F.col("id") == F.col("first")), F.col("value")).otherwise(F.concat(F.lit(start), "value"))
    return joined.select("log_id", "block", (F.col("before") + F.col("id") - F.col("first")).alias("ord"), value.alias("value"))


def fill_down(lines: DataFrame, headers: dict[str, Column], above: bool = False) -> DataFrame:
    """Add a column per header: its last value that is not null at or above each line of the file, or above it only."""
    for name, value in headers.items():
        lines = lines.withColumn(f"__{name}", value)
    own = Window.partitionBy("log_id", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1 if above else 0)
    ends = lines.groupBy("log_id", "block").agg(
        *[F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col("ord"))).alias(f"__end_{n}") for n in headers]
    )
    before = Window.partitionBy("log_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("log_id", "block", *[F.last(f"__end_{n}", True).over(before).alias(f"__from_{n}") for n in headers])
    filled = lines.select("*", *[F.last(f"__{n}", True).over(own).alias(f"__in_{n}") for n in headers])
    joined = filled.join(F.broadcast(carried), ["log_id", "block"])
    keep = [c for c in lines.columns if not c.startswith("__")]
    return joined.select(*keep, *[F.coalesce(f"__in_{n}", f"__from_{n}").alias(n) for n in headers])


def sum_above(lines: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column: the sum of value over all lines of the file above each line."""
    lines = lines.withColumn("__value", value)
    own = Window.partitionBy("log_id", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("log_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy("log_id", "block").agg(F.sum("__value").alias("sum"))  # a row per block
    ends = ends.select("log_id", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("__above"))
    out = lines.withColumn("__own", F.coalesce(F.sum("__value").over(own), F.lit(0))).join(F.broadcast(ends), ["log_id", "block"])
    return out.withColumn(name, F.col("__above") + F.col("__own")).drop("__above", "__own", "__value")


def sections(lines: DataFrame, mark: str = "==========") -> DataFrame:
    """Add section: how many separator lines stand above a line (a separator belongs to the section it ends)."""
    is_mark = F.col("value").startswith(mark)
    own = Window.partitionBy("log_id", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("log_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy("log_id", "block").agg(F.count_if(is_mark).alias("marks"))  # a row per block
    ends = ends.select("log_id", "block", F.coalesce(F.sum("marks").over(before), F.lit(0)).alias("__above"))
    out = lines.withColumn("__own", F.coalesce(F.count_if(is_mark).over(own), F.lit(0)))
    out = out.join(F.broadcast(ends), ["log_id", "block"])
    return out.withColumn("section", (F.col("__above") + F.col("__own")).cast("int")).withColumn("is_mark", is_mark).drop("__above", "__own")
