"""A class census over a stream of log files, beyond what a batch analysis needs: files are counted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import cc_class
from ..sources.cc_log import NODE


def stream_class_census(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(log_id, class, n), a streaming DataFrame over the text files that appear in a folder.

    State holds one count per file and class; write it in update or complete mode, with a checkpoint in shared storage.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).schema("value string").text(folder)
    nodes = lines.select("value", F.col("_metadata.file_name").alias("log_id")).where(F.col("value").rlike(NODE) & ~F.col("value").startswith(">"))
    return nodes.groupBy("log_id", cc_class(F.regexp_extract("value", NODE, 3)).alias("class")).agg(F.count("*").alias("n"))
