"""Lineage cuts: intermediate results written to the shared folder, never to an executor's disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_PATHS: dict[int, tuple[DataFrame, str]] = {}
#: Shuffle files of a finished write are of no more use; Spark then removes them at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs in one process (tests), a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="heaploom-"))
        path = _OWN[0]
    return path.rstrip("/")


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df and read it back: loops get plans of constant size, and lost executors lose no finished round."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = out, path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what written() wrote for tables; nothing that is read later may depend on them."""
    for df in tables:
        _, path = _PATHS.pop(id(df))
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def release() -> None:
    """Remove all that written() has written, once the results that were made of it have been stored or shown."""
    discard(*[df for df, _ in list(_PATHS.values())])
