"""Durable intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir. Where that is unset, a temporary one, if
    driver and executors are one process, as in tests; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/scanlake-{uuid.uuid4().hex}"


def _own_dir(kept: list = []) -> str:  # noqa: B006
    if not kept:
        kept.append(tempfile.TemporaryDirectory(prefix="scanlake-"))
        atexit.register(kept[0].cleanup)
    return f"file://{kept[0].name}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written table in the shared folder: an executor
    that is lost later costs nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing will read again."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
