"""Intermediate tables in the folder that all executors share.

The folder is the session's spark.checkpoint.dir. Only where the session names none and runs on this machine alone, as in
tests, a temporary folder takes its place; on a cluster that raises. The tables go when the session's driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and (at := spark.sparkContext.getCheckpointDir()):
        named = at
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sitelode-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The same rows, read back from a Parquet table: later readers don't repeat the work, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sitelode-tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # its buffers go with the writer; other codecs' wait for a collection
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.clear()
