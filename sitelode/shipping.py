"""The package on every executor, whether or not they were started with it on their path."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends the package's sources along with the session's jobs, once a session."""
    context = spark.sparkContext
    if not any("sitelode-src" in str(f) for f in getattr(context, "_python_includes", ())):
        at = Path(tempfile.mkdtemp()) / "sitelode-src"
        context.addPyFile(shutil.make_archive(str(at), "zip", HERE.parent, HERE.name))


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, *rest) -> DataFrame:
        ship(spark)
        return query(spark, *rest)

    return run
