"""Brings this package to the Python workers, which needn't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch, where the session has Spark's default: long rows would fill sixteen times as much, in every worker.
BATCH_BYTES = 4 << 20


def ensure(spark: SparkSession) -> None:
    """Once for each application: the package's sources as a zip that executors fetch from the driver."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="loomgraph-"), "loomgraph-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "loomgraph")):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shipped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query (spark, ...) that makes sure of it first."""

    @wraps(f)
    def run(spark: SparkSession, *args) -> DataFrame:
        ensure(spark)
        return f(spark, *args)

    return run
