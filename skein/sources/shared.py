"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; in local mode, where it is unset, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="skein-store-"))


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in that folder."""
    return f"{folder(spark)}/skein-{name}-{uuid.uuid4().hex}"


#: Tasks for each core of the session, at least, where the work on a row costs much more than reading it.
TASKS = 4


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """A table's rows dealt to all cores by ``keys``: Spark cuts scans by bytes, so small compressed files would be one task however much is made of their rows."""
    least = TASKS * table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= least else table.repartition(least, *keys)


#: Spark's setting that lets shuffle files go when the query that made them has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Writes within leave no shuffle files behind: once the table is there they are of no more use."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table there: cut off from what led to it, and safe from lost executors."""
    path = fresh(df.sparkSession, name)
    with no_shuffle_left(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
