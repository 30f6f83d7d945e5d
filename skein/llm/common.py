"""Shared plumbing: staging tables in the cluster's shared folder, row keys, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}
_HELD: dict[Hashable, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode only, a temporary one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="skein-")
    return _LOCAL[app]


#: Spark's setting that lets shuffle files go when the query that made them has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives lost executors.

    Once the table is there, the shuffle files that led to it are of no more use.
    """
    path = f"{shared_dir(df.sparkSession)}/skein-{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names hold."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def drop(df: DataFrame) -> None:
    """Deletes a staged table that no later step reads."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def row_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes that stand for a row's values; equal rows share them, nulls included.

    A null flag for each column keeps (null, x) apart from (x, null).
    """
    flags = [F.col(c).isNull() for c in cols]
    return [F.xxhash64(*cols, *flags).alias("_k1"), F.xxhash64(F.lit(7), *reversed(cols), *flags).alias("_k2")]


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """A Python worker's one model or tokenizer with its cache, held for the next tasks; asking for another lets it go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """Of ``rows`` (doc_id and a label), at most ``most`` of each label: the first by hash of doc_id.

    A bound on the hash, from each label's number of rows, leaves somewhat more than ``most`` rows;
    only those are ranked. The driver holds one row a label.
    """
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    held = rows.select("doc_id", label, share.alias("_h"))
    bound = held.groupBy(label).agg(F.count("*").alias("_n")).select(F.col(label).alias("_label"), ((most + 8 * most**0.5 + 20) / F.col("_n")).alias("_most"))
    near = held.join(bound, F.col(label) == F.col("_label")).filter("_h <= _most")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", "doc_id"))
    return near.withColumn("_r", rank).filter(F.col("_r") <= most).select("doc_id", label)
