"""Sources and sinks: documents from files, standard input and commands; snapshots of the store."""

from __future__ import annotations

import shlex
import subprocess
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.blocks import TTL, live
from skein.sources.shared import no_shuffle_left

SCHEMA = "filename string, mime_type string, text string"
#: Signs that a command without a shell may not hold. Fixed values.
SHELL_SIGNS = ("|", ";", "&&", "||", ">", "<", "&", "$", "`")


@F.arrow_udf(T.StringType())
def _decoded(content: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for x in content.to_pylist()], pa.string())


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """A row for each file: base name and text; bytes that aren't UTF-8 go, line ends become line feeds.

    Files that are UTF-8 are decoded by expressions; Python meets the others alone. Spark plans no
    scan of an empty file, so those are the files of its list that the scan doesn't name.
    """
    whole = spark.read.format("binaryFile").load(list(paths))
    raw = whole.select(F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), "content")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    own = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    text = F.when(good, own).otherwise(_decoded(F.when(~good, F.col("content"))))
    mime = F.lit(None).cast("string").alias("mime_type")
    path = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/").alias("_path")
    listed = spark.createDataFrame([(f,) for f in whole.inputFiles()], "_path string").select(path("_path"))
    empty = listed.join(whole.select(path("_metadata.file_path")), "_path", "left_anti")
    name = F.url_decode(F.replace(F.regexp_extract("_path", "([^/]*)$", 1), F.lit("+"), F.lit("%2B")))
    return raw.select("filename", mime, text.alias("text")).unionByName(empty.select(name.alias("filename"), mime, F.lit("").alias("text")))


def read_stdin(spark: SparkSession, stream=None) -> DataFrame:
    return spark.createDataFrame([(None, None, (stream or sys.stdin).read())], SCHEMA)


def run_command(spark: SparkSession, command: str | list[str], shell: bool = False) -> tuple[DataFrame, int]:
    """Output and errors of a command that the driver runs, as one document, and its exit code."""
    line = command if isinstance(command, str) else " ".join(command)
    if not shell and any(x in line for x in SHELL_SIGNS):
        raise ValueError("the command holds shell signs; ask for a shell to run it")
    done = subprocess.run(line if shell else (shlex.split(command) if isinstance(command, str) else command), shell=shell, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, encoding="utf-8", errors="ignore", check=False)
    return spark.createDataFrame([("command.log", None, done.stdout)], SCHEMA), done.returncode


#: A filter of a megabyte for each file, which is Parquet's own choice, would outgrow the blocks of a day by far: the smallest of these candidates that holds the row group's hashes is written.
BLOOM = {"parquet.bloom.filter.enabled#hash": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number#hash": "16"}
#: Columns of a snapshot; the day of created_at (UTC) is its partition.
BLOCKS = "hash string, content string, created_at timestamp, seq long"


def read_blocks(spark: SparkSession, path: str, now: Column | None = None, ttl: int = TTL) -> DataFrame:
    """A snapshot of the store; with ``now`` its live blocks alone, of which only the days that may hold some are scanned.

    Its folders are listed once; what a file of it holds is told by that file alone.
    """
    rows = spark.read.schema(f"{BLOCKS}, day date").parquet(path)
    one = rows.select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))).limit(1).collect()
    found = {f.name: f.dataType for f in spark.read.option("basePath", path).parquet(one[0][0]).schema.fields} if one else {}
    odd = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if found and found.get(f.name) != f.dataType]
    if odd:
        raise ValueError(f"{path} is no snapshot of a store: it has no {', '.join(odd)}")
    if now is not None:
        since = now - F.make_dt_interval(secs=F.lit(ttl))
        rows = live(rows.filter(F.col("day") >= _day(since)), now, ttl)
    return rows.drop("day")


def look_up(spark: SparkSession, path: str, *hashes: str) -> DataFrame:
    """The blocks of a snapshot that these hashes name; files are sorted by hash and have Bloom filters of it, so few row groups are read."""
    return read_blocks(spark, path).filter(F.col("hash").isin(*hashes))


def _day(at: Column) -> Column:
    """The day in UTC, whatever the session's zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(at) / 86_400).cast("int"))


def write_blocks(store: DataFrame, path: str) -> None:
    """A snapshot goes to a folder of its own, a folder for each day in it; an old one is never written over."""
    rows = store.select("hash", "content", F.col("created_at").cast("timestamp").alias("created_at"), F.col("seq").cast("long").alias("seq")).withColumn("day", _day(F.col("created_at")))
    placed = rows.repartitionByRange("day", "hash").sortWithinPartitions("day", "hash")
    with no_shuffle_left(store.sparkSession):
        placed.write.mode("error").partitionBy("day").options(**BLOOM).parquet(path)


def write_text(df: DataFrame, path: str, column: str = "compressed") -> None:
    """A line-separated text file of the column; null rows are empty."""
    df.select(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("value")).write.mode("error").text(path)


def write_stdout(df: DataFrame, column: str = "compressed", stream=None) -> int:
    """The column's texts on the driver's standard output, each with a line end; a partition at a time is held. Gives their number."""
    out, n = stream or sys.stdout, 0
    for row in df.select(F.col(f"`{column}`").cast("string")).toLocalIterator():
        out.write(f"{row[0] or ''}\n")
        n += 1
    return n
