"""The calls of the engine, over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.rows import col, packed, unpacked
from skein.operators import blocks, inflate
from skein.operators.index import Index, search
from skein.operators.logs import crush_log
from skein.operators.router import compress
from skein.sources.corpus import run_command

__all__ = ["clean", "clear", "compress", "compress_output", "decompress", "decompress_logged", "retrieve", "stats", "store"]


def store(compressed: DataFrame, now: Column) -> DataFrame:
    """The blocks of compressed documents, as a snapshot."""
    rows = compressed.select(F.explode("blocks").alias("b")).select(F.col("b.content").alias("content"), now.alias("created_at"))
    return blocks.make_blocks(rows)


def compress_output(spark: SparkSession, command: str | list[str], k_lines: int = 20, shell: bool = False) -> tuple[DataFrame, int]:
    """A command's output, crushed as a log whatever it holds, and the command's exit code."""
    rows, code = run_command(spark, command, shell)
    return rows.select("filename", crush_log(F.col("text"), k_lines).alias("compressed")), code


def retrieve(asked: DataFrame, snapshot: DataFrame, now: Column, ttl: int = blocks.TTL, index: Index | None = None) -> DataFrame:
    """``asked`` (token, query, or both) with hash, content and hit; columns of these names give way to them.

    token is a token or a bare hash. A query that isn't null or empty has priority and gets the
    best block by ``blocks.bm25``, or by an ``index`` that holds all of the snapshot's blocks; a row
    with neither has a null hit.
    """
    kept = blocks.live(snapshot, now, ttl)
    rows = asked.select(packed(asked).alias("_row"), *[(col(c) if c in asked.columns else F.lit(None)).cast("string").alias(f"_{c}") for c in ("token", "query")])
    rows = rows.withColumn("_search", F.coalesce(F.col("_query") != "", F.lit(False)))
    direct = blocks.retrieve(rows.filter("not _search").withColumn("hash", blocks.parse_token(F.col("_token"))), kept)
    direct = direct.withColumn("hit", F.when(F.col("_token").isNotNull(), F.col("hit")))
    searched = rows.filter("_search")
    queries = searched.select(F.col("_query").alias("query_id"), F.col("_query").alias("query")).distinct()
    best = None if index is None else search(index, queries, 1, kept.select("hash", "seq"))
    told = blocks.retrieve_query(queries, kept, best).select(F.col("query_id").alias("_q"), "hash", "content", "hit")
    found = searched.join(told, F.col("_query") == F.col("_q"), "left")
    both = direct.select("_row", "hash", "content", "hit").unionByName(found.select("_row", "hash", "content", "hit"))
    names = [c for c in asked.columns if c not in ("hash", "content", "hit")]
    return both.select(*unpacked("_row", names, {c: F.col(c) for c in ("hash", "content", "hit")}))


def decompress(df: DataFrame, snapshot: DataFrame, now: Column, text: str = "text", ttl: int = blocks.TTL, max_passes: int | None = 1) -> DataFrame:
    """``df`` with known tokens of ``text`` replaced; tokens within blocks as far as ``max_passes`` passes go, or to the last (None)."""
    for _ in range(max_passes or 1):
        df = inflate.decompress(df, blocks.live(snapshot, now, ttl), text, max_passes is None)[0]
    return df


def decompress_logged(df: DataFrame, snapshot: DataFrame, now: Column, text: str = "text", ttl: int = blocks.TTL, to_the_last: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same, and the log (hash, hit) of each token that was looked up, for ``stats``."""
    return inflate.decompress(df, blocks.live(snapshot, now, ttl), text, to_the_last)


def stats(snapshot: DataFrame, retrieved: DataFrame, now: Column, ttl: int = blocks.TTL, stored: DataFrame | None = None) -> DataFrame:
    return blocks.stats(blocks.live(snapshot, now, ttl), retrieved, stored)


def clean(snapshot: DataFrame, now: Column, ttl: int = blocks.TTL) -> DataFrame:
    """The snapshot without the blocks that are too old."""
    return blocks.live(snapshot, now, ttl)


def clear(snapshot: DataFrame) -> DataFrame:
    return blocks.clear(snapshot)
