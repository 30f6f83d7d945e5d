"""Decompression: tokens in texts give way to the blocks that they name, once or to the last.

Texts are cut at their tokens within their row; only tokens meet the store, once for equal texts, and
rows are told by a digest of the text, so a task that runs again changes nothing.

``closed`` does the same to the store itself. Blocks whose tokens name blocks form a graph; those
without such a token are done, and each round inflates the blocks all of whose references are done,
every block once, until no block is left or none is ready: what is left refers to itself, or to a
block that does. There the tokens of blocks that are not done stay as they are. A round for each
level of nesting; only ids are looked at to find which blocks are ready.

Each token that is looked up is a retrieval: a hit, a miss, or, where the block exists but leads into
a cycle, neither (null). What a block's own tokens retrieve counts wherever the block is put in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.lines import let
from skein.functions.rows import col, packed, unpacked
from skein.operators.blocks import TOKEN
from skein.sources.shared import written

PLACE = f"[ \t]*{TOKEN}"
LOG = "array<struct<hash:string,hit:boolean>>"


def named(text: Column) -> Column:
    """Hashes of the tokens of a text, in order, repeated ones too."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def _filled(text: Column, got: Column) -> Column:
    """The text with the contents of ``got`` (one for each token, null: it stays). A token's indentation isn't doubled."""

    def piece(token: Column, content: Column) -> Column:
        indent = F.regexp_extract(token, r"\A[ \t]*", 0)
        return F.when(content.isNull(), token).when(content.startswith(indent), content).otherwise(F.concat(indent, content))

    parts = F.struct(F.split(text, PLACE, -1).alias("kept"), F.regexp_extract_all(text, F.lit(f"({PLACE})"), F.lit(1)).alias("token"), got.alias("got"))
    joined = lambda p: F.transform(p["kept"], lambda x, i: F.concat(x, F.when(i < F.size(p["token"]), piece(F.get(p["token"], i), F.get(p["got"], i)["content"])).otherwise("")))
    return let(parts, lambda p: F.array_join(joined(p), ""))


def _looked_up(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (_text and others) with the text filled from ``table`` (hash, content, log; content null: a block that isn't done) and the log of what was looked up."""
    open_ = rows.filter(F.col("_text").rlike(TOKEN)).withColumn("_k", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    plain = rows.filter(~F.col("_text").rlike(TOKEN)).withColumn("_log", F.array().cast(LOG))
    texts = open_.groupBy("_k").agg(F.any_value(named(F.col("_text"))).alias("_named"))
    asked = texts.select("_k", F.posexplode("_named").alias("_at", "_hash"))
    found = asked.join(table.select(F.col("hash").alias("_h"), "content", "log", F.lit(True).alias("_there")), F.col("_hash") == F.col("_h"), "left")
    hit = F.when(F.col("content").isNotNull(), True).when(F.col("_there"), F.lit(None)).otherwise(False)
    log = F.concat(F.array(F.struct(F.col("_hash").alias("hash"), hit.alias("hit"))), F.coalesce("log", F.array().cast(LOG)))
    got = found.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_at", "content", log.cast(LOG).alias("log")))).alias("_got"))
    done = open_.join(got.withColumnRenamed("_k", "_g"), F.col("_k") == F.col("_g"))
    out = done.withColumn("_log", F.flatten("_got.log")).withColumn("_text", _filled(F.col("_text"), F.col("_got")))
    return plain.unionByName(out.select(*plain.columns))


def closed(store: DataFrame) -> DataFrame:
    """hash, content and log of each block of ``store`` (hash, content), its tokens inflated to the last."""
    blocks = written(store.select("hash", F.coalesce("content", F.lit("")).alias("_text")), "blocks")
    edges = blocks.select(F.col("hash").alias("src"), F.explode(named(F.col("_text"))).alias("dst")).distinct()
    edges = written(edges.join(blocks.select(F.col("hash").alias("dst")), "dst", "left_semi"), "edges")
    waiting = written(edges.select(F.col("src").alias("hash")).distinct(), "waiting")
    missed = F.transform(named(F.col("_text")), lambda h: F.struct(h.alias("hash"), F.lit(False).alias("hit"))).cast(LOG)
    levels = [written(blocks.join(waiting, "hash", "left_anti").select("hash", F.col("_text").alias("content"), missed.alias("log")), "level")]
    while True:
        done = reduce(DataFrame.unionByName, levels)
        edges = written(edges.join(levels[-1].select(F.col("hash").alias("dst")), "dst", "left_anti"), "edges")
        ready = waiting.join(edges.select(F.col("src").alias("hash")), "hash", "left_anti")
        told = _looked_up(blocks.join(ready, "hash", "left_semi"), done)
        level = written(told.select("hash", F.col("_text").alias("content"), F.col("_log").alias("log")), "level")
        if level.isEmpty():
            break
        levels.append(level)
        waiting = written(waiting.join(level.select("hash"), "hash", "left_anti"), "waiting")
    undone = waiting.select("hash", F.lit(None).cast("string").alias("content"), F.array().cast(LOG).alias("log"))
    rest = _looked_up(blocks.join(waiting, "hash", "left_semi"), done.unionByName(undone))
    return done.unionByName(rest.select("hash", F.col("_text").alias("content"), F.col("_log").alias("log")))


def decompress(df: DataFrame, store: DataFrame, text: str = "text", to_the_last: bool = False) -> tuple[DataFrame, DataFrame]:
    """``df`` with known tokens of ``text`` replaced by their content, and the log (hash, hit) of what was looked up.

    Unknown tokens stay, a null text becomes the empty one. Once: tokens in what was put in stay too.
    """
    rows = df.select(packed(df).alias("_row"), F.coalesce(col(text), F.lit("")).alias("_text"))
    table = closed(store) if to_the_last else store.select("hash", "content", F.array().cast(LOG).alias("log"))
    done = _looked_up(rows, table)
    return done.select(*unpacked("_row", df.columns, {text: F.col("_text")})), done.select(F.explode("_log").alias("_l")).select("_l.*")
