"""The content-addressed block store as DataFrames: blocks(hash, content, created_at, seq), retrievals(hash).

Nothing is changed in place: an operation takes a snapshot and the time, and gives a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.rows import col

#: Characters that a token is taken to cost, and seconds that a block lives. Fixed values.
TOKEN_COST, TTL = 80, 300
TOKEN = r"<<ccr:([a-f0-9]{64}),([^,>]+),(\d+)>>"


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _latest(rows: DataFrame) -> DataFrame:
    """One row a hash, stored last at created_at; ``seq`` is that time in microseconds, the order in which a snapshot is read."""
    each = rows.groupBy("hash").agg(F.max_by("content", "created_at").alias("content"), F.max("created_at").alias("created_at"))
    return each.withColumn("seq", F.unix_micros("created_at"))


def make_blocks(df: DataFrame, content: str = "content", created_at: str = "created_at") -> DataFrame:
    """Distinct blocks, the latest time of each."""
    rows = df.filter(col(content).isNotNull()).select(content_hash(col(content)).alias("hash"), col(content).alias("content"), col(created_at).cast("timestamp").alias("created_at"))
    return _latest(rows)


def upsert(store: DataFrame, blocks: DataFrame) -> DataFrame:
    """A block that is stored again lives anew. The order of a snapshot is that of (seq, hash)."""
    return _latest(store.select("hash", "content", "created_at").unionByName(blocks.select("hash", "content", "created_at")))


def clear(store: DataFrame) -> DataFrame:
    """The snapshot without its blocks; counters begin anew with an empty log of retrievals and of new blocks."""
    return store.filter(F.lit(False))


def new_blocks(store: DataFrame, blocks: DataFrame) -> DataFrame:
    return blocks.join(store.select("hash"), "hash", "left_anti")


def saved(blocks: DataFrame) -> DataFrame:
    """saved_bytes: characters of new blocks beyond a token's cost."""
    return blocks.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.length("content") - TOKEN_COST)), F.lit(0)).cast("bigint").alias("saved_bytes"))


def live(store: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    """Blocks no older than ``ttl`` seconds."""
    return store.filter(F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(ttl)))


def retrieve(asked: DataFrame, store: DataFrame) -> DataFrame:
    """``asked`` (hash and other columns) with content and hit."""
    return asked.join(store.select("hash", "content"), "hash", "left").withColumn("hit", F.col("content").isNotNull())


def stats(store: DataFrame, retrieved: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row of figures; a retrieval whose ``hit`` is null counts as neither hit nor miss.

    ``stored`` (content) has the blocks that were new when they were stored; with it there is saved_bytes.
    """
    a = store.agg(F.count("*").alias("count"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("bigint").alias("total_bytes"))
    b = retrieved.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    ratio = F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)).cast("double")
    out = a.crossJoin(b).select("count", "total_bytes", "hits", "misses", ratio.alias("hit_ratio"))  # one row each
    return out if stored is None else out.crossJoin(saved(stored))


def parse_token(token: Column) -> Column:
    """The hash that a token or a bare hash names."""
    return F.nullif(F.regexp_extract(token, r"^\s*(?:<<ccr:)?([a-f0-9]{64})(?:,[^>]*>>)?\s*$", 1), F.lit(""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


#: Saturation and length weight of the ranking. Fixed values.
K1, B = 1.5, 0.75


#: The term that each block has beside its words; no word is a blank.
WHOLE = " "
#: Pairs of query and term that go to every task, so that hits stay with their block; more are joined by term.
ASKED = 200_000


def _terms(store: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """asked (query_id, term, qtf), tf (hash, seq, dl, term, tf), df (term, df) of the terms that are asked for, and the row (n, avgdl)."""
    words = store.select("hash", "seq", tokens(F.col("content")).alias("w")).withColumn("dl", F.size("w"))
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    each = words.select("hash", "seq", "dl", F.explode(F.concat(F.coalesce("w", F.array().cast("array<string>")), F.array(F.lit(WHOLE)))).alias("term"))
    marked = each.join(asked.select("term", F.lit(True).alias("_asked")).distinct(), "term", "left").filter(F.col("term").isNotNull() & (F.col("_asked") | (F.col("term") == WHOLE)))
    counted = marked.groupBy("hash", "seq", "dl", "term").agg(F.count("*").alias("tf"))  # what follows reads this one shuffle, so texts are cut once: no filter here that Spark would push below it
    own = F.col("term") == WHOLE
    whole = counted.agg(F.coalesce(F.sum(F.when(own, F.col("tf"))), F.lit(0)).alias("n"), F.try_divide(F.sum(F.when(own, F.col("tf") * F.col("dl"))), F.sum(F.when(own & F.col("dl").isNotNull(), F.col("tf")))).alias("avgdl"))
    df = counted.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))
    return asked, counted, df, whole  # both hold WHOLE, which no query asks for


def _idf() -> Column:
    return F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)


def bm25_terms(store: DataFrame, queries: DataFrame) -> DataFrame:
    """term, df and idf of the terms that queries ask for and the store holds."""
    _, _, df, whole = _terms(store, queries)
    return df.filter(F.col("term") != WHOLE).crossJoin(F.broadcast(whole)).select("term", "df", _idf().alias("idf"))


def bm25(store: DataFrame, queries: DataFrame, top: int = 1) -> DataFrame:
    """query_id, hash, score and rank of the best blocks of a snapshot for queries (query_id, query); ties go to the smaller (seq, hash).

    Only postings of terms that queries ask for are joined; N and the mean length are one row. Postings
    are dealt by hash, so where the queries fit a task the hits, many for each block, are not shuffled.
    """
    asked, tf, df, whole = _terms(store, queries)
    terms = asked.join(df, "term")
    if asked.limit(ASKED + 1).count() <= ASKED:
        terms, tf = F.broadcast(terms), tf.repartition("hash")
    hits = tf.join(terms, "term").crossJoin(F.broadcast(whole))  # the last has one row
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("query_id", "hash", "seq").agg(F.sum(F.col("qtf") * _idf() * part).alias("score")).filter("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "seq", "hash")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "hash", "score", "rank")


def retrieve_query(queries: DataFrame, store: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """``queries`` (query_id, query) with hash, content and hit of the best block, which ``best`` (query_id, hash) may tell.

    hit is null, so that it counts as neither hit nor miss, where the store is empty or the query has no word.
    """
    best = bm25(store, queries, 1) if best is None else best
    best = best.select(F.col("query_id").alias("_q"), "hash").join(store.select("hash", "content"), "hash")
    some = store.limit(1).agg(F.count("*").alias("_some"))  # one row
    counted = (F.col("_some") > 0) & (F.size(tokens(F.coalesce(F.col("query"), F.lit("")))) > 0)
    joined = queries.join(best, F.col("query_id") == F.col("_q"), "left").crossJoin(F.broadcast(some))
    return joined.withColumn("hit", F.when(counted, F.col("content").isNotNull())).drop("_q", "_some")
