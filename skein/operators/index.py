"""A persisted inverted index beside snapshots of the block store.

A block's content never changes, as its hash names it: its postings are written once. ``build``
writes a segment of blocks, ``update`` one of the blocks that an index doesn't hold yet, ``merge``
makes one segment of several. Which blocks live is a snapshot's matter and asked when searching.

Blocks are dealt to slots by a hash. A posting is (term, slot, hash, tf, length of the block); the
first of a term and slot also has their bounds: the number of blocks and, where there are several,
the largest tf and the smallest length. From these follows the most that the term can add to any block of the slot, whatever the mean
length is, so slots are ruled out without looking at their blocks. The table is partitioned by a
bucket of the term and sorted by part, term and slot, so a search reads the buckets and the terms
that it asks for. A segment is made by one reading of its texts and one shuffle.

Search: 1. the bounds of a query's terms are summed for each slot. 2. The most promising slots are
scored exactly; their ``top``-th score is a floor. 3. Other slots are scored only if their bound
reaches it. What is left out can't be among the best: the result is that of ``blocks.bm25``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.lines import let
from skein.operators.blocks import ASKED, K1, WHOLE, B, tokens
from skein.sources.shared import no_shuffle_left, written

#: Blocks of a slot on average; partitions by term, and parts of each by slot; terms that go into the scan's filter as they are.
PER_SLOT, BUCKETS, SPREAD, NAMED = 16, 64, 8, 1000
#: The bucket of the rows that stand for whole blocks while a segment is made.
BLOCKS = -1
#: Slots of a query that are scored first, at least.
FIRST = 8
#: Scores are ranked by nine digits; bounds are compared with more room than that.
ROOM = 1e-7


@dataclass
class Index:
    """postings (bucket, term, segment, slot, hash, tf, dl), bounds (bucket, term, segment, slot, n, max_tf, min_dl), which are read from the same table, and docs (hash, dl) of all segments."""

    spark: SparkSession
    paths: tuple[str, ...]
    buckets: int

    @property
    def postings(self) -> DataFrame:
        return self._rows().drop("n", "max_tf", "min_dl")

    @property
    def bounds(self) -> DataFrame:
        most = {"max_tf": F.coalesce("max_tf", "tf"), "min_dl": F.coalesce("min_dl", "dl")}
        return self._rows().filter(F.col("n").isNotNull()).withColumns(most).drop("hash", "tf", "dl")

    def _rows(self) -> DataFrame:
        schema = _schema(self.docs.schema["hash"].dataType.simpleString())  # an empty segment has no file to tell it
        every = [self.spark.read.schema(schema).parquet(f"{p}/postings").withColumn("segment", F.lit(i)) for i, p in enumerate(self.paths)]
        return reduce(DataFrame.unionByName, every).filter(F.col("bucket") != BLOCKS)

    @property
    def docs(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{p}/docs") for p in self.paths])


def _schema(kind: str) -> str:
    return f"bucket int, term string, slot int, hash {kind}, tf int, dl int, n int, max_tf int, min_dl int"


def _bucket(term: Column, buckets: int) -> Column:
    return F.when(term == WHOLE, BLOCKS).otherwise(F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")).alias("bucket")


def _slots(blocks: int, per_slot: int) -> int:
    return 1 << max(0, (blocks // per_slot).bit_length())


def _write(postings: DataFrame, slots: int, path: str, buckets: int) -> None:
    """(term, hash, tf, dl) as a segment's postings with their bounds.

    A posting is dealt once, by bucket and part of the slots, so a term that most blocks hold is
    spread over tasks. A term and slot are in one task, whose order their bounds need as well.
    """
    slot = F.pmod(F.xxhash64("hash"), F.lit(slots)).cast("int").alias("slot")
    told = postings.select(_bucket(F.col("term"), buckets), "term", slot, "hash", "tf", "dl").withColumn("_part", F.pmod("slot", F.lit(SPREAD)))
    group = Window.partitionBy("bucket", "_part", "term", "slot").orderBy("hash")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, first = F.count(F.lit(1)).over(whole), F.row_number().over(group) == 1
    several = lambda value: F.when(first & (n > 1), value.over(whole))
    bounds = [F.when(first, n.cast("int")).alias("n"), several(F.max("tf")).alias("max_tf"), several(F.min("dl")).alias("min_dl")]
    with no_shuffle_left(postings.sparkSession):
        rows = told.repartition("bucket", "_part").select("bucket", "term", "slot", "hash", "tf", "dl", *bounds)
        rows.write.partitionBy("bucket").option("compression", "zstd").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")


def _counted(words: Column) -> Column:
    """(term, tf) of the words of a block, from runs of equal words in order."""

    def runs(w: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.element_at(w, F.greatest(i - 1, F.lit(1))) != F.element_at(w, i)))
        ends = lambda h: F.transform(h, lambda at, i: F.struct(F.element_at(w, at).alias("term"), (F.coalesce(F.get(h, i + 1), F.size(w) + 1) - at).alias("tf")))
        return F.when(F.size(w) > 0, let(heads, ends))

    return let(F.sort_array(words), runs)


def build(store: DataFrame, path: str, buckets: int = BUCKETS, per_slot: int = PER_SLOT) -> Index:
    """A new index of the blocks (hash, content), one row a hash, as a segment at ``path``."""
    spark, kind = store.sparkSession, store.schema["hash"].dataType.simpleString()
    slots = _slots(store.select("hash").count(), per_slot)
    words = store.select("hash", tokens(F.col("content")).alias("_w")).withColumn("dl", F.size("_w"))
    block = F.array(F.struct(F.lit(WHOLE).alias("term"), F.lit(1).alias("tf")))  # a block without words has a row too
    each = words.select("hash", "dl", F.explode(F.concat(F.coalesce(_counted(F.col("_w")), F.slice(block, 1, 0)), block)).alias("_t")).select("hash", "dl", "_t.*")
    _write(each, slots, path, buckets)
    spark.read.schema(_schema(kind)).parquet(f"{path}/postings").filter(F.col("bucket") == BLOCKS).select("hash", "dl").write.parquet(f"{path}/docs")
    return Index(spark, (path,), buckets)


def update(index: Index, store: DataFrame, path: str, per_slot: int = PER_SLOT) -> Index:
    """The index with the blocks of a snapshot that it doesn't hold yet, in a segment at ``path``."""
    new = store.join(index.docs.select("hash"), "hash", "left_anti")
    return Index(index.spark, (*index.paths, *build(new, path, index.buckets, per_slot).paths), index.buckets)


def merge(index: Index, path: str, store: DataFrame | None = None, per_slot: int = PER_SLOT) -> Index:
    """All segments as one at ``path``, without reading a content; blocks that ``store`` doesn't hold go."""
    docs = index.docs if store is None else index.docs.join(store.select("hash"), "hash", "left_semi")
    docs.write.parquet(f"{path}/docs")
    slots = _slots(index.spark.read.parquet(f"{path}/docs").count(), per_slot)
    each = index.postings.select("term", "hash", "tf", "dl")
    each = each if store is None else each.join(store.select("hash"), "hash", "left_semi")
    _write(each, slots, path, index.buckets)
    return Index(index.spark, (path,), index.buckets)


def asked_rows(index: Index, asked: DataFrame) -> list[DataFrame]:
    """The postings and the bounds of the terms that ``asked`` (term) names: scans are told their buckets and, up to ``NAMED``, the terms.

    The driver holds a number for each bucket and ``NAMED`` terms at most.
    """
    terms = asked.select("term").distinct()
    named = [r[0] for r in terms.limit(NAMED + 1).collect()]
    found = [r[0] for r in terms.select(_bucket(F.col("term"), index.buckets)).distinct().collect()]
    kept = [t.filter(F.col("bucket").isin(found)) for t in (index.postings, index.bounds)]
    return [t.filter(F.col("term").isin(named)) if len(named) <= NAMED else t.join(terms, "term", "left_semi") for t in kept]


def _part(tf: Column, dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def search(index: Index, queries: DataFrame, top: int = 1, live: DataFrame | None = None) -> DataFrame:
    """query_id, hash, score and rank of the best blocks for queries (query_id, query), as ``blocks.bm25`` gives them.

    ``live`` (hash, seq) has the blocks that count, all of them in the index; without it all blocks
    of the index do, and ties go to the smaller hash.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = written(asked, "asked")
    postings, limits = asked_rows(index, asked)
    docs = index.docs if live is None else index.docs.join(live.select("hash"), "hash", "left_semi")
    n_docs, avgdl = docs.agg(F.count("*"), F.avg("dl")).first()
    some = None if live is None or n_docs == index.docs.count() else live  # where all blocks live, bounds tell how many have a term
    if some is None:
        df = limits.groupBy("term").agg(F.sum("n").alias("df"))
    else:
        df = postings.select("term", "hash").join(some.select("hash"), "hash", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    terms = written(asked.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"), F.lit(avgdl).cast("double").alias("avgdl")), "terms")
    few = terms.count() <= ASKED
    with_terms = lambda rows: rows.join(F.broadcast(terms) if few else terms, "term")

    most = with_terms(limits)
    bounds = most.groupBy("query_id", "segment", "slot").agg(F.sum(F.col("weight") * _part(F.col("max_tf"), F.col("min_dl"))).alias("bound"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "slot")
    bounds = written(bounds.withColumn("_r", F.row_number().over(by_bound)), "bounds")

    def scored(slots: DataFrame) -> DataFrame:
        """Postings are dealt by slot, once for all queries that look at it; all hits of a block then are in one task already."""
        looked = written(slots.groupBy("segment", "slot").agg(F.collect_list("query_id").alias("_queries")), "looked")
        pairs = looked.select("segment", "slot")
        near = postings.join(F.broadcast(pairs) if pairs.count() <= ASKED else pairs, ["segment", "slot"], "left_semi")
        counted = near if some is None else near.join(some.select("hash"), "hash", "left_semi")
        dealt = counted.select("term", "segment", "slot", "hash", "tf", "dl").repartition("segment", "slot").join(looked, ["segment", "slot"])
        hits = with_terms(dealt).filter(F.array_contains("_queries", F.col("query_id")))
        return hits.groupBy("segment", "slot", "query_id", "hash").agg(F.sum(F.col("weight") * _part(F.col("tf"), F.col("dl"))).alias("score")).drop("segment", "slot")

    first = written(scored(bounds.filter(F.col("_r") <= max(FIRST, top))), "scored")
    floor = first.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("_r") == top).select("query_id", (F.col("score") - ROOM).alias("floor"))
    rest = bounds.filter(F.col("_r") > max(FIRST, top)).join(floor, "query_id", "left").filter(F.col("bound") >= F.coalesce("floor", F.lit(0.0)))
    every = first.unionByName(scored(rest)).filter("score > 0")
    near = every.withColumn("_r", F.rank().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc()))).filter(F.col("_r") <= top).drop("_r")
    told = near.withColumn("seq", F.lit(0)) if live is None else near.join(live.select("hash", "seq"), "hash")
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "seq", "hash")
    return told.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "hash", "score", "rank")
