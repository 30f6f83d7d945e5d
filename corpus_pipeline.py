"""A training corpus from ``documents``: toxic ones go, later repeated lines go, one of each near-duplicate group stays, sources are mixed, the rest is packed.

Nulls and edge cases: a null or empty text is never toxic, keeps its row through line dedup, has no
near copies (rows equal in doc_id and text leave one), counts as no word in the mix, which keeps it
once, and packs as the end-of-document id. A null doc_id is a document like others, without near copies.
Ties go to the smaller doc_id, then the row's hash. Columns beside those that a stage reads pass through
whatever their names; of rows that are dropped as equal the others of their columns are lost. Empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import langid, linededup, minhash, mixing, packing, toxicity
from skein.llm.common import columns, quoted, row_key, stage
from skein.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go; the field learns from the labels as in its own query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    crf = toxicity.fit(docs.select("doc_id", "text"), labels, ~(langid.remainder(3) == 1))
    scored = toxicity.score(docs.select("doc_id", "text", columns(docs).alias("_row")), crf, F.col("_row"))
    return scored.filter("predicted = 0").select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of lines go, of single ones too; a document of which nothing but blanks is left goes with them."""
    out = linededup.dedup(docs, linededup.EVERY)
    left = out.filter((F.col("_removed") == 0) | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.col("_removed") > 0, F.col("_text")).otherwise(F.col("_row.text"))
    new = {"text": text, "n_chars": F.when(F.col("_removed") > 0, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars"))}
    return left.select(*[(new[c] if c in new else F.col(f"_row.{quoted(c)}")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; repeated rows of it, once."""
    found = minhash.near_duplicates(docs)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(columns(docs).alias("_row"), F.col("doc_id").alias("_id"), *row_key("doc_id", "text"))
    stay = rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return stay.dropDuplicates(["_id", "_k1", "_k2"]).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), cache_words=200_000, at_once=256)  # other stages' workers need memory too


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The field of the first stage can't be written as SQL; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
