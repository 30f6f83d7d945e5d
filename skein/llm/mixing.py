"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Every document has a 60-bit hash of its id. A source that is to give ``r`` times its size takes
all its documents ``floor(r)`` times and, once more, those whose hash lies under a threshold. The
threshold is found from histograms of token sums by source and hash digit: the digit in which the
budget runs out is refined by the next digit, among its documents only. Nothing is sorted.

Nulls and edge cases: a null text has size 0; a null source is a source of its own, last in
order; a null ``doc_id`` hashes as the empty string; rows that share a ``doc_id`` share a fate;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD, columns, stage

#: Weights by source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its size.
MOST = 3
#: Bits of a digit of the hash, and digits.
BITS, DIGITS = 12, 5


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Shares of all sizes by weight, none above ``most`` times its source, the excess reshared.

    Whether a source is capped depends on its room for each unit of weight only: those with the
    least room are capped, and the others share what is left at one level.
    """
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight = sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    for at, i in enumerate(order):
        if most * sizes[i] * weight > left * weights[i]:
            for j in order[at:]:
                out[j] = weights[j] * (left / weight)
            break
        out[i] = float(most * sizes[i])
        left, weight = left - most * sizes[i], weight - weights[i]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and hash of each document."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, BITS * DIGITS // 4), 16, 10).cast("long").alias("_h"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, keep: DataFrame | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document.

    The driver holds a row for each source, as it holds their weights; no row of a document. These
    rows are joined as their size suggests, not by a broadcast that is forced.
    """
    spark = docs.sparkSession
    rows = stage(sized(docs), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["n"] for r in found]
    goal = targets(sizes, [w for w, _ in zip(cycle(weights), found, strict=False)], most)
    whole = [min(most, int(t // n)) if n else 0 for t, n in zip(goal, sizes, strict=True)]
    rest = [t - w * n for t, w, n in zip(goal, whole, sizes, strict=True)]
    # _below: hashes under it are taken once more; found digit by digit in the boundary bucket.
    below, spent, open_ = [0] * len(found), [0] * len(found), {i for i, r in enumerate(rest) if r > 0}
    schema = "_s string, _prefix long, _rest double"
    for digit in range(DIGITS):
        if not open_:
            break
        shift = BITS * (DIGITS - 1 - digit)
        edge = spark.createDataFrame([(found[i]["source"], below[i] >> (shift + BITS), rest[i] - spent[i]) for i in sorted(open_)], schema)
        bucket = F.shiftright("_h", shift)
        sums = (
            rows.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_h", shift + BITS) == F.col("_prefix")))
            .groupBy("source", "_rest", bucket.alias("_b"))
            .agg(F.sum("size").alias("n"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
        )
        run = Window.partitionBy("source").orderBy("_b")  # at most 2 ** BITS rows for each source
        crossed = sums.withColumn("_cum", F.sum("n").over(run)).filter(F.col("_cum") > F.col("_rest"))
        first = crossed.groupBy("source").agg(F.min(F.struct("_b", (F.col("_cum") - F.col("n")).alias("before"), "n", "_lo", "_hi")).alias("x"))
        at = {r["source"]: r["x"] for r in first.collect()}
        for i in sorted(open_):
            x = at.get(found[i]["source"])
            if x is None:  # all of them fit
                below[i] = (below[i] >> (shift + BITS) << (shift + BITS)) + (1 << (shift + BITS))
                open_.discard(i)
                continue
            below[i] = x["_b"] << shift
            spent[i] += x["before"]
            if x["_lo"] == x["_hi"]:  # one hash is left: the nearer side
                below[i] = x["_lo"] + (x["n"] - (rest[i] - spent[i]) < rest[i] - spent[i])
                open_.discard(i)
    plan = spark.createDataFrame([(r["source"], r["n"], goal[i], whole[i], below[i]) for i, r in enumerate(found)], "_s string, source_size long, target double, _whole int, _below long")
    taken = F.col("size") * (F.col("_whole") + (F.col("_h") < F.col("_below")).cast("int"))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeats(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; documents without words stay as they are."""
    took = mix(docs, weights, most).select(F.col("doc_id").alias("_id"), F.when(F.col("size") == 0, 1).otherwise(F.expr("taken div size")).cast("int").alias("_n"), F.col("size").alias("_size"))
    took = took.groupBy("_id").agg(F.max(F.when(F.col("_size") > 0, F.col("_n"))).alias("_n"))
    rows = docs.select(columns(docs).alias("_row"))
    n = F.when(F.coalesce(F.regexp_count(F.col("_row.text"), F.lit(WORD)), F.lit(0)) == 0, F.lit(1)).otherwise(F.coalesce(F.col("_n"), F.lit(0)))
    joined = rows.join(took, F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("_row", F.explode(F.array_repeat(F.lit(0), n)).alias("_i")).select("_row.*")
