"""Line dedup by winnowing over line hashes; DataFrame functions only.

Lines are compared without white space at their ends; blank lines are left out of the comparison.

1. Each window of ``width`` consecutive lines selects the line with the least hash (the rightmost
   of equals). The selected lines are the text's fingerprints: wherever two texts share a window
   they share its fingerprint, so no common run of ``width`` lines is missed.
2. Fingerprints that stand at one place of the corpus go, with the windows that selected them.
3. The places of a fingerprint are joined with the earliest place at which the same lines stand
   around it: a later place and its source.
4. Matches are extended both ways, as long as the next line (or the one before) continues the same
   source, into the longest runs. Later runs are deleted.

So a line goes if a window that covers it occurs earlier, in the order of ``doc_id`` (null first),
the row's hash and the line's place. A blank line goes with the line before it. The earliest
occurrence stays, and so do runs shorter than ``width`` lines; with ``EVERY`` as the width each
line is a run, so every later repeat of a line goes.

Nulls and edge cases: a null or empty text is left alone; rows equal in ``doc_id`` and text count
as one document; an empty table gives an empty result; other columns pass through whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.lines import let
from skein.llm.common import columns, row_key, stage

#: Lines of the shortest run that is found, as in the SQL of op5_line_dedup.
WIDTH = 2
#: The width at which single lines are found too.
EVERY = 1


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _lines(text: Column) -> Column:
    """The text's lines that aren't blank: i (place among all lines, from 0) and t (trimmed)."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), _trimmed(x).alias("t"))), lambda x: x["t"] != "")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """_k1, _k2, doc_id, _f (hash of a selected line) and _wins: the windows that selected it, as s (first line, from 1, blank ones left out) and two hashes of their lines."""
    hashes = F.transform(_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x["t"]).alias("a"), F.xxhash64(F.lit(11), x["t"]).alias("b")))
    rows = docs.select(*row_key("doc_id", "text"), F.col("doc_id"), hashes.alias("_h")).filter(F.size("_h") >= width)
    if width == 1:  # a line is its own window
        only = lambda x, i: F.array(F.struct((i + 1).alias("s"), F.xxhash64(x["a"]).alias("x"), F.xxhash64(x["b"]).alias("y")))
        each = F.transform("_h", lambda x, i: F.struct(x["a"].alias("f"), only(x, i).alias("wins")))
    else:
        at = lambda s, k, f: F.element_at(F.col("_h"), s + k)[f]
        least = lambda s: F.least(*[F.struct(at(s, k, "a").alias("a"), (-(s + k)).alias("p")) for k in range(width)])
        window = lambda s: F.struct(least(s).alias("m"), s.alias("s"), F.xxhash64(*[at(s, k, "a") for k in range(width)]).alias("x"), F.xxhash64(*[at(s, k, "b") for k in range(width)]).alias("y"))
        rows = rows.withColumn("_w", F.transform(F.sequence(F.lit(1), F.size("_h") - (width - 1)), window))
        # Windows that select the same line are neighbours, at most ``width`` of them.
        heads = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: (i == 1) | (F.element_at(F.col("_w"), F.greatest(i - 1, F.lit(1)))["m"] != F.element_at(F.col("_w"), i)["m"]))
        picked = lambda i: F.filter(F.slice("_w", i, width), lambda w: w["m"] == F.element_at(F.col("_w"), i)["m"])
        each = F.transform(heads, lambda i: F.struct(F.element_at(F.col("_w"), i)["m"]["a"].alias("f"), F.transform(picked(i), lambda w: F.struct(w["s"].alias("s"), w["x"].alias("x"), w["y"].alias("y"))).alias("wins")))
    return rows.select("_k1", "_k2", "doc_id", F.explode(each).alias("e")).select("_k1", "_k2", "doc_id", F.col("e.f").alias("_f"), F.col("e.wins").alias("_wins"))


def later_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """_k1, _k2 and _at: first and last lines (from 1, blank ones left out) of the runs that occur earlier."""
    prints = stage(fingerprints(docs, width), "prints")
    if width > 1:
        often = prints.groupBy("_f").agg(F.count("*").alias("n")).filter("n > 1").select("_f")
        prints = prints.join(often, "_f", "left_semi")
    wins = prints.select("_k1", "_k2", "doc_id", F.explode("_wins").alias("w")).select("_k1", "_k2", "doc_id", F.col("w.s").alias("_s"), F.col("w.x").alias("_x"), F.col("w.y").alias("_y"))
    place = F.struct(F.col("doc_id"), F.col("_k1"), F.col("_k2"), F.col("_s"))
    source = wins.groupBy("_x", "_y").agg(F.min(place).alias("_first"), F.count("*").alias("n")).filter("n > 1").select("_x", "_y", "_first")
    later = wins.join(source, ["_x", "_y"]).filter(place > F.col("_first"))
    # A match and its neighbour continue the same source if both go on by one line.
    seeds = later.select("_k1", "_k2", "_s", F.col("_first._k1").alias("_a"), F.col("_first._k2").alias("_b"), (F.col("_s") - F.col("_first._s")).alias("_d")).repartition("_k1", "_k2")
    order = Window.partitionBy("_k1", "_k2", "_a", "_b", "_d").orderBy("_s")
    runs = seeds.withColumn("_g", F.col("_s") - F.row_number().over(order)).groupBy("_k1", "_k2", "_a", "_b", "_d", "_g").agg(F.min("_s").alias("from"), (F.max("_s") + (width - 1)).alias("to"))
    return runs.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("from", "to")).alias("_at"))


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``_row`` (the row of ``docs``), the kept ``_text`` and the counts ``_lines`` and ``_removed``."""
    rows = docs.select(columns(docs).alias("_row"), *row_key("doc_id", "text"))
    joined = rows.join(later_runs(docs, width), ["_k1", "_k2"], "left")
    raw = F.split("_row.text", "\n", -1)
    plain = joined.filter(F.col("_at").isNull()).select("_row", F.col("_row.text").alias("_text"), F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(raw)).alias("_lines"), F.lit(0).alias("_removed"))
    cut = joined.filter(F.col("_at").isNotNull()).select("_row", _cut(F.col("_row.text"), F.col("_at")).alias("_x"))
    some = cut.select("_row", F.col("_x.text").alias("_text"), F.col("_x.lines").alias("_lines"), F.col("_x.removed").alias("_removed"))
    return plain.unionByName(some)


def _cut(text: Column, runs: Column) -> Column:
    """text without the lines of the runs, and the numbers of lines and of removed ones. Each part is computed once, wherever the optimizer moves this."""

    def gone(raw: Column, full: Column) -> Column:
        last = lambda x: F.when(x["to"] < F.size(full), F.get(full, x["to"]) - 1).otherwise(F.size(raw) - 1)
        return F.flatten(F.transform(runs, lambda x: F.sequence(F.element_at(full, x["from"]), last(x))))

    def told(raw: Column, keep: Column) -> Column:
        kept = F.array_join(F.transform(keep, lambda i: F.get(raw, i)), "\n")
        return F.struct(kept.alias("text"), F.size(raw).alias("lines"), (F.size(raw) - F.size(keep)).alias("removed"))

    places = F.transform(_lines(text), lambda x: x["i"])
    left = lambda raw, full: F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), gone(raw, full))
    return let(F.split(text, "\n", -1), lambda raw: let(let(places, lambda full: left(raw, full)), lambda keep: told(raw, keep)))
