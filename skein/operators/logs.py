"""Logs: the first and last K lines, and runs of anomalous lines between them with their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.lines import head, is_blank, let, lines, middle, tail
from skein.functions.predicates import log_anomaly


def runs(found: Column) -> Column:
    """(first, last, items) of the runs of consecutive numbers ``at`` in an array of (at, item)."""

    def heads(f: Column) -> Column:
        """Places, from 1, where a run begins, and the place after the last."""
        new = F.filter(F.sequence(F.lit(1), F.size(f)), lambda i: (i == 1) | (F.element_at(f, F.greatest(i - 1, F.lit(1)))["at"] != F.element_at(f, i)["at"] - 1))
        return F.concat(new, F.array(F.size(f) + 1))

    def cut(f: Column, h: Column) -> Column:
        run = lambda i: F.slice(f, F.element_at(h, i), F.element_at(h, i + 1) - F.element_at(h, i))
        return F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: let(run(i), lambda r: F.struct(F.element_at(r, 1)["at"].alias("first"), F.element_at(r, -1)["at"].alias("last"), r.alias("items"))))

    return let(found, lambda f: F.when(F.size(f) > 0, let(heads(f), lambda h: cut(f, h))))


def crush_log(text: Column, k: int = 20) -> Column:
    """A log of at most 2K lines stays as it is."""
    k = max(0, k)
    strings = lambda *xs: F.array(*xs).cast("array<string>")
    omitted = lambda n: F.when(n > 0, strings(F.concat(F.lit("... [omitted "), n, F.lit(" lines] ...")))).otherwise(strings())
    shown = lambda g: F.concat(
        strings(F.concat(F.lit("--- Preserved anomaly/error lines "), g["first"], F.lit("-"), g["last"], F.lit(" ---"))),
        F.transform(g["items"], lambda x: F.concat(F.lit("[Line "), x["at"], F.lit("] "), x["item"])),
    )

    def body(all_: Column, groups: Column) -> Column:
        before = lambda i: F.when(i == 0, k).otherwise(F.element_at(groups, F.greatest(i, F.lit(1)))["last"])
        parts = F.flatten(F.transform(groups, lambda g, i: F.concat(omitted(g["first"] - before(i) - 1), shown(g))))
        none = groups.isNull() | (F.size(groups) == 0)
        last = F.when(none, k).otherwise(F.element_at(groups, -1)["last"])
        inner = [F.coalesce(parts, strings()), omitted(F.size(all_) - k - last)]
        return F.array_join(F.concat(*([head(all_, k), *inner, tail(all_, k)] if k else inner)), "\n")

    found = lambda all_: F.filter(middle(all_, k), lambda x: log_anomaly(x["item"]))
    crushed = let(lines(text), lambda all_: F.when(F.size(all_) <= 2 * k, text).otherwise(let(runs(found(all_)), lambda g: body(all_, g))))
    return F.when(is_blank(text), "").otherwise(crushed)


def islands(rows: DataFrame, key: str, at: str, flag: str) -> DataFrame:
    """The same runs for line rows, for logs too long for one row: key, first, last and n of each."""
    order = Window.partitionBy(key).orderBy(at)
    marked = rows.filter(flag).withColumn("_g", F.col(at) - F.row_number().over(order))
    return marked.groupBy(key, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_g")
