"""Columns over texts and their lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends that count, and white space. Fixed values.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"[\s\x1C-\x1F]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used, in lambdas too."""
    return F.transform(F.array(value), body)[0]


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(rf"(?U)\A{SPACE}*\z")


def lines(text: Column) -> Column:
    """The lines of a text; none for an empty one, and no empty last line after a final line end."""
    return let(F.split(text, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def right_trim(line: Column) -> Column:
    return F.regexp_replace(line, rf"(?U){SPACE}+\z", "")


def head(items: Column, k: int) -> Column:
    return F.slice(items, 1, k)


def tail(items: Column, k: int) -> Column:
    """The last ``k`` of more than ``k`` items."""
    return F.slice(items, F.size(items) - (k - 1), F.lit(k))


def middle(items: Column, k: int) -> Column:
    """(at, item) of the items that are neither among the first nor the last ``k``; ``at`` counts from 1."""
    numbered = F.transform(items, lambda x, i: F.struct((i + 1).alias("at"), x.alias("item")))
    return F.slice(numbered, F.lit(k + 1), F.greatest(F.size(items) - 2 * k, F.lit(0)))
