"""Prose: trailing space, runs of blank lines and inner runs of blanks go, indentation stays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.lines import SPACE, is_blank, let, lines, right_trim


def collapse_blank_lines(trimmed: Column) -> Column:
    """One empty line for each run of them."""
    return let(trimmed, lambda t: F.filter(t, lambda x, i: (x != "") | (i == 0) | (F.element_at(t, F.greatest(i, F.lit(1))) != "")))


def squeeze(line: Column) -> Column:
    indent = F.regexp_extract(line, rf"(?U)\A{SPACE}*", 0)
    return F.concat(indent, F.regexp_replace(F.substr(line, F.length(indent) + 1), "[ \t]+", " "))


def compress_text(text: Column) -> Column:
    kept = F.transform(collapse_blank_lines(F.transform(lines(text), right_trim)), squeeze)
    return F.when(is_blank(text), "").otherwise(F.array_join(kept, "\n"))
