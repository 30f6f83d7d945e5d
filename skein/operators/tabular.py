"""CSV and TSV: header, first and last K rows, and anomalous rows between them with their numbers.

Texts without quotes are split by expressions; those with quotes go through Python's csv module
in an Arrow UDF. A text that can't be parsed stays as it is.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.lines import LINE_END, head, is_blank, let, middle, tail
from skein.functions.predicates import value_anomaly


#: Characters of a cell at most; a table with a longer one stays as it is. Fixed value.
LONGEST = 131072


def delimiter_of(text: Column) -> Column:
    return F.when(F.split(text, LINE_END, 2)[0].contains("\t"), "\t").otherwise(",")


def _cell(c: Column, delimiter: Column) -> Column:
    odd = c.contains(delimiter) | c.rlike('["\r\n]')
    return F.when(odd, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def write_row(row: Column, delimiter: Column) -> Column:
    text = F.concat_ws("", F.call_function("array_join", F.transform(row, lambda c: _cell(c, delimiter)), delimiter))
    return F.when((F.size(row) == 1) & (row[0] == ""), '""').otherwise(text)


def parse_plain(text: Column, delimiter: Column) -> Column:
    """Rows of cells of a text without quotes; a blank line is a row without cells. Null if a cell is too long."""
    flat = F.regexp_replace(text, "\r\n", "\n")
    parts = F.split(F.regexp_replace(flat, "\n\\z", ""), "\n", -1)
    cells = lambda x: F.when(delimiter == "\t", F.split(x, "\t", -1)).otherwise(F.split(x, ",", -1))
    rows = F.transform(parts, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(cells(x)))
    long = (F.length(text) > LONGEST) & F.exists(rows, lambda r: F.exists(r, lambda c: F.length(c) > LONGEST))
    return F.when(~long, rows)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def parse_quoted(text: pa.Array, delimiter: pa.Array) -> pa.Array:
    out = []
    for t, d in zip(text.to_pylist(), delimiter.to_pylist(), strict=True):
        try:
            out.append(None if t is None else list(csv.reader(io.StringIO(t, newline="\n"), delimiter=d)))
        except csv.Error:
            out.append(None)
    return pa.array(out, pa.list_(pa.list_(pa.string())))


def render(rows: Column, text: Column, delimiter: Column, k: int) -> Column:
    """The crushed table from its rows (null: the text stays); ``k`` rows at either end."""
    empty = F.array().cast("array<array<string>>")

    def body(r: Column, data: Column, found: Column) -> Column:
        pad = F.greatest(F.size(r[0]) - 1, F.lit(0))
        omitted = lambda n: F.when(n > 0, F.array(F.concat(F.array(F.concat(F.lit("... [omitted "), n, F.lit(" rows] ..."))), F.array_repeat(F.lit(""), pad)))).otherwise(empty)
        before = lambda i: F.when(i == 0, k).otherwise(F.element_at(found, F.greatest(i, F.lit(1)))["at"])
        numbered = lambda x: F.concat(F.array(F.concat(F.lit("[Row "), x["at"] + 1, F.lit("]"))), x["item"])
        shown = F.flatten(F.transform(found, lambda x, i: F.concat(omitted(x["at"] - before(i) - 1), F.array(numbered(x)))))
        last = F.when(F.size(found) == 0, k).otherwise(F.element_at(found, -1)["at"])
        end = omitted(F.size(data) - k - last)
        parts = [F.slice(r, 1, 1), head(data, k), shown, end, tail(data, k)] if k else [F.slice(r, 1, 1), shown, end]
        return F.concat(F.array_join(F.transform(F.concat(*parts), lambda x: write_row(x, delimiter)), "\n"), F.lit("\n"))

    def crushed(r: Column) -> Column:
        data = F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))
        found = lambda d: F.filter(middle(d, k), lambda x: F.exists(x["item"], value_anomaly))
        short = r.isNull() | (F.size(r) == 0) | ((F.size(r) - 1 <= 2 * k) if k else F.lit(False))
        return F.when(short, text).otherwise(let(data, lambda d: let(found(d), lambda f: body(r, d, f))))

    return F.when(is_blank(text), "").otherwise(let(rows, crushed))


def crush_rows(text: Column, k: int = 5, delimiter: str | None = None) -> Column:
    """The crushed table as a column. Only texts with quotes, lone carriage returns or other delimiters meet Python.

    Text and delimiter are bound once, whatever expressions they are: what is done for each cell only reads them.
    """
    k, sep = max(0, k), F.lit(delimiter) if delimiter else delimiter_of(text)
    odd = F.coalesce(text.rlike('"|\r(?!\n)'), F.lit(False)) | F.lit(delimiter not in (None, ",", "\t"))
    plain = let(F.struct(F.when(~odd, text).alias("text"), sep.alias("sep")), lambda x: parse_plain(x["text"], x["sep"]))
    rows = F.when(odd, parse_quoted(F.when(odd, text), sep)).otherwise(plain)
    return let(F.struct(rows.alias("rows"), text.alias("text"), sep.alias("sep")), lambda x: render(x["rows"], x["text"], x["sep"], k))


def crush_table(df: DataFrame, text: str = "text", k: int = 5, delimiter: str | None = None, out: str = "compressed") -> DataFrame:
    """``df`` with the column ``out``."""
    return df.withColumn(out, crush_rows(F.col(f"`{text}`"), k, delimiter))
