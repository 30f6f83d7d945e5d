"""Truncation that can be undone: what logs, tables and lists omit becomes blocks with tokens; expressions only.

A text is cut into parts (lines, records, items) that keep what ends them, so that the parts joined
are the text. The first and last K and the anomalous ones between them stay. Each run of others is
taken out as one block and leaves a token, whose language says what it held (``log 12 lines``); the
end of its last part stays. Decompressing the skeleton once, with the blocks in the store, gives the
text to the last character, whatever its line ends or quotes.

Edge cases: a null text is null without blocks; a text of at most 2K parts, and runs of at most
``TOKEN_COST`` characters, which a token would not shorten, stay. Equal runs are one block of the
store. A text that holds a token already stays whole, as its token could not be told from new ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.lines import let, middle
from skein.functions.predicates import log_anomaly, value_anomaly
from skein.functions.rows import json_of
from skein.operators.blocks import TOKEN, TOKEN_COST, content_hash
from skein.operators.logs import runs

BLOCKS = "array<struct<hash:string,lang:string,size:int,content:string>>"
PART = "array<struct<text:string,end:string>>"
#: Single characters that end a line, as in ``LINE_END``, and the place after an end; CR LF is one end.
_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
_AFTER_END = r"(?<=[\n\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]|\r(?!\n))"


def _record(sep: str) -> str:
    """A record with its end: cells, quoted only if they begin with a quote, in which separators and line ends count for nothing."""
    cell = rf'(?:"(?:[^"]++|"")*+"?+)?+[^{sep}\n]*+'
    return rf"{cell}(?:{sep}{cell})*+(?:\n|\z)"


def _ended(pieces: Column, ends: str) -> Column:
    """Parts of pieces that end with one of ``ends``, with CR LF or with none; the empty piece at a text's end is no part."""

    def part(piece: Column) -> Column:
        last = F.right(piece, F.lit(1))
        width = F.when(piece.endswith("\r\n"), 2).when(F.lit(ends).contains(last), 1).otherwise(0)
        return let(width, lambda w: F.struct(F.left(piece, F.length(piece) - w).alias("text"), F.right(piece, w).alias("end")))

    return F.transform(F.filter(pieces, lambda x: x != ""), part).cast(PART)


def log_parts(text: Column) -> Column:
    return _ended(F.split(text, _AFTER_END, -1), _ENDS)


def table_parts(text: Column) -> Column:
    """Records by the delimiter that the first line shows: a tab if it has one, else a comma."""
    by = lambda sep: F.regexp_extract_all(text, F.lit(f"({_record(sep)})"), F.lit(1))
    return _ended(F.when(F.substring_index(text, "\n", 1).contains("\t"), by("\t")).otherwise(by(",")), "\n")


def list_parts(items: Column) -> Column:
    """The items of a typed array as JSON, a comma after each but the last."""
    return F.transform(items, lambda x, i: F.struct(json_of(x).alias("text"), F.when(i + 1 < F.size(items), ",").otherwise("").alias("end"))).cast(PART)


def _cut(parts: Column, k: int, first: int, odd, kind: str, unit: str) -> Column:
    """skeleton and blocks of parts, of which the first ``first`` stay beside K at either end."""
    join = lambda xs: F.array_join(F.transform(xs, lambda p: F.concat(p["text"], p["end"])), "")

    def block(run: Column) -> Column:
        def told(end: Column) -> Column:
            whole = join(run["items"]["item"])
            return let(F.substr(whole, F.lit(1), F.length(whole) - F.length(end)), lambda c: F.struct(
                run["first"].alias("first"), run["last"].alias("last"), end.alias("end"),
                F.struct(content_hash(c).alias("hash"), F.concat(F.lit(f"{kind} "), run["last"] - run["first"] + 1, F.lit(f" {unit}")).alias("lang"), F.length(c).alias("size"), c.alias("content")).alias("block"),
            ))

        return let(F.element_at(run["items"], -1)["item"]["end"], told)

    def skeleton(all_: Column, gaps: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.element_at(gaps, F.greatest(i, F.lit(1)))["last"])
        token = lambda b: F.concat(F.lit("<<ccr:"), b["hash"], F.lit(","), b["lang"], F.lit(","), b["size"], F.lit(">>"))
        shown = F.transform(gaps, lambda g, i: F.concat(join(F.slice(all_, before(i) + 1, g["first"] - before(i) - 1)), token(g["block"]), g["end"]))
        last = F.when(F.size(gaps) == 0, 0).otherwise(F.element_at(gaps, -1)["last"])
        return F.concat(F.array_join(shown, ""), join(F.slice(all_, last + 1, F.size(all_) - last)))

    def done(all_: Column) -> Column:
        kept = F.filter(middle(all_, k), lambda x: (x["at"] > k + first) & ~odd(x["item"]["text"]))
        gaps = F.filter(F.transform(F.coalesce(runs(kept), F.array()), block), lambda g: g["block"]["size"] > TOKEN_COST)
        return let(gaps, lambda g: F.struct(skeleton(all_, g).alias("skeleton"), F.transform(g, lambda x: x["block"]).cast(BLOCKS).alias("blocks")))

    return let(parts, done)


def _whole(text: Column) -> Column:
    return F.struct(text.alias("skeleton"), F.array().cast(BLOCKS).alias("blocks"))


def keep_log(text: Column, k: int = 20) -> Column:
    """Struct of the skeleton and its blocks: the first and last K lines and the anomalous ones stay in sight."""
    return F.when(text.isNull() | text.rlike(TOKEN), _whole(text)).otherwise(_cut(log_parts(text), max(0, k), 0, log_anomaly, "log", "lines"))


def keep_table(text: Column, k: int = 5) -> Column:
    """The same for CSV and TSV: the header stays too, and records are cut where they truly end."""
    return F.when(text.isNull() | text.rlike(TOKEN), _whole(text)).otherwise(_cut(table_parts(text), max(0, k), 1, value_anomaly, "table", "rows"))


def keep_list(items: Column, k: int = 5) -> Column:
    """The same for a typed array, whose JSON the skeleton decompresses to; ``from_json`` then gives the array."""
    made = _cut(list_parts(items), max(0, k), 0, value_anomaly, "json", "items")
    some = let(made, lambda m: F.struct(F.concat(F.lit("["), m["skeleton"], F.lit("]")).alias("skeleton"), m["blocks"].alias("blocks")))
    tokens = F.exists(items, lambda x: json_of(x).rlike(TOKEN))
    return F.when(items.isNull() | tokens, _whole(F.to_json(items, {"ignoreNullFields": "false"}))).otherwise(some)
