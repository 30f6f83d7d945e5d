"""Which compressor a document gets: by file name, MIME type, then content."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.lines import LINE_END, is_blank, let
from skein.functions.rows import packed, unpacked
from skein.operators.align import align
from skein.operators.code import KIND, TYPE, skeleton
from skein.operators.jsonlists import is_json, render
from skein.operators.logs import crush_log
from skein.operators.retrievable import keep_log, keep_table
from skein.operators.tabular import crush_rows
from skein.operators.text import compress_text

#: Extensions, MIME parts and log marks. Fixed values.
CODE = (".py", ".js", ".ts", ".go", ".cpp", ".h", ".hpp", ".java", ".cs", ".rs", ".swift")
MIME = (("json", ("json",)), ("log", ("log",)), ("tabular", ("csv", "tab-separated-values")), ("code", ("python", "javascript", "code")))
LOG_MARKS = ("[info]", "[error]", "[warn]", "[debug]", "error:", "warning:", "traceback", "exception:")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/\\]*)$", 1), r"^\.*[^.].*(\.[^.]*)$", 1))


def by_extension(name: Column) -> Column:
    ext = extension(F.coalesce(name, F.lit("")))
    return F.when(ext == ".json", "json").when(ext.isin(*CODE), "code").when(ext == ".log", "log").when(ext.isin(".csv", ".tsv"), "tabular")


def language(name: Column) -> Column:
    ext = extension(F.coalesce(name, F.lit("")))
    return F.when(ext == ".py", "python").when(ext.isin(*CODE), F.substr(ext, F.lit(2)))


def by_mime(mime: Column) -> Column:
    low = F.lower(mime)
    out = F.lit(None).cast("string")
    for route, parts in reversed(MIME):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(x) for x in parts]), route).otherwise(out)
    return out


def _even(first: Column, sign: str) -> Column:
    """Whether two or three lines hold ``sign`` equally often."""
    counts = F.transform(F.filter(F.slice(first, 1, 3), lambda x: ~x.rlike(r"^\s*$")), lambda x: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit(""))))
    return let(counts, lambda c: (F.size(c) >= 2) & (F.size(F.array_distinct(c)) == 1) & (F.get(c, F.lit(0)) > 0))


def by_content(text: Column) -> Column:
    """All but JSON, which is told by parsing. Only the first lines are parted from the text, once."""
    has = text.contains
    code = (has("def ") & has(":")) | has("import ") | (has("class ") & has("{")) | (has("function ") & has("{"))
    marked = lambda x: reduce(lambda a, b: a | b, [x.contains(m) for m in LOG_MARKS])
    shape = lambda first: F.when(_even(first, ",") | _even(first, "\t"), "tabular").when(F.size(F.filter(first, lambda x: marked(F.lower(x)))) >= 2, "log")
    told = let(F.slice(F.split(text, LINE_END, 21), 1, 20), shape)
    return let(told, lambda x: F.when(x == "tabular", x).when(code, "code").when((x == "log") | F.lower(text).contains("traceback"), "log").otherwise("text"))


def named(df: DataFrame) -> Column:
    """The route that blankness, file name or type tells, else null."""
    return F.when(is_blank(F.col("text")), "empty").otherwise(F.coalesce(by_extension(F.col("filename")), by_mime(F.col("mime_type"))))


def route(df: DataFrame) -> DataFrame:
    """``df`` (filename, mime_type, text) with its route; only documents that neither name nor type tells are parsed as JSON."""
    first = df.withColumn("route", named(df))
    told = F.when(is_json(F.when(F.col("route").isNull(), F.col("text"))), "json").otherwise(by_content(F.col("text")))
    return first.withColumn("route", F.coalesce("route", told))


def _parsed(k: int, output: str):
    """What needs a parser, in one pass: the JSON of a text that may be some, else the skeleton of one that is code."""
    kind = pa.struct([("json", pa.string()), ("code", KIND)])

    def one(text: str | None, named_: str | None, content: str | None, lang: str | None) -> dict | None:
        made = render(text, k, output) if text is not None and named_ in (None, "json") else None
        if made is not None:
            return {"json": made}
        return {"code": skeleton(text, lang)} if text is not None and (named_ or content) == "code" else None

    @F.arrow_udf(f"struct<json:string,code:{TYPE}>")
    def run(texts: pa.Array, named_: pa.Array, contents: pa.Array, langs: pa.Array) -> pa.Array:
        return pa.array(map(one, *(x.to_pylist() for x in (texts, named_, contents, langs))), kind)

    return run


def compress(df: DataFrame, k_elements: int = 5, k_lines: int = 20, k_rows: int = 5, output: str = "json", aligned: bool = False, retrievable: bool = False) -> DataFrame:
    """``df`` with route, compressed and blocks, in one pass over it; columns of these names give way to them, all others stay.

    Only documents that may be JSON or code are handed to Python, once; the others' texts stay in the JVM.
    ``retrievable``: what logs and tables omit becomes blocks too, so that it can be put back.
    """
    text = F.col("text")
    rows = df.select(packed(df).alias("_row"), (align(text) if aligned else text).alias("text"), *[F.col(c) for c in ("filename", "mime_type")])
    first = rows.withColumn("_named", named(rows))
    guess = first.withColumn("_content", F.when(F.col("_named").isNull(), by_content(text)))
    open_ = F.col("_named").isNull() | F.col("_named").isin("json", "code")
    read = guess.withColumn("_made", _parsed(k_elements, output)(F.when(open_, text), F.col("_named"), F.col("_content"), language(F.col("filename"))))
    routed = read.withColumn("_route", F.coalesce("_named", F.when(F.col("_made.json").isNotNull(), "json").otherwise(F.col("_content"))))
    is_ = lambda name: F.col("_route") == name
    log, table, found = crush_log(text, k_lines), crush_rows(F.when(is_("tabular"), text), k_rows), F.when(is_("code"), F.col("_made.code.blocks"))
    if retrievable:
        kept = F.when(is_("log"), keep_log(text, k_lines)).when(is_("tabular"), keep_table(text, k_rows))
        routed = routed.withColumn("_kept", kept)
        log, table, found = F.col("_kept.skeleton"), F.col("_kept.skeleton"), found.otherwise(F.col("_kept.blocks"))
    made = (
        F.when(is_("empty"), "").when(is_("json"), F.coalesce("_made.json", compress_text(text))).when(is_("code"), F.col("_made.code.skeleton"))
        .when(is_("log"), log).when(is_("tabular"), table).otherwise(compress_text(text))
    )
    new = {"text": text} if aligned else {}
    return routed.select(*unpacked("_row", df.columns, new | {"route": F.col("_route"), "compressed": made, "blocks": found}))
