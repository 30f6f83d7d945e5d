"""Cache alignment: volatile values become placeholders, and may be kept aside to be put back.

The rules can't overlap, so one pass over the text finds what they replace one after another. What
looks like a placeholder in the text itself is kept with the values, as its own value: then the
values and what looks like a placeholder in the aligned text are as many, in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.lines import let
from skein.functions.rows import col, packed, unpacked

_L, _R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Placeholders by pattern, in the order in which they apply. Fixed values.
RULES = (
    ("[UUID]", "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    ("[DATETIME]", r"\d{4}-\d{2}-\d{2}(?:T| +)\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("[DATE]", r"\d{4}-\d{2}-\d{2}"),
    ("[TIME]", r"\d{2}:\d{2}:\d{2}(?:\.\d+)?"),
    ("[COMMIT_HASH]", "[0-9a-fA-F]{40}"),
)


#: What a text must hold for any rule but the last, told at a fraction of their cost.
SIGN = "[-:](?:[0-9]{2}[-:][0-9]{2}|[0-9a-fA-F]{4}-)"


def _replaced(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Where a rule begins with a digit, that is looked for before what stands in front of it."""
    for name, pattern in rules:
        text = F.regexp_replace(text, ("(?=[0-9])" if pattern.startswith(r"\d") else "") + _L + f"(?:{pattern})" + _R, name)
    return text


def align(text: Column) -> Column:
    signed = F.when(text.rlike(SIGN), _replaced(text, RULES[:-1])).otherwise(text)
    return F.coalesce(_replaced(signed, RULES[-1:]), F.lit(""))


LIKE = r"\[(?:" + "|".join(name[1:-1] for name, _ in RULES) + r")\]"
KEPT = "|".join(_L + f"(?:{pattern})" + _R for _, pattern in RULES) + "|" + LIKE


def kept(text: Column) -> Column:
    """What ``put_back`` needs of a text to undo ``align``: an array of its values in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({KEPT})"), F.lit(1))


def put_back(aligned: Column, values: Column) -> Column:
    """The text that ``align`` was given; a null one is empty."""
    parts = F.struct(F.split(aligned, LIKE, -1).alias("text"), values.alias("value"))
    return let(parts, lambda p: F.array_join(F.transform(p["text"], lambda x, i: F.concat(x, F.coalesce(F.get(p["value"], i), F.lit("")))), ""))


def side_table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, place (from 0) and value of what ``align`` takes out of the texts of ``df``, whose ``key`` tells its rows apart."""
    return df.select(col(key).alias("key"), F.posexplode(kept(col(text))).alias("place", "value"))


def restore(df: DataFrame, side: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with the values of a side table put back into its aligned texts; rows with a null key or without values stay."""
    values = side.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "value")))["value"].alias("_values"))
    rows = df.select(packed(df).alias("_row"), col(key).alias("_key"), col(text).alias("_text"))
    joined = rows.join(values.withColumnRenamed("key", "_of"), F.col("_key") == F.col("_of"), "left")
    back = F.when(F.col("_values").isNull(), F.col("_text")).otherwise(put_back(F.col("_text"), F.col("_values")))
    return joined.select(*unpacked("_row", df.columns, {text: back}))
