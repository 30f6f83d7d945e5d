"""Rows as values, so that an operator's own columns never meet those of its user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.lines import let


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str, of: str | None = None) -> Column:
    """The column of exactly this name, whatever it holds; of a struct ``of``, its field."""
    return F.col(quoted(name) if of is None else f"{of}.{quoted(name)}")


def packed(df: DataFrame) -> Column:
    """All columns as one struct."""
    return F.struct(*[col(c).alias(c) for c in df.columns])


def unpacked(row: str, names: list[str], new: dict[str, Column]) -> list[Column]:
    """The fields of a packed row; those that ``new`` names give way to it, at their place or at the end."""
    kept = [new[c].alias(c) if c in new else col(c, row).alias(c) for c in names]
    return kept + [value.alias(c) for c, value in new.items() if c not in names]


def json_of(value: Column) -> Column:
    """The JSON of any value; null for null."""
    return let(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), lambda j: F.substr(j, F.lit(6), F.length(j) - 6))
