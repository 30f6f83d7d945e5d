"""Typed values crushed at every level by expressions that are compiled from their type; no Python.

The type tells the nesting, so each list of each level gets an expression of its own: a list of more
than 2K items (any list if K is 0) becomes the node of ``truncate_list``, its kept items crushed in
turn. Levels deeper than ``DEPTH`` are written as they are. The result is compact JSON.

Edge cases: null values, items and fields are ``null``; keys of maps are written as strings, and a
field's or key's name counts as well as its value when an item is looked at for anomalies; a value
that isn't a string or holds none is no anomaly.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.lines import head, let, middle, tail
from skein.functions.predicates import value_anomaly, value_word
from skein.functions.rows import col, json_of
from skein.operators.jsonlists import DEPTH


def _odd(value: Column, of: T.DataType, depth: int = 0) -> Column | None:
    """Whether a string within the value marks an anomaly; None if none can."""
    if depth > DEPTH:
        return None
    if isinstance(of, T.StringType):
        return value_anomaly(value)
    if isinstance(of, T.StructType):
        if any(value_word(f.name) for f in of):
            return value.isNotNull()
        some = [x for f in of if (x := _odd(value.getField(f.name), f.dataType, depth + 1)) is not None]
        return F.greatest(*some, F.lit(False)) if some else None
    if isinstance(of, T.ArrayType):
        found = lambda items, kind: None if _odd(F.lit(None), kind, depth + 1) is None else F.coalesce(F.exists(items, lambda x: _odd(x, kind, depth + 1)), F.lit(False))
        return found(value, of.elementType)
    if isinstance(of, T.MapType):
        keys, values = _odd(F.lit(None), of.keyType, depth + 1), _odd(F.lit(None), of.valueType, depth + 1)
        some = [F.coalesce(F.exists(F.map_keys(value), lambda x: _odd(x, of.keyType, depth + 1)), F.lit(False))] if keys is not None else []
        some += [F.coalesce(F.exists(F.map_values(value), lambda x: _odd(x, of.valueType, depth + 1)), F.lit(False))] if values is not None else []
        return F.greatest(*some, F.lit(False)) if some else None
    return None


def _object(fields: list[tuple[str, Column]]) -> Column:
    pieces = [p for i, (name, value) in enumerate(fields) for p in (F.lit(("," if i else "") + json.dumps(name, ensure_ascii=False) + ":"), value)]
    return F.concat(F.lit("{"), *pieces, F.lit("}"))


def _array(items: Column, write) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, write), ","), F.lit("]"))


def _cut(items: Column, of: T.DataType, k: int, depth: int) -> Column:
    """The node of a truncated list."""
    write = lambda x: _written(x, of, k, depth + 1)
    odd = lambda x: _odd(x, of)
    found = F.filter(middle(items, k), lambda x: odd(x["item"])) if odd(F.lit(None)) is not None else F.slice(middle(items, k), 1, 0)
    ends = [(name, _array(part(items, k), write) if k else F.lit("[]")) for name, part in (("head", head), ("tail", tail))]
    anomalies = _array(found, lambda x: _object([("original_index", (x["at"] - 1).cast("string")), ("value", write(x["item"]))]))
    return _object([("__type__", F.lit('"truncated_list"')), *ends, ("anomalies", anomalies), ("omitted_count", (F.size(items) - 2 * k).cast("string"))])


def _written(value: Column, of: T.DataType, k: int, depth: int = 0) -> Column:
    null = lambda made: F.when(value.isNull(), "null").otherwise(made)
    deeper = lambda x, kind: _written(x, kind, k, depth + 1)
    if depth > DEPTH:
        return json_of(value)
    if isinstance(of, T.StructType):
        return null(_object([(f.name, deeper(value.getField(f.name), f.dataType)) for f in of]))
    if isinstance(of, T.ArrayType):
        whole = lambda xs: _array(xs, lambda x: deeper(x, of.elementType))
        cut = lambda xs: _cut(xs, of.elementType, k, depth)
        return null(let(value, lambda xs: F.when(F.size(xs) <= 2 * k, whole(xs)).otherwise(cut(xs)) if k else cut(xs)))
    if isinstance(of, T.MapType):
        entry = lambda e: F.concat(json_of(e["key"].cast("string")), F.lit(":"), deeper(e["value"], of.valueType))
        return null(F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(value), entry), ","), F.lit("}")))
    return json_of(value)


def crush_typed(value: Column, of: T.DataType, k: int = 5) -> Column:
    """The crushed JSON of a value of the type ``of``."""
    return _written(value, of, max(0, k))


def crush_column(df: DataFrame, name: str, k: int = 5, out: str = "compressed") -> DataFrame:
    """``df`` with the crushed JSON of its column ``name``."""
    return df.withColumn(out, crush_typed(col(name), df.schema[name].dataType, k))
