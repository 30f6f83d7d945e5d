"""JSON lists: typed arrays by expressions, any JSON text by an Arrow UDF."""

from __future__ import annotations

import csv
import io
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.lines import head, is_blank, middle, tail
from skein.functions.predicates import VALUE, value_anomaly
from skein.operators.text import compress_text

DEPTH = 100
_WORDS = re.compile(VALUE)


def truncate_list(items: Column, k: int = 5) -> Column:
    """head, tail, anomalies (original_index from 0, value) and omitted_count of a typed array of more than 2K items; of every array if K is 0."""
    k = max(0, k)
    whole = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    found = F.filter(middle(items, k), lambda x: value_anomaly(whole(x["item"])))
    return F.when((F.size(items) > 2 * k) | F.lit(k == 0), F.struct(
        F.lit("truncated_list").alias("__type__"), (head(items, k) if k else F.slice(items, 1, 0)).alias("head"), (tail(items, k) if k else F.slice(items, 1, 0)).alias("tail"),
        F.transform(found, lambda x: F.struct((x["at"] - 1).alias("original_index"), x["item"].alias("value"))).alias("anomalies"), (F.size(items) - 2 * k).alias("omitted_count"),
    ))


class Cut(dict):
    """A truncated list; a user's object of the same looks stays an object."""


def _odd(x, depth: int = 0) -> bool:
    if depth > DEPTH:
        return False
    if isinstance(x, str):
        return bool(_WORDS.search(x))
    if isinstance(x, dict):
        return any(_odd(y, depth + 1) for kv in x.items() for y in kv)
    return isinstance(x, list) and any(_odd(y, depth + 1) for y in x)


def crush(x, k: int, depth: int = 0):
    if depth > DEPTH:
        return x
    deeper = lambda y: crush(y, k, depth + 1)
    if isinstance(x, dict):
        return {key: deeper(y) for key, y in x.items()}
    if not isinstance(x, list):
        return x
    n = len(x)
    if 0 < k and n <= 2 * k:
        return [deeper(y) for y in x]
    found = [{"original_index": i, "value": deeper(x[i])} for i in range(k, n - k) if _odd(x[i])]
    return Cut({"__type__": "truncated_list", "head": [deeper(y) for y in x[:k]], "tail": [deeper(y) for y in x[n - k :]] if k else [], "anomalies": found, "omitted_count": n - 2 * k})


def leaves(x, path: str = ""):
    """(path, type, value) of each leaf; a cut list has a row for what is missing."""
    if isinstance(x, Cut):
        yield path, "truncated_list", f"({x['omitted_count']} items omitted)"
        for i, y in enumerate(x["head"]):
            yield from leaves(y, f"{path}[{i}]")
        for a in x["anomalies"]:
            yield from leaves(a["value"], f"{path}[{a['original_index']}] (ANOMALY)")
        for i, y in enumerate(x["tail"]):
            yield from leaves(y, f"{path}[tail_{i}]")
    elif isinstance(x, dict):
        for key, y in x.items():
            yield from leaves(y, f"{path}.{key}" if path else key)
    elif isinstance(x, list):
        for i, y in enumerate(x):
            yield from leaves(y, f"{path}[{i}]")
    else:
        yield path, type(x).__name__, str(x)


def bullets(x, level: int = 0):
    """Nested bullets, two blanks a level; what a bullet holds stands a level deeper, in a cut list three.

    The titles and labels are fixed values.
    """
    pad = "  " * level
    if isinstance(x, Cut):
        first = len(x["head"])
        sections = [(f"Head (First {first} items)", [(str(i), y) for i, y in enumerate(x["head"])])]
        if x["anomalies"]:
            sections.append(("Anomalies Found", [(f"Index {a['original_index']}", a["value"]) for a in x["anomalies"]]))
        sections.append((f"Tail (Last {len(x['tail'])} items)", [(str(first + x["omitted_count"] + i), y) for i, y in enumerate(x["tail"])]))
        yield f"{pad}* **List (Truncated)**: {x['omitted_count']} items omitted"
        for title, entries in sections:
            yield f"{pad}  * **{title}:**"
            for name, y in entries:
                yield f"{pad}    * [{name}]:"
                yield from bullets(y, level + 3)
    elif isinstance(x, dict | list):
        for name, y in [(f"**{n}**", y) for n, y in x.items()] if isinstance(x, dict) else [(f"[{i}]", y) for i, y in enumerate(x)]:
            if isinstance(x, dict) and not isinstance(y, dict | list):
                yield f"{pad}* {name}: {y}"
            else:
                yield f"{pad}* {name}:"
                yield from bullets(y, level + 1)
        if not x:
            yield ""
    else:
        yield f"{pad}{x}"


def render(text: str, k: int, output: str = "json", sort_keys: bool = False) -> str | None:
    """None if the text isn't JSON. Lone surrogates, which no UTF-8 text can hold, come out as their escapes."""
    try:
        x = crush(json.loads(text), max(0, k))
        if output == "csv-schema":
            out = io.StringIO()
            w = csv.writer(out)
            w.writerow(["Path", "Type", "Value"])
            w.writerows(leaves(x))
            made = out.getvalue()
        elif output == "markdown-kv":
            made = "\n".join(bullets(x))
        else:
            made = json.dumps(x, indent=2, sort_keys=sort_keys)
    except (ValueError, RecursionError):
        return None
    return made.encode("utf-8", "backslashreplace").decode()


def render_json(text: Column, k: int = 5, output: str = "json", sort_keys: bool = False) -> Column:
    """The crushed JSON, null for what isn't JSON; each text is parsed once."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else render(t, k, output, sort_keys) for t in texts.to_pylist()], pa.string())

    return run(text)


def crush_json(text: Column, k: int = 5, output: str = "json", sort_keys: bool = False) -> Column:
    """What isn't JSON is compressed as prose."""
    return F.when(is_blank(text), "").otherwise(F.coalesce(render_json(text, k, output, sort_keys), compress_text(text)))


@F.arrow_udf(T.BooleanType())
def is_json(texts: pa.Array) -> pa.Array:
    def ok(t: str | None) -> bool:
        try:
            json.loads(t or "")
            return True
        except (ValueError, RecursionError):
            return False

    return pa.array([ok(t) for t in texts.to_pylist()], pa.bool_())
