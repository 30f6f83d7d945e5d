"""Code: bodies of functions leave a token in their place and become blocks of the store."""

from __future__ import annotations

import ast
import contextlib
import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = pa.struct([("skeleton", pa.string()), ("blocks", pa.list_(pa.struct([("hash", pa.string()), ("lang", pa.string()), ("size", pa.int32()), ("content", pa.string())])))])
TYPE = "struct<skeleton:string,blocks:array<struct<hash:string,lang:string,size:int,content:string>>>"
#: Words with which an identifier before a bracket may not begin, words that open a function, and characters that a body needs. Fixed values.
NOT_FUNCTIONS = ("if", "for", "while", "switch", "catch", "class")
OPENERS = ("func", "function")
LEAST = 10
WORD = re.compile(r"\w+")
SPACE = re.compile(r"\s*")
PIECES = re.compile(r"""(["'`])(?:\\.|(?!\1)[^\\])*(?:\1|\Z)|//[^\n]*|/\*.*?(?:\*/|\Z)|[{}]""", re.DOTALL)


def token_of(content: str, lang: str) -> tuple[str, dict]:
    digest = hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()
    return f"<<ccr:{digest},{lang},{len(content)}>>", {"hash": digest, "lang": lang, "size": len(content), "content": content}


def closing(text: str, at: int) -> int:
    """Where the brace at ``at`` closes, strings and comments aside; -1 if nowhere."""
    depth = 0
    for m in PIECES.finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth and m[0] == "}":
            return m.start()
    return -1


class Finder:
    """Where a sign stands next; what was found is kept, so that asking in order reads a text once."""

    def __init__(self, text: str, sign: str) -> None:
        self.text, self.sign, self.at, self.found = text, sign, 0, -2

    def after(self, at: int) -> int:
        """-1 if nowhere."""
        if self.found == -2 or at < self.at or -1 < self.found < at:
            self.at, self.found = at, self.text.find(self.sign, at)
        return self.found


def signatures(text: str) -> Iterator[tuple[int, int]]:
    """(first brace, place after the signature's brace) of what looks like a function's head, in order.

    A head is ``func`` or ``function`` and a name with a brace on the name's line, or an identifier,
    a bracket up to the first closing one and the next brace, wherever that is. What is sent back
    is the place from which to go on.
    """
    opening, closing_, ends = Finder(text, "{"), Finder(text, ")"), Finder(text, "\n")
    at = 0
    while m := WORD.search(text, at):
        at, first = m.end(), opening.after(m.start())
        if first < 0:
            return
        head = -1
        after = SPACE.match(text, at).end()
        if m[0] in OPENERS and after > at and (name := WORD.match(text, after)):
            brace, line = opening.after(name.end()), ends.after(name.end())
            head = brace if brace >= 0 and not -1 < line < brace else -1
            first = opening.after(m.start())
        if head < 0 and text[after : after + 1] == "(" and not m[0].startswith(NOT_FUNCTIONS):
            close = closing_.after(after)
            head = opening.after(close) if close >= 0 else -1
            first = opening.after(m.start())
        if head >= 0:
            at = (yield first, head + 1) or head + 1


def cut(text: str, spans: Iterable[tuple[int, int, str]], lang: str) -> tuple[str, list[dict]]:
    """``text`` with a token, after what stands before it, in place of each span (from, to, what stands before); spans are in order and apart."""
    pieces, blocks, done = [], [], 0
    for start, end, lead in spans:
        token, block = token_of(text[start:end], lang)
        blocks.append(block)
        pieces += [text[done:start], lead, token]
        done = end
    return "".join([*pieces, text[done:]]), blocks


def between_braces(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans between the braces of what looks like a function, outermost first found; short ones stay."""
    heads, after = signatures(text), None
    with contextlib.suppress(StopIteration):
        while True:
            opened, after = heads.send(after)
            end = closing(text, opened)
            if end >= 0:
                after = end + 1
                if len(text[opened + 1 : end].strip()) > LEAST:
                    yield opened + 1, end, ""


def braces(text: str, lang: str) -> tuple[str, list[dict]]:
    return cut(text, between_braces(text), lang)


def functions(tree: ast.Module) -> Iterator[ast.FunctionDef | ast.AsyncFunctionDef]:
    """Functions at the top, in classes and in the main part of statements, none within another."""
    todo = deque([tree])
    while todo:
        for node in todo.popleft().body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                yield node
            elif isinstance(getattr(node, "body", None), list):
                todo.append(node)


def python(text: str, keep_docstring: bool = False) -> tuple[str, list[dict]] | None:
    """The whole lines of each body leave a token at their indentation; None if it isn't Python."""
    try:
        found = list(functions(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    runs = []
    for f in found:
        body = f.body[1:] if keep_docstring and ast.get_docstring(f) is not None else f.body
        if body and body[0].lineno > f.lineno:  # else it begins on the line of its head
            runs.append((body[0].lineno - 1, body[-1].end_lineno))
    if not runs:
        return text, []
    end, lines = "\r\n" if "\r\n" in text else "\n", text.splitlines()
    starts = [0, *accumulate(len(x) + len(end) for x in lines)]
    whole = end.join(lines) + (end if text.endswith("\n") else "")
    blank = lambda x: x[: len(x) - len(x.lstrip())]
    return cut(whole, [(starts[a], starts[b] - len(end), blank(lines[a])) for a, b in sorted(runs)], "python")


def skeleton(text: str | None, lang: str | None, keep_docstring: bool = False) -> dict:
    if not (text or "").strip():
        return {"skeleton": "", "blocks": []}
    done = None
    if lang == "python" or (not lang and re.search("def |import |class ", text)):
        done = python(text, keep_docstring)
    done = done or braces(text, lang or "generic")
    return {"skeleton": done[0], "blocks": done[1]}


def compress_code(text: Column, lang: Column | None = None, keep_docstring: bool = False) -> Column:
    """Struct of the skeleton and its blocks."""
    @F.arrow_udf(TYPE)
    def run(texts: pa.Array, langs: pa.Array) -> pa.Array:
        return pa.array([skeleton(t, x, keep_docstring) for t, x in zip(texts.to_pylist(), langs.to_pylist(), strict=True)], KIND)

    return run(text, F.lit(None).cast("string") if lang is None else lang)
