"""Toxicity by a linear-chain conditional random field that tags toxic words.

Labels are of documents; words get theirs from them: a word of a toxic training document is toxic
if it, or its beginning, is bound to toxic documents beyond chance (a likelihood ratio test over
all units, corrected for their number, and again over the documents left unexplained). That gives
the labelled tokens and no more: the field, trained on these texts, has no list of words to look
at, only its own features (the word, affixes, n-grams), which carry over to unseen words, and its
transitions; forward-backward gives each word's marginal. Marginals aggregate to a document's score through a logistic curve
fitted on the training documents; words with a marginal of a half or more are the offending spans.

The classifier is fitted on at most ``TOXIC`` and ``CLEAN`` whole labelled documents, the first by
hash of their id. Only what is fitted is sampled, never what is scored.

Nulls and edge cases: a null or empty text has no words and the score of a text without findings;
labels that are null, and labels without a document, teach nothing; a document with several
labels counts by their greatest; without a toxic training document every score is 0; repeated
rows get equal results; a null ``doc_id`` is scored and not held out; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import sample, stage
from skein.llm.crf import Crf, Tagger, lexicon_hits, tagger_of, train

#: Labelled documents that the classifier is fitted on at most.
TOXIC, CLEAN = 1000, 2500
THRESHOLD = 0.7
TOKEN = re.compile(r"[^\W_]+")
#: Chance of a single false unit among all that are tested.
CHANCE = 0.01


def words(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def units(word: str) -> list[str]:
    """What is tested: the word and its beginnings of 4 to 8 characters."""
    return [f"={word}", *(f"{word[:k]}*" for k in range(4, min(len(word), 8) + 1))]


class Texts:
    """Texts as arrays of the numbers of their distinct words, which is all that the test of units looks at."""

    def __init__(self, texts: list[list[str]]) -> None:
        number: dict[str, int] = {}
        self.of = [np.unique(np.fromiter((number.setdefault(w, len(number)) for w in t), np.int32, len(t))) for t in texts]
        self.vocab = list(number)

    def seen(self, within: list[np.ndarray]) -> np.ndarray:
        """In how many of the texts each word is."""
        out = np.zeros(len(self.vocab), np.int64)
        for t in within:
            out[t] += 1
        return out


def groups(texts: Texts, sketch: int = 16, common: float = 0.02) -> list[int]:
    """A number for each text, equal for texts that share half of their least rare words by hash: copies aren't independent evidence."""
    rare = texts.seen(texts.of) <= max(3, common * len(texts.of))
    by_word = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in texts.vocab), np.uint32, len(texts.vocab))
    where: dict[int, int] = {}
    out: list[int] = []
    for i, t in enumerate(texts.of):
        s = np.sort(by_word[t[rare[t]]])[:sketch].tolist()
        votes = Counter(where[h] for h in s if h in where)
        g, n = votes.most_common(1)[0] if votes else (i, 0)
        out.append(g if n and 2 * n >= len(s) else i)
        for h in s:
            where.setdefault(h, out[i])
    return out


def bound_units(words_of: list[list[str]], toxic: list[bool]) -> frozenset[str]:
    """Units whose documents are toxic more often than not, and beyond chance; near copies count once.

    Documents with a unit found are set aside and the rest is tested again, so that words of a
    less frequent language are held against what is still unexplained.
    """
    texts = Texts(words_of)
    merged: dict[tuple[int, bool], list[np.ndarray]] = defaultdict(list)
    for t, g, y in zip(texts.of, groups(texts), toxic, strict=True):
        merged[g, y].append(t)
    left, out = [(t[0] if len(t) == 1 else np.unique(np.concatenate(t)), y) for (_, y), t in merged.items()], set()
    while new := beyond_chance(texts, left):
        out |= new
        hit = np.fromiter((bool(lexicon_hits(w, new)) for w in texts.vocab), bool, len(texts.vocab))
        left = [(t, y) for t, y in left if not hit[t].any()]
    return frozenset(out)


def beyond_chance(texts: Texts, left: list[tuple[np.ndarray, bool]]) -> set[str]:
    share = sum(y for _, y in left) / max(len(left), 1)
    if share in (0, 1):
        return set()
    number: dict[str, int] = {}  # of each unit of a toxic text
    for i in np.flatnonzero(texts.seen([t for t, y in left if y])).tolist():
        for u in units(texts.vocab[i]):
            number.setdefault(u, len(number))
    per_word, flat = np.zeros(len(texts.vocab), np.int64), array("i")
    for i in np.flatnonzero(texts.seen([t for t, _ in left])).tolist():
        known = [number[u] for u in units(texts.vocab[i]) if u in number]
        per_word[i] = len(known)
        flat.extend(known)
    flat, first = np.frombuffer(flat, np.int32), np.cumsum(per_word) - per_word
    counts = np.zeros((2, len(number)), np.int64)
    for t, y in left:
        n = per_word[t]
        counts[int(y), np.unique(flat[np.repeat(first[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())])] += 1
    clean, bad = counts
    need = np.log(max(int((clean + bad >= 3).sum()), 1) / CHANCE)
    p = bad / (clean + bad)
    gain = bad * np.log(p / share) + clean * np.log(np.maximum(1 - p, 1e-9) / (1 - share))
    found = (clean + bad >= 3) & (p >= max(0.5, share)) & (gain >= need)
    return {u for u, k in number.items() if found[k]}


def summary(marginals: np.ndarray) -> list[float]:
    """What the score is made of: log odds of the greatest marginal, and the expected number of toxic words."""
    p = marginals[:, 1] if len(marginals) else np.zeros(1)
    top = float(np.clip(p.max(), 1e-6, 1 - 1e-6))
    return [np.log(top / (1 - top)) / 14, np.log1p(float(p.sum(dtype=np.float64)))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Newton's method; the last weight is the constant."""
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", most: tuple[int, int] = (TOXIC, CLEAN)) -> Crf | None:
    """Learns from the texts of ``docs`` and ``label`` (1: toxic) of ``labels``, of ids for which ``training`` holds."""
    known = labels.filter(training & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(F.col(label).cast("int")) == 1).cast("int").alias("_y"))
    some = sample(known.filter("_y = 1"), "_y", most[0]).unionByName(sample(known.filter("_y = 0"), "_y", most[1]))
    chosen = stage(some, "sample")
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("_t"))
    rows = texts.join(chosen, "doc_id").groupBy("doc_id", "_y").agg(F.min("_t").alias("_t")).collect()  # the sample, a text each
    rows = sorted((r["doc_id"], r["_t"], r["_y"]) for r in rows)
    same: dict[str, str] = {}  # a word is held once
    toxic = [y == 1 for _, _, y in rows]
    tokens = [[same.setdefault(w, w) for w in words(t)] for _, t, _ in rows]
    del rows, same  # the driver's memory is small
    return learn(tokens, toxic)


def learn(texts: list[list[str]], toxic: list[bool]) -> Crf | None:
    """The field and the curve from whole labelled texts; None without toxic or without clean ones."""
    if not any(toxic) or all(toxic):
        return None
    found = bound_units(texts, toxic)
    x, y = [], []
    for t, bad in zip(texts, toxic, strict=True):
        tag = np.array([bad and bool(lexicon_hits(w, found)) for w in t], np.int8)
        if not bad or tag.any():  # a toxic document without a known word would teach that its words are clean
            x.append(t)
            y.append(tag)
    crf = train(x, y, ["clean", "toxic"], epochs=4)
    tagger, seen = Tagger(crf), []
    for at in range(0, len(texts), 128):
        seen += [summary(m) for m in tagger.marginals(texts[at : at + 128])]
    crf.extra["curve"] = logistic(np.array(seen), np.array(toxic, float))
    return crf


def chance(crf: Crf, marginals: np.ndarray) -> float:
    """A document's score from the marginals of its words."""
    return float(1 / (1 + np.exp(-np.clip(float(np.r_[summary(marginals), 1.0] @ crf.extra["curve"]), -30, 30))))


def score(docs: DataFrame, crf: Crf | None, *more: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the columns ``more``, score, predicted and the offending ``spans`` (start and end in characters, marginal) of every whole text."""
    rows = docs.select(F.col("doc_id"), *more, F.col("text").cast("string").alias("_text"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("marginal", T.FloatType())])
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float32())]))
    names = rows.columns[:-1]
    model = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        tagger = tagger_of(crf) if crf else None
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b = batch.slice(at, 128)
                raw = b.column(b.num_columns - 1).to_pylist()
                texts = [words(t) for t in raw]
                scores, found = [], []
                for t, m in zip(raw, tagger.marginals(texts) if tagger else [np.zeros((0, 2))] * len(raw), strict=True):
                    scores.append(chance(crf, m) if crf else 0.0)
                    bad = np.flatnonzero(m[:, 1] >= 0.5)
                    found.append(offsets(t, m, bad) if len(bad) else [])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, kind)], [*names, "score", "predicted", "spans"])

    return rows.mapInArrow(run, schema)


def offsets(text: str, marginals: np.ndarray, bad: np.ndarray) -> list[dict]:
    """Where the offending words stand in the text, which lower-casing may have lengthened."""
    lower = text.lower()
    at = [m.span() for m in TOKEN.finditer(lower)]
    back = range(len(text)) if len(lower) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    return [{"start": back[at[i][0]], "end": back[at[i][1] - 1] + 1, "marginal": float(marginals[i, 1])} for i in bad]
