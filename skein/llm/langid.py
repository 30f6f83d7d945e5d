"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets marginal probabilities of the languages by forward-backward, so a text
may switch its language; the text's language is the one with the most probability over all its
words, and the score is that share. The model is fitted on at most ``PER_LANG`` whole training
texts of every language that the labels name (the first by hash of their id); words that are much more frequent in one
language than in the others make up the lexicon.

Nulls and edge cases: a text that is null or has no letter is ``und`` with score 0; ties go to the
first label in code-point order; without a single training text all are ``und``; repeated rows get
equal results; a null ``doc_id`` is never a training row (its remainder is null, so ``held_out`` is
false); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import sample, stage
from skein.llm.crf import Crf, tagger_of, train

#: Training texts of a language at most, and of their characters all.
PER_LANG = 250
#: Lexicon entries of a language.
LEXICON = 300


#: Runs of the word class without decimal digits; the other numerals in it, such as halves, are parted off word by word.
RUNS = re.compile(r"[^\W\d_]+")


def remainder(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def words(text: str | None) -> list[str]:
    """Runs of characters of the Unicode category L, in lower case."""
    found = RUNS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def lexicon(texts: list[list[str]], langs: list[str]) -> frozenset[str]:
    """Words at least ten times as frequent in one language as in all the others."""
    counts: dict[str, Counter] = {}
    for t, lang in zip(texts, langs, strict=True):
        counts.setdefault(lang, Counter()).update(t)
    totals, every = {k: sum(c.values()) for k, c in counts.items()}, sum(counts.values(), Counter())
    out = set()
    for lang, c in counts.items():
        rest = max(1, sum(totals.values()) - totals[lang])
        fit = [(n, w) for w, n in c.items() if n >= 3 and n / totals[lang] >= 10 * (every[w] - n) / rest]
        out |= {f"={w}" for _, w in sorted(fit, key=lambda x: (-x[0], x[1]))[:LEXICON]}
    return frozenset(out)


def fit(docs: DataFrame, training: Column, label: str = "lang", per_label: int = PER_LANG) -> Crf | None:
    """Learns from ``text`` and ``label`` of the rows for which ``training`` holds."""
    known = docs.filter(training & F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("string").alias("_y"), F.col("text").cast("string").alias("_t"))
    chosen = stage(sample(known.select("doc_id", "_y").distinct(), "_y", per_label), "sample")
    rows = known.join(chosen, ["doc_id", "_y"], "left_semi").groupBy("doc_id", "_y").agg(F.min("_t").alias("_t")).collect()  # the sample, a text each
    if not rows:
        return None
    rows = sorted(set(map(tuple, rows)), key=lambda r: (r[0], r[1], r[2]))
    texts, langs = [words(r[2]) for r in rows], [r[1] for r in rows]
    labels = sorted(set(langs))
    tags = [np.full(len(t), labels.index(y), np.int32) for t, y in zip(texts, langs, strict=True)]
    return train(texts, tags, labels, lexicon(texts, langs), epochs=3)


def predict(docs: DataFrame, crf: Crf | None, *more: Column) -> DataFrame:
    """doc_id, the columns ``more``, lang_pred and score of every whole text."""
    rows = docs.select(F.col("doc_id"), *more, F.col("text").cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = rows.columns[:-1]
    model = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        tagger = tagger_of(crf) if crf else None
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b = batch.slice(at, 128)
                texts = [words(t) for t in b.column(b.num_columns - 1).to_pylist()]
                langs, scores = [], []
                for m in tagger.marginals(texts) if tagger else [np.zeros((0, 1))] * len(texts):
                    if len(m):
                        share = m.mean(0, dtype=np.float64)
                        langs.append(crf.labels[int(share.argmax())])
                        scores.append(min(1.0, float(share.max())))
                    else:
                        langs.append("und")
                        scores.append(0.0)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
