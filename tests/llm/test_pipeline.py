"""The pipeline's stages against plain versions, and all of it on small tables."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import mixing
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MORE = DOCS + ", `n.x` string, _row string, _id int, `a``b` string, size int"


def texts():
    rng = np.random.default_rng(3)
    prose = [" ".join(f"w{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.integers(0, 600, 80)) for _ in range(60)]
    rows = [(i, f"{t}\nshared line\n{t[::-1]}" + (" zorgish zorgish" if i % 3 == 0 else "")) for i, t in enumerate(prose)]
    rows += [(100, prose[1] + " more"), (101, prose[1] + " more"), (101, prose[1] + " more"), (102, None), (102, None), (103, ""), (104, "alone"), (105, "alone"), (None, "no id")]
    return rows


def wide(spark, rows):
    """Columns with dots, quotes and names that the stages use themselves."""
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t) if t is not None else None, "dot", "own", 3, "tick", 4) for k, (i, t) in enumerate(rows)], MORE)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t) if t is not None else None) for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture
def table(spark, tmp_path):
    def write(rows):
        d = f"{tmp_path}/{len(rows)}"
        frame(spark, rows).write.parquet(f"{d}/documents.parquet")
        labels = [(i, 1, int("zorgish" in t)) for i, t in rows if i is not None and i < 60]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        return d

    return write


def lines_left(rows):
    kept = brute.line_dedup(rows, 1)
    return [(i, kept[i, t][2]) for i, t in rows if not kept[i, t][1] or kept[i, t][2].strip()]


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_drop_toxic(spark, table):
    rows = texts()
    got = pairs(corpus_pipeline.drop_toxic(spark, frame(spark, rows), table(rows)))
    assert got == sorted(((i, t) for i, t in rows if "zorgish" not in (t or "")), key=repr)


def test_dedup_lines(spark):
    rows = texts()
    out = corpus_pipeline.dedup_lines(spark, frame(spark, rows), "")
    assert pairs(out) == sorted(lines_left(rows), key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


def test_drop_near_duplicates(spark):
    rows = [x for x in texts() if x[0] is not None]
    first = brute.near_duplicates(sorted(set(rows), key=repr))
    want = sorted({(i, t) for i, t in rows if first[i][1] == i}, key=repr)
    assert pairs(corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")) == want


def test_run(spark, table):
    rows = texts()
    left = {i for i, _ in lines_left([(i, t) for i, t in rows if "zorgish" not in (t or "")])}
    got = corpus_pipeline.run(spark, table(rows))
    assert {r["doc_id"] for r in got.select("doc_id").collect()} <= left and got.count() > 10
    assert corpus_pipeline.run(spark, table([])).count() == 0


def plain_mix(spark, docs):
    """How often each row stays, from the mix's own table."""
    took = {}
    for r in mixing.mix(docs).collect():
        took.setdefault(r["doc_id"], []).append((r["size"], r["taken"]))
    return {i: max([n // s for s, n in x if s] or [1]) for i, x in took.items()}


def test_mix_sources(spark):
    """Each row as often as the mix takes it, texts without words once, targets met."""
    rows = texts()
    docs = frame(spark, rows)
    want = plain_mix(spark, docs)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    rows = Counter(rows)
    assert got == Counter({x: n * (want[x[0]] if (x[1] or "").split() else 1) for x, n in rows.items() if want[x[0]] or not (x[1] or "").split()})


def test_pack_sequences(spark):
    """All texts come back as pieces that fit, in order."""
    rows = texts()
    got = corpus_pipeline.pack_sequences(spark, frame(spark, rows), "").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096


def test_names_and_empty_tables(spark, table):
    """Extra columns come through every stage but the last; empty tables stay empty."""
    rows = texts()
    d, none = table(rows), table([])
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, wide(spark, rows), d)
        assert out.columns == wide(spark, rows).columns, name
        assert {(r["n.x"], r["_row"], r["_id"], r["a`b"], r["size"]) for r in out.collect()} == {("dot", "own", 3, "tick", 4)}, name
        assert step(spark, wide(spark, []), none).count() == 0, name


def test_near_copies_after_line_dedup(spark, table):
    """A near copy that differs in one line keeps only that line, and shares no five words with what it copied."""
    rng = np.random.default_rng(6)
    base = [" ".join(f"v{x}" for x in rng.integers(0, 5000, 12)) for _ in range(20)]
    rows = [(1, "\n".join(base)), (2, "\n".join([*base[:10], "one other line of words here", *base[11:]]))]
    assert [i for i, _ in pairs(corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), ""))] == [1]
    left = corpus_pipeline.dedup_lines(spark, frame(spark, rows), "")
    assert pairs(left) == [rows[0], (2, "one other line of words here")] and corpus_pipeline.drop_near_duplicates(spark, left, "").count() == 2
