"""Each query against its SQL."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from skein.plans import catalogue, rendered

DATA = "/root/testdata/sf0.01"


def norm(df):
    plain = lambda x: None if x is None or x is pd.NA or x != x else bool(x) if isinstance(x, bool | np.bool_) else int(x) if isinstance(x, int | np.integer) else (int(x) if x == int(x) else float(x)) if isinstance(x, float | np.floating) else x
    return sorted(repr(tuple(plain(x) for x in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in catalogue.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "events", "benchmark", "part"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.execute(catalogue.ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert norm(got) == norm(want)


def test_parts_are_spread(spark):
    """What is made of the parts is made by all cores, whatever the size of their file."""
    for name in ("compress_routes", "code_brace_blocks", "compress_aligned", "json_nested"):
        assert "REPARTITION_BY_NUM" in catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert rendered.parts(spark, DATA).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_code_is_compressed_once(spark):
    """The store and the texts are read from a table, so no parser runs again for either."""
    assert "EvalPython" not in catalogue.QUERIES["code_round_trip"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_search_cuts_texts_once(spark):
    """Postings, frequencies and lengths are read from one shuffle."""
    found = catalogue.QUERIES["bm25_topk"](spark, DATA)
    found.collect()
    done = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("FileScan" in x and "documents.parquet" in x for x in done.splitlines()) == 1


def test_bm25_whole_text(spark, tmp_path):
    """Words beyond the fifth of a benchmark text count, repeated ones as often as they occur."""
    docs = [(1, "a b c d e"), (2, "f g f"), (3, "g"), (4, None), (5, "x y")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "n1 n2 n3 n4 n5 F g g"), (8, "a b c d e x y x"), (9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in catalogue.QUERIES["bm25_topk"](spark, str(tmp_path)).collect()}
    words = {i: t.split() for i, t in docs if t}
    mean = sum(map(len, words.values())) / len(words)

    def score(query, w):
        held = lambda x: sum(x in v for v in words.values())
        return sum(math.log((len(docs) - held(x) + 0.5) / (held(x) + 0.5) + 1) * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for x in query.split() if x in w)

    want = {}
    for item, query in ((7, "f g g"), (8, "a b c d e x y x")):
        best = sorted((-round(score(query, w), 9), i) for i, w in words.items() if score(query, w) > 0)[:3]
        want |= {(item, k + 1): (i, round(-s, 6)) for k, (s, i) in enumerate(best)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) == 4
    assert all(got[k][1] == pytest.approx(v[1], abs=2e-6) for k, v in want.items())
