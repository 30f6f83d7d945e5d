"""The inverted index, and decompression to the last, on small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein import api
from skein.operators import blocks, index, inflate


def found(df):
    return {(r["query_id"], r["rank"]): (r["hash"], round(r["score"], 6)) for r in df.collect()}


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, i // 2, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(300)] + [(300, 1, None), (301, 1, ""), (302, 1, "!?"), (303, 9, "tie tie"), (304, 2, "tie tie"), (305, 2, "tie tie")]
    asked = [(q, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))) for q in range(40)] + [(90, "w1 w1 W1"), (91, "tie"), (92, "nowhere"), (93, ""), (94, None)]
    store = spark.createDataFrame(rows, "hash long, seq long, content string").cache()
    return store, spark.createDataFrame(asked, "query_id long, query string")


@pytest.mark.parametrize(("per_slot", "top"), [(1, 4), (8, 1), (1000, 4)])
def test_index(texts, tmp_path, per_slot, top):
    """Segments, updates, live blocks, merging: the same as scoring all blocks."""
    store, asked = texts
    live = store.select("hash", "seq")
    part = index.build(store.filter("hash % 3 > 0"), f"{tmp_path}/a", 5, per_slot)
    assert found(index.search(part, asked, top, live.filter("hash % 3 > 0"))) == found(blocks.bm25(store.filter("hash % 3 > 0"), asked, top))
    whole = index.update(part, store, f"{tmp_path}/b", per_slot)
    assert found(index.search(whole, asked, top, live)) == found(blocks.bm25(store, asked, top))
    some = store.filter("hash % 5 <> 1")
    want = found(blocks.bm25(some, asked, top))
    assert found(index.search(whole, asked, top, some.select("hash", "seq"))) == want
    merged = index.merge(whole, f"{tmp_path}/c", some, per_slot)
    assert found(index.search(merged, asked, top, some.select("hash", "seq"))) == want
    assert len(whole.paths) == 2 and merged.docs.count() == some.count()


def test_index_edges(spark, texts, tmp_path, monkeypatch):
    store, asked = texts
    none = index.build(store.limit(0), f"{tmp_path}/a")
    assert index.search(none, asked).count() == 0
    again = index.update(none, store, f"{tmp_path}/b")
    assert index.search(again, asked.limit(0)).count() == 0 and index.update(again, store, f"{tmp_path}/c").postings.count() == again.postings.count()
    for name in ("NAMED", "ASKED"):  # more terms than go into the filter, more pairs than go to every task
        monkeypatch.setattr(index, name, 3)
    assert found(index.search(again, asked, 2, store.select("hash", "seq"))) == found(blocks.bm25(store, asked, 2))


def test_index_made_at_once(spark, texts, tmp_path):
    """A segment reads each text once, and has exact bounds without a table of their own."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    made = index.build(texts[0].select("hash", told.asNondeterministic()("content").alias("content")), f"{tmp_path}/a", 2, 8)
    assert seen.value == texts[0].count() == made.docs.count()
    assert sorted(x.name for x in tmp_path.glob("a/*")) == ["docs", "postings"]
    key = ["bucket", "term", "segment", "slot"]
    want = made.postings.groupBy(*key).agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    assert sorted(made.bounds.select(want.columns).collect()) == sorted(want.collect()) and want.filter("n > 1").count() > 0


def test_index_plan(spark, texts, tmp_path):
    """A search reads the buckets and terms that are asked for, and no content."""
    whole = index.build(texts[0], f"{tmp_path}/a", 16)
    plan = index.asked_rows(whole, spark.createDataFrame([("w1",), ("tie",)], "term string"))[0]._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [tie,w1])" in plan.replace("In(term, [w1,tie])", "In(term, [tie,w1])") and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and "content" not in plan


def test_retrieve_by_index(spark, texts, tmp_path):
    rows = texts[0].select(F.sha2(F.concat("content", F.col("hash").cast("string")), 256).alias("hash"), "seq", "content", F.timestamp_seconds(F.lit(100)).alias("created_at")).filter("hash is not null")
    asked = spark.createDataFrame([(1, "w2 w3", "mine", 5), (2, "zzz", "mine", 6), (3, None, "mine", 7)], "`i.d` int, query string, hash string, _q int")
    now = F.timestamp_seconds(F.lit(101))
    plain = api.retrieve(asked, rows, now)
    by_index = api.retrieve(asked, rows, now, index=index.build(rows, f"{tmp_path}/a"))
    assert plain.columns == ["i.d", "query", "_q", "hash", "content", "hit"]
    assert sorted(plain.collect(), key=str) == sorted(by_index.collect(), key=str)


def h(name):
    return (name * 64)[:64]


def token(name):
    return f"<<ccr:{h(name)},t,1>>"


STORE = {
    "a": "leaf", "b": f"({token('a')}|{token('a')})", "c": f"[{token('b')} {token('f0')}]", "d": f"one {token('e')}{token('a')}", "e": f"two {token('d')}", "1": f"self {token('1')}",
    "2": f"into {token('d')} {token('c')}", "3": "", "4": f"  in {token('3')}", "5": f"\t{token('4')}", "6": f"deep {token('2')}",
}


def plain(name, done):
    """Text and log of a block; ``done`` has what is inflated, all else stays."""
    log = []

    def put(m):
        part = next((n for n in STORE if h(n) == m[2]), "f0")
        if part not in done:
            log.append((m[2], None if part in STORE else False))
            return m[0]
        inner, more = done[part]
        log.extend([(m[2], True), *more])
        return inner if inner.startswith(m[1]) else m[1] + inner

    return re.sub(r"([ \t]*)<<ccr:([a-f0-9]{64}),t,1>>", put, STORE[name]), log


def test_closed(spark):
    """Levels of nesting, cycles, unknown and repeated tokens, empty blocks and indentation, against a plain loop."""
    names, done = {n: {m for m in STORE if token(m) in t} for n, t in STORE.items()}, {}
    while ready := [n for n in STORE if n not in done and names[n] <= set(done)]:
        done |= {n: plain(n, {m: done[m] for m in names[n]}) for n in ready}
    assert set(STORE) - set(done) == {"d", "e", "1", "2", "6"}
    want = {n: (t, sorted(x, key=str)) for n, (t, x) in (done | {n: plain(n, {m: done[m] for m in names[n] if m in done}) for n in STORE if n not in done}).items()}
    store = spark.createDataFrame([(h(n), t) for n, t in STORE.items()], "hash string, content string")
    got = {r["hash"]: (r["content"], sorted(((x["hash"], x["hit"]) for x in r["log"]), key=str)) for r in inflate.closed(store).collect()}
    assert got == {h(n): x for n, x in want.items()}


def test_decompress_log(spark):
    store = spark.createDataFrame([(h(n), t) for n, t in STORE.items()], "hash string, content string").withColumn("created_at", F.timestamp_seconds(F.lit(100))).withColumn("seq", F.lit(0))
    docs = [(1, f"x {token('b')} {token('f0')} {token('b')}"), (1, f"x {token('b')} {token('f0')} {token('b')}"), (None, token("6")), (3, "none"), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, 9) for r in docs], "id int, `te``x.t` string, _text int").repartition(3)
    now = F.timestamp_seconds(F.lit(101))
    texts, log = api.decompress_logged(df, store, now, "te`x.t")
    b = STORE["b"]
    assert sorted(map(tuple, texts.collect()), key=str) == sorted([(1, f"x {b} {token('f0')} {b}", 9)] * 2 + [(None, STORE["6"], 9), (3, "none", 9), (4, "", 9), (5, "", 9)], key=str)
    assert api.stats(store, log, now).select("hits", "misses").first() == (5, 2)
    texts, log = api.decompress_logged(df, store, now, "te`x.t", to_the_last=True)
    deep = f"deep {token('2')}"
    assert sorted(map(tuple, texts.collect()), key=str) == sorted([(1, f"x (leaf|leaf) {token('f0')} (leaf|leaf)", 9)] * 2 + [(None, deep, 9), (3, "none", 9), (4, "", 9), (5, "", 9)], key=str)
    assert api.stats(store, log, now).select("hits", "misses").first() == (13, 2)  # the token of 2 within 6 is neither
    assert inflate.decompress(df.limit(0), store, "te`x.t", True)[0].count() == 0
