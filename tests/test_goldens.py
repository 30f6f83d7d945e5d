"""Inline goldens for the operators: routes, compressors, sources, sinks and the store's edge cases."""

import io
import json
import os
import random
import shutil
import sys
import time

import pytest
from pyspark.sql import functions as F

from skein import api
from skein.operators import blocks, code, router
from skein.operators.align import align, kept, put_back, restore, side_table
from skein.operators.jsonlists import crush_json, render
from skein.operators.logs import crush_log
from skein.operators.tabular import crush_rows
from skein.operators.text import compress_text
from skein.sources import corpus
from skein.streaming.store import first_sights, lives
from skein.streaming.store import snapshot as blocks_left

CORPUS = "filename string, mime_type string, text string"


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def at(seconds):
    return F.timestamp_seconds(F.lit(seconds))


def test_prose(spark):
    harbour = "Tide  tables\t\tfor June \t \n\t  low   water:  04h   \n \t\n\n\x1f\nebb"
    assert one(spark, harbour, compress_text) == "Tide tables for June\n\t  low water: 04h\n\nebb"
    assert one(spark, "a\u2028b\x1c\nc\r\nd\n", compress_text) == "a\nb\n\nc\nd"
    for f in (compress_text, crush_json, crush_log, crush_rows):
        assert one(spark, "", f) == one(spark, "\t\n \x0c", f) == ""


def test_log(spark):
    lines = [f"pump {i} at {i * 7 % 5} bar" for i in range(14)]
    lines[4], lines[5], lines[9] = "pump 4 WARNING dry", "valve exception", "a fatal leak"
    want = [
        *lines[:2], "... [omitted 2 lines] ...", "--- Preserved anomaly/error lines 5-6 ---", "[Line 5] pump 4 WARNING dry", "[Line 6] valve exception", "... [omitted 3 lines] ...",
        "--- Preserved anomaly/error lines 10-10 ---", "[Line 10] a fatal leak", "... [omitted 2 lines] ...", *lines[12:],
    ]
    assert one(spark, "\n".join(lines) + "\n", lambda t: crush_log(t, 2)) == "\n".join(want)
    for k in (0, -3):
        assert one(spark, "oak\nelm\nash", lambda t: crush_log(t, k)) == "... [omitted 3 lines] ..."
    assert one(spark, "a\nb\n", lambda t: crush_log(t, 1)) == "a\nb\n"
    assert one(spark, "a\nb\nc", lambda t: crush_log(t, 1)) == "a\n... [omitted 1 lines] ...\nc"
    frames = "x\n\tat com.Foo.bar(Foo.java:1)\nok\n  File \"a.py\", line 3\ncaused \t by: x\nFAILOVER\nz"
    assert one(spark, frames, lambda t: crush_log(t, 1)).split("\n")[1:] == ["--- Preserved anomaly/error lines 2-2 ---", "[Line 2] \tat com.Foo.bar(Foo.java:1)", "... [omitted 1 lines] ...", "--- Preserved anomaly/error lines 4-6 ---", '[Line 4]   File "a.py", line 3', "[Line 5] caused \t by: x", "[Line 6] FAILOVER", "z"]


def test_json(spark):
    rows = [{"berth": chr(65 + i), "ship": ["tug", "fatally late"][i in (3, 4)], "tons": i / 4} for i in range(9)]
    got = json.loads(one(spark, json.dumps(rows), lambda t: crush_json(t, 3)))
    assert got == {"__type__": "truncated_list", "head": rows[:3], "tail": rows[6:], "anomalies": [{"original_index": i, "value": rows[i]} for i in (3, 4)], "omitted_count": 3}
    for k in (0, -7):
        got = json.loads(one(spark, '["x", [], {}]', lambda t: crush_json(t, k)))
        assert (got["head"], got["tail"], got["omitted_count"]) == ([], [], 3)
    assert one(spark, "[tons:  4,  ]", crush_json) == "[tons: 4, ]"
    assert json.loads(render('{"b": [[1,2,3,4],[]], "a": NaN, "a": null}', 1)) == {"b": [{"__type__": "truncated_list", "head": [1], "tail": [4], "anomalies": [], "omitted_count": 2}, []], "a": None}
    assert json.loads(render('[1,{"fatal": null},3]', 1))["anomalies"] == [{"original_index": 1, "value": {"fatal": None}}]
    deep = "[" * 101 + "[1,2,3]" + "]" * 101
    assert render(deep, 1).count("truncated_list") == 0 and render("[" * 20 + "[1,2,3]" + "]" * 20, 1).count("truncated_list") == 1
    assert render('{"__type__": "truncated_list"}', 1, "markdown-kv") == "* **__type__**: truncated_list"
    assert render("[" * 5000, 1) is None


def test_json_formats(spark):
    text = '{"dock": [{"no": 4, "by": "rail"}, {"no": 5, "by": "barge, slow"}, {"no": 6, "by": null}]}'
    assert render(text, 1, "csv-schema").split("\r\n") == ["Path,Type,Value", "dock,truncated_list,(1 items omitted)", "dock[0].no,int,4", "dock[0].by,str,rail", "dock[tail_0].no,int,6", "dock[tail_0].by,NoneType,None", ""]
    assert render(text, 1, "markdown-kv").split("\n") == ["* **dock**:", "  * **List (Truncated)**: 1 items omitted", "    * **Head (First 1 items):**", "      * [0]:", "        * **no**: 4", "        * **by**: rail", "    * **Tail (Last 1 items):**", "      * [2]:", "        * **no**: 6", "        * **by**: None"]
    assert render(text, 2, "csv-schema").split("\r\n")[4] == 'dock[1].by,str,"barge, slow"'
    assert render('{"a": [true, null, 1.5]}', 5, "csv-schema").split("\r\n")[1:4] == ["a[0],bool,True", "a[1],NoneType,None", "a[2],float,1.5"]
    for f in ("json", "csv-schema", "markdown-kv"):  # a lone surrogate comes out as its escape
        assert "\\ud800" in one(spark, '["\\ud800", "x"]', lambda t, f=f: crush_json(t, 5, f))


def test_tables(spark):
    rows = ["ship,berth,note", *[f"s{i},{i % 3},{'critical' if i == 4 else 'calm'}" for i in range(8)]]
    want = [*rows[:4], "... [omitted 1 rows] ...,,", "[Row 6],s4,1,critical", *rows[6:]]
    assert one(spark, "\n".join(rows) + "\n", lambda t: crush_rows(t, 3)) == "\n".join(want) + "\n"
    for sign in "\t", ";":
        got = one(spark, "\n".join(rows).replace(",", sign), lambda t, sign=sign: crush_rows(t, 3, None if sign == "\t" else sign))
        assert got == "\n".join(want).replace(",", sign) + "\n"
    quoted = 'a,b\n1,"x ""y"", z\nfatal"\n2,\n\n3,"p,q"\n'
    assert one(spark, quoted, lambda t: crush_rows(t, 1)) == 'a,b\n1,"x ""y"", z\nfatal"\n... [omitted 2 rows] ...,\n3,"p,q"\n'
    for odd in ("a,b\n1,2\n3,4\rx\n5,6", "a,b\n1,2\n3," + "x" * 131073 + "\n5,6"):
        assert one(spark, odd, lambda t: crush_rows(t, 1)) == odd


@pytest.mark.parametrize("sign", ["\t", ","])
def test_tables_are_linear(spark, sign):
    """Eight times the rows take less than 24 times as long; the delimiter is looked for once a text, not once a cell."""

    def took(n):
        text = f"a{sign}b\n" + "\n".join(f"{i}{sign}{'fail' if i % 9 == 4 else 'x'}" for i in range(n))
        df = spark.createDataFrame([(text,)], "t string").select(crush_rows(F.when(F.length("t") > 3, F.col("t"))))
        df.collect()
        began = time.perf_counter()
        assert len(df.first()[0]) > n
        return time.perf_counter() - began

    small, large = took(8_000), took(64_000)
    assert large < max(24 * small, 6)


def test_code():
    text = "def top(x):\n    y = x + 1\n    return y\n\nclass Helper:\n    @staticmethod\n    async def method(self):\n        # stays\n        'doc'\n        return True\n\nif x:\n    def inner():\n        pass\nelse:\n    def other():\n        pass\n"
    got, found = code.python(text)
    assert [b["content"] for b in found] == ["    y = x + 1\n    return y", "        'doc'\n        return True", "        pass"]
    assert "        # stays\n        <<ccr:" in got and "else:\n    def other():\n        pass\n" in got and got.endswith("\n")
    assert code.python("def f():\r\n    a = 1\r\n    return a\r\n")[1][0]["content"] == "    a = 1\r\n    return a"
    assert code.python("x = 10\n") == ("x = 10\n", []) and code.python("def f(:\n") is None
    assert code.skeleton("def f(: function g() { return 123456; }", "python")["blocks"][0]["lang"] == "python"
    assert code.skeleton(" \n", None) == {"skeleton": "", "blocks": []} and code.skeleton("x = 10\ny = 20\n", "javascript")["skeleton"] == "x = 10\ny = 20\n"
    assert code.skeleton("import os\ndef f():\n    return os\n", None)["blocks"][0]["lang"] == "python" and code.skeleton("important {", None)["blocks"] == []


def test_braces():
    take = lambda t: [b["content"] for b in code.braces(t, "js")[1]]
    assert take("int tide(int h) {\n  while (h > 9) { h -= 9; }\n  return h;\n}\nvoid noop() { ; }\n") == ["\n  while (h > 9) { h -= 9; }\n  return h;\n"]
    quay = "func moor(s Ship) {\n\ts.log('\\\\', \"}\\\"\", `{`) /* }}} */ // }\n}"
    assert take(quay) == [quay[len("func moor(s Ship) {") : -1]]
    assert take("if (x) { aaaaaaaaaaaaaaa } while (y) { bbbbbbbbbbbbbbbbb }") == []
    assert take("func (r T) name() { return 1234567890 }") == [" return 1234567890 "]
    assert take("call(1)\n\nclass A { m(x) { // }\n '}' /* } */ `}` 12345 } }") == [" m(x) { // }\n '}' /* } */ `}` 12345 } "]
    assert take("f(x) { never closed, g(y) { 1234567890123 }") == [" 1234567890123 "]
    assert take("function\nname\n{ 12345678901 }") == [] and take("f(\nx\n)\n: int\n{ 12345678901 }") == [" 12345678901 "]
    assert take("forEach(x => { 12345678901 })") == [] and take("map(x => { 12345678901 })") == []
    assert take("run({a: 1234567890123}) { b }") == ["a: 1234567890123"]
    assert code.braces("f(x) " * 200_000, "js")[1] == [] and code.braces("f( " * 200_000, "js")[1] == []


def test_align(spark):
    got = one(spark, "(0F8FAD5B-d9cb-469f-A165-70867728950e) from 1999-12-31 to 1999-12-31T23:59:60,x 7:00:00 07:00:00.25 " + "ab" * 20 + " é2024-01-02 2024-01-02  03:04:05.5+0200", align)
    assert got == "([UUID]) from [DATE] to [DATETIME],x 7:00:00 [TIME] [COMMIT_HASH] é2024-01-02 [DATETIME]"


def test_align_passes_over(spark, monkeypatch):
    """A text that can hold no value meets one rule only; one that may hold a value gives what all rules in turn do."""
    from skein.operators import align as rules

    rnd = random.Random(9)
    parts = ["-", ":", " ", "a", "é", "_", "1", "12", "12:34:56", "12:34:56.7", "2024-01-02", "2024-01-02T03:04:05Z", "0f8fad5b-d9cb-469f-a165-70867728950e", "ab" * 20, "0" * 40, "T", "+0200"]
    df = spark.createDataFrame([(None,), ("",), *[("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6))),) for _ in range(3000)]], "text string")
    plain = F.col("text")
    for name, pattern in rules.RULES:
        plain = F.regexp_replace(plain, rules._L + f"(?:{pattern})" + rules._R, name)
    got = df.select(align(F.col("text")).alias("got"), F.coalesce(plain, F.lit("")).alias("want")).collect()
    assert [r for r in got if r["got"] != r["want"]] == []
    monkeypatch.setattr(rules, "RULES", (("[NONE]", "(no pattern"), rules.RULES[-1]))
    assert one(spark, "well-known: 10-12, 3:4 " + "ab" * 20, align) == "well-known: 10-12, 3:4 [COMMIT_HASH]"


def test_align_and_put_back(spark):
    """Any mixture of values, look-alikes and what stands between comes back; so does code that was aligned, compressed and stored."""
    rnd = random.Random(8)
    some = ["2024-01-02", "03:04:05", "03:04:05.678", "2024-01-02T03:04:05Z", "2024-01-02  03:04:05+0100", "0f8fad5b-d9cb-469f-a165-70867728950e", "ab" * 20, "ab" * 32, "[DATE]", "[UUID]", "[", "]", "[TIME", "é", "x", "-", "_", " ", "\n", ":", "T", "1"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 14))) for _ in range(400)] + [None, "", "[DATE][DATE]2024-01-02"]
    df = spark.createDataFrame(list(enumerate(texts)), "`i.d` int, text string")
    got = df.select("text", align(F.col("text")).alias("a"), put_back(align(F.col("text")), kept(F.col("text"))).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") for r in got) and sum(r["a"] != r["text"] for r in got) > 200
    side = side_table(df, "i.d")
    back = restore(df.withColumn("text", align(F.col("text"))), side, "i.d")
    assert {r["i.d"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    source = "def f():\n    day = '2024-01-02'\n    return day, '[DATE]', '03:04:05'\n"
    docs = spark.createDataFrame([(1, "f.py", None, source), (2, "f.py", None, "x = '2024-01-02'\n")], "id int, " + CORPUS)
    done = router.compress(docs, aligned=True)
    whole = api.decompress(done.select("id", F.col("compressed").alias("text")), api.store(done, at(1)), at(1))
    assert {r["id"]: r["text"] for r in restore(whole, side_table(docs, "id"), "id").collect()} == {1: source, 2: "x = '2024-01-02'\n"}


def test_routes(spark):
    rows = [
        ("test.json", None, "{}", "json"), (None, None, "123", "json"), (None, None, " NaN ", "json"), (".json", None, "abc", "text"), ("x.tar.PY", None, "a", "code"), ("a/b.c", "application/x-log", "a", "log"),
        (None, None, "a,b\nc,d", "tabular"), (None, None, "a\tb\n\nc\td", "tabular"), (None, None, "def f(x):", "code"), (None, None, "we import goods", "code"), (None, None, "class A {", "code"),
        (None, None, "[INFO] a\n[Error] b", "log"), (None, None, "one Traceback", "log"), (None, None, "error: only one", "text"), ("a.log", None, " \n", "empty"), (None, None, None, "empty"), ("n.txt", "text/csv", "p", "tabular"), (None, None, "plain prose", "text"),
    ]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "id string, " + CORPUS + ", want string")
    assert router.route(df).filter("route <> want").count() == 0
    out = {r["id"]: r for r in router.compress(df).collect()}
    assert len(out) == len(rows) and all(out[str(i)]["route"] == r[3] for i, r in enumerate(rows))
    logs = "\n".join(["[INFO] a"] * 5 + ["[ERROR] DB failed"] + ["[INFO] b"] * 6)
    got = router.compress(spark.createDataFrame([("test.json", None, '{"b": [1,2,3,4,5,6,7,8,9]}'), ("test.py", None, "def foo():\n    print(41)\n    return"), (None, None, logs), (None, None, "at 2024-01-02\nit  is")], CORPUS), k_elements=2, k_lines=2, aligned=True)
    got = [r["compressed"] for r in got.collect()]
    assert "truncated_list" in got[0] and "<<ccr:" in got[1] and "Preserved anomaly/error lines 6-6" in got[2] and got[3] == "at [DATE]\nit is"


def test_router_plan(spark):
    """One scan of the documents, and no union of the routes."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.lit(None).cast("string").alias("filename"), F.lit(None).cast("string").alias("mime_type"), "text")
    plan = router.compress(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_router_keeps_columns(spark):
    df = spark.createDataFrame([("a.py", None, "def f():\n    return 1234567890\n", 1, 2, 3, 4)], CORPUS + ", _json int, _named int, `a``b.c` int, route int")
    got = router.compress(df)
    assert got.columns == [*df.columns, "compressed", "blocks"]  # route gives way to the document's
    row = got.first()
    assert (row["_json"], row["_named"], row["a`b.c"], row["route"], len(row["blocks"])) == (1, 2, 3, "code", 1)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nb\rc\ufffd".encode())
    (tmp_path / "b.log").write_bytes(b"x\xff\xfey\r\n\xe9")
    (tmp_path / "c +é%20.py").write_bytes(b"")
    got = {r["filename"]: r["text"] for r in corpus.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "é\nb\nc\ufffd", "b.log": "xy\n", "c +é%20.py": ""}
    assert [tuple(r) for r in corpus.read_stdin(spark, io.StringIO("a\nb")).collect()] == [(None, None, "a\nb")]
    store = blocks.make_blocks(spark.createDataFrame([("x",)], "content string").withColumn("created_at", at(5)))
    corpus.write_blocks(store, f"{tmp_path}/store")
    assert corpus.read_blocks(spark, f"{tmp_path}/store").collect() == store.collect()
    with pytest.raises(Exception, match="exists"):
        corpus.write_blocks(store, f"{tmp_path}/store")


def test_snapshot_layout(spark, tmp_path):
    """Days that hold no live block aren't scanned, nor row groups that can't hold a hash."""
    times = [0, 86_399, 86_400, 200_000, 259_199, 259_200, -1]
    store = blocks.make_blocks(spark.createDataFrame([(f"block {t}", t) for t in times], "content string, t long").withColumn("created_at", F.timestamp_seconds("t")))
    corpus.write_blocks(store, f"{tmp_path}/s")
    assert sorted(x.name for x in (tmp_path / "s").iterdir() if x.is_dir()) == [f"day={d}" for d in ("1969-12-31", "1970-01-01", "1970-01-02", "1970-01-03", "1970-01-04")]
    assert sorted(map(str, corpus.read_blocks(spark, f"{tmp_path}/s").collect())) == sorted(map(str, store.collect()))
    for now in (86_500, 259_200, 259_500, 259_501, 10**7):
        got = corpus.read_blocks(spark, f"{tmp_path}/s", at(now))
        assert {r["content"] for r in got.collect()} == {f"block {t}" for t in times if t >= now - 300}
    plan = corpus.read_blocks(spark, f"{tmp_path}/s", at(259_500))._jdf.queryExecution().executedPlan().toString()
    assert "(day" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")] and "1970-01-04" in plan
    one_ = store.first()
    found = corpus.look_up(spark, f"{tmp_path}/s", one_["hash"], "f" * 64)
    assert [r["content"] for r in found.collect()] == [one_["content"]] and "In(hash" in found._jdf.queryExecution().executedPlan().toString()
    spark.range(3).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="no snapshot"):
        corpus.read_blocks(spark, f"{tmp_path}/other")


def test_snapshot_size(spark, tmp_path):
    """Many days of few blocks: a file's Bloom filter is as large as its hashes need."""
    store = blocks.make_blocks(spark.range(40).select(F.concat(F.lit("block "), F.col("id").cast("string")).alias("content"), F.timestamp_seconds(F.col("id") * 43_200).alias("created_at")))
    path = tmp_path / "a b+c"
    corpus.write_blocks(store, str(path))
    files = list(path.glob("day=*/*.parquet"))
    assert len(files) == 20 and max(f.stat().st_size for f in files) < 10_000
    assert corpus.look_up(spark, str(path), *[r["hash"] for r in store.collect()]).count() == 40


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a",), (None,), ("c d",)], "compressed string").coalesce(1)
    corpus.write_text(df, f"{tmp_path}/out")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["a", "", "c d"]
    out = io.StringIO()
    assert corpus.write_stdout(df, stream=out) == 3 and out.getvalue() == "a\n\nc d\n"


@pytest.mark.skipif(not shutil.which("sh"), reason="no shell")
def test_commands(spark):
    rows, status = corpus.run_command(spark, f"{sys.executable} -c 'print(\"a  b\"); exit(3)'", shell=True)
    assert (rows.first()["text"], status) == ("a  b\n", 3)
    assert corpus.run_command(spark, "echo 'a b'")[0].first()["text"] == "a b\n"
    for sign in corpus.SHELL_SIGNS:
        with pytest.raises(ValueError, match="shell"):
            corpus.run_command(spark, f"echo a {sign} b")
    rows, status = api.compress_output(spark, "seq 10", k_lines=2)
    assert (rows.first()["compressed"], status) == ("1\n2\n... [omitted 6 lines] ...\n9\n10", 0)


def snapshot(spark, *texts, second=100):
    return blocks.make_blocks(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "content string, i int").withColumn("created_at", F.timestamp_seconds(F.lit(second) + F.col("i"))))


def test_search(spark):
    docs = ["Herons nest above the tidal marsh", "a lock keeper opens the sluice at ebb", "Barges load gravel, barges carry salt"]
    asked = spark.createDataFrame([(1, None, "who opens a SLUICE"), (2, None, "salt-barges"), (3, None, "zeppelin"), (4, None, "!?"), (5, "x", ""), (6, None, None), (7, f"<<ccr:{'0' * 64},js,3>>", "herons")], "id int, token string, query string")
    got = {r["id"]: (r["content"], r["hit"]) for r in api.retrieve(asked, snapshot(spark, *docs), at(110)).collect()}
    assert got == {1: (docs[1], True), 2: (docs[2], True), 3: (None, False), 4: (None, None), 5: (None, False), 6: (None, None), 7: (docs[0], True)}
    late = {r["id"]: r["hit"] for r in api.retrieve(asked, snapshot(spark, *docs), at(10_000)).collect()}
    assert late == {1: None, 2: None, 3: None, 4: None, 5: False, 6: None, 7: None}  # an empty store counts no search
    hashes = [r["hash"] for r in snapshot(spark, "b word", "a word").orderBy("seq").collect()]
    assert blocks.bm25(snapshot(spark, "b word", "a word"), spark.createDataFrame([(1, "word")], "query_id int, query string")).first()["hash"] == hashes[0]  # ties: the earlier


def test_store_life(spark):
    old = snapshot(spark, "x" * 100, "short", second=100)
    new = blocks.upsert(old, snapshot(spark, "short", second=350))
    assert {r["content"]: r["created_at"].timestamp() for r in new.collect()} == {"x" * 100: 100.0, "short": 350.0}
    assert [r["content"] for r in api.clean(new, at(401)).collect()] == ["short"] and api.clean(new, at(400)).count() == 2  # a block of just its time stays
    log = api.retrieve(spark.createDataFrame([(r["hash"],) for r in new.collect()] + [("f" * 64,), (None,)], "token string"), new, at(400))
    s = api.stats(new, log, at(400), stored=blocks.new_blocks(snapshot(spark, "short"), new)).first().asDict()
    assert s == {"count": 2, "total_bytes": 105, "hits": 2, "misses": 1, "hit_ratio": 2 / 3, "saved_bytes": 20}
    assert api.stats(api.clear(new), log.limit(0), at(0), stored=new.limit(0)).first().asDict() == {"count": 0, "total_bytes": 0, "hits": 0, "misses": 0, "hit_ratio": 0.0, "saved_bytes": 0}


def test_decompress(spark):
    store = snapshot(spark, "    body\n    two", "plain", "")
    h = {r["content"]: r["hash"] for r in store.collect()}
    tok = lambda t, lang="py": f"<<ccr:{h.get(t, '0' * 64)},{lang},3>>"
    texts = [f"def f():\n    {tok('    body' + chr(10) + '    two')}\nend", f"a\x00b \t{tok('plain')}\x00", f"{tok('unknown')}{tok('plain')}{tok('')}", f"<<ccr:{h['plain']},,3>>", "no token", "", None, "no token"]
    want = ["def f():\n    body\n    two\nend", "a\x00b \tplain\x00", f"{tok('unknown')}plain", texts[3], "no token", "", "", "no token"]
    df = spark.createDataFrame([(None if i % 2 else 7, t, i) for i, t in enumerate(texts)], "`k.x` int, text string, _rest int")
    got = api.decompress(df, store, at(110))
    assert got.columns == df.columns and [(r[1]) for r in sorted(got.collect(), key=lambda r: r[2])] == want
    nested = snapshot(spark, "plain", f"see {tok('plain')}")
    outer = f"<<ccr:{nested.filter('content <> ' + repr('plain')).first()['hash']},x,1>>"
    rows = spark.createDataFrame([(outer,)], "text string")
    assert api.decompress(rows, nested, at(110)).first()[0] == f"see {tok('plain')}" and api.decompress(rows, nested, at(110), max_passes=2).first()[0] == "see plain"
    source = "class Crane:\n    def lift(self, tons):\n        # slowly\n        self.load += tons\n        return self\n"
    done = router.compress(spark.createDataFrame([("crane.py", None, source)], CORPUS))
    back = api.decompress(done.select(F.col("compressed").alias("text")), api.store(done, at(1)), at(1))
    assert "<<ccr:" in done.first()["compressed"] and back.first()[0] == source


def test_first_sights(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "content string, s int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("content string, s int").parquet(f"{tmp_path}/in").withColumn("created_at", F.timestamp_seconds("s"))
    run = first_sights(stream).writeStream.format("memory").queryName("sights").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r["content"] for r in spark.table("sights").collect()) == ["a", "b"]


def test_lives(spark, tmp_path):
    """A block that is stored again while it lives outlives its first end; each end is told, in time or later."""
    batches = [[("a", 0), ("b", 0), (None, 3), ("z", None)], [("a", 250), ("b", 200), ("b", 100)], [("c", 560), ("a", 540)], [("b", 900), ("c", 1000)], [("d", 2000)], [("d", 2300)]]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "content string, s int").coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        for f in (tmp_path / f"w{i}").glob("part-*"):
            f.rename(tmp_path / "in" / f"{i}.parquet")
            os.utime(tmp_path / "in" / f"{i}.parquet", (1000 + i, 1000 + i))
    stream = spark.readStream.schema("content string, s int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("created_at", F.timestamp_seconds(F.col("s") + 5000))  # what isn't after the watermark, at first 0, is late
    run = lives(stream).writeStream.format("memory").queryName("lives").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(200)
    told = spark.table("lives")
    names = {r["hash"]: r["content"] for r in told.filter("content is not null").collect()}
    got = sorted((names[r["hash"]], int(r["at"].timestamp()) - 5000, r["event"]) for r in told.collect())
    assert got == sorted([
        ("a", 0, "stored"), ("a", 250, "renewed"), ("a", 540, "renewed"), ("a", 840, "expired"), ("b", 0, "stored"), ("b", 100, "renewed"), ("b", 200, "renewed"), ("b", 500, "expired"),
        ("b", 900, "stored"), ("b", 1200, "expired"), ("c", 560, "stored"), ("c", 860, "expired"), ("c", 1000, "stored"), ("c", 1300, "expired"), ("d", 2000, "stored"), ("d", 2300, "renewed"),
    ])
    assert [(r["content"], r["created_at"].timestamp()) for r in blocks_left(told).collect()] == [("d", 7300.0)]


def test_lives_share_a_state(spark, tmp_path):
    """Blocks of one group have one state and one timer: their lives are those that a plain loop tells."""
    rnd, end = random.Random(4), 20_000_000
    batches = [[(f"b{rnd.randint(0, 25)}", 1000 + 200 * i + rnd.randint(0, 199)) for _ in range(12)] for i in range(5)] + [[("last", end), ("late", end + 9 * 10**9)], [("end", end + 9 * 10**9 + 1)]]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "content string, s long").coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        for f in (tmp_path / f"w{i}").glob("part-*"):
            f.rename(tmp_path / "in" / f"{i}.parquet")
            os.utime(tmp_path / "in" / f"{i}.parquet", (1000 + i, 1000 + i))
    stream = spark.readStream.schema("content string, s long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("created_at", F.timestamp_seconds("s"))
    run = lives(stream, late="1000 seconds", groups=1).writeStream.format("memory").queryName("shared_lives").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(200)
    told = spark.table("shared_lives").withColumn("s", F.unix_seconds("at"))
    names = {r["hash"]: r["content"] for r in told.filter("content is not null").collect()}
    want, last = [], {}
    for content, at_ in [x for rows in batches for x in sorted(rows, key=lambda r: r[1])]:
        if content in last and at_ - last[content] > 300:
            want.append((content, "expired", last.pop(content) + 300))
        want.append((content, "renewed" if content in last else "stored", at_))
        last[content] = at_
    want += [(c, "expired", t + 300) for c, t in last.items() if t <= end]
    assert sorted((names[r["hash"]], r["event"], r["s"]) for r in told.collect()) == sorted(want) and len(want) > 80
