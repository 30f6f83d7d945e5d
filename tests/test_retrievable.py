"""What truncation takes out comes back to the last character; typed values are crushed as JSON texts are."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from skein import api
from skein.operators import jsonlists, router
from skein.operators.retrievable import keep_list, keep_log, keep_table
from skein.operators.typed import crush_column

ENDS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1e", "\x85", "\u2028", "\u2029"]
PAST = "<<ccr:" + "a" * 64 + ",x,3>>"


def now():
    return F.timestamp_seconds(F.lit(1))


def rail(i, word, end):
    return f"wagon {i} {word}{'at' if i % 3 else 'by'} dock {i * 7 % 5}{end}"


def logs():
    r = random.Random(3)
    every = "".join(rail(i, "FATAL " if i % 17 == 3 else "", r.choice(ENDS)) for i in range(300))
    return [None, "", "\n", "one", "x\n" * 3, every, every[:-1] + "last", "\n".join(["  indented words " * 3] * 40), "y" * 200_000 + "\n" + "é\U0001f600" * 3000 + "\n" + "z", f"see {PAST}\n" * 9]


def tables():
    quoted = "a,b\n" + "".join(f'{i},"q ""{i}"" \nnext, {"error" if i % 13 == 5 else "fine"}"\n' for i in range(80))
    return [None, "", "a,b", quoted, quoted.replace("\n", "\r\n"), "a\tb\r\n" + "".join(f'{i}\tx"y{i}\r\n' for i in range(80)), 'a,b\n1,"open \n' + "x\n" * 100, 'h\n"' + "long " * 60_000 + '"\n' + "".join(f"{i}\n" for i in range(99)), f"a,b\n{PAST},1\n" * 30]


@pytest.mark.parametrize(("texts", "keep", "k", "blocks"), [(logs, keep_log, 0, 38), (logs, keep_log, 2, 37), (tables, keep_table, 0, 17), (tables, keep_table, 2, 14)])
def test_put_back(spark, texts, keep, k, blocks):
    """Runs between the marked lines or rows: 18 of each of two logs, 7 (6 beyond the ends) of two tables, and one of each other long text."""
    rows = spark.createDataFrame(list(enumerate(texts())), "id int, given string").select("id", "given", keep(F.col("given"), k).alias("c"))
    made = rows.select("id", "given", F.col("c.skeleton").alias("text"), F.col("c.blocks").alias("blocks"))
    back = api.decompress(made, api.store(made, now()), now()).collect()
    assert all(x["text"] == (x["given"] or "") for x in back) and len(back) == len(texts())
    assert sum(len(x["blocks"]) for x in back) == blocks
    assert all(PAST not in x["given"] or not x["blocks"] for x in back if x["given"])


def test_what_stays(spark):
    lines = [rail(i, "warning " if i == 20 else "", "") for i in range(40)]
    row = spark.createDataFrame([("\n".join(lines),)], "t string").select(keep_log(F.col("t"), 2).alias("c")).first()["c"]
    shown = row["skeleton"].split("\n")
    assert [shown[i] for i in (0, 1, 3, 5, 6)] == [lines[i] for i in (0, 1, 20, 38, 39)] and len(shown) == 7
    assert [(b["lang"], b["content"]) for b in row["blocks"]] == [("log 18 lines", "\n".join(lines[2:20])), ("log 17 lines", "\n".join(lines[21:38]))]
    assert shown[2] == f"<<ccr:{row['blocks'][0]['hash']},log 18 lines,{len(row['blocks'][0]['content'])}>>"
    short = spark.createDataFrame([("a\nbc\nd",)], "t string").select(keep_log(F.col("t"), 1).alias("c")).first()["c"]
    assert short["skeleton"] == "a\nbc\nd" and short["blocks"] == []  # a token would be longer


def test_lists_put_back(spark):
    kind = "array<struct<n:int,s:string>>"
    items = [None, [], [(1, "a")], [(i, f"reed {i}" if i % 11 else "error, \"é\"") for i in range(60)] + [(None, None)], [None] * 40, [(1, PAST)] * 30]
    rows = spark.createDataFrame(list(enumerate(items)), f"id int, given {kind}").select("id", "given", keep_list(F.col("given"), 3).alias("c"))
    made = rows.select("id", "given", F.col("c.skeleton").alias("text"), F.col("c.blocks").alias("blocks"))
    back = api.decompress(made, api.store(made, now()), now()).select("id", "given", F.from_json("text", kind).alias("got"), F.size("blocks").alias("n")).collect()
    assert all(x["given"] == x["got"] for x in back)
    assert {x["id"]: x["n"] for x in back} == {0: 0, 1: 0, 2: 0, 3: 5, 4: 1, 5: 0}


def test_router_keeps_what_it_omits(spark):
    log, table = "".join(rail(i, "", "\r\n") for i in range(90)), "a,b\n" + "".join(f'{i},"x, {i}"\n' for i in range(90))
    rows = spark.createDataFrame([("a.log", None, log, 1), ("b.csv", None, table, 2), ("c.py", None, "def f():\n    return 'a long enough body'\n", 3), ("d.txt", None, "plain", 4)], "filename string, mime_type string, text string, _kept int")
    done = router.compress(rows, retrievable=True)
    assert {x["_kept"]: x["blocks"] and [b["lang"] for b in x["blocks"]] for x in done.collect()} == {1: ["log 50 lines"], 2: ["table 80 rows"], 3: ["python"], 4: None}
    back = api.decompress(done, api.store(done, now()), now(), text="compressed").collect()
    assert all(x["compressed"] == x["text"] for x in back)


def test_keeping_is_linear(spark):
    def seconds(n):
        df = spark.createDataFrame([("".join(rail(i, "error " if i % 3 == 0 else "quiet " * 20, "\n") for i in range(n)),)], "t string").select(keep_log(F.col("t"), 5)["skeleton"].alias("s"))
        times = []
        for _ in range(3):
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        return min(times)

    assert seconds(32_000) < 10 * seconds(4_000) + 1


TYPED = "struct<id:int,words:array<string>,deep:array<struct<at:bigint,rows:array<array<int>>,names:array<string>>>,by:map<string,array<int>>,fatal_flag:array<struct<error:int>>,`a.b \"c`:array<double>>"


@pytest.mark.parametrize("k", [0, 1, 2])
def test_typed(spark, k):
    r = random.Random(k)
    word = lambda: r.choice(["elm", "oak \"x\"\n", "a WARNing", None, "", "é€"])
    deep = lambda: r.choice([None, (r.randint(0, 9), [[1, 2, 3, 4, 5][: r.randint(0, 5)] for _ in range(r.randint(0, 6))], [word() for _ in range(r.randint(0, 6))])])
    rows = [(i, [word() for _ in range(r.randint(0, 9))], [deep() for _ in range(r.randint(0, 7))], {"x": [1, 2, 3, 4, 5, 6], "error": None}, [(1,), None, (2,), (None,), (3,), (4,)], [0.5] * 7) for i in range(30)]
    rows += [(None, None, None, None, None, None), (1, [], [], {}, [], [])]
    df = spark.createDataFrame([(x,) for x in [*rows, None]], f"v {TYPED}")
    got = crush_column(df, "v", k).select(F.to_json(F.struct("v"), {"ignoreNullFields": "false"}).alias("given"), "compressed").collect()
    for x in got:
        assert json.loads(x["compressed"]) == jsonlists.crush(json.loads(x["given"])["v"], k)


def test_typed_edges(spark):
    every = spark.createDataFrame([([3, None],)], "`a``b.c` array<int>")
    assert crush_column(every, "a`b.c", 0).first()[1] == '{"__type__":"truncated_list","head":[],"tail":[],"anomalies":[],"omitted_count":2}'
    assert crush_column(every, "a`b.c", 1).first()[1] == "[3,null]"
    plan = crush_column(every, "a`b.c", 1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
