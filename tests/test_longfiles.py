"""Long logs and tables, in blocks of any size, against the row-wise crushers and Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import longfiles
from skein.operators.logs import crush_log
from skein.operators.tabular import crush_rows


@pytest.fixture
def blocks_of(spark):
    def put(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def joined(df):
    """{base name of the document: its lines}"""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["document"], r["line_no"], r["kind"])):
        out.setdefault(r["document"].rsplit("/", 1)[-1], []).append(r["text"])
    return out


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def logs():
    rnd = random.Random(2)
    made = {"all.log": ["ERROR x"] * 40, "none.log": ["ok"] * 50, "short.log": ["a", "fail", "b"], "odd.log": ["x warn\x0by", "", "\tat a.b", "z\r"] * 9}
    for i, share in enumerate((0.1, 0.9)):
        made[f"{i}.log"] = [("fatal " if rnd.random() < share else "fine ") + "n" * rnd.randint(0, 12) for _ in range(50)]
    made["long.log"] = ["fine"] * 9 + ["error e"] * 40 + ["fine"] * 9 + ["error f"] + ["fine"] * 9
    return made


@pytest.mark.parametrize("size", [150, 10**6])
def test_long_logs(spark, tmp_path, blocks_of, size):
    for name, lines in logs().items():
        (tmp_path / name).write_bytes(("\r\n" if name == "1.log" else "\n").join(lines).encode() + b"\n" * (name != "0.log"))
    blocks_of(size)
    if size < 200:
        assert longfiles.lines_of(spark, str(tmp_path)).select("file", "start").distinct().count() > 9
    for k in (0, 3):
        got = joined(longfiles.crush_logs(spark, str(tmp_path), k))
        for name, lines in logs().items():
            want = one(spark, ("\r\n" if name == "1.log" else "\n").join(lines), lambda t, k=k: crush_log(t, k))
            want = want.split("\n") if len("\n".join(lines).splitlines()) > 2 * k else "\n".join(lines).splitlines()
            assert got[name] == want, (name, k)


def test_long_log_of_parts(spark, tmp_path, blocks_of):
    """A folder is one log; runs go on from file to file, also through whole files."""
    lines = ["ok"] * 10 + ["error"] * 25 + ["ok"] * 12 + ["warn"] + ["ok"] * 7
    folder = tmp_path / "log"
    folder.mkdir()
    for i in range(0, len(lines), 5):
        (folder / f"part-{i:03}").write_text("\n".join(lines[i : i + 5]) + "\n")
    (folder / "part-999").write_text("")
    blocks_of(64)
    for k in (0, 2):
        got = joined(longfiles.crush_logs(spark, str(folder), k, whole_folder=True))
        assert got == {"log": one(spark, "\n".join(lines), lambda t, k=k: crush_log(t, k)).split("\n")}


def tables():
    rnd = random.Random(4)
    made = {"plain.csv": "a,b\n" + "".join(f"{i},{'fail' if i % 11 == 5 else 'x'}\n" for i in range(40)), "few.csv": 'a,b\n1,"x\ny"\n', "open.csv": 'a,b\n1,2\n3,"4\n5,6\n\n7,8', "blank.csv": "a,b\n\n\n" + "1,2\n" * 30}
    pieces = ["", "x", '"p"', '"q, r"', '"two\nlines"', '"a ""b"" c"', '"""\n,"""', 'in"side', '"x"tail', '"\n\n\n"', '"an\nerror"', '""', '"x""', "y"]
    for i in range(3):
        some = pieces if i > 1 else pieces[:-2]
        made[f"{i}.csv"] = "h1,h2\n" + ("\r\n" if i == 1 else "\n").join(",".join(rnd.choice(some) for _ in range(rnd.randint(1, 3))) for _ in range(30))
    return made


@pytest.mark.parametrize("size", [97, 10**6])
def test_long_tables(spark, tmp_path, blocks_of, size):
    for name, text in tables().items():
        (tmp_path / name).write_bytes(text.encode())
    blocks_of(size)
    records = {}
    for r in longfiles.csv_records(spark, str(tmp_path)).collect():
        records.setdefault(r["document"].rsplit("/", 1)[-1], []).append((r["record"], r["n"], r["text"]))
    for name, text in tables().items():
        want = list(csv.reader(io.StringIO(text, newline="\n")))
        got = sorted(records[name])
        assert [r[0] for r in got] == list(range(1, len(want) + 1)) and {r[1] for r in got} == {len(want)}
        assert [next(csv.reader(io.StringIO(r[2], newline="\n")), []) for r in got] == want, name
        assert "\n".join(r[2] for r in got) == text.removesuffix("\n")
    for k in (0, 4)[size > 99 :]:
        got = joined(longfiles.crush_tables(spark, str(tmp_path), k))
        for name, text in tables().items():
            assert "\n".join(got[name]) == one(spark, text, lambda t, k=k: crush_rows(t, k, ",")).removesuffix("\n"), (name, k)


def test_gaps_over_stretches(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text(tables()["plain.csv"])
    want = joined(longfiles.crush_tables(spark, str(tmp_path), 2))
    monkeypatch.setattr(longfiles, "STRETCH", 7)
    assert joined(longfiles.crush_tables(spark, str(tmp_path), 2)) == want
