"""Archives, the prefix trie of conversations and the fill-in-middle transformation."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from skein.llm import fim, trie, warc
from tests.llm import brute

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
PAGE = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def rows(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def pages(table, least=0):
    last = {}
    for p, _, h in table:
        last[h or ""] = max(last.get(h or "", (False, 0)), (p is not None, p or 0))
    out = []
    for p, _, h in table:
        data, top = (h or "").encode(), last[h or ""]
        full = len(data) < least or (p is not None, p or 0) == top
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if full else "revisit", None if full else top[1]))
    return sorted(out, key=repr)


ODD = [
    (1, "u", "a"), (2, None, "a"), (3, "u\r\nx", None), (4, "é", ""), (None, "u", "a"), (None, "u", "zz"), (None, "u", "zz"), (7, "u", "HTTP/1.1 200\r\n\r\nWARC/1.0\r\n\r\n"),
    (7, "u", "q"), (7, "u", "q"), (6, "u", "q"), (8, "u", "é😀\x00" * 50_000), (-5, "u", "é😀\x00" * 50_000),
]


@pytest.mark.parametrize("how", ["gzip", "none"])
def test_archive_round_trip(spark, tmp_path, how):
    warc.register(spark)
    df = spark.createDataFrame([(*r, 1, "x") for r in ODD], "page_id long, url string, html string, _k int, payload string").repartition(3)
    for least in (0, 2):
        path = f"{tmp_path}/{least}"
        warc.records(df, least).write.format("warc").option("compression", how).option("file_bytes", 2000).mode("append").save(path)
        archive = spark.read.format("warc").option("partition_bytes", 5000).load(path)
        assert rows(warc.pages_of(archive), PAGE) == pages(ODD, least)
        assert {r[0] for r in archive.filter("record_type = 'response'").select("payload").collect()} == {(h or "").encode() for _, _, h in ODD}
        assert not [f for f in (tmp_path / str(least)).iterdir() if f.name.startswith("_")]
    with pytest.raises(Exception, match="already holds"):
        warc.records(df).write.format("warc").mode("append").save(path)
    warc.records(df.limit(0)).write.format("warc").mode("append").save(f"{tmp_path}/none")
    assert spark.read.format("warc").load(f"{tmp_path}/none").count() == 0


def test_archive_work_is_dealt_and_done_once(spark, tmp_path):
    """A payload's digest is made once a record, and small archives are read by as many tasks as are asked for."""
    df = spark.createDataFrame([(b"",), (b"a",), (None,), (bytes(range(256)),)], "payload binary").select("payload", warc.base32_digest(F.col("payload")).alias("d"))
    assert [r["d"] for r in df.collect()] == [None if r["payload"] is None else warc.base32_sha1(r["payload"]) for r in df.collect()]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
    for i, n in enumerate((0, 300, 300, 300, 300, 900)):
        (tmp_path / f"{i}.warc").write_bytes(bytes(n))
    planned = lambda **more: [len(p.paths) for p in warc.WarcReader({"path": str(tmp_path), **more}, df.select("payload").schema).partitions()]
    assert planned() == [6] and len(planned(partitions="4")) >= 4 and planned(partition_bytes="600", partitions="2") == [1, 2, 3]
    for i in range(6):
        (tmp_path / f"{i}.warc").write_bytes(b"")
    assert planned(partitions="4") == [6]


@pytest.mark.parametrize("how", ["gzip", "none"])
def test_archive_skips(spark, tmp_path, how):
    """Predicates on the header are the reader's, and blocks that nobody asks for aren't read."""
    warc.register(spark)
    warc.records(spark.createDataFrame(ODD, "page_id long, url string, html string")).write.format("warc").option("compression", how).mode("append").save(f"{tmp_path}/a")
    read = spark.read.format("warc").schema("record_type string, record_id string, target_uri string, content_length long").load(f"{tmp_path}/a")
    some = read.filter("record_type = 'revisit' and target_uri >= 'u' and record_id in ('<urn:page:1>', '<urn:page:6>', '<urn:page:7>')")
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert sorted(r["record_id"] for r in some.collect()) == ["<urn:page:1>", "<urn:page:6>"]
    assert read.filter("content_length > 100000").count() == 1

    class Counted(io.BytesIO):
        read_ = 0

        def read(self, n=-1):
            data = super().read(n)
            self.read_ += len(data)
            return data

        def readinto(self, into):
            n = super().readinto(into)
            self.read_ += n
            return n

    noise = random.Random(1).randbytes(3_000_000)  # can't be compressed
    made = [warc.record({"record_type": t, "record_id": str(i), "payload": noise if t == "resource" else b"x"}) for i, t in enumerate(["resource", "metadata", "resource", "metadata"])]
    file = Counted(b"".join(map(warc.member, made)) if how == "gzip" else b"".join(made))
    found = list(warc.walk(file, how == "gzip", lambda lines: (lines["WARC-Type"] == "metadata", True)))
    assert [(x["WARC-Record-ID"], block) for _, x, block in found] == [("1", b"x"), ("3", b"x")]
    assert file.read_ < 500_000  # of six million bytes


def test_archive_of_others(spark, tmp_path):
    """Members without their length, plain records in one member, chunks and codings; what is cut off fails."""
    warc.register(spark)
    body = gzip.compress(b"hello")
    chunked = b"3\r\n" + body[:3] + b"\r\n" + hex(len(body) - 3)[2:].encode() + b";x=y\r\n" + body[3:] + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nX-Long: a\r\n b\r\ncontent-length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\na\nb\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(one))
    (tmp_path / "b.warc").write_bytes(two + one)
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert sorted((r["record_type"], bytes(r["payload"])) for r in got) == [("response", b"hello")] * 3 + [("warcinfo", b"a\nb")] * 2
    assert all(r["headers"]["X-Long"] == "a b" for r in got if r["record_type"] == "response")
    assert spark.read.format("warc").load(f"{tmp_path}/b.warc").filter("record_type = 'response'").first()["offset"] == len(two)
    for name, data in (("c.warc", one[:-20]), ("d.warc.gz", gzip.compress(one)[:-12]), ("e.warc", b"GIF89a"), ("f.warc.gz", gzip.compress(one) + b"xx")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=name):
            spark.read.format("warc").load(f"{tmp_path}/{name}").collect()


def talks(rnd, n, longest):
    return {i: [(rnd.choice(("user", "bot")), rnd.choice("ab")) for _ in range(rnd.randint(0, longest))] for i in range(-3, n)}


def turns_of(spark, convs, rnd):
    table = [(i, None if t == 0 else t, r or None, x or None, "z") for i, turns in convs.items() for t, (r, x) in enumerate(turns)] + [(None, 1, "user", "lost", "z")]
    rnd.shuffle(table)
    return spark.createDataFrame(table, "conv_id long, turn int, role string, text string, depth string").repartition(3)


@pytest.mark.parametrize("bits", [(), (3, 5), (1, 2, 4)])
def test_trie(spark, bits):
    """Against plain dictionaries, also where fingerprints of few bits collide and a conversation spans partitions."""
    rnd = random.Random(3)
    convs = talks(rnd, 50, 7)
    convs |= {500: convs[5] + [("user", "é")] * 300, 501: convs[5] + [("user", "é")] * 290, 502: [("", ""), ("a", "bc"), ("ab", "c")], 503: [("", ""), ("ab", "c")]}
    ids = spark.createDataFrame([(i,) for i in convs] + [(None,), (5,)], "conv_id long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = trie.contents(turns_of(spark, convs, rnd))
        assert turns.select(F.spark_partition_id()).distinct().count() > 1
        assert rows(trie.trie(turns, ids, bits), NODE) == brute.trie(convs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_edges(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(trie.contents(none)).count() == 0
    assert rows(trie.trie(trie.contents(none), spark.createDataFrame([(7,), (3,)], "conv_id long")), NODE) == brute.trie({3: [], 7: []})
    many = {i: [("user", "same")] for i in range(10_000)}  # ends of a node in several pieces
    table = spark.range(10_000).selectExpr("id as conv_id", "1L as turn", "'user' as role", "'same' as text")
    assert rows(trie.trie(trie.contents(table)), NODE) == brute.trie(many)
    ties = spark.createDataFrame([(1, 1, "b", "x"), (1, 1, "a", "y"), (1, None, "z", "z"), (1, 1, "a", "y"), (2, 5, "z", "z"), (2, 6, "a", "y")], "conv_id long, turn long, role string, text string")
    assert rows(trie.trie(trie.contents(ties)), NODE) == brute.trie({1: [("z", "z"), ("a", "y"), ("a", "y"), ("b", "x")], 2: [("z", "z"), ("a", "y")]})


TEXTS = [None, "", " ", "  \n", "a", "a ", " a b\x0b c  ", "é😀 b😀 c d e", "a <P> b", "x<S y> <M z <", "x<S y> <M z <", "w " * 9000, " \t" * 5000, "q" * 9000]


@pytest.mark.parametrize("size", [1, 2, 3, 7, fim.CHUNK])
def test_fill_in_middle(spark, size):
    table = [(i, t, "z", 1) for i, t in enumerate(TEXTS)] + [(None, "null id of some words", "z", 1)] * 2
    table = [r for r in table if size > 3 or len(r[1] or "") < 100]
    docs = spark.createDataFrame(table, "doc_id long, text string, `_t.x` string, form int")
    for rate in (0, 50, 100):
        made = fim.transform(docs, rate=rate, size=size)
        got = made.select("_row.doc_id", "n", made["form"], "prefix", "middle", "output", fim.restore(F.col("output"), F.col("form")).alias("back"), "_row.text").collect()
        assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((brute.fill_in_middle(i, t, rate) for i, t, *_ in table), key=repr)
        assert all(r["back"] == (r["text"] or "") for r in got)
    assert fim.transform(docs.limit(0)).count() == 0


def test_fill_in_middle_plan(spark):
    made = fim.transform(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
