import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from skein.llm import chat, media, mixing, packing, queries
from tests.test_queries import norm

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, lang string, n_chars long, length int, _k int, start string"
ODD = ["<|endoftext|> x<|startoftext|>y", "It's we'll\tx y　z", "ﬁ É́ ÅÅ Σας ΟΔΟΣ", "a" * 300 + " " + "ab1" * 500, "😀 \x1c q\x85r", "word " * 9000, "x\r\ny\x0b\x0cz", "'S 'LL d'd"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, None, None, 1, 2, "z") for i, t, s in rows], DOCS)


def test_packing_round_trip(spark):
    table = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = table + [(10**6 + i, t) for i, t in enumerate([None, "", " \n", *ODD])] + [(None, "null id"), (0, table[0][1])]
    got = packing.pack(docs_of(spark, [(i, t, "s") for i, t in rows]), queries.tokenizer_path()).collect()
    tok, want = Tokenizer.from_file(queries.tokenizer_path()), []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, want))
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 4096
    hist: dict = {}
    for r in got:
        hist[r["length"]] = hist.get(r["length"], 0) + 1
    assert len(by) <= packing.lower_bound(hist, 4096) + 1
    assert packing.pack(docs_of(spark, []), queries.tokenizer_path()).count() == 0


def least_bins(items, capacity):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= items[i]}):
            rest = list(rooms)
            rest.remove(r)
            go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(5)
    cases = [[6, 6, 4, 4, 4, 3, 3], [7, 5, 5, 4, 3, 3, 3], [51, 27, 26, 23, 23, 26, 24], [50, 34, 33, 33, 33, 17], [10] * 3]
    cases += [[rng.randint(8, 60) for _ in range(rng.randint(5, 10))] for _ in range(60)]
    for items in cases:
        cap = 100 if max(items) > 10 else 10
        hist = {n: items.count(n) for n in items}
        plan = packing.bin_completion(hist, cap)
        held: dict = {}
        for pattern, times in plan.items():
            assert sum(n * c for n, c in pattern) <= cap
            for n, c in pattern:
                held[n] = held.get(n, 0) + c * times
        assert held == hist and sum(plan.values()) == least_bins(items, cap)
        assert packing.lower_bound(hist, cap) <= sum(plan.values())


def test_best_fit_counts():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 4097, 20000).tolist() + [37] * 5000
    hist = {int(n): int(c) for n, c in zip(*np.unique(sizes, return_counts=True), strict=True)}
    plan = packing.bin_completion(hist)
    held: dict = {}
    for pattern, times in plan.items():
        for n, c in pattern:
            held[n] = held.get(n, 0) + c * times
    assert held == hist and sum(plan.values()) <= packing.lower_bound(hist, 4096) * 1.0005


def test_bin_completion_beats_best_fit(spark):
    """Lengths that best fit packs badly at full capacity; the query's packing is that of the search."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(700, 2500, 400).tolist()
    hist = {int(n): int(c) for n, c in zip(*np.unique(sizes, return_counts=True), strict=True)}
    plan, first = packing.bin_completion(hist), packing.best_fit(hist, 4096)
    assert packing.lower_bound(hist, 4096) <= sum(plan.values()) < sum(first.values())
    got = packing.pack(docs_of(spark, [(i, "the " * (n - 1), "s") for i, n in enumerate(sizes)]), queries.tokenizer_path())
    assert sorted(r["length"] for r in got.collect()) == sorted(sizes) and got.select("sequence_id").distinct().count() == sum(plan.values())


def test_fillings():
    """All undominated fillings, by waste, against enumeration."""
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randint(1, 20) for _ in range(rng.randint(2, 8))]
        hist, room = {n: items.count(n) for n in items}, 25
        rest = list(items)
        largest = max(items)
        rest.remove(largest)
        every = {tuple(sorted(rest[i] for i in range(len(rest)) if mask >> i & 1)) for mask in range(1 << len(rest))}
        fits = {f for f in every if sum(f) <= room - largest}

        def worse(f, fits=fits, rest=rest):
            """An item left out is as large as some of the chosen together, or more, and still fits in their place."""
            left = list(rest)
            for n in f:
                left.remove(n)
            parts = [[f[i] for i in range(len(f)) if mask >> i & 1] for mask in range(1 << len(f))]
            return any(sum(p) <= n <= sum(p) + room - largest - sum(f) and n not in p for n in left for p in parts)

        want = {f for f in fits if not worse(f)}
        got = [(w, tuple(sorted(n for n, c in f for _ in range(c)))) for w, f in packing.fillings(hist, largest, room, room) if f is not None]
        assert {f for _, f in got} == want and len(got) == len(want)
        assert [w for w, _ in got] == sorted(room - largest - sum(f) for _, f in got)


def plain_targets(sizes, weights):
    capped: set = set()
    while True:
        left = sum(sizes) - sum(3 * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        new = {i for i in range(len(sizes)) if i not in capped and weights[i] * left / w > 3 * sizes[i]}
        if not new:
            return [3.0 * sizes[i] if i in capped else weights[i] * left / w for i in range(len(sizes))]
        capped |= new


def test_targets():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 1000, 10**6]) * rng.randint(1, 9) for _ in range(rng.randint(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        if sum(sizes):
            assert mixing.targets(sizes, weights) == pytest.approx(plain_targets(sizes, weights))


def test_mix(spark):
    table = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = table + [(None, "a b", None), (-1, None, None), (-2, "", "zzz"), (-3, "one " * 50000, "é"), (-4, "x\x0by z", "😀"), (0, table[0][1], table[0][2])]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((i or 0, len((t or "").encode().split())) for i, t, _ in rows)
    assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in got)
    source = {}
    for r in got:
        x = source.setdefault((r["source_size"], r["target"]), [0, 0])
        x[0] += r["taken"]
        x[1] = max(x[1], r["size"])
    for (_, target), (taken, largest) in source.items():
        assert abs(taken - target) <= largest / 2 + 1
    assert sorted(map(str, mixing.mix(docs_of(spark, rows)).collect())) == sorted(map(str, got))
    kept = mixing.repeats(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sum(len((r["text"] or "").encode().split()) for r in kept.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix(docs_of(spark, [])).count() == 0 and mixing.repeats(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert norm(got) == norm(want)


def test_chat_events(spark):
    rows = [
        (1, 1, "message", 1, "user", "hi <|end|>\n"), (1, 2, "message", 2, "assistant", None), (1, 3, "delta", 2, None, "wr"), (1, 4, "delta", 2, None, "ong"), (1, 5, "regenerate", 2, None, None),
        (1, 6, "delta", 2, None, "ri"), (1, 7, "delta", 2, None, "ght [x]&amp;"), (1, 8, "edit", 1, None, "hello"), (1, 9, "message", 3, "user", "gone"), (1, 10, "delete", 3, None, None),
        (2, 1, "delta", 9, None, "never opened"), (None, 5, "message", 1, None, None), (3, None, "message", 1, "a\nb", "t"), (3, 2, None, 1, "x", "y"), (3, 2, "other", 1, "x", "y"),
    ]
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg long, role string, text string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.reconstruct(log))).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", "hello"), ("assistant", "right [x]&amp;")] and back[1]["loss_texts"] == ["right [x]&amp;"]
    assert "[x]" not in back[1]["formatted"]
    assert [tuple(t) for t in back[None]["turns"]] == [("", "")] and [tuple(t) for t in back[3]["turns"]] == [("a\nb", "t")] and 2 not in back
    assert chat.render(chat.reconstruct(log.limit(0))).count() == 0


def test_chat_long_and_repeated(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", "<s>[é]&" * i) for i in range(600)] + [(2, 1, "user", "x"), (2, 1, "user", "x"), (2, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.reconstruct(chat.events_of_turns(df)))).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [t[2:] for t in turns[:600]] and back[1]["loss_texts"] == [t[3] for t in turns[1:600:2]]
    assert [tuple(t) for t in back[2]["turns"]] == [("", ""), ("user", "x"), ("user", "x")]


def test_media_round_trip(spark):
    texts = [None, "", "a", "x" * 192, "x" * 193, "é" * 100, "a ", "a", *ODD, "z" * 300_000]
    docs = docs_of(spark, [(i, t, "<s&\">") for i, t in enumerate(texts)] + [(None, "a", None)])
    made = media.documents_as_media(docs).cache()
    rows = media.resolve(media.parse(made.select("doc_id", "html"), "doc_id", "html"), "doc_id", media.features(made)).filter("kind = 'media'").collect()
    assert len(rows) == len(texts) + 1
    stored = {r["doc_id"]: r["media"] for r in made.collect()}
    for r in rows:
        data = ("a" if r["doc_id"] is None else texts[r["doc_id"]] or "").encode()
        full = data + b" " * (-len(data) % 192 if data else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[r["doc_id"]]), hashlib.sha256(stored[r["doc_id"]]).hexdigest())
        assert media.decode(stored[r["doc_id"]]).tobytes() == full and r["caption"] == f"{len(data)} bytes"
    assert media.features(media.documents_as_media(docs.limit(0))).count() == 0


def test_html_sequences(spark):
    page = "<html><head><title>T &amp; t</title><style>p{}</style></head><body><p>one <b>two</b></p><figure><img src='sha256:ab' alt='old'><figcaption>new  one</figcaption></figure>three<img src=\"u.png\" alt=\"pic\"><script>no</script><img><p>four<br>five"
    got = [(x["position"], x["kind"], x["text"], x["ref"], x["caption"]) for x in media.sequence(page)]
    assert got == [(0, "text", "T & t", None, None), (1, "text", "one two", None, None), (2, "media", None, "sha256:ab", "new one"), (3, "text", "three", None, None), (4, "media", None, "u.png", "pic"), (5, "text", "four", None, None), (6, "text", "five", None, None)]
    assert media.sequence(None) == [] and media.sequence("<p") in ([], [{"position": 0, "kind": "text", "text": "<p", "ref": None, "caption": None}])
    pages = media.parse(spark.read.parquet(f"{DATA}/pages.parquet"), "page_id", "html")
    assert pages.filter("size(elements) > 2").count() == pages.count() == 250
