import numpy as np
import pytest

import corpus_pipeline
from skein.llm import linededup, minhash, substring, vectors
from skein.llm.components import components
from tests.llm import brute

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, size int, a int"


def rows_of(spark, *texts):
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in texts], SCHEMA)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def documents(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def hard_texts():
    """Chains of near copies, shared passages, copies, very short and very long texts, self-repeats."""
    base, out = prose(1, 300), []
    for i in range(30):  # each a little further from the first
        w = list(base)
        for j in range(i):
            w[j * 9] = f"x{j}"
        out.append(" ".join(w))
    passage = prose(2, 60)
    out += [" ".join([*prose(100 + i, 5 + i), *passage, *prose(200 + i, 40)]) for i in range(40)]
    out += [None, "", " \t\n", "one", "one two", "One TWO", "one two three four", "a b c d e", "A b c d e", "ß É a b c", "ß é a b c"]
    out += [" ".join(prose(3, 20_000)), " ".join(["same"] * 36), " ".join(["same"] * 200), " ".join(prose(4, 50) * 3), " ".join(prose(5, 34)), " ".join(prose(5, 34))]
    out += [" ".join(prose(6, 35))] * 3 + ["x " * 5000 + "y", " ".join(prose(7, 100)) + "     z"]
    return [(i * 3, t) for i, t in enumerate(out)]


def check_near(spark, docs, df, **how):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, **how).collect()}
    want = brute.near_duplicates(docs)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_minhash_documents(spark, documents):
    check_near(spark, documents, spark.read.parquet(f"{DATA}/documents.parquet"))


def test_minhash_hard(spark):
    check_near(spark, hard_texts(), rows_of(spark, *hard_texts()))


def test_minhash_shared_names(spark):
    """Many different sets whose classes have one of eight names at first."""
    check_near(spark, hard_texts(), rows_of(spark, *hard_texts()), bits=3)


def test_minhash_crossing_components(spark):
    """Buckets whose first isn't like the others, which are like each other."""
    base, docs = prose(9, 400), []
    for i in range(60):
        w = list(base)
        for j in range(0, 6 * (i % 10), 1):
            w[(j * 31 + i % 10 * 7) % 400] = f"v{i % 10}_{j}"
        docs.append((i, " ".join([*w, f"end{i}"])))
    check_near(spark, docs, rows_of(spark, *docs))


def test_minhash_repeated_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (1, "z y x w v"), (7, "z y x w v")]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in minhash.near_duplicates(rows_of(spark, *docs)).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (1, 1), (5, 1), (7, 1)]
    assert minhash.near_duplicates(rows_of(spark).limit(0)).count() == 0


def check_substring(spark, docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(rows_of(spark, *docs)).collect()}
    assert got == dict(zip([i for i, _ in docs], brute.repeated_words([t for _, t in docs]), strict=True))


def test_substring_documents(spark, documents):
    check_substring(spark, documents)


def test_substring_hard(spark):
    check_substring(spark, hard_texts())


def test_substring_branches(spark):
    """Passages that leave a common stem for different ends, meet again, and cross each other."""
    stem, ends = prose(20, 60), [prose(21 + i, 50) for i in range(4)]
    texts = [[*stem, *e] for e in ends] + [[*e, *stem] for e in ends] + [[*ends[0], *stem, *ends[1]], [*ends[2], *stem[5:50], *ends[3]], stem[10:50] * 3, stem[:36], stem[24:]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    check_substring(spark, docs)
    rows = lambda walks: [(p, 1, i, 7, ord(e), ord(e), *([ord(w[k + 1])] * 2 if k + 1 < len(w) else [None] * 2)) for p, at, w in walks for k, (i, e) in enumerate(enumerate(w, at))]
    table = lambda *walks: spark.createDataFrame(rows(walks), "_p1 long, _p2 long, pos int, _m long, _e1 long, _e2 long, _x long, _y long")
    found = lambda df: sorted(tuple(r) for r in substring.nonbranching(df).select("_p1", "pos", "n").collect())
    assert found(table((1, 0, "abcd"), (2, 0, "abcd"), (3, 1, "cd"))) == [(1, 0, 4), (2, 0, 4), (3, 1, 2)]
    # cut before c, where two walks meet, and after d, where they part
    assert found(table((1, 0, "abcdx"), (2, 0, "abcdy"), (3, 0, "zcd"))) == [(1, 0, 2), (1, 2, 2), (1, 4, 1), (2, 0, 2), (2, 2, 2), (2, 4, 1), (3, 0, 1), (3, 1, 2)]


@pytest.mark.parametrize("group", [1 << 16, 40])
def test_substring_groups(spark, monkeypatch, group):
    """A minimizer's paths dealt to one group and to many."""
    monkeypatch.setattr(substring, "GROUP", group)
    check_substring(spark, hard_texts())


def test_substring_hash_collisions(spark, monkeypatch):
    """Words whose hashes are all the same few values: nothing but unequal texts keeps windows apart."""
    weak = lambda data: np.fromiter((len(w) % 3 for w in data.split()), np.uint64)
    monkeypatch.setattr(substring, "word_hashes", weak)
    base = prose(30, 200)
    texts = [base[:120], base[20:100] + prose(31, 80), [w[:-1] + "q" for w in base[:100]], prose(32, 150), base[60:]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    check_substring(spark, docs)


def test_substring_repeated_rows(spark):
    text = " ".join(prose(5, 40))
    got = substring.dedup(rows_of(spark, (1, text), (1, text), (None, "a b"))).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 40), (1, 40)]
    assert substring.dedup(rows_of(spark).limit(0)).count() == 0


@pytest.mark.parametrize("width", [2, 3])
def test_lines(spark, documents, width):
    more = [(None, "p\nq\n\n r"), (2_000_001, " p \nq\nz\nq\nr"), (2_000_002, "p\n\n\nq\t\n\nx\n\n"), (2_000_003, ""), (2_000_004, None), (2_000_005, "\n\n"), (2_000_006, "u\nu\nu\nu"), (2_000_007, "\n".join(f"l{i % 50}" for i in range(5000)))]
    docs = documents + more
    got = linededup.dedup(rows_of(spark, *docs), width).select("_row.doc_id", "_row.text", "_lines", "_removed", "_text").collect()
    assert {(r[0], r[1]): (r[2], r[3], r[4]) for r in got} == brute.line_dedup(docs, width)
    assert len(got) == len(docs)
    assert linededup.dedup(rows_of(spark).limit(0)).count() == 0


def test_single_lines(spark, documents):
    """Every later repeat of a line goes, between unlike neighbours and as a whole document too, in the pipeline's stage as well."""
    odd = [(None, "n\n\nr"), (2_000_001, "a\none\nb"), (2_000_002, "c\n one \n\nd\nd"), (2_000_003, "alone"), (2_000_004, "alone"), (2_000_005, "alone\n"), (2_000_006, ""), (2_000_007, None), (2_000_007, None), (2_000_008, "\nr\n")]
    docs = documents + odd
    got = linededup.dedup(rows_of(spark, *docs), linededup.EVERY).select("_row.doc_id", "_row.text", "_lines", "_removed", "_text").collect()
    want = brute.line_dedup(docs, 1)
    assert {(r[0], r[1]): (r[2], r[3], r[4]) for r in got} == want and len(got) == len(docs)
    assert [want[x][1] for x in odd] == [0, 0, 3, 0, 1, 2, 0, 0, 0, 2]
    left = corpus_pipeline.dedup_lines(spark, rows_of(spark, *docs), DATA).select("doc_id", "text").collect()
    stay = [(i, want[i, t][2]) for i, t in docs if not want[i, t][1] or want[i, t][2].strip()]
    assert sorted(map(tuple, left), key=repr) == sorted(stay, key=repr)


def brute_vectors(rows):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = []
    for n in {len(v) for v in ok.values()}:
        ids = [i for i, v in ok.items() if len(v) == n]
        x = np.array([ok[i] for i in ids])
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        links += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True)]
    ids = [i for i, _ in rows if i is not None]
    comp, n = brute.components(ids, links), dict.fromkeys(ids, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i]) for i in ids}


def test_vectors_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = brute_vectors([(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()])
    assert {r[0]: (r[1], r[2]) for r in vectors.near_duplicates(df).collect()} == want


def test_vectors_hard(spark):
    """Tight groups, chains at a few degrees, groups at the threshold, odd rows."""
    rng, rows = np.random.default_rng(3), []
    for c in range(6):
        center = rng.standard_normal(16)
        center /= np.linalg.norm(center)
        for _ in range(60):
            noise = rng.standard_normal(16)
            rows.append(center + noise / np.linalg.norm(noise) * (0.05, 0.2, 0.25, 0.3, 0.4, 0.6)[c])
    rows += [np.r_[np.cos(t), np.sin(t), np.zeros(14)] for t in np.linspace(0, 1.5, 40)]
    rows = [(i * 7 % 5003, [float(x) for x in v]) for i, v in enumerate(rows)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [1.0, None]), (9005, [float("nan")] * 16), (9006, [float("inf")] + [0.0] * 15), (9007, [1.0, 2.0]), (9008, [2.0, 4.0]), (9009, [1e-300, 2e-300]), (9010, [1e300, 2e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r[0]: (r[1], r[2]) for r in vectors.near_duplicates(df).collect()}
    want = brute_vectors(rows)
    missed = sum(w[0] for w in want.values()) - sum(g[0] for g in got.values())
    assert missed >= 0 and missed <= 0.002 * sum(w[0] for w in want.values())
    assert all(g[0] <= want[i][0] for i, g in got.items())
    assert got[9001] == (0, 9001) and got[9007] == got[9009] == (3, 9007)


def test_vectors_recall(spark):
    """Pairs planted at the threshold in 64 dimensions, among unrelated vectors: all that brute force finds but for one in a hundred."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(600):
        side = rng.standard_normal(64)
        side -= side @ x[i] * x[i]
        c = 0.900001 + 0.0001 * (i % 20)
        x[1000 + i] = c * x[i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    rows = [(i, [float(z) for z in v * rng.uniform(0.1, 9)]) for i, v in enumerate(x)]
    got = {r[0]: (r[1], r[2]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = brute_vectors(rows)
    links = sum(w[0] for w in want.values())
    found = sum(g[0] for g in got.values())
    print("recall", found / links)
    assert links >= 1190 and 0.99 * links <= found <= links and all(g[0] <= want[i][0] for i, g in got.items())


def test_vectors_blocks(spark, monkeypatch):
    """Balls that the triangle inequality doesn't decide, member by member in many blocks."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    center = np.eye(16)[0]
    rows = []
    for k, angle in enumerate((0.0, 0.44, 0.47)):  # two balls of which some members link
        lead = np.cos(angle) * center + np.sin(angle) * np.eye(16)[k + 1]
        for _ in range(90):
            side = rng.standard_normal(16)
            rows.append(lead + 0.08 * side / np.linalg.norm(side))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    got = {r[0]: (r[1], r[2]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = brute_vectors(rows)
    assert {i: w[0] for i, w in want.items()} == {i: g[0] for i, g in got.items()} and {g[1] for g in got.values()} == {w[1] for w in want.values()}


def test_vectors_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert sorted((r[0] or 0, r[1], r[2] or 0, r[3]) for r in vectors.near_duplicates(df).collect()) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (4, 1, 1, False)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(2000 + i, 2001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)]
    want = brute.components({x for e in edges for x in e}, edges)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in want.items() if v in got} and all(v == c for v, c in want.items() if v not in got)
