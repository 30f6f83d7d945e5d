"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A document's set is that of its distinct ``K``-word shingles. Its signature has ``PLACES``
minhashes of which 16 bits are kept. Signatures at a distance (places that differ) of at most
``RADIUS`` are found without exception: they are split into ``CHUNKS`` chunks, and since
``RADIUS < CHUNKS * (ERRORS + 1)``, two such signatures have a chunk with at most ``ERRORS`` (one) places
that differ. Each chunk is entered into the index once for each place left out, so these meet in
a bucket. At the threshold a pair's expected distance is 9, and one beyond ``RADIUS`` is most
likely found all the same, since any chunk will do; candidates are given up only beyond ``LOOSE``
or for their sizes, and the others are verified on their full sets.

Documents with equal sets are one class, represented by its smallest id. A bucket doesn't expand
into all its pairs: each member is compared with the bucket's first. Where such a comparison
fails and members of a bucket are in different components after that, components with near signatures in
the bucket are put into one cluster (at most an edge for each member), and a cluster's full sets
are compared across components in blocks that any number of tasks share; only links come out. No
bucket is capped and no link between components is lost. Shingles are compared by their 64-bit hashes.
A class is named by half of its set's 128-bit digest; sets that differ in the other half but share that
name are told apart before anything is compared.

Nulls and edge cases: a null or empty text has no shingle and no link; a text with fewer than ``K`` words
has one, the whole sequence; rows with a null id have no link, a null component and are kept;
rows that share an id share a component; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import drop, stage, text_bytes
from skein.llm.components import components
from skein.llm.shingles import mixed, runs, word_hashes

K = 5
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
CHUNKS, WIDTH, ERRORS, RADIUS = 10, 6, 1, 19
PLACES = CHUNKS * WIDTH
#: Distance beyond which a candidate isn't verified; at the threshold one in 1e10 pairs is.
LOOSE = 30
#: Members of a block when a cluster is compared all against all.
BLOCK = 256
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PLACES, dtype=np.uint64)
_SALT = _RNG.integers(1, 2**63, (CHUNKS, WIDTH, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROWS = 1024


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; bytes.lower() changes A-Z alone."""
    words = word_hashes(text_bytes(text).lower())
    if not len(words):
        return words
    return np.unique(runs(words, min(K, len(words))) if len(words) >= K else mixed(runs(words, len(words)) + np.uint64(len(words))))


def signature(shingles: np.ndarray) -> bytes:
    least = np.full(PLACES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), ROWS):
        least = np.minimum(least, (shingles[at : at + ROWS, None] * _A + _B).min(0))
    return (mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


def digest(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Name of a set's class, of so many bits, and the other half of its digest."""
    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (h >> (128 - bits)) - 2 ** (bits - 1), (h & (2**64 - 1)) - 2**63


def sketches(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, _c and _d (class and digest of the set) and _sig of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = []
                for text in b.column(1).to_pylist():
                    s = shingle_set(text)
                    out.append((len(s), *digest(s, bits), signature(s)) if len(s) else (0, None, None, None))
                n, c, d, sig = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip((n, c, d, sig), kinds, strict=True))], ["doc_id", "n_shingles", "_c", "_d", "_sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, _c long, _d long, _sig binary")


def classes_of(sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches with one class for each different set, and the classes: _c, _d, _rep (least id), _n and _sig.

    Different sets that share a name get new ones, all but that with the least digest, until none share any.
    """
    while True:
        known = sketch.filter(F.col("_c").isNotNull() & F.col("doc_id").isNotNull())
        made = stage(
            known.groupBy("_c").agg(F.min("_d").alias("_d"), F.max("_d").alias("_d1"), F.min("doc_id").alias("_rep"), F.max("n_shingles").alias("_n"), F.first("_sig").alias("_sig")),
            "classes",
        )
        shared = made.filter("_d <> _d1").select("_c", F.col("_d").alias("_least"))
        if shared.isEmpty():
            return sketch, made.drop("_d1")
        name = F.when(F.col("_d") != F.col("_least"), F.xxhash64("_c", "_d")).otherwise(F.col("_c"))
        again = stage(sketch.join(shared, "_c", "left").withColumn("_c", name).select(*sketch.columns), "sketches")
        drop(sketch)
        drop(made)
        sketch = again


def index(classes: DataFrame) -> DataFrame:
    """_key and _c: the buckets of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, CHUNKS, WIDTH).astype(np.uint64) + np.uint64(1)
                keys = []
                for c in range(CHUNKS):
                    for out in range(WIDTH):
                        salt = _SALT[c, out].copy()
                        salt[out] = 0
                        keys.append(mixed((sig[:, c] * salt).sum(1, dtype=np.uint64) + np.uint64(c * WIDTH + out)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(b.column(0).to_numpy(), len(keys)))], ["_key", "_c"])

    return classes.select("_c", "_sig").mapInArrow(run, "_key long, _c long")


def stars(buckets: DataFrame) -> DataFrame:
    """a (the bucket's first) and b of each further member; _key if the bucket has three or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0, first, members = None, 0, 0  # the bucket that is open, its first and the number of its members
        for b in batches:
            key, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            head = np.r_[True, key[1:] != key[:-1]]
            if key0 is not None and key[0] == key0:
                head[0] = False
            start = np.maximum.accumulate(np.where(head, np.arange(len(key)), -1))
            lead = np.where(start >= 0, c[start], first)
            known = 0 if key0 is None else members  # of the open bucket, before this batch
            place = np.where(start >= 0, np.arange(len(key)) - start, np.arange(len(key)) + known)
            bucket = np.cumsum(head)
            size = np.bincount(bucket)[bucket] + np.where(start >= 0, 0, known)
            size[bucket == bucket[-1]] = np.maximum(size[bucket == bucket[-1]], 3)  # may go on in the next batch
            out = place > 0
            rest = size[out] > 2
            yield pa.RecordBatch.from_arrays([pa.array(lead[out]), pa.array(c[out]), pa.array(key[out], mask=~rest)], ["a", "b", "_key"])
            key0, first, members = key[-1], int(lead[-1]), int(place[-1]) + 1

    rows = buckets.repartition("_key").sortWithinPartitions("_key", "_c").select("_key", "_c")
    return rows.mapInArrow(run, "a long, b long, _key long")


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs that their sizes and signatures don't rule out."""
    end = lambda x: classes.select(F.col("_c").alias(x), F.col("_n").alias(f"_n{x}"), F.col("_sig").alias(f"_s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, PLACES) for i in (2, 3))
                ok = pa.array((x != y).sum(1) <= LOOSE)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    fits = F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * PERCENT
    rows = pairs.join(end("a"), "a").join(end("b"), "b").filter(fits)
    return rows.select("a", "b", "_sa", "_sb").mapInArrow(run, "a long, b long")


def sets_of(need: DataFrame, docs: DataFrame) -> DataFrame:
    """_c and _set (sorted hashes) of the classes ``need`` (_c, _d, _rep), made from their representatives' texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = []
                for c, d, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    s = shingle_set(text)
                    if len(s) and digest(s)[1] == d:  # else another text under the same id
                        out.append((c, s.tobytes()))
                c, s = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.binary())], ["_c", "_set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_rep"), F.col("text").cast("string").alias("_text")).join(need, "_rep").select("_c", "_d", "_text")
    return stage(texts.mapInArrow(sets, "_c long, _set binary").dropDuplicates(["_c"]), "sets")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("_c")).distinct().join(classes.select("_c", "_d", "_rep"), "_c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], ["a", "b"])

    made = sets_of(need, docs)
    end = lambda x: made.select(F.col("_c").alias(x), F.col("_set").alias(f"_{x}"))
    out = stage(pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "_a", "_b").mapInArrow(compare, "a long, b long"), "links")
    drop(made)
    return out


def across(members: DataFrame) -> DataFrame:
    """Edges u < w between components of a bucket's members that have near signatures, so that near components are connected.

    ``members`` (_key, _c, comp, _n, _sig) arrive by bucket, the largest component last: the others are held,
    it streams past them. A component that is connected already looks no further: the edges are at most as many as the members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0: int | None = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            key, last, comp, size = (batch.column(i).to_numpy() for i in range(4))
            sigs = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u2").reshape(-1, PLACES)
            for i in range(batch.num_rows):
                if key[i] != key0:  # label: what a component is connected to so far; held: the members outside the largest
                    key0, label, held = int(key[i]), {}, 0
                    held_label, held_comp, held_n = (np.zeros(16, np.int64) for _ in range(3))
                    held_sig = np.zeros((16, PLACES), np.uint16)
                own = int(comp[i])
                mine = label.setdefault(own, own)
                at = np.flatnonzero(held_label[:held] != mine)
                if len(at):
                    fits = (100 * np.minimum(held_n[at], size[i]) >= PERCENT * np.maximum(held_n[at], size[i])) & ((held_sig[at] != sigs[i]).sum(1) <= LOOSE)
                    for c in np.unique(held_comp[at[fits]]).tolist():
                        if label[c] != mine:
                            out.append((min(own, c), max(own, c)))
                            old = label[c]
                            held_label[:held][held_label[:held] == old] = mine
                            label.update({x: mine for x, y in label.items() if y == old})
                if not last[i]:
                    if held == len(held_n):
                        held_label, held_comp, held_n, held_sig = (np.concatenate([x, np.zeros_like(x)]) for x in (held_label, held_comp, held_n, held_sig))
                    held_label[held], held_comp[held], held_n[held], held_sig[held] = mine, own, size[i], sigs[i]
                    held += 1
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "w"])

    count = members.groupBy("_key", "comp").agg(F.count("*").alias("n"))
    top = count.groupBy("_key").agg(F.max(F.struct("n", "comp")).alias("x"), F.count("*").alias("comps")).filter("comps > 1").select("_key", F.col("x.comp").alias("_top"))
    rows = members.join(top, "_key").select("_key", (F.col("comp") == F.col("_top")).cast("int").alias("_last"), "comp", "_n", "_sig")
    return rows.repartition("_key").sortWithinPartitions("_key", "_last").mapInArrow(run, "u long, w long")


def similar(sets_x: list[np.ndarray], sets_y: list[np.ndarray]) -> np.ndarray:
    """Whether the sets of either list are similar enough, all against all, by products of membership matrices."""
    flat_x, flat_y = np.concatenate(sets_x), np.concatenate(sets_y)
    both = np.intersect1d(flat_x, flat_y)
    count = np.zeros((len(sets_x), len(sets_y)), np.float64)
    place = [(np.repeat(np.arange(len(s)), [len(x) for x in s]), np.searchsorted(both, f), np.isin(f, both)) for s, f in ((sets_x, flat_x), (sets_y, flat_y))]
    for lo in range(0, len(both), 8192):
        m = []
        for (row, col, known), s in zip(place, (sets_x, sets_y), strict=True):
            on = known & (col >= lo) & (col < lo + 8192)
            x = np.zeros((len(s), min(8192, len(both) - lo)), np.float32)
            x[row[on], col[on] - lo] = 1
            m.append(x)
        count += m[0] @ m[1].T
    size_x, size_y = (np.array([len(x) for x in s]) for s in (sets_x, sets_y))
    return 100 * count >= PERCENT * (size_x[:, None] + size_y - count)


def between(members: DataFrame) -> DataFrame:
    """Links u, w of components of a cluster, by full sets: all its members against those outside its largest component, in blocks.

    ``members`` (_cluster, comp, _set). A pair of blocks is one group of at most about ``2 * BLOCK`` rows; any
    number of tasks can share a cluster.
    """
    count = members.groupBy("_cluster", "comp").agg(F.count("*").alias("n"))
    total = count.groupBy("_cluster").agg(F.max(F.struct("n", "comp")).alias("x"), F.sum("n").alias("all"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    plan = total.select("_cluster", F.col("x.comp").alias("_top"), blocks(F.col("all") - F.col("x.n")).alias("_few"), blocks(F.col("x.n")).alias("_many"))
    rows = members.join(plan, "_cluster")
    big = F.col("comp") == F.col("_top")
    own = F.pmod(F.xxhash64("_c"), F.when(big, F.col("_many")).otherwise(F.col("_few"))).cast("int")
    few, many = F.sequence(F.lit(0), F.col("_few") - 1), F.sequence(F.lit(0), F.col("_many") - 1)
    # (i, j, 0): blocks i <= j outside the largest component; (i, j, 1): block i outside, block j of the largest.
    jobs = F.when(big, F.transform(few, lambda i: F.struct(i.alias("i"), F.col("_own").alias("j"), F.lit(1).alias("k")))).otherwise(
        F.concat(
            F.transform(few, lambda i: F.struct(F.least(i, F.col("_own")).alias("i"), F.greatest(i, F.col("_own")).alias("j"), F.lit(0).alias("k"))),
            F.transform(many, lambda j: F.struct(F.col("_own").alias("i"), j.alias("j"), F.lit(1).alias("k"))),
        )
    )
    dealt = rows.withColumn("_own", own).select("comp", "_set", F.explode(jobs).alias("x"), "_cluster", big.cast("int").alias("_big")).select(F.xxhash64("_cluster", "x.i", "x.j", "x.k").alias("_job"), "_big", "comp", "_set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            x = [r for r in rows if not r[1]]
            y = [r for r in rows if r[1]] or x
            out: set[tuple[int, int]] = set()
            for lo in range(0, len(x), BLOCK):
                for hi in range(0, len(y), BLOCK):
                    p, q = x[lo : lo + BLOCK], y[hi : hi + BLOCK]
                    ok = similar([r[3] for r in p], [r[3] for r in q])
                    out |= {(min(p[i][2], q[j][2]), max(p[i][2], q[j][2])) for i, j in zip(*np.nonzero(ok), strict=True) if p[i][2] != q[j][2]}
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["u", "w"])

        held: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(3)), (np.frombuffer(z.as_buffer(), np.uint64) for z in b.column(3)), strict=True):
                if held and held[0][0] != r[0]:
                    yield from told(held)
                    held = []
                held.append(r)
        if held:
            yield from told(held)

    return dealt.repartition("_job").sortWithinPartitions("_job").mapInArrow(run, "u long, w long").distinct()


def near_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``. ``bits``: of a class's name, at first."""
    sketch, classes = classes_of(stage(sketches(docs, bits), "sketches"))
    star = stage(stars(index(classes)), "stars")
    asked = stage(near(star.select("a", "b").distinct(), classes), "pairs")
    links = verified(asked, classes, docs)
    rep = classes.select(F.col("_c").alias("_x"), "_rep")

    def by_id(pairs: DataFrame) -> DataFrame:
        return pairs.join(rep.withColumnsRenamed({"_x": "a", "_rep": "u"}), "a").join(rep.withColumnsRenamed({"_x": "b", "_rep": "w"}), "b").select("u", "w")

    # Classes that share an id (rows of one id with several texts) belong together too.
    told = sketch.filter(F.col("_c").isNotNull() & F.col("doc_id").isNotNull())
    twice = told.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    own = told.join(twice, "doc_id", "left_semi").join(rep, F.col("_c") == F.col("_x")).filter("doc_id <> _rep").select(F.col("doc_id").alias("u"), F.col("_rep").alias("w"))
    comp = components(by_id(links), "u", "w")
    failed = star.filter("_key is not null").join(links.withColumn("_ok", F.lit(1)), ["a", "b"], "left").filter("_ok is null").select("_key").distinct()
    open_ = star.join(failed, "_key").select("_key", F.explode(F.array("a", "b")).alias("_c")).distinct()
    where = stage(classes.join(comp, F.col("_rep") == F.col("v"), "left").select("_c", "_d", "_rep", F.coalesce("component", "_rep").alias("comp"), "_n", "_sig"), "where")
    near_comps = stage(across(open_.join(where, "_c").select("_key", "_c", "comp", "_n", "_sig")).distinct(), "across")
    drop(star)
    edges = by_id(links).unionByName(own)
    if not near_comps.isEmpty():
        cluster = components(near_comps, "u", "w").select(F.col("v").alias("comp"), F.col("component").alias("_cluster"))
        inside = stage(where.join(cluster, "comp").select("_c", "_d", "_rep", "comp", "_cluster"), "inside")
        made = sets_of(inside.select("_c", "_d", "_rep"), docs)
        edges = edges.unionByName(stage(between(inside.join(made, "_c").select("_c", "_cluster", "comp", "_set")), "between"))
    final = components(edges, "u", "w").withColumnsRenamed({"v": "_v"})
    of_class = rep.join(final, F.col("_rep") == F.col("_v"), "left").select("_x", F.coalesce("component", "_rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("_c")).alias("_c")).join(of_class, F.col("_c") == F.col("_x"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
