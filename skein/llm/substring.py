"""Substring dedup over token k-mers, by compaction of the corpus's De Bruijn graph.

The edges of the graph are windows of ``K`` consecutive words. A text is a walk; it is cut into
pieces, runs of consecutive edges that share a minimizer (the least hash of ``M`` words in the
window). Equal windows have equal minimizers, so a minimizer's pieces hold all copies of its edges.

1. Minimizers that occur once can't lie in a repeated window: their pieces go before any edge is made.
2. Pieces of the same words are one path, whatever its number of copies, with a count and the
   source coordinates of one copy. A minimizer with one path needs no edges: all of them are
   repeated if the path is.
3. Other paths are read again at their source coordinates. Each edge is named by its minimizer and
   a 128-bit digest of its source words. A minimizer's paths are dealt to groups of bounded size,
   which sum their edges; the sums of all groups are joined.
4. Repeated edges that follow each other in a path are joined unless a branch lies between them (an
   edge with more than one successor, or predecessor): what is left are the nonbranching runs,
   one row each.
5. Runs are joined back to all source coordinates of their paths; a text's spans next to each
   other form its repeated passages.

Hashes of 64 bits only choose minimizers, so their collisions cost time and no correctness:
paths and edges are told apart by digests of their words. No group is held in one task: paths and
edges are summed before they are shuffled, and joins on a frequent key are ones that adaptive execution can split.

Nulls and edge cases: a null or empty text has no words; texts shorter than a window keep all;
rows equal in ``doc_id`` and text each count as a place of their own, so their windows repeat; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import drop, row_key, stage, text_bytes
from skein.llm.shingles import runs, window_minima, word_hashes

K, M = 35, 6
#: Edges of a piece at most.
LONGEST = 1024
#: Edges of a group of paths, about, and bytes of groups that are handled at once.
GROUP, AT_ONCE = 1 << 16, 4 << 20


def pieces(words: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of edges and minimizers of the pieces of a text."""
    if len(words) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = window_minima(runs(words, m), k - m + 1)
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    n = np.diff(np.r_[start, len(least)])
    if n.max() > LONGEST:
        parts = -(-n // LONGEST)
        first = np.repeat(start, parts)
        inner = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = first + inner * LONGEST
        n = np.diff(np.r_[start, len(least)])
    return start, n, least[start].view(np.int64)


def minimizer_places(words: np.ndarray, k: int, m: int) -> np.ndarray:
    """The minimizer at each place that is the minimizer of a window; a window that starts twice in a text has two of them."""
    if len(words) < k:
        return np.zeros(0, np.int64)
    h, width = runs(words, m), k - m + 1
    least = window_minima(h, width)
    edge = np.full(width - 1, 2**64 - 1, np.uint64)
    most = ~window_minima(np.concatenate([edge, ~least, edge]), width)  # the greatest minimum of the windows over each place
    return h[most == h].view(np.int64)


def minimizers(docs: DataFrame, k: int, m: int) -> DataFrame:
    """_k1 and minimizer, with the places of the text where it stands (2: two or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                keys, least, many = [], [], []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x, c = np.unique(minimizer_places(word_hashes(text_bytes(text)), k, m), return_counts=True)
                    keys.append(np.full(len(x), key, np.int64))
                    least.append(x)
                    many.append(np.minimum(c, 2).astype(np.int8))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, least, many)], ["_k1", "_m", "_n"])

    return docs.mapInArrow(run, "_k1 long, _m long, _n byte")


def parts_of(data: bytes) -> tuple[bytes, np.ndarray]:
    """The words joined by single blanks, and where each begins (and where one more would)."""
    words = data.split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    return b" ".join(words), np.r_[0, ends]


def digests(joined: bytes, begin: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """128-bit digests, as two columns, of runs of words given by their first word and number."""
    whole = memoryview(joined)
    cut = zip(begin[start].tolist(), (begin[start + words] - 1).tolist(), strict=True)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(whole[x:y]) for x, y in cut]), np.int64).reshape(-1, 2)


def path_rows(found: DataFrame, k: int, m: int) -> DataFrame:
    """From _k1, _k2, text, _ms (minimizers to look at) and _w (equal rows): their pieces, with the digest of their words (_p1, _p2) and whether an edge stands in one twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                out = []
                for row, text, wanted in zip(range(b.num_rows), b.column(2).to_pylist(), b.column(3), strict=True):
                    data = text_bytes(text)
                    words, (joined, begin) = word_hashes(data), parts_of(data)
                    start, n, least = pieces(words, k, m)
                    want = np.isin(least, wanted.values.to_numpy())
                    if want.any():
                        start, n, least = start[want], n[want], least[want]
                        edges = runs(words, k)
                        twice = [len(np.unique(edges[x : x + c])) < c for x, c in zip(start.tolist(), n.tolist(), strict=True)]
                        out.append((np.full(len(n), row), start.astype(np.int32), n.astype(np.int32), least, *digests(joined, begin, start, n + k - 1).T, np.array(twice)))
                if out:
                    row, *cols = (np.concatenate(x) for x in zip(*out, strict=True))
                    keys = [b.column(i).take(pa.array(row)) for i in (0, 1, 4)]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x) for x in cols)], ["_k1", "_k2", "_w", "start", "n", "_m", "_p1", "_p2", "_twice"])

    return found.select("_k1", "_k2", "text", "_ms", "_w").mapInArrow(run, "_k1 long, _k2 long, _w long, start int, n int, _m long, _p1 long, _p2 long, _twice boolean")


def path_edges(found: DataFrame, k: int) -> DataFrame:
    """From text and _paths (start, n, _m, _p1, _p2, c): each path with the digests of its edges, 16 bytes an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                for text, paths in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    joined, begin = parts_of(text_bytes(text))
                    start, n, *cols = paths.values.flatten()
                    e = []
                    for x, many in zip(start.to_pylist(), n.to_pylist(), strict=True):
                        e.append(digests(joined, begin, np.arange(x, x + many), np.full(many, k)).tobytes())
                    yield pa.RecordBatch.from_arrays([*cols, n, pa.array(e, pa.binary())], ["_m", "_p1", "_p2", "c", "n", "_edges"])

    return found.select("text", "_paths").mapInArrow(run, "_m long, _p1 long, _p2 long, c long, n int, _edges binary")


def in_groups(batches: Iterator[pa.RecordBatch], ids: tuple[str, str] = ("_m", "_g")) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about AT_ONCE bytes that end where a group ends; rows arrive by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            b = batch.slice(at, 4096)
            m, g = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ids)
            last = b.num_rows - int(np.argmin(((m == m[-1]) & (g == g[-1]))[::-1])) if ((m != m[-1]) | (g != g[-1])).any() else 0
            if last:
                held.append(b.slice(0, last))
                if sum(x.nbytes for x in held) > AT_ONCE:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
            if last < b.num_rows:
                held.append(b.slice(last))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def group_numbers(b: pa.RecordBatch) -> np.ndarray:
    m, g = b.column(b.schema.get_field_index("_m")).to_numpy(), b.column(b.schema.get_field_index("_g")).to_numpy()
    return np.cumsum(np.r_[False, (m[1:] != m[:-1]) | (g[1:] != g[:-1])])


def repeated_edges(paths: DataFrame) -> DataFrame:
    """_p1, _p2, pos, _m, _e1 and _e2 of the edges of ``paths`` (as ``path_edges`` makes them) that occur more than once; _x and _y: the next edge, if it is one of them.

    A minimizer's paths are dealt to as many groups as its edges need. A group sums its edges, the
    sums of all groups are added up, and each group gets back those of its edges that are repeated.
    An edge that a minimizer's only group has once is dropped there.
    """
    name = ["_m", "_e1", "_e2"]
    parts = paths.groupBy("_m").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("_parts"))
    several = stage(parts.filter("_parts > 1"), "parts")  # as a table of known size; Spark chooses the join by that
    dealt = paths.join(several, "_m", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_g", F.pmod("_p1", "_parts").cast("int"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches):
            m, g, alone, c = (b.column(i).to_numpy() for i in range(4))
            e = np.frombuffer(b"".join(b.column(4).to_pylist()), np.int64).reshape(-1, 2)
            n = np.fromiter((len(x.as_buffer()) // 16 for x in b.column(4)), np.int64, b.num_rows)
            row, group = np.repeat(np.arange(b.num_rows), n), group_numbers(b)
            order = np.lexsort((e[:, 1], e[:, 0], group[row]))
            x, of = e[order], group[row[order]]
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(1) | (of[1:] != of[:-1])])
            total = np.add.reduceat(c[row[order]], first)
            row = row[order[first]]
            on = (total > 1) | (alone[row] == 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(y[on])) for y in (m[row], g[row], *x[first].T, total)], ["_m", "_g", "_e1", "_e2", "c"])

    by_group = dealt.select("_m", "_g", (F.col("_parts") == 1).cast("int").alias("_alone"), "c", "_edges").repartition("_m", "_g").sortWithinPartitions("_m", "_g")
    sums = stage(by_group.mapInArrow(summed, "_m long, _g int, _e1 long, _e2 long, c long"), "sums")
    often = sums.groupBy(*name).agg(F.sum("c").alias("n")).filter("n > 1").select(*name)
    known = sums.join(often, name).groupBy("_m", "_g").agg(F.collect_list(F.struct("_e1", "_e2")).alias("_es"))  # at most the group's edges
    none = F.lit(None)
    both = known.select("_m", "_g", F.lit(0).alias("_kind"), none.cast("long").alias("_p1"), none.cast("long").alias("_p2"), none.cast("binary").alias("_edges"), "_es")
    both = both.unionByName(dealt.select("_m", "_g", F.lit(1).alias("_kind"), "_p1", "_p2", "_edges", none.cast("array<struct<_e1:long,_e2:long>>").alias("_es")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches):
            group, kind = group_numbers(b), b.column(2).to_numpy()
            m, paths = b.column(0).to_numpy(), np.flatnonzero(kind)
            sets = b.column(6).take(pa.array(np.flatnonzero(kind == 0)))
            old = np.stack([x.to_numpy() for x in sets.flatten().flatten()], 1) if len(sets) else np.zeros((0, 2), np.int64)
            rows = b.column(5).take(pa.array(paths))
            new = np.frombuffer(b"".join(rows.to_pylist()), np.int64).reshape(-1, 2)
            n = np.fromiter((len(x.as_buffer()) // 16 for x in rows), np.int64, len(rows))
            pos = np.arange(len(new)) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(paths, n)
            e = np.concatenate([old, new])
            where = np.concatenate([np.repeat(group[kind == 0], sets.value_lengths().to_numpy()), group[of]])
            order = np.lexsort((np.arange(len(e)), e[:, 1], e[:, 0], where))  # what is known stands first among equals
            x, w = e[order], where[order]
            first = np.r_[True, (x[1:] != x[:-1]).any(1) | (w[1:] != w[:-1])] if len(e) else np.zeros(0, bool)
            on = np.zeros(len(e), bool)
            on[order] = (order[first] < len(old))[np.cumsum(first) - 1]
            on = on[len(old) :]
            p1, p2 = (b.column(i).take(pa.array(of[on])) for i in (3, 4))
            alone = ~np.r_[on[1:] & (of[1:] == of[:-1]), False] if len(on) else on
            follow = np.roll(new, -1, 0)[on].T
            cols = [pa.array(np.ascontiguousarray(y)) for y in (m[of[on]], *new[on].T)] + [pa.array(np.ascontiguousarray(y), mask=alone[on]) for y in follow]
            yield pa.RecordBatch.from_arrays([p1, p2, pa.array(pos[on].astype(np.int32)), *cols], ["_p1", "_p2", "pos", "_m", "_e1", "_e2", "_x", "_y"])

    again = both.repartition("_m", "_g").sortWithinPartitions("_m", "_g", "_kind")
    out = stage(again.mapInArrow(found, "_p1 long, _p2 long, pos int, _m long, _e1 long, _e2 long, _x long, _y long"), "repeated")
    drop(sums)
    return out


def nonbranching(repeated: DataFrame) -> DataFrame:
    """_p1, _p2, pos and n of the runs without a branch in each path; ``repeated`` as ``repeated_edges`` makes them."""
    name = ["_m", "_e1", "_e2"]
    walk = Window.partitionBy("_p1", "_p2").orderBy("pos")  # at most LONGEST rows
    links = repeated.filter("_x is not null").select(*name, "_x", "_y").distinct()
    links = stage(links, "links")
    fork = links.groupBy(*name).agg(F.count("*").alias("n")).filter("n > 1").select(*name, F.lit(True).alias("_out"))
    meet = links.groupBy("_m", "_x", "_y").agg(F.count("*").alias("n")).filter("n > 1").select("_m", F.col("_x").alias("_e1"), F.col("_y").alias("_e2"), F.lit(True).alias("_in"))
    marked = repeated.select("_p1", "_p2", "pos", *name).join(fork, name, "left").join(meet, name, "left")
    before = lambda x: F.lag(x).over(walk)
    begins = before("pos").isNull() | (before("pos") != F.col("pos") - 1) | F.coalesce(before("_out"), F.lit(False)) | F.coalesce("_in", F.lit(False))
    runs_ = marked.select("_p1", "_p2", "pos", begins.cast("int").alias("_new")).withColumn("_run", F.sum("_new").over(walk))
    return runs_.groupBy("_p1", "_p2", "_run").agg(F.min("pos").alias("pos"), F.count("*").cast("int").alias("n")).drop("_run")


def repeated_spans(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """_k1, _k2 and the spans (start, edges) of windows that start elsewhere too; documents have _k1, _k2 and text."""
    key = ["_k1", "_k2"]
    seen = stage(minimizers(docs.select("_k1", "text"), k, m), "minimizers")
    often = seen.groupBy("_m").agg(F.sum(F.col("_n").cast("long")).alias("c")).filter("c > 1").select("_m")
    wanted = stage(seen.join(often, "_m").groupBy("_k1").agg(F.collect_set("_m").alias("_ms")), "wanted")
    drop(seen)
    # Equal rows are read once, with their number as weight.
    copies = stage(docs.groupBy(*key).agg(F.count("*").alias("_w")).filter("_w > 1"), "copies")
    known = docs.join(wanted, "_k1")
    single = known.join(copies, key, "left_anti").withColumn("_w", F.lit(1).cast("long"))
    texts = single.unionByName(known.join(copies, key).dropDuplicates(key))
    places = stage(path_rows(texts, k, m), "places")
    path = ["_p1", "_p2"]
    one = F.min(F.struct("_k1", "_k2", "start"))
    paths = stage(places.groupBy(*path).agg(F.sum("_w").alias("c"), F.first("_m").alias("_m"), F.first("n").alias("n"), F.max("_twice").alias("_twice"), one.alias("_at")), "paths")
    open_ = paths.groupBy("_m").agg(F.count("*").alias("x"), F.max("_twice").alias("y")).filter("x > 1 or y").select("_m")
    whole = paths.join(open_, "_m", "left_anti").filter("c > 1").select(*path, F.lit(0).alias("pos"), "n")
    asked = paths.join(open_, "_m", "left_semi").groupBy(F.col("_at._k1").alias("_k1"), F.col("_at._k2").alias("_k2"))
    asked = asked.agg(F.collect_list(F.struct(F.col("_at.start").alias("start"), "n", "_m", "_p1", "_p2", "c")).alias("_paths"))
    edges = stage(path_edges(texts.select(*key, "text").join(asked, key), k), "edges")
    repeated = repeated_edges(edges)
    drop(edges)
    runs_ = stage(whole.unionByName(nonbranching(repeated)), "runs")
    drop(repeated)
    return places.select(*key, "start", *path).join(runs_, path).select(*key, (F.col("start") + F.col("pos")).alias("start"), F.col("n").alias("edges"))


def keep_words(data: bytes, spans: list[tuple[int, int]], k: int) -> tuple[list[bytes], int]:
    """The words outside the spans' windows, and the number of words."""
    words = data.split()
    if not spans:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, n in spans:
        edge[start] += 1
        edge[min(len(words), start + n + k - 1)] -= 1
    keep = np.cumsum(edge)[:-1] == 0
    return [w for w, x in zip(words, keep.tolist(), strict=True) if x], len(words)


def dedup(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and kept_sha256 of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *row_key("doc_id", "text"))
    spans = repeated_spans(rows.select("_k1", "_k2", "text"), k, m)
    each = spans.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "edges")).alias("_spans"))
    joined = rows.join(each, ["_k1", "_k2"], "left").select("doc_id", "text", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = []
                for text, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    kept, n = keep_words(text_bytes(text), [(x["start"], x["edges"]) for x in cut or ()], k)
                    data = b" ".join(kept)
                    out.append((n, n - len(kept), data.decode("utf-8", "surrogatepass"), hashlib.sha256(data).hexdigest()))
                n, gone, text, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
