"""Prefix trie of conversations: which first turns conversations share, and what that saves.

A node of depth d is a distinct sequence of d turns with which some conversation begins; the
conversations that begin with it are its members, the root has all of them.

1. ``contents`` orders the turns of each conversation and replaces role and text by a SHA-256, so
   that no text travels after that.
2. ``trie`` reads the turns once in order and gives each prefix a polynomial rolling fingerprint,
   F(d) = F(d - 1) * B + t(d) modulo 2**64. B is odd and so has an inverse: F(d) = B**d * sum of
   t(i) * B**-i, which numpy adds up for a whole batch. Rows are sorted by ranges of
   (conversation, turn), so a conversation of any length is spread over tasks: such sums add up
   over tasks as well, by one row for each conversation that crosses a border.
3. Equal fingerprints group candidates. Each group is verified turn by turn against its
   representative, the smallest conversation in it: all members must have the representative's
   turn there and the same group one turn before. What differs is split off and gets fingerprints
   of another base from that depth on, until no group differs.
4. Parent rollup: a node's representative represents its deeper prefixes too, until it ends, so each
   representative owns one chain of nodes. Sums along a chain are a window's; a whole chain's sums
   are given to each node above it, which the representative's own turns name. Nothing is iterated
   by depth.

Nulls and edge cases: a null role or text is empty; a null turn comes first; turns with the same
number order by role and text, repeated rows are turns of their own; rows whose ``conv_id`` is null
are left out; conversations without a turn, which ``convs`` may name, are members of the root; no
conversation, no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stage

#: The first base of the fingerprints; odd, and 5 modulo 8, so that its powers repeat after 2**62 only.
BASE = 0x9E3779B97F4A7C15
WORD64 = (1 << 64) - 1
#: Ids of one text piece of the ends of a node: 2**BUCKET at most.
BUCKET = 12


def base_of(generation: int) -> int:
    """Bases of later generations are odd powers of the first one."""
    return pow(BASE, 2 * generation + 1, 1 << 64)


def _scanned(rows: DataFrame, by: list[str], base: int) -> DataFrame:
    """``rows`` (conv_id, _t: a turn's hash, and others) in the order of ``by`` (conv_id first), with depth (from 1) and fp.

    First each partition of the sorted rows is added up for itself, then the sums of conversations
    that cross partitions are carried on: at most two rows a partition.
    """
    inverse = pow(base, -1, 1 << 64)
    kept = [f for f in rows.schema.fields if f.name not in ("turn", "role", "text")]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, s = TaskContext.get().partitionId(), None, np.int64(0), np.uint64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            t = batch.column("_t").to_numpy().view(np.uint64)
            heads = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            which = np.cumsum(np.bincount(heads, minlength=len(conv))) - 1
            goes_on = conv[0] == last
            at = np.arange(1, len(conv) + 1, dtype=np.int64) - heads[which] + np.where(which == 0, n if goes_on else 0, 0)
            sums = np.cumsum(t * np.power(np.uint64(inverse), at.astype(np.uint64)), dtype=np.uint64)
            start = np.concatenate([[np.uint64(0)], sums[heads[1:] - 1]]).astype(np.uint64)
            if goes_on:
                start[0] -= s
            sums = sums - start[which]
            last, n, s = conv[-1], at[-1], sums[-1]
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(np.full(len(conv), part, np.int32)), pa.array(at), pa.array(sums.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + ["_p", "_i", "_s"])

    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*[f.name for f in kept])
    summed = stage(ranged.mapInArrow(local, out + ", _p int, _i long, _s long"), "scan")
    crossing = summed.groupBy("conv_id").agg(F.min("_p").alias("a"), F.max("_p").alias("b")).filter("a < b").select("conv_id")
    ends = summed.join(crossing, "conv_id", "left_semi").groupBy("conv_id", "_p").agg(F.max(F.struct("_i", "_s")).alias("e")).collect()  # at most two rows a partition
    carry, before = [], {}
    for r in sorted(ends, key=lambda r: (r["conv_id"], r["_p"])):
        n, s = before.get(r["conv_id"], (0, 0))
        carry.append((r["conv_id"], r["_p"], n, s - (1 << 64) if s >> 63 else s))
        before[r["conv_id"]] = (n + r["e"]["_i"], (s + (r["e"]["_s"] & WORD64) * pow(inverse, n, 1 << 64)) & WORD64)
    told = rows.sparkSession.createDataFrame(carry, "_c long, _q int, _n long, _b long")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u64 = lambda c: c.to_numpy().view(np.uint64)
        for batch in batches:
            before = batch.column("_n").to_numpy()
            depth = batch.column("_i").to_numpy() + before
            sums = u64(batch.column("_b")) + u64(batch.column("_s")) * np.power(np.uint64(inverse), before.astype(np.uint64))
            fp = sums * np.power(np.uint64(base), depth.astype(np.uint64))
            columns = [batch.column(f.name) for f in kept] + [pa.array(depth), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + ["depth", "fp"])

    joined = summed.join(F.broadcast(told), (F.col("conv_id") == F.col("_c")) & (F.col("_p") == F.col("_q")), "left") if carry else summed.withColumns({"_n": F.lit(None), "_b": F.lit(None)})
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return joined.select(*[f.name for f in kept], "_i", "_s", zero("_n"), zero("_b")).mapInArrow(whole, out + ", depth long, fp long")


def contents(turns: DataFrame) -> DataFrame:
    """conv_id, turn (from 1), content (SHA-256 of role and text) and n_bytes (of the text) of each turn of a table conv_id, turn, role, text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), text("role"), text("text"))
    content = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    told = rows.select("*", content.alias("content"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("_t"))
    return _scanned(told, ["conv_id", "turn", "role", "text"], 1).select("conv_id", F.col("depth").alias("turn"), "content", "n_bytes")


def _key(g: Column, f: Column) -> Column:
    return F.struct(g.cast("int").alias("g"), f.alias("f"))


#: The root's key; no fingerprint has its generation.
ROOT = (-1, 0)


def _fingerprints(rows: DataFrame, generation: int, bits: int) -> DataFrame:
    """conv_id, depth, key, parent, content, n_bytes: keys of one generation, of ``bits`` bits of the fingerprints."""
    base = base_of(generation)
    inverse = pow(base, -1, 1 << 64)
    hashed = F.xxhash64(F.lit(generation), "content").alias("_t")

    def step_back(fp: Column, t: Column) -> Column:
        """F(d - 1) = (F(d) - t(d)) / B."""

        @F.arrow_udf("long")
        def run(f: pa.Array, x: pa.Array) -> pa.Array:
            return pa.array(((f.to_numpy().view(np.uint64) - x.to_numpy().view(np.uint64)) * np.uint64(inverse)).view(np.int64))

        return run(fp, t)

    some = lambda c: F.shiftrightunsigned(c, 64 - bits) if bits < 64 else c
    read = _scanned(rows.select("conv_id", "turn", "content", "n_bytes", hashed), ["conv_id", "turn"], base).withColumn("_up", step_back(F.col("fp"), F.col("_t")))
    parent = F.when(F.col("depth") == 1, _key(F.lit(ROOT[0]), F.lit(ROOT[1]).cast("long"))).otherwise(_key(F.lit(generation), some(F.col("_up"))))
    return read.select("conv_id", "depth", _key(F.lit(generation), some(F.col("fp"))).alias("key"), parent.alias("parent"), "content", "n_bytes")


def _grouped(rows: DataFrame) -> DataFrame:
    """One row for each group: its representative's turn and group before, and whether all members have the same."""
    seen = F.struct("content", "parent")
    return rows.groupBy("key").agg(
        F.min(F.struct("conv_id", "content", "parent")).alias("rep"), F.min(seen).alias("_lo"), F.max(seen).alias("_hi"),
        F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
    ).select("key", "rep", "depth", "n_convs", "n_bytes", (F.col("_lo") == F.col("_hi")).alias("same"))


def classes(rows: DataFrame, bits: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key) of each prefix, and the verified groups, for rows conv_id, turn, content, n_bytes.

    ``bits`` are those of the first generations' fingerprints (64 if not given).
    """
    generation, width = 0, lambda g: bits[g] if g < len(bits) else 64
    told = stage(_fingerprints(rows, 0, width(0)), "prefixes")
    groups = stage(_grouped(told), "groups")
    while not groups.filter(~F.col("same")).isEmpty():
        generation += 1
        wrong = groups.filter(~F.col("same")).select("key", "rep")
        differs = (F.col("content") != F.col("rep.content")) | (F.col("parent") != F.col("rep.parent"))
        apart = stage(told.join(wrong, "key").filter(differs).groupBy("conv_id").agg(F.min("depth").alias("_from")), "apart")
        again = _fingerprints(rows.join(apart, "conv_id", "left_semi"), generation, width(generation)).join(apart, "conv_id").filter("depth >= _from")
        old = told.join(apart, "conv_id", "left").filter("_from is null or depth < _from").drop("_from")
        # The first turn that is split off still stands below the old group of the turn before it.
        above = told.join(apart, "conv_id").filter("depth = _from").select(F.col("conv_id").alias("_c"), F.col("parent").alias("_above"))
        new = again.join(above, F.col("conv_id") == F.col("_c")).withColumn("parent", F.when(F.col("depth") == F.col("_from"), F.col("_above")).otherwise(F.col("parent")))
        told = stage(old.unionByName(new.select(*old.columns)), "prefixes")
        groups = stage(_grouped(told), "groups")
    return told.select("conv_id", "depth", "key"), groups


def _hashed(ends: DataFrame) -> DataFrame:
    """key and ends_sha256 for rows key, conv_id. Ids travel as pieces of text in order; a task holds one piece at a time."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("key", F.shiftright("conv_id", BUCKET).alias("_b")).agg(ids.alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind = ["g", "f", "ends_sha256"], pa.schema([("g", pa.int32()), ("f", pa.int64()), ("ends_sha256", pa.string())])
        at, digest = None, None
        for batch in batches:
            done = []
            for g, f, piece in zip(*(batch.column(c).to_pylist() for c in ("g", "f", "_ids")), strict=True):
                if (g, f) != at:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (g, f), hashlib.sha256()
                    digest.update(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], kind)
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*at, digest.hexdigest()), strict=True))], kind)

    ordered = pieces.select("key.g", "key.f", "_b", "_ids").repartition("g", "f").sortWithinPartitions("g", "f", "_b").select("g", "f", "_ids")
    return ordered.mapInArrow(run, "g int, f long, ends_sha256 string").select(_key(F.col("g"), F.col("f")).alias("key"), "ends_sha256")


def trie(rows: DataFrame, convs: DataFrame | None = None, bits: tuple[int, ...] = ()) -> DataFrame:
    """One row for each node of the conversations ``rows`` (conv_id, turn, content, n_bytes, as ``contents`` gives them).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (nodes without a
    child in its subtree), saved_tokens (over its subtree, what members beyond the first would repeat
    of each node's last text) and ends_sha256 (of the ids of members that end there). ``convs``
    (conv_id) may name conversations without turns.
    """
    told, groups = classes(rows, bits)
    root = _key(F.lit(ROOT[0]), F.lit(ROOT[1]).cast("long"))
    every = rows.select("conv_id") if convs is None else rows.select("conv_id").unionByName(convs.select(F.col("conv_id").cast("long").alias("conv_id")))
    every = every.filter(F.col("conv_id").isNotNull()).distinct()
    top = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").withColumn("key", root)  # one row
    nodes = groups.select("key", "rep.conv_id", "rep.parent", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("_v"))
    kids = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    known = stage(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")

    # A representative's chain: what stands below a node of it, and the whole for the nodes above it.
    leaf = (F.col("n_children") == 0).cast("long")
    chains = known.groupBy("conv_id").agg(F.min("depth").alias("_start"), F.sum("_v").alias("_sum"), F.sum(leaf).alias("_leaves"))
    above = told.join(chains, "conv_id").filter("depth < _start and (_sum > 0 or _leaves > 0)").select("key", F.col("_sum").alias("saved"), F.col("_leaves").alias("leaves"))
    below = known.selectExpr("conv_id", "depth", "key", "_v", "int(n_children = 0) as _leaf")
    summed = below.selectExpr("key", "sum(_v) over (partition by conv_id order by depth desc) as saved", "sum(_leaf) over (partition by conv_id order by depth desc) as leaves")
    sums = above.unionByName(summed).groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    whole = known.agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("saved_tokens"), F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.count_if(F.col("n_children") == 0), F.lit(1)).alias("n_leaves"))  # one row

    last = told.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    silent = every.join(last.select("conv_id"), "conv_id", "left_anti").select(root.alias("key"), "conv_id")
    ends = _hashed(last.select("key", "conv_id").unionByName(silent))

    # Only a chain's first node has a parent of another chain; below the root it is the root's.
    first = known.join(chains.select(F.col("conv_id").alias("_c"), "_start"), (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_start"))).drop("_c", "_start")
    high = first.filter("depth = 1").crossJoin(F.broadcast(top.select(F.col("conv_id").alias("parent_conv_id"))))  # one row
    deep = first.filter("depth > 1").join(known.select(F.col("key").alias("_k"), F.col("conv_id").alias("parent_conv_id")), F.col("parent") == F.col("_k")).drop("_k")
    inner = known.join(chains.select(F.col("conv_id").alias("_c"), "_start"), (F.col("conv_id") == F.col("_c")) & (F.col("depth") > F.col("_start"))).drop("_c", "_start").withColumn("parent_conv_id", F.col("conv_id"))
    named = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    body = high.select(*named).unionByName(deep.select(*named)).unionByName(inner.select(*named)).join(sums, "key")
    crown = top.crossJoin(F.broadcast(whole)).withColumn("depth", F.lit(0).cast("long")).withColumn("parent_conv_id", F.lit(None).cast("long"))  # one row each
    columns = ["key", *named[1:], "n_leaves", "saved_tokens"]
    none = F.sha2(F.lit("").cast("binary"), 256)
    done = body.select(*columns).unionByName(crown.select(*columns)).join(ends, "key", "left")
    longs = [F.col(c).cast("long").alias(c) for c in columns[1:]]
    return done.select(*longs, F.coalesce("ends_sha256", none).alias("ends_sha256"))
