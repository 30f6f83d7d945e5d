"""Near-duplicate vectors by cosine, with collision-counting projections.

Unit vectors are projected on many random directions, one dimension each, and every projection is
sorted. Two vectors collide on a projection if each lies in the window that is centred at the
other. In the middle of a projection a window holds a fixed share of all vectors, alike or not, so
windows are looked at in the outer parts only: beyond ``level`` standard deviations, where alike
vectors go together and others seldom meet. Collisions are counted for each pair, and pairs with at
least ``COUNT`` are verified. ``design`` places the level by the number of vectors, so that a vector
meets about ``FAR`` unrelated ones, and takes as many projections as a pair at the threshold needs
to reach the count with the wanted probability, by the distribution of its collisions.

Directions come in families: the normed sums of one of ``SIZE`` random directions from each of
``parts`` sets. Their outer parts are found from the sets' projections, without any of the others.

Groups of very similar vectors are not expanded into pairs. Vectors within half the threshold's
angle of a common leader are linked to each other by the triangle inequality: they form a ball.
A projection holds each ball once, as the range that its members span, candidates are pairs of
balls, and links of their members are counted by the same inequality where it decides. Where it
doesn't, blocks of members are multiplied, and only counts come out.

Nulls and edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, and neither do vectors of different lengths; rows with a null id have no links, a null component
and are kept; rows that share an id are one vector (the first by value) and get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, cos, erfc, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import drop, stage
from skein.llm.components import components
from skein.llm.shingles import FACTOR, mixed

COSINE = 0.9
RECALL = 0.9995
#: Collisions that a pair needs to be verified.
COUNT = 2
#: Half width of a window, in standard deviations of a pair at the threshold.
WINDOW = 1.6
#: Unrelated vectors that a vector collides with, about.
FAR = 100
#: Directions in each set of a family, and projections of a family at most before sets of three are summed.
SIZE, FAMILIES = 64, 512
#: Pairs whose collisions are drawn to find their distribution.
DRAWN = 40_000
#: Vectors in a projection's outer part from which on they look for a leader, and leaders that a vector asks at most; links don't depend on it.
DENSE, LEADERS = 32, 3
#: Vectors of a block when members of balls are multiplied.
BLOCK = 256
PAIRS_AT_ONCE = 1 << 18


def beyond(x: float) -> float:
    """Chance of a standard normal value over x."""
    return erfc(x / sqrt(2)) / 2


@dataclass(frozen=True)
class Design:
    level: float
    window: float
    parts: int
    families: int


def near_chance(level: float, window: float, cosine: float) -> float:
    """Chance that a pair at this cosine collides on a projection, at either end of it."""
    x = np.linspace(level, level + 8, 4001)
    s = sqrt(1 - cosine**2)
    cdf = np.vectorize(lambda z: 1 - beyond(z))
    low, high = np.maximum(level, x - window), x + window
    inside = cdf((high - cosine * x) / s) - cdf((low - cosine * x) / s)
    return float(2 * np.trapezoid(np.exp(-(x**2) / 2) / sqrt(2 * pi) * inside, x))


def outer(sets: list[np.ndarray], level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, direction and projection of the outer parts of all directions of a family; ``sets`` has a row for each vector.

    Sums are built up set by set; those that the best of the other sets can't lift over the level go.
    """
    goal = level * sqrt(len(sets))
    row, code, total = [], [], []
    for sign in (1, -1):
        y = [sign * x for x in sets]
        rest = [sum((x.max(1) for x in y[k + 1 :]), np.zeros(len(y[0]))) for k in range(len(y))]
        r, at = np.nonzero(y[0] + rest[0][:, None] >= goal)
        c, t = at.astype(np.int64), y[0][r, at]
        for k in range(1, len(y)):
            more = t[:, None] + y[k][r]
            i, at = np.nonzero(more + rest[k][r][:, None] >= goal)
            r, c, t = r[i], c[i] * SIZE + at, more[i, at]
        row.append(r)
        code.append(2 * c + (sign < 0))
        total.append(sign * t)
    return np.concatenate(row), np.concatenate(code), np.concatenate(total) / sqrt(len(sets))


def collisions(level: float, window: float, parts: int, cosine: float, drawn: int = DRAWN) -> np.ndarray:
    """How often drawn pairs at this cosine collide 0, 1, 2, ... times in a family."""
    rng, found = np.random.default_rng(5), np.zeros(drawn, np.int64)
    for lo in range(0, drawn, 2000):
        n = min(2000, drawn - lo)
        x = [rng.standard_normal((n, SIZE)) for _ in range(parts)]
        y = [cosine * z + sqrt(1 - cosine**2) * rng.standard_normal((n, SIZE)) for z in x]
        (r, c, p), (s, d, q) = outer(x, level), outer(y, level)
        left, right = r * (2 * SIZE**parts) + c, s * (2 * SIZE**parts) + d
        _, i, j = np.intersect1d(left, right, return_indices=True)
        np.add.at(found, lo + r[i[np.abs(p[i] - q[j]) <= window]], 1)
    return np.bincount(found, minlength=COUNT + 1) / drawn


def enough(chance: np.ndarray, recall: float) -> int:
    """Families after which a pair has reached the count with the wanted probability."""
    one, now, n = chance[:COUNT], np.r_[1.0, np.zeros(COUNT - 1)], 0
    while now.sum() > 1 - recall:
        now = np.convolve(now, one)[:COUNT]
        n += 1
    return n


def design(n: int, cosine: float = COSINE, recall: float = RECALL) -> Design:
    window, need = WINDOW * sqrt(2 - 2 * cosine), 10.0
    level, many = 2.0, 1.0
    while level < 8:
        many = need / near_chance(level, window, cosine)
        if 2 * many * beyond(level) ** 2 * n <= FAR:
            break
        level += 0.25
    parts = 2
    while many > FAMILIES * SIZE**parts:
        parts += 1
    return Design(level, window, parts, enough(collisions(level, window, parts, cosine), recall))


def unit(batch: pa.Array) -> np.ndarray:
    """Rows of equal length, divided by their length."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(batch), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that can link."""
    v = F.col("embedding").cast("array<double>")
    big = F.array_max(F.transform(v, F.abs))
    # Scaled by the largest component, so that no square overflows or vanishes.
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (big > 0)
    scaled = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).select("vec_id", F.transform(v, lambda x: x / big).alias("v"))
    return scaled.groupBy("vec_id").agg(F.min("v").alias("v"))


def tails_of(rows: DataFrame, plan: Design, seed: int = 7) -> DataFrame:
    """vec_id, _key (length, family and direction) and _x (projection) of each vector's places in the outer parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            lens = batch.column(1).value_lengths().to_numpy()
            for d in np.unique(lens).tolist():
                if d not in made:
                    made.clear()
                    rng = np.random.default_rng([seed, d])
                    made[d] = rng.standard_normal((plan.families * plan.parts * SIZE, d)).astype(np.float32)
                own = batch.filter(pa.array(lens == d))
                for at in range(0, own.num_rows, 1024):
                    b = own.slice(at, 1024)
                    y = (unit(b.column(1)).astype(np.float32) @ made[d].T).astype(np.float64).reshape(b.num_rows, plan.families, plan.parts, SIZE)
                    ids = b.column(0)
                    for f in range(plan.families):
                        row, code, x = outer([y[:, f, k] for k in range(plan.parts)], plan.level)
                        key = mixed(code.astype(np.uint64) + np.uint64(f) * FACTOR + np.uint64(d) * np.uint64(0xD1B54A32D192ED03))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(x)], ["vec_id", "_key", "_x"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, _key long, _x double")


def meet(ranges: DataFrame, window: float) -> DataFrame:
    """a < b of balls whose ranges come within a window of each other in a cell; once for each cell at most.

    The rows arrive by cell and start of the range. Only those of the current cell that can still
    meet another are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]
        for b in batches:
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            old = len(held[0])
            key, lo, hi, ball = (np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
            reach = hi.copy()
            at, lag = np.arange(len(key)), 1
            while len(at):
                at = at[at + lag < len(key)]
                at = at[(key[at + lag] == key[at]) & (lo[at + lag] <= reach[at] + window)]
                i, j = at[at + lag >= old], at[at + lag >= old] + lag  # pairs of two held rows are out already
                for k in range(0, len(i), PAIRS_AT_ONCE):
                    x, y = ball[i[k : k + PAIRS_AT_ONCE]], ball[j[k : k + PAIRS_AT_ONCE]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
                lag += 1
            if len(key):
                stay = (key == key[-1]) & (reach + window >= lo[-1])
                held = [x[stay] for x in (key, lo, hi, ball)]

    rows = ranges.repartition("_key").sortWithinPartitions("_key", "lo").select("_key", "lo", "hi", "ball")
    return rows.mapInArrow(run, "a long, b long").filter("a <> b")


def judge(pairs: DataFrame, cosine: float, columns: list[str]) -> DataFrame:
    """_is: 1 all members are linked, -1 none, 0 to be told one by one; u, w: vectors, ru, rw: angles that members lie within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = acos(cosine)
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda n: b.column(b.schema.get_field_index(n))
            out = np.zeros(b.num_rows, np.int32)
            same = (col("u").value_lengths().to_numpy() == col("w").value_lengths().to_numpy())
            lens = col("u").value_lengths().to_numpy()
            ru, rw = col("ru").to_numpy(), col("rw").to_numpy()
            out[~same] = -1
            for d in np.unique(lens[same]):
                at = np.flatnonzero(same & (lens == d))
                x, y = col("u").take(pa.array(at)), col("w").take(pa.array(at))
                x, y = (z.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) for z in (x, y))
                c = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                r = ru[at] + rw[at]
                angle = np.arccos(np.clip(c, -1, 1))
                out[at] = np.where(r == 0, np.where(c >= cosine, 1, -1), np.where(angle + r <= limit - 1e-7, 1, np.where(angle - r > limit + 1e-7, -1, 0)))
            yield pa.RecordBatch.from_arrays([*(col(n) for n in columns), pa.array(out)], [*columns, "_is"])

    types = ", ".join(f"{c} long" for c in columns)
    return pairs.mapInArrow(run, f"{types}, _is int").filter("_is >= 0")


def balls_of(rows: DataFrame, tails: DataFrame, cosine: float) -> DataFrame:
    """vec_id, v, ball (id of the leader, which may be the vector itself) and r (angle to the leader).

    Vectors in crowded outer parts ask the least id there whether it is near enough to lead them.
    """
    near = cos(acos(cosine) / 2 - 1e-6)
    least = tails.groupBy("_key").agg(F.min("vec_id").alias("lead"), F.count("*").alias("n")).filter(F.col("n") >= DENSE).select("_key", "lead")
    asked = tails.select("vec_id", "_key").join(least, "_key").filter("lead < vec_id").groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_set("lead")), 1, LEADERS).alias("x")).select("vec_id", F.explode("x").alias("lead"))
    mine, theirs = rows.select("vec_id", F.col("v").alias("u")), rows.select(F.col("vec_id").alias("lead"), F.col("v").alias("w"))
    zero = [F.lit(0.0).alias("ru"), F.lit(0.0).alias("rw")]
    asked = stage(asked, "asked")
    good = stage(judge(asked.join(mine, "vec_id").join(theirs, "lead").select("vec_id", "lead", "u", "w", *zero), near, ["vec_id", "lead"]).filter("_is = 1"), "leads")
    roots = good.select("lead").distinct().join(good.select(F.col("vec_id").alias("lead")).distinct(), "lead", "left_anti")
    mine_ = stage(good.join(roots, "lead").groupBy("vec_id").agg(F.min("lead").alias("ball")), "led")
    joined = rows.join(mine_, "vec_id", "left").select("vec_id", "v", F.coalesce("ball", "vec_id").alias("ball"))
    lead = rows.select(F.col("vec_id").alias("ball"), F.col("v").alias("w"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    far = F.acos(F.least(F.lit(1.0), dot(F.col("v"), F.col("w")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("w"), F.col("w")))))
    single = joined.filter("ball = vec_id").withColumn("r", F.lit(0.0))
    out = stage(single.unionByName(joined.filter("ball <> vec_id").join(lead, "ball").select("vec_id", "v", "ball", far.alias("r"))), "balls")
    drop(asked)
    return out


def multiplied(rest: DataFrame, members: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n): links between the members x of ball a in ``rest`` (a, b, x, u) and those of ball b; (a, b): balls with one.

    Both sides go in blocks, a pair of blocks is one group, and no pair of vectors becomes a row.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    size = members.groupBy("ball").agg(F.count("*").alias("n"))
    jobs = rest.groupBy("a", "b").agg(blocks(F.count("*")).alias("_i")).join(size, F.col("b") == F.col("ball")).select("a", "b", "_i", blocks(F.col("n")).alias("_j"))
    jobs = stage(jobs, "jobs")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rest.join(jobs, ["a", "b"]).select("a", "b", own("x", "_i").alias("i"), every("_j").alias("j"), F.lit(0).alias("k"), F.col("x").alias("id"), F.col("u").alias("v"))
    y = jobs.join(members.select(F.col("ball").alias("b"), "vec_id", "v"), "b").select("a", "b", every("_i").alias("i"), own("vec_id", "_j").alias("j"), F.lit(1).alias("k"), F.col("vec_id").alias("id"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            sides = [[r for r in rows if r[4] == k] for k in (0, 1)]
            for lo in range(0, len(sides[0]), BLOCK):
                for hi in range(0, len(sides[1]), BLOCK):
                    p, q = sides[0][lo : lo + BLOCK], sides[1][hi : hi + BLOCK]
                    m = [np.array([r[6] for r in side]) for side in (p, q)]
                    m = [z / np.linalg.norm(z, axis=1, keepdims=True) for z in m]
                    ok = m[0] @ m[1].T >= cosine
                    if ok.any():
                        ids, n = [r[5] for r in p] + [r[5] for r in q], [*ok.sum(1).tolist(), *ok.sum(0).tolist()]
                        keep = [k for k, z in enumerate(n) if z]
                        out = [[rows[0][0]] * len(keep), [rows[0][1]] * len(keep), [ids[k] for k in keep], [n[k] for k in keep]]
                        yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in out], ["a", "b", "vec_id", "n"])

        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(6)), (z.values.to_numpy() for z in batch.column(6)), strict=True):
                if held and held[0][:4] != r[:4]:
                    yield from told(held)
                    held = []
                held.append(r)
        if held:
            yield from told(held)

    dealt = x.unionByName(y).repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j")
    found = stage(dealt.mapInArrow(run, "a long, b long, vec_id long, n long"), "multiplied")
    return found.select("vec_id", "n"), found.select("a", "b").distinct()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    rows = stage(usable(vectors), "vectors")
    plan = design(rows.count(), cosine, recall)
    tails = stage(tails_of(rows, plan), "tails")
    members = balls_of(rows, tails, cosine)
    about = stage(members.groupBy("ball").agg(F.count("*").alias("size"), F.max("r").alias("r")).join(members.filter("vec_id = ball").select("ball", "v"), "ball"), "about")
    led = stage(members.join(about.filter("size > 1").select("ball"), "ball", "left_semi").select("vec_id", "ball"), "members")
    placed = tails.join(led, "vec_id", "left")
    alone = placed.filter("ball is null").select("_key", F.col("_x").alias("lo"), F.col("_x").alias("hi"), F.col("vec_id").alias("ball"))
    merged = placed.filter("ball is not null").groupBy("_key", "ball").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).select("_key", "lo", "hi", "ball")
    met = meet(alone.unionByName(merged), plan.window)
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= COUNT).select("a", "b")
    pairs = stage(pairs, "pairs")
    end = lambda x: about.select(F.col("ball").alias(x), F.col("v").alias("u" if x == "a" else "w"), F.col("r").alias("ru" if x == "a" else "rw"))
    told = stage(judge(pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "u", "w", "ru", "rw"), cosine, ["a", "b"]), "told")
    size = about.select(F.col("ball").alias("_ball"), "size")
    with_size = lambda df, x, y: df.join(size, F.col(y) == F.col("_ball")).select(F.col(x).alias("ball"), F.col("size").alias("n"))
    whole = told.filter("_is = 1").select("a", "b")
    # Balls that the inequality doesn't decide: each member of a against the ball b, then blocks of what is left against b's members.
    part = told.filter("_is = 0").select("a", "b")
    one = members.select(F.col("ball").alias("a"), F.col("vec_id").alias("x"), F.col("v").alias("u"))
    by_member = stage(judge(part.join(one, "a").join(end("b"), "b").select("a", "b", "x", "u", "w", F.lit(0.0).alias("ru"), "rw"), cosine, ["a", "b", "x"]), "by-member")
    rest = by_member.filter("_is = 0").select("a", "b", "x").join(rows.select(F.col("vec_id").alias("x"), F.col("v").alias("u")), "x")
    single, linked = multiplied(rest, members, cosine)
    for_balls = (
        with_size(whole, "a", "b").unionByName(with_size(whole, "b", "a"))
        .unionByName(by_member.filter("_is = 1").select(F.col("b").alias("ball"), F.lit(1).cast("long").alias("n")))
        .groupBy("ball").agg(F.sum("n").alias("nb"))
    )
    own = by_member.filter("_is = 1").select("x", "b")
    for_one = own.join(size, F.col("b") == F.col("_ball")).select(F.col("x").alias("vec_id"), F.col("size").alias("n")).unionByName(single)
    for_one = for_one.groupBy("vec_id").agg(F.sum("n").alias("nv"))
    edges = whole.unionByName(by_member.filter("_is = 1").select("a", "b")).unionByName(linked).distinct()
    comp = components(edges).select(F.col("v").alias("ball"), "component")
    ball = about.select("ball", "size").join(for_balls, "ball", "left").join(comp, "ball", "left")
    ball = ball.select("ball", (F.col("size") - 1 + F.coalesce("nb", F.lit(0))).alias("n"), F.coalesce("component", "ball").alias("component"))
    done = members.select("vec_id", "ball").join(ball, "ball").join(for_one, "vec_id", "left").select(F.col("vec_id").alias("_id"), (F.col("n") + F.coalesce("nv", F.lit(0))).alias("n_links"), "component")
    out = vectors.select("vec_id").join(done, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
