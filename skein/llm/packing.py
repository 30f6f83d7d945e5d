"""Best-fit packing of documents into fixed-length token sequences by bin completion.

Lengths are integers from 1 to the capacity, so the whole corpus reduces to a histogram of at
most ``capacity`` rows. The packing is computed on that histogram, as *patterns* (which lengths
share a sequence) with multiplicities, and handed back to the pieces by their rank among the
pieces of equal length. Neither the driver nor a task ever holds the pieces of a length.

Nulls and edge cases: a null or empty text has the end-of-document id only; a null ``doc_id`` is
carried through; repeated rows are packed as often as they occur; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from operator import neg

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import held, stage

CAPACITY = 4096
#: Nodes of the branch-and-bound searches after which the best incumbent stands: a budget of the driver's time, not of what is packed.
MAX_NODES = 8_000
#: Nodes from one packing of the rest by best fit to the next.
EVERY = 32
#: Nodes that hold their fillings; those further up make them again when the search comes back.
OPEN = 64
#: Texts that are tokenized at once.
TEXTS = 1024
#: Words in either half of a worker's token cache.
CACHE_WORDS = 700_000
#: Words longer than this aren't cached.
CACHE_CHARS = 64

Pattern = tuple[tuple[int, int], ...]  # (length, how often), lengths descending


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Waste bound L2: items that can't share a sequence, plus what the others overflow; the best over all lengths that may count as small."""
    count = np.zeros(capacity + 1, np.int64)
    count[list(hist)] = list(hist.values())
    many, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(half + 1)  # shorter ones are left out; items over capacity - a stand alone, those over a half don't meet
    alone = many[capacity] - many[capacity - a]
    mid, mid_total = many[capacity - a] - many[half], total[capacity - a] - total[half]
    small = total[half] - np.where(a > 0, total[a - 1], 0)
    over = -(-(small - (mid * capacity - mid_total)) // capacity)
    return max(int((alone + mid + np.maximum(over, 0)).max()), -(-int(total[capacity]) // capacity))


def best_fit(hist: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Best-fit decreasing, whole classes of equal sequences at a time."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, how many]
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, many: int) -> None:
        if many:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append([pattern, many])

    for n in sorted(hist, reverse=True):
        left = hist[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                full, rest = divmod(left, each)
                put(capacity - each * n, ((n, each),), full)
                if rest:
                    put(capacity - rest * n, ((n, rest),), 1)
                break
            room = rooms[at]
            pattern, many = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            each = room // n
            used = min(many, left // each)
            put(room - each * n, (*pattern, (n, each)), used)
            left -= used * each
            many -= used
            if many and left:  # fewer than `each` are left: they end in one more sequence
                put(room - left * n, (*pattern, (n, left)), 1)
                many, left = many - 1, 0
            put(room, pattern, many)
    out: dict[Pattern, int] = defaultdict(int)
    for classes in open_.values():
        for pattern, many in classes:
            out[pattern] += many
    return dict(out)


def with_copies(sums: int, n: int, copies: int, full: int) -> int:
    """The bitset of sums, with up to ``copies`` items of length ``n`` added to each."""
    step = 1
    while copies > 0:
        step = min(step, copies)
        sums |= (sums << (n * step)) & full
        copies -= step
        step *= 2
    return sums


def fillings(hist: dict[int, int], largest: int, capacity: int, max_waste: int) -> Iterator[tuple[int, Pattern | None]]:
    """Every undominated filling around one ``largest`` item, by waste, larger items first; None in the place of a dominated one.

    They are made one at a time: bitsets of the sums that the shorter lengths can still make lead
    straight to a filling, so a caller that stops early pays for no others.
    """
    room = capacity - largest
    free = {n: c - (n == largest) for n, c in hist.items() if n <= room}
    lengths = sorted((n for n, c in free.items() if c > 0), reverse=True)
    full, made = (1 << (room + 1)) - 1, [1]
    for n in reversed(lengths):
        made.append(with_copies(made[-1], n, min(free[n], room // n), full))
    made.reverse()  # made[i]: sums of lengths[i:]
    for waste in range(min(room, max_waste) + 1):
        if not made[0] >> (room - waste) & 1:
            continue
        stack: list[tuple[int, int, Pattern]] = [(0, room - waste, ())]
        while stack:
            i, left, chosen = stack.pop()
            while left:
                i = bisect_left(lengths, -left, lo=i, key=neg)
                n = lengths[i]
                counts = [c for c in range(min(free[n], left // n), -1, -1) if made[i + 1] >> (left - c * n) & 1]
                stack += [(i + 1, left - c * n, (*chosen, (n, c)) if c else chosen) for c in counts[:0:-1]]
                if counts[0]:
                    chosen = (*chosen, (n, counts[0]))
                i, left = i + 1, left - counts[0] * n
            yield waste, None if dominated(chosen, waste, room, free) else chosen


def dominated(chosen: Pattern, waste: int, room: int, free: dict[int, int]) -> bool:
    """Whether an item left out fits in the place of some of the chosen ones, or beside them: the filling with it leaves the easier items for later."""
    used = dict(chosen)
    left_out = sum(1 << n for n, c in free.items() if c > used.get(n, 0))
    sums, low = 1, 0  # of chosen items of at most `low`
    for n, c in [*chosen[::-1], (room, 0)]:
        fits, reach = sums, 0  # lengths from a sum to the sum and the waste
        while reach < waste:
            step = min(reach + 1, waste - reach)
            fits |= fits << step
            reach += step
        if left_out & fits & ((1 << (n + 1)) - (1 << (low + 1))):
            return True
        sums, low = with_copies(sums, n, c, (1 << (room + 1)) - 1), n
    return False


def search(hist: dict[int, int], capacity: int, target: int, best: dict[Pattern, int], max_nodes: int) -> tuple[dict[Pattern, int], int]:
    """A packing at least as good as ``best``, of ``target`` sequences if one is found, and the nodes used.

    Branch and bound: the sequence of the largest item is completed by each undominated filling in
    turn, as often as the counts allow at first; what would waste more than the target leaves, or
    whose rest has too high a bound, is cut off. On the way down, best fit packs what is left:
    the best of these packings is the incumbent.
    """
    spare = target * capacity - sum(n * c for n, c in hist.items())
    counts, chosen, placed, nodes, count = dict(hist), [], 0, 0, sum(best.values())

    def options(spare: int) -> Iterator[tuple[int, Pattern, int] | None]:
        largest, now = max(counts), dict(counts)
        for waste, filling in fillings(now, largest, capacity, spare):
            if filling is None:
                yield None
                continue
            pattern: dict[int, int] = defaultdict(int)
            pattern[largest] += 1
            for n, c in filling:
                pattern[n] += c
            most = min(now[n] // c for n, c in pattern.items())
            most = min(most, spare // waste) if waste else most
            for times in range(most, 0, -1):
                yield waste, tuple(sorted(pattern.items(), reverse=True)), times

    # Of each open node: the waste it may still have, the options taken, and their iterator, which only the last OPEN nodes hold.
    stack: list[list] = [[spare, 0, options(spare)]] if counts and spare >= 0 else []
    while stack and nodes < max_nodes and count > target:
        nodes += 1
        top = stack[-1]
        if top[2] is None:
            top[2] = islice(options(top[0]), top[1], None)
        step = next(top[2], ())
        top[1] += 1
        if step is None:
            continue
        if not step:
            stack.pop()
            if chosen:
                waste, pattern, times = chosen.pop()
                spare, placed = spare + waste * times, placed - times
                for n, c in pattern:
                    counts[n] = counts.get(n, 0) + c * times
            continue
        waste, pattern, times = step
        chosen.append(step)
        spare, placed = spare - waste * times, placed + times
        for n, c in pattern:
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
        if nodes % EVERY == 0 or len(counts) < EVERY:
            rest = best_fit(counts, capacity)
            if placed + sum(rest.values()) < count:
                out: dict[Pattern, int] = defaultdict(int, rest)
                for _, done, many in chosen:
                    out[done] += many
                best, count = dict(out), sum(out.values())
        stack.append([spare, 0, options(spare) if counts and placed + lower_bound(counts, capacity) <= target else iter(())])
        if len(stack) > OPEN:
            stack[-OPEN - 1][2] = None
    return best, nodes


def bin_completion(hist: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> dict[Pattern, int]:
    """Patterns and multiplicities that hold every item of ``hist`` in few sequences.

    The first incumbent is best-fit decreasing. Where it misses the bound, bin completion looks
    for a packing at the bound, then halfway to the incumbent, and so on; each search gets half of
    the nodes that are left.
    """
    best = best_fit(hist, capacity)
    low, left = lower_bound(hist, capacity), max_nodes
    target = low
    while low < sum(best.values()) and left > 0:
        best, nodes = search(hist, capacity, target, best, -(-left // 2))
        left -= nodes
        low = max(low, target + 1)
        target = (low + sum(best.values()) - 1) // 2
    return best


def placement(patterns: dict[Pattern, int]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, places in each sequence and first offset of each pattern."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in sorted(patterns.items(), reverse=True):
        offset = 0
        for n, c in sorted(pattern, reverse=True):
            rows[n].append((rank[n], sequence, c, offset))
            rank[n] += c * times
            offset += n * c
        sequence += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()}


class Ids:
    """Token ids, as bytes, of blank-separated words; kept for the worker's next tasks, in bounded number.

    The tokenizer drops white space, no token crosses it, and a run of letters is a pre-token of its
    own. So a text's ids are those of its words, and a word of letters in Latin-1 has those of its
    lower case, followed by those of a comma or full stop at its end.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.known, self.old, self.most = Tokenizer.from_file(path), {}, {}, cache_words
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.stops = {x: array("I", self.tok.encode(x, add_special_tokens=False).ids).tobytes() for x in (",", ".")}
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # For lower-case letters nothing is left to normalise, and blanks part the words.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    @classmethod
    def of(cls, path: str, cache_words: int = CACHE_WORDS) -> Ids:
        return held(("ids", path, cache_words), lambda: cls(path, cache_words))

    def add(self, words: list[str]) -> None:
        """Words of letters, with or without a final comma or full stop, are put together from their
        parts; those parts are tokenized in one go and parted where a token ends a word."""
        known, old = self.known, self.old
        parts: list[tuple[str, str, bytes]] = []
        rest: list[str] = []
        for w in words:
            core, stop = (w, b"") if w.isalpha() else (w[:-1], self.stops.get(w[-1:], b""))
            if (stop or core is w) and core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                parts.append((w, core.lower(), stop))
            else:
                rest.append(w)
        plain = []
        for core in {core for _, core, _ in parts}:
            if core not in known:
                x = old.get(core)
                if x is None:
                    plain.append(core)
                else:
                    known[core] = x
        if rest:
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        if plain:
            ids = np.array(self.plain.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(plain):
                raise ValueError("the tokenizer doesn't take runs of letters as words")
            data, ends = ids.tobytes(), (4 * ends).tolist()
            known.update(zip(plain, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        for w, core, stop in parts:
            known[w] = known[core] + stop if stop else known[core]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and where each text's begin and end. Python sees each distinct word once."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.known.get, words))
        gaps = [i for i, x in enumerate(found) if x is None]
        need = [words[i] for i in gaps]
        if need:
            again = {w: x for w in need if (x := self.old.get(w)) is not None}
            self.known.update(again)
            self.add([w for w in need if w not in again] if again else need)
            for i, w in zip(gaps, need, strict=True):
                found[i] = self.known[w]
                if len(w) > CACHE_CHARS:
                    del self.known[w]
        if len(self.known) > self.most:  # words that are met again come back from the older half
            self.old, self.known = self.known, {}
        many = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(many) - many
        each = many[at]
        before = np.r_[0, np.cumsum(each)]
        place = np.repeat(first[at] - before[:-1], each)
        place += np.arange(len(place))
        return np.frombuffer(b"".join(found), "<u4")[place], before[split.offsets.to_numpy() - split.offsets[0].as_py()]


def tokenizer_pieces(path: str, capacity: int = CAPACITY, end_id: int = 1, cache_words: int = CACHE_WORDS, at_once: int = TEXTS):
    """A mapInArrow function: (doc_id, text) to pieces of at most ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, part = Ids.of(path, cache_words), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                b = batch.slice(at, at_once)
                rows = []
                flat, ends = ids.texts(b.column(1))
                for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    data = flat[lo:hi].tobytes() + end
                    for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                        x = data[start : start + 4 * capacity]
                        n = len(x) // 4
                        rows.append((i, piece, start // 4, n, zlib.crc32(x), part, seen[n]))
                        seen[n] += 1
                i, piece, start, n, crc, p, k = (pa.array(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(i), piece.cast("int32"), start, n, crc, p.cast("int32"), k], ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_k"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, max_nodes: int = MAX_NODES, cache_words: int = CACHE_WORDS, at_once: int = TEXTS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = stage(rows.mapInArrow(tokenizer_pieces(tokenizer_path, capacity, cache_words=cache_words, at_once=at_once), "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _k long"), "pieces")
    by_task = pieces.groupBy("_part", "length").agg(F.count("*").alias("_c"))
    hist = {r["length"]: r["c"] for r in by_task.groupBy("length").agg(F.sum("_c").alias("c")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(placement(bin_completion(hist, capacity, max_nodes)) if hist else {})
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("_part", "length", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    ranked = pieces.join(first, ["_part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_k")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else ():
                first, base, each, start = plan.value[int(n[rows[0]])]
                at = np.searchsorted(first, rank[rows], "right") - 1
                copy, slot = np.divmod(rank[rows] - first[at], each[at])
                sequence[rows], offset[rows] = base[at] + copy, start[at] + slot * n[rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
