"""A linear-chain conditional random field over words, in numpy: training and forward-backward.

A word's features are hashed: the word, its affixes, its character n-grams and the lexicon
entries that it hits. A sequence of words has a score from each word's features and from learned
transitions; forward-backward gives each word's marginal probabilities over the whole text. Long
texts run as pieces of ``SPAN`` words side by side: each piece's product of transfer matrices
carries what stands before and after it exactly, so no transition is cut.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np

from skein.llm.common import held

#: Weights by feature are held in this many slots.
SLOTS = 1 << 17
#: Words of a piece of a text that runs beside others; the results don't depend on it.
SPAN = 64
#: Words whose scores a worker keeps from task to task; it starts anew beyond that.
CACHE_WORDS = 500_000
#: Words of the texts of a training step, about.
STEP = 8192


crc = zlib.crc32


def features(word: str, lexicon: frozenset[str] = frozenset()) -> list[int]:
    """Hashes of a word's features: itself, prefixes and suffixes up to 5, bigrams and trigrams, lexicon hits."""
    w = word.encode("utf-8", "surrogatepass")
    n = len(w)
    marked = b"^" + w + b"$"
    out = [crc(w), crc(b"%d" % min(n, 12), 1)]  # the checksum's start value keeps the kinds apart
    out += [crc(w[:k], 2) for k in range(1, min(n, 5) + 1)]
    out += [crc(w[-k:], 3) for k in range(1, min(n, 5) + 1)]
    out += [crc(marked[i : i + 2], 4) for i in range(n + 1)]
    out += [crc(marked[i : i + 3], 5) for i in range(n)]
    if lexicon:
        out += [crc(x.encode("utf-8", "surrogatepass"), 6) for x in lexicon_hits(word, lexicon)]
    return out


def lexicon_hits(word: str, lexicon: frozenset[str]) -> list[str]:
    """Entries are whole words, ``=word``, or beginnings of words, ``beginning*``."""
    return [x for x in (f"={word}", *(f"{word[:k]}*" for k in range(3, min(len(word), 8) + 1))) if x in lexicon]


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # slots x labels
    moves: np.ndarray  # from label x to label
    starts: np.ndarray
    lexicon: frozenset[str] = frozenset()
    extra: dict = field(default_factory=dict)

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of each word, shifted so that the best is 0."""
        slots = [features(w, self.lexicon) for w in words]
        lens = np.fromiter(map(len, slots), np.int64, len(slots))
        flat = np.fromiter((x for s in slots for x in s), np.int64, int(lens.sum())) % SLOTS
        out = np.add.reduceat(self.weights[flat], np.r_[0, np.cumsum(lens)[:-1]], axis=0) if len(words) else np.zeros((0, len(self.labels)))
        out /= np.sqrt(lens)[:, None]
        return out - out.max(1, keepdims=True)


def spans(counts: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Lengths of the sequences that texts of so many words are cut into, in order."""
    pieces = -(-counts // span)
    out = np.full(int(pieces.sum()), span, np.int64)
    ends = np.cumsum(pieces)[counts > 0] - 1
    out[ends] = (counts[counts > 0] - 1) % span + 1
    return out


def normed(x: np.ndarray) -> np.ndarray:
    return x / x.sum(tuple(range(1, x.ndim)), keepdims=True)


def forward_backward(emit: np.ndarray, lens: np.ndarray, moves: np.ndarray, starts: np.ndarray, pairs: bool = False, span: int = SPAN):
    """Marginals of each word (rows of ``emit``: exp of scores) in sequences of the given lengths, and expected transitions."""
    step, begin = np.exp(moves), np.exp(starts)
    pieces = -(-lens // span)
    size = spans(lens, span)
    first = np.cumsum(size) - size
    nth = np.arange(len(size)) - np.repeat(np.cumsum(pieces) - pieces, pieces)  # of its sequence
    more = np.repeat(pieces, pieces) - nth  # pieces from it to the sequence's end
    order = np.argsort(-size, kind="stable")
    n_at = np.searchsorted(-size[order], -np.arange(1, (size.max() if len(size) else 0) + 1), "right")
    left, right = np.tile(begin.astype(emit.dtype), (len(size), 1)), np.ones((len(size), emit.shape[1]), emit.dtype)
    if len(pieces) and pieces.max() > 1:
        through = np.zeros((len(size), *step.shape), emit.dtype)  # from what comes before a piece's first word to its last word
        for t, n in enumerate(n_at):
            at, on = order[:n], emit[first[order[:n]] + t][:, None, :]
            through[at] = normed(np.eye(step.shape[0], dtype=emit.dtype) * on if t == 0 else (through[at] @ step) * on)
        for k in range(1, int(pieces.max())):
            at = np.flatnonzero(nth == k) if k == 1 else at[more[at] > 1] + 1
            left[at] = normed((left[at - 1][:, None, :] @ through[at - 1] @ step)[:, 0])
        for k in range(2, int(pieces.max()) + 1):
            at = np.flatnonzero(more == k) if k == 2 else at[nth[at] > 0] - 1
            right[at] = normed((step @ (through[at + 1] @ right[at + 1][:, :, None]))[:, :, 0])
    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    for t, n in enumerate(n_at):
        at = first[order[:n]] + t
        alpha[at] = normed(emit[at] * (left[order[:n]] if t == 0 else alpha[at - 1] @ step))
    expected = np.zeros(step.shape)

    def add(x: np.ndarray, nxt: np.ndarray) -> None:
        joint = alpha[x][:, :, None] * step[None] * nxt[:, None, :]
        expected[:] += normed(joint).sum(0)

    for t in range(len(n_at) - 1, -1, -1):
        n, longer = n_at[t], n_at[t + 1] if t + 1 < len(n_at) else 0
        at = first[order[:n]] + t
        b = right[order[:n]].copy()
        if longer:
            nxt = emit[at[:longer] + 1] * beta[at[:longer] + 1]
            b[:longer] = nxt @ step.T
            if pairs:
                add(at[:longer], nxt)
        beta[at] = normed(b)
    if pairs and (nth > 0).any():
        head = first[nth > 0]
        add(head - 1, emit[head] * beta[head])
    out = normed(alpha * beta)
    return (out, expected) if pairs else out


def columns_of(where: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place."""
    return np.stack([np.bincount(where, rows[:, k], n) for k in range(rows.shape[1])], 1)


def train(texts: list[list[str]], tags: list[np.ndarray], labels: list[str], lexicon: frozenset[str] = frozenset(), epochs: int = 6, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> Crf:
    """Maximum likelihood by AdaGrad over batches of whole texts; the same input gives the same weights."""
    n_labels, rng = len(labels), np.random.default_rng(seed)
    crf = Crf(labels, np.zeros((SLOTS, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels), lexicon)
    vocab: dict[str, int] = {}
    whole = [(np.array([vocab.setdefault(w, len(vocab)) for w in t], np.int32), y) for t, y in zip(texts, tags, strict=True) if t]
    n_of, every = np.zeros(len(vocab), np.int64), array("I")
    for i, w in enumerate(vocab):
        f = features(w, lexicon)
        n_of[i] = len(f)
        every.extend(f)
    every = np.frombuffer(every, np.uint32) % np.uint32(SLOTS)
    first_of = np.cumsum(n_of) - n_of
    g_w, g_m, g_s = np.full_like(crf.weights, 1e-6), np.full_like(crf.moves, 1e-6), np.full_like(crf.starts, 1e-6)
    for _ in range(epochs if whole else 0):
        order = rng.permutation(len(whole))
        step = np.cumsum([len(whole[i][0]) for i in order]) // STEP
        for part in np.split(order, np.flatnonzero(np.diff(step)) + 1):
            part = [whole[i] for i in part]
            lens = np.array([len(x) for x, _ in part])
            x, y = np.concatenate([x for x, _ in part]), np.concatenate([y for _, y in part])
            words, at = np.unique(x, return_inverse=True)
            n = n_of[words]
            flat = every[np.repeat(first_of[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
            score = np.add.reduceat(crf.weights[flat], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
            score = score[at]
            diff, moved = forward_backward(np.exp(score - score.max(1, keepdims=True)), lens, crf.moves, crf.starts, True)
            diff[np.arange(len(y)), y] -= 1
            inner = np.ones(len(y), bool)
            heads = np.cumsum(lens) - lens
            inner[heads] = False
            seen = np.zeros_like(crf.moves)
            np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
            by_word = columns_of(at, diff, len(words)) / np.sqrt(n)[:, None]
            touched, where = np.unique(flat, return_inverse=True)
            units = len(y) / SPAN  # the gradient is one of a span of words
            grad = columns_of(where, np.repeat(by_word, n, axis=0), len(touched)) / units + decay * crf.weights[touched]
            g_w[touched] += grad**2
            crf.weights[touched] -= rate * grad / np.sqrt(g_w[touched])
            for w, g, acc in ((crf.moves, (moved - seen) / units, g_m), (crf.starts, diff[heads].mean(0), g_s)):
                acc += g**2
                w -= rate * g / np.sqrt(acc)
    crf.weights = crf.weights.astype(np.float32)
    return crf


def tagger_of(crf: Crf) -> Tagger:
    """The worker's tagger for a model, which is kept for its next tasks."""
    key = crf.extra.setdefault("key", uuid.uuid4().hex)
    return held(("tagger", key), lambda: Tagger(crf))


class Tagger:
    """Marginals for many texts at once, with a bounded cache of the scores of words."""

    def __init__(self, crf: Crf) -> None:
        self.crf = crf
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(crf.labels)), np.float32)

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        look = self.known
        need = list({w for t in texts for w in t if w not in look})
        if len(look) + len(need) > CACHE_WORDS:
            look.clear()
            need = list({w for t in texts for w in t})
        if need:
            old, new = len(look), len(look) + len(need)
            look.update(zip(need, range(old, new), strict=True))
            if new > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(new, len(self.table)), self.table.shape[1]), np.float32)])
            self.table[old:new] = np.maximum(np.exp(self.crf.scores(need)), 1e-20)
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter(map(look.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if not len(ids):
            return [np.zeros((0, len(self.crf.labels)), np.float32) for _ in texts]
        out = forward_backward(self.table[ids], counts, self.crf.moves.astype(np.float32), self.crf.starts.astype(np.float32))
        return np.split(out, np.cumsum(counts)[:-1])
