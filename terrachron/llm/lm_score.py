"""Language-model scoring by online logistic context mixing.

A text is its words, A-Z in lower case, and one end. Every token of every text is coded bit by bit, in order, along a Huffman tree over
the words that training has at least twice and at least one time in `frequent` tokens (no more than that many, of at most `LONGEST`
bytes; the end is the empty word); one leaf stands for all other words, whose spelling follows. Each bit is predicted from counts of zeros
and ones at its node in hashed contexts: the class of the text as far as it was read, and the last 1, 2, ... tokens, in tables of
2**`far` cells whatever the corpus, counted over all training texts. The stretched probabilities are mixed by weights that depend on how
often each context was seen, in sets that a gate picks by the longer contexts. The weights learn online from all training texts, each
bit with its own occurrence taken out of the counts: a first slice of texts, of about `FIRST` tokens, is learned in three passes; from there
each task goes over its texts, and the states are averaged by their tokens. A class is a language of training documents (the `classes` - 1
most frequent, and others). A text's own is not told: at each place it is the one that gives the words before it the highest probability,
P(w | class) = (c_class + `shrink` c / N) / (N_class + `shrink`).

A word outside the tree costs log P = max(c - d, 0) / M + (d U / M) spelling(w), c its count, M and U the tokens and distinct words of such
words in training. The spelling is coded bit by bit, closed by a space, by a mixer of the same kind over the last 1 to 5 bytes of the word
so far, in tables of 2**`bits` cells, with a refining table behind it. It learns from all distinct training words, in slices of about
`sample` words, which are joined as above; such words get theirs by a join. `score` is the log10 of a text's probability; bits per byte follow.

Defined results: null and empty texts are their end alone; very long texts count whole; a null doc_id counts as training, a
null lang as other; repeated rows are scored each and count each; an empty table gives no rows; further columns are ignored.
Where Spark cuts partitions otherwise, the averaged weights and with them the scores differ slightly.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import encoded, hashes, mixed, portions, slices_of
from ._util import bounded, dropped, sliced, table, written

ORDERS = 5
DISCOUNT = 0.8
GATES = 21
_CLOSE = 32


def _of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x at places that are all inside, which take then need not check."""
    return x.take(at, mode="clip")


def held_out(doc_id) -> bool:
    return doc_id is not None and not pd.isna(doc_id) and zlib.crc32(str(int(doc_id)).encode()) % 10 == 0


def _count(langs: list[str]):
    """Words of training documents by class and count, those of the others with 0, summed as they fit in memory; ends as the empty word."""
    index = {x: i for i, x in enumerate(langs)}

    def run(batches):
        held, rows = [], 0

        def summed():
            t = pa.Table.from_batches(held).group_by(["word", "k"], use_threads=False).aggregate([("c", "sum")])
            return t.select(["word", "k", "c_sum"]).rename_columns(["word", "k", "c"]).combine_chunks().to_batches()

        for b in batches:
            for part in portions(b):
                at, distinct, size = encoded(part["text"])
                kinds = [-1 if held_out(doc) else index.get(x, len(langs)) for doc, x in zip(part["doc_id"].to_pylist(), part["lang"].to_pylist())]
                kinds, kind = np.unique(kinds, return_inverse=True)
                times = np.bincount(at * len(kinds) + np.repeat(kind, size), minlength=len(distinct) * len(kinds))
                some = np.flatnonzero(times)
                k = kinds[some % len(kinds)]
                held.append(pa.RecordBatch.from_pydict({"word": distinct.take(pa.array(some // len(kinds))), "k": pa.array(np.maximum(k, 0), pa.int32()), "c": times[some] * (k >= 0)}))
                rows += len(some)
                if rows > 600_000:
                    held = summed()
                    rows = sum(map(len, held))
                    if rows > 300_000:
                        yield from held
                        held, rows = [], 0
        if held:
            yield from summed()

    return run


def grams(words: list[bytes]):
    """(codes, row, place): distinct codes of a byte with the ORDERS before it, over all words and their closing spaces; for
    each such position its word and its code's place. Nine bits each, 0 before the start."""
    size = np.array([len(w) + 1 for w in words])
    x = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(words)), size)
    j = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    code = x.copy()
    for k in range(1, ORDERS + 1):
        code[k:] |= np.where(j[k:] >= k, x[:-k], np.uint64(0)) << np.uint64(9 * k)
    codes, place = np.unique(code, return_inverse=True)
    return codes, row, place


def steps(codes: np.ndarray, bits: tuple[int, ...]):
    """(cells [ORDERS, codes], bit) of each of the eight bits."""
    ctx = codes >> np.uint64(9)
    mult, shift = np.uint64(0x9E3779B97F4A7C15), np.array([[64 - b] for b in bits], np.uint64)
    base = np.stack([ctx & np.uint64((1 << 9 * o) - 1) for o in range(1, ORDERS + 1)])
    base = mixed((base + (np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[:, None]) * mult)
    byte, node = (codes & np.uint64(511)) - np.uint64(1), np.ones(len(codes), np.uint64)
    for k in range(7, -1, -1):
        bit = (byte >> np.uint64(k)) & np.uint64(1)
        z = (base ^ (node * np.uint64(0xD6E8FEB86659FD93))) * mult
        yield ((z ^ (z >> np.uint64(31))) * mult >> shift).astype(np.int64), bit.astype(np.float64)
        node = node * np.uint64(2) + bit


def gathered(batches, rows: int = 80_000):
    """Batches joined to about so many rows: the more words at a time, the more of their codes are the same."""
    now, n = [], 0
    for b in batches:
        now.append(b)
        n += len(b)
        if n >= rows:
            yield pd.concat(now, ignore_index=True)
            now, n = [], 0
    if now:
        yield pd.concat(now, ignore_index=True)


def _tables(bits: tuple[int, ...]):
    """Counts of zeros and ones per cell over distinct words."""

    def run(batches):
        t = None
        for b in gathered(batches):
            t = [np.zeros(2 << k, np.float32) for k in bits] if t is None else t
            codes, _, place = grams(b["word"].tolist())
            times = np.bincount(place, minlength=len(codes)).astype(np.float32)  # of the tables' type, or it is slow
            for cells, bit in steps(codes, bits):
                for o in range(ORDERS):
                    np.add.at(t[o], cells[o] * 2 + bit.astype(np.int64), times)
        if t is not None:
            for o in range(ORDERS):
                for p in range(0, len(t[o]), 1 << 17):
                    yield pd.DataFrame({"part": [o << 20 | p >> 17], "counts": [zlib.compress(t[o][p : p + (1 << 17)].astype("<f4").tobytes(), 1)]})

    return run


def _sum(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for p, c in zip(b["part"], b["counts"]):
            x = np.frombuffer(zlib.decompress(c), "<f4").astype(np.float64)
            total[p] = total[p] + x if p in total else x
    for p, x in total.items():
        yield pd.DataFrame({"part": [p], "counts": [zlib.compress(x.astype("<f4").tobytes(), 1)]})


_SEEN = (1, 2, 4, 10, 100, 1000)
LEVELS = len(_SEEN) + 1
_LEVEL = np.searchsorted(_SEEN, np.arange(_SEEN[-1] + 1), "right")
_LOG = np.log(np.arange(65536) + 0.02)


def packed(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts in two bytes each; larger ones are scaled down together."""
    n = counts.reshape(-1, 2)
    part = np.ceil(n * (65535 / np.maximum(65535, n.max(1, keepdims=True))))
    return np.minimum(65535, part).astype(np.uint16).ravel()  # rounding may go beyond


class Mixer:
    """Gated logistic mixing over tables of counts, refined by a second table.

    Each context weighs by how often it was seen, within a set of weights that the gate picks."""

    def __init__(self, tables: list[np.ndarray], bits, state: np.ndarray | None = None):
        self.t, self.bits = tables, bits
        self.w = np.full((GATES, ORDERS, LEVELS), 0.25)
        self.b = np.zeros(GATES)
        self.apm = np.tile(np.linspace(-8, 8, 33), (GATES, 1))
        self.g2, self.gb = np.full(self.w.size, 1e-12), np.full(GATES, 1e-12)
        if state is not None:
            at = 0
            for x in self._learned():
                x[...] = state[at : at + x.size].reshape(x.shape)
                at += x.size

    def _learned(self):
        return self.w, self.b, self.apm, self.g2, self.gb

    def state(self) -> np.ndarray:
        """All that learning changes, in one row."""
        return np.concatenate([x.ravel() for x in self._learned()])

    def inputs(self, cells, bit=None):
        """Stretched probabilities, the place of their weights, and the gate; with bit: with one occurrence less."""
        n = np.stack([_of(self.t[o].view(np.uint32), c) for o, c in enumerate(cells)])  # both counts at once
        n = n.view(np.uint16).reshape(*n.shape, 2)
        zero, one = n[..., 0].astype(np.int64), n[..., 1].astype(np.int64)
        if bit is not None:
            less = np.maximum(zero, one) < 65535  # those scaled down hardly change
            zero, one = np.maximum(0, zero - (less & (bit == 0))), np.maximum(0, one - (less & (bit > 0)))
        seen = _of(_LEVEL, np.minimum(zero + one, _SEEN[-1]))
        st = _of(_LOG, one) - _of(_LOG, zero)
        gate = seen[-1] * 3 + np.minimum(2, (seen[-3] + 2) // 3)
        return st, (gate * ORDERS + np.arange(ORDERS)[:, None]) * LEVELS + seen, gate

    def mixed(self, st, at, gate):
        return np.clip((_of(self.w.ravel(), at) * st).sum(0) + _of(self.b, gate), -14, 14)

    def refined(self, z, gate):
        """Probability of a one: half the mixer's, half the refining table's, in the stretched domain."""
        a = np.clip((np.clip(z, -7.99, 7.99) + 8) * 2, 0, 31.99)
        i = a.astype(np.int64)
        f = a - i
        return 0.5 * z + 0.5 * (self.apm[gate, i] * (1 - f) + self.apm[gate, i + 1] * f), i, f

    def learn(self, words, passes: int = 3, batch: int = 4096, rate: float = 0.02, seed: int = 3):
        rng = np.random.default_rng(seed)
        words = [words[i] for i in rng.permutation(len(words))]
        for _ in range(passes):
            for a in range(0, len(words), batch):
                codes, _, place = grams(words[a : a + batch])
                wt = np.bincount(place, minlength=len(codes)).astype(float)
                for cells, bit in steps(codes, self.bits):
                    st, at, gate = self.inputs(cells, bit)
                    z = self.mixed(st, at, gate)
                    err = (1 / (1 + np.exp(-z)) - bit) * wt / wt.sum()
                    g = np.bincount(at.ravel(), (err * st).ravel(), self.w.size)
                    self.g2 += g * g
                    self.w -= (rate * g / np.sqrt(self.g2)).reshape(self.w.shape)
                    g = np.bincount(gate, err, GATES)
                    self.gb += g * g
                    self.b -= rate * g / np.sqrt(self.gb)
                    s, i, f = self.refined(z, gate)
                    miss = (bit - 1 / (1 + np.exp(-s))) * wt
                    i = gate * 33 + i
                    num = np.bincount(i, miss * (1 - f), GATES * 33) + np.bincount(i + 1, miss * f, GATES * 33)
                    den = np.bincount(i, wt * (1 - f), GATES * 33) + np.bincount(i + 1, wt * f, GATES * 33)
                    self.apm += (0.3 * num / (den + 20)).reshape(GATES, 33)

    def score(self, words: list[bytes], most: int = 200_000) -> np.ndarray:
        """log10 probability of each word with its close."""
        out = np.zeros(len(words))
        for a in range(0, len(words), most):
            codes, row, place = grams(words[a : a + most])
            total = np.zeros(len(codes))
            for k in range(0, len(codes), 100_000):
                e = slice(k, k + 100_000)
                for cells, bit in steps(codes[e], self.bits):
                    st, at, gate = self.inputs(cells)
                    z = self.refined(self.mixed(st, at, gate), gate)[0]
                    total[e] -= np.logaddexp(0, np.where(bit > 0, -z, z))
            out[a : a + most] = np.bincount(row, total[place], len(words[a : a + most])) / np.log(10)
        return out


def learned(words: DataFrame, v: int, held, bits: tuple[int, ...], sample: int) -> tuple[np.ndarray, int]:
    """State of a mixer over the broadcast tables that learned from all v words of a written table, and how many those were."""
    slices = max(1, -(-v // sample))
    words = words.select("word", F.pmod(F.xxhash64("word"), F.lit(slices)).alias("slice"))

    def after(some: DataFrame, parts: int, start: np.ndarray | None):
        def run(key, d):
            m = Mixer(held.value, bits, start)
            m.learn(sorted(d["word"].tolist()), 3 if start is None else 1)
            return pd.DataFrame({"slice": [key[0]], "n": [len(d)], "state": [m.state()]})

        return some.repartition(parts, "slice").groupBy("slice").applyInPandas(run, "slice long, n long, state array<double>")

    first = after(words.where("slice = 0"), 1, None).first()
    start = np.array(first.state) if first else None
    total, n = (start * first.n, first.n) if first else (0.0, 0)
    if slices > 1:
        rest = written(after(words.where("slice > 0"), slices - 1, start), "learned")
        for r in rest.orderBy("slice").toLocalIterator():  # in one order, so that reruns agree
            total, n = total + np.array(r.state) * r.n, n + r.n
        dropped(words.sparkSession, rest)
    return (total / n if n else None), n


LONGEST = 64
FIRST = 300_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_QUANT = np.minimum(63, np.round(4 * np.log2(1 + np.arange(65536)))).astype(np.uint16)


def _coarse():
    """Stretched probability and level of each pair of coarse counts; then with a zero, and with a one less."""
    times = np.bincount(_QUANT, minlength=64)
    count = np.where(times > 0, np.bincount(_QUANT, np.arange(65536), 64) / np.maximum(times, 1), 0)
    zero, one = np.tile(count, 64), np.repeat(count, 64)
    every = [(zero, one), (np.maximum(0, zero - 1), one), (zero, np.maximum(0, one - 1))]
    st = np.concatenate([np.log(b + 0.02) - np.log(a + 0.02) for a, b in every]).astype(np.float32)
    return st, np.concatenate([np.searchsorted(_SEEN, a + b, "right") for a, b in every]).astype(np.uint8)


_STRETCH, _OFTEN = _coarse()
_GATE, _GATE2 = _OFTEN * 3, np.minimum(2, (_OFTEN + 2) // 3)
_CHILD = np.arange(32)  # of a node and a bit: twice the node's number within four levels, and the bit; 0 where a code has ended
_SIGN = np.where(_CHILD > 0, 1 - 2 * (_CHILD & 1), 0).astype(np.float32)
_LESS = np.where(_CHILD > 0, ((_CHILD & 1) + 1) << 12, 0)


def coarse(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts in six bits each: exact up to 7, within a tenth above."""
    q = _QUANT.take(packed(counts)).reshape(-1, 2)
    return q[:, 0] | q[:, 1] << 6


class Tree:
    """Huffman code of leaves by their counts."""

    def __init__(self, counts: list[int]):
        n = len(counts)
        heap = [(c, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        up, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64)
        for k in range(n, 2 * n - 1):
            c, i = heapq.heappop(heap)
            d, j = heapq.heapreplace(heap, (c + heap[0][0], k))
            up[i] = up[j] = k
            side[j] = 1
        depth = np.zeros(2 * n - 1, np.int64)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        self.size = depth[:n]
        self.start = np.cumsum(self.size) - self.size
        node, bit = np.zeros(self.size.sum(), np.uint64), np.zeros(self.size.sum(), np.int64)
        leaf, now = np.arange(n), np.arange(n)
        while len(leaf := leaf[depth[now] > 0]):
            now = now[depth[now] > 0]
            at = self.start[leaf] + depth[now] - 1
            node[at], bit[at] = up[now], side[now]
            now = up[now]
        self.groups = (self.size + 3) // 4
        self.first = np.cumsum(self.groups) - self.groups
        self.length, self.root, self.both = np.zeros(self.groups.sum(), np.int64), np.zeros(self.groups.sum(), np.uint64), np.zeros(len(bit), np.uint8)
        for d in range(self.size.max()):
            leaf = np.flatnonzero(self.size > d)
            at = self.start[leaf] + d
            if d % 4 == 0:
                place, local = self.first[leaf] + d // 4, np.ones(len(leaf), np.int64)
                self.root[place], self.length[place] = mixed((node[at] + np.uint64(1)) * _MULT), np.minimum(4, self.size[leaf] - d)
            else:
                local = self.both[at - 1].astype(np.int64)  # the one above, twice, and its bit
            self.both[at] = local * 2 + bit[at]
        k = np.repeat(np.cumsum(self.length) - self.length, self.length)
        four = np.zeros((len(self.root), 4), np.uint8)
        four[np.repeat(np.arange(len(self.root)), self.length), np.arange(len(k)) - k] = self.both
        self.four, self.last = four.view(np.uint32).ravel(), four.max(1)  # children's numbers grow downwards
        self.spare = 4 * self.groups - self.size

    def grouped(self, leaf: np.ndarray, contexts: list[np.ndarray], far: tuple[int, ...]):
        """By four levels of the leaves' codes: rows of 16 cells by context, place, and how many such groups each leaf has."""
        groups = _of(self.groups, leaf)
        at = np.arange(groups.sum()) + np.repeat(_of(self.first, leaf) - np.cumsum(groups) + groups, groups)
        root = _of(self.root, at)
        return [((np.repeat(c, groups) ^ root) * _MULT >> np.uint64(68 - b)).view(np.int64) for c, b in zip(contexts, far)], at, groups

    def children(self, at: np.ndarray) -> np.ndarray:
        """[4, groups] children's numbers of each level of these groups, 0 below the end of a code."""
        return np.ascontiguousarray(_of(self.four, at).view(np.uint8).reshape(-1, 4).T)

    def count(self, tables: list[np.ndarray], leaf: np.ndarray, contexts: list[np.ndarray], far: tuple[int, ...], times: np.ndarray) -> None:
        """Add the leaves, so many times each, at the lowest child of each group; spread() gives those above their share."""
        rows, at, groups = self.grouped(leaf, contexts, far)
        last, times = _of(self.last, at).astype(np.int64), np.repeat(times.astype(np.float32), groups)
        for t, r in zip(tables, rows):
            np.add.at(t, r * 32 + last, times)

    def coded(self, leaf: np.ndarray, contexts: list[np.ndarray], far: tuple[int, ...]):
        """Cells by context and bit, of each bit of the leaves' codes, and how many bits each has; four levels of the tree share 16 cells, for locality.
        The plain form, against which grouped() and count() are held."""
        groups = self.groups.take(leaf)
        at = np.arange(groups.sum()) + np.repeat(self.first.take(leaf) - np.cumsum(groups) + groups, groups)
        root, length = self.root.take(at), self.length.take(at)
        group = np.repeat(np.arange(len(at)), length)
        size = self.size.take(leaf)
        both = self.both.take(np.arange(len(group)) + np.repeat(self.start.take(leaf) - np.cumsum(size) + size, size))
        local = both >> 1
        cells = [(((np.repeat(c, groups) ^ root) * _MULT >> np.uint64(68 - b)) << np.uint64(4)).view(np.int64).take(group) + local for c, b in zip(contexts, far)]
        return cells, both & 1, size


def spread(t: np.ndarray) -> np.ndarray:
    """Counts of all children from those of the lowest: each holds what is below it."""
    x = t.reshape(-1, 32)
    for j in range(15, 1, -1):
        x[:, j] += x[:, 2 * j] + x[:, 2 * j + 1]
    return t


def contexts(ids: np.ndarray, kinds: np.ndarray, size: np.ndarray, orders: int) -> list[np.ndarray]:
    """Hashes of the class, and of the last 1 to orders tokens, before each token of texts of these sizes."""
    h = mixed((ids.astype(np.int64).view(np.uint64) + np.uint64(1)) * _MULT)
    j = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
    out, now = [mixed((kinds.astype(np.uint64) + np.uint64(1)) * _MULT)], np.zeros(len(ids), np.uint64)
    for k in range(1, orders + 1):
        before = np.full(len(ids), k, np.uint64)
        before[k:] = np.where(j[k:] >= k, h[:-k], np.uint64(k))
        now = mixed(now * _MULT + before)
        out.append(now)
    return out


def read_back(batches, leaves: int, orders: int, most: int = 500_000):
    """(frame, place, leaf, contexts, times) of written texts joined to about so many tokens: distinct tokens in their contexts,
    how often each occurs, and the place among them of each token, text by text."""

    def out(rows):
        b = pd.concat(rows, ignore_index=True)
        ids, kinds = np.frombuffer(b"".join(b["ids"]), "<i4"), np.frombuffer(b"".join(b["kinds"]), np.uint8)
        every = contexts(ids, kinds, b["n_tokens"].to_numpy(), orders)
        leaf = np.where(ids < 0, leaves - 1, ids)
        place, _ = pd.factorize(mixed(every[-1] ^ every[0] * _MULT) ^ mixed((leaf.astype(np.uint64) + np.uint64(1)) * _MULT))
        first = np.empty(place.max() + 1, np.int64)
        first[place[::-1]] = np.arange(len(place) - 1, -1, -1)
        return b, place, leaf[first], [c[first] for c in every], np.bincount(place)

    now, n = [], 0
    for b in batches:
        for r in sliced([b], 200):
            now.append(r)
            n += int(r["n_tokens"].sum())
            if n >= most:
                yield out(now)
                now, n = [], 0
    if now:
        yield out(now)


def pieces(n: int, size: int = 2048):
    return (slice(a, a + size) for a in range(0, n, size))


class TextMixer:
    """Gated logistic mixing of the bits of a tree's codes, over tables of coarse counts."""

    def __init__(self, tree: Tree, tables: list[np.ndarray], far: tuple[int, ...], state: np.ndarray | None = None):
        self.tree, self.t, self.far, k = tree, tables, far, len(far)
        x = np.zeros((2, GATES * (k * LEVELS + 1))) if state is None else state.reshape(2, -1).copy()
        if state is None:
            x[0, : GATES * k * LEVELS] = 1 / k
            x[1] = 1e-12
        self.x, self.n = x, GATES * k * LEVELS  # weights, then biases; below them the sums of squares of what they were changed by

    def coded(self, leaf, ctx):
        """[4, groups] codes of counts by context, children's numbers, and how many groups each leaf has."""
        rows, place, groups = self.tree.grouped(leaf, ctx, self.far)
        child = self.tree.children(place)
        at = (child >> 1) + np.arange(0, 16 * len(place), 16)
        return [_of(_of(t.view("V32"), r).view(np.uint16), at) for t, r in zip(self.t, rows)], child, groups  # a row is one place in memory

    def learn(self, leaf, ctx, times, rate: float = 0.02):
        for e in pieces(len(leaf)):
            code, child, groups = self.coded(leaf[e], [c[e] for c in ctx])
            less, sign = _of(_LESS, child), _of(_SIGN, child)
            code = [c + less for c in code]
            gate = (_of(_GATE, code[-1]) + _of(_GATE2, code[max(0, len(code) - 2)])).astype(np.int64)
            base, w = gate * (len(code) * LEVELS), self.x[0].astype(np.float32)
            at, st = [base + _of(_OFTEN, c) for c in code], [_of(_STRETCH, c) for c in code]
            z = _of(w[self.n :], gate)
            for o, (s, a) in enumerate(zip(st, at)):
                z += _of(w[o * LEVELS :], a) * s
            err = sign / (1 + np.exp(-sign * np.clip(z, -14, 14))) * np.repeat(times[e].astype(np.float32), groups)  # 0 beyond a code's end
            g = np.zeros(self.x.shape[1])
            for o, (s, a) in enumerate(zip(st, at)):
                g[o * LEVELS :] += np.bincount(a.ravel(), (err * s).ravel(), len(g) - o * LEVELS)
            g[self.n :] += np.bincount(gate.ravel(), err.ravel(), GATES)
            g /= (times[e] * _of(self.tree.size, leaf[e])).sum()
            self.x[1] += g * g
            self.x[0] -= rate * g / np.sqrt(self.x[1])

    def score(self, leaf, ctx) -> np.ndarray:
        """Natural logarithm of each leaf's probability in its context."""
        k, code = len(self.far), np.arange(4096)
        w = self.x[0, : self.n].reshape(GATES, k, LEVELS)
        every = [(w[:, o].take(_OFTEN[code], 1) * _STRETCH[code]).astype(np.float32) for o in range(k)]  # what each code adds, by gate
        every[0] += self.x[0, self.n :, None].astype(np.float32)
        every = [x.ravel() for x in every]
        gate, gate2 = (x[:4096].astype(np.int64) << 12 for x in (_GATE, _GATE2))
        out = np.zeros(len(leaf))
        for e in pieces(len(leaf)):
            code, child, groups = self.coded(leaf[e], [c[e] for c in ctx])
            base = _of(gate, code[-1]) + _of(gate2, code[max(0, k - 2)])
            z = _of(every[0], base + code[0])
            for x, c in zip(every[1:], code[1:]):
                z += _of(x, base + c)
            odds = 1 + np.exp(np.clip(z, -14, 14) * _of(_SIGN, child))  # exactly 2 beyond a code's end
            loss = np.cumsum(np.log(odds[0] * odds[1] * odds[2] * odds[3]), dtype=float)[np.cumsum(groups) - 1]
            out[e] = _of(self.tree.spare, leaf[e]) * np.log(2) - np.diff(loss, prepend=0)
        return out


def _sums(parts: DataFrame, bits: tuple[int, ...]) -> list[np.ndarray]:
    """Tables of counts from their tasks' parts."""
    tables = [np.zeros(2 << k, np.float32) for k in bits]
    for r in parts.repartition(16, "part").mapInPandas(_sum, "part int, counts binary").toLocalIterator():
        o, p = r.part >> 20, (r.part & 0xFFFFF) << 17
        tables[o][p : p + (1 << 17)] = np.frombuffer(zlib.decompress(bytes(r.counts)), "<f4")
    return tables


def coding(got: DataFrame, held_tree, leaves: int, far: tuple[int, ...], n: int):
    """Broadcast tables and the state of a mixer that learned from all training texts of a written table."""
    spark, orders = got.sparkSession, len(far) - 1
    tasks = 2 * spark.sparkContext.defaultParallelism
    train = got.where("not held_out").select("dk", "n_tokens", "ids", "kinds")

    def count(batches):
        t = None
        for _, _, leaf, ctx, times in read_back(batches, leaves, orders):
            t = [np.zeros(2 << k, np.float32) for k in far] if t is None else t
            for e in pieces(len(leaf)):
                held_tree.value.count(t, leaf[e], [c[e] for c in ctx], far, times[e])
        for o, x in enumerate(t or []):
            for p in range(0, len(x), 1 << 17):
                yield pd.DataFrame({"part": [o << 20 | p >> 17], "counts": [zlib.compress(x[p : p + (1 << 17)].astype("<f4").tobytes(), 1)]})

    held = spark.sparkContext.broadcast([coarse(spread(t)) for t in _sums(train.coalesce(tasks).mapInPandas(count, "part int, counts binary"), far)])

    def after(start, passes):
        def run(batches):
            m, k = TextMixer(held_tree.value, held.value, far, start), 0
            for _, place, leaf, ctx, times in read_back(batches, leaves, orders):
                for _ in range(passes):
                    m.learn(leaf, ctx, times)
                k += len(place)
            if k:
                yield pd.DataFrame({"dk": [0], "n": [k], "state": [m.x.ravel()]})

        return run

    schema = "dk long, n long, state array<double>"
    slices = max(1, -(-n // FIRST))
    first = train.where(F.pmod("dk", F.lit(slices)) == 0).repartition(1).sortWithinPartitions("dk").mapInPandas(after(None, 3), schema).first()
    start = np.array(first.state) if first else None
    rest = train.coalesce(tasks).mapInPandas(after(start, 1), schema).collect()  # a row of some 900 numbers for each task
    total = sum((np.array(r.state) * r.n for r in rest), 0.0)
    return held, (total / sum(r.n for r in rest) if rest else None)


def score(docs: DataFrame, bits: tuple[int, ...] = (16, 20, 20, 22, 22), sample: int = 30_000, frequent: int = 1_000_000, classes: int = 8, shrink: float = 20_000.0, far: tuple[int, ...] = (20, 22, 22)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    bounded(spark)
    train = F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
    langs = docs.where("lang is not null").where(train).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(classes - 1).collect()
    langs = sorted(r.lang for r in langs)
    ks = range(len(langs) + 1)
    vocab = docs.mapInArrow(_count(langs), "word binary, k int, c long").groupBy("word")
    vocab = vocab.agg(F.sum("c").alias("c"), *(F.sum(F.when(F.col("k") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in ks))
    vocab = written(vocab, "words")
    total = vocab.agg(F.count("*"), F.count_if(F.col("c") > 0), *(F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in ks)).first()
    v, per = total[1], np.array(total[2:], float)
    n = int(per.sum())
    least = max(2, -(-n // frequent))
    inside = ((F.col("c") >= least) & (F.octet_length("word") <= LONGEST)) | (F.col("word") == F.lit(b""))
    at, counts = {}, []
    for r in vocab.where(inside).orderBy(F.desc("c"), "word").toLocalIterator():  # at most `frequent` + 1 words of LONGEST bytes
        at[bytes(r.word)] = len(at)
        counts.append(r[1:])
    if not at:
        return docs.select("doc_id", *(F.lit(None).cast(t).alias(x) for x, t in _COLUMNS))
    c = np.array(counts, float)
    m, u = n - int(c[:, 0].sum()), v - int((c[:, 0] > 0).sum())
    base = np.log10((c[:, 0] + 0.1) / (n + 0.1 * (v + 1)))
    lps = np.log((c[:, 1:] + shrink * np.maximum(c[:, :1], 0.5) / max(1, n)) / (per + shrink))
    share = np.log(np.maximum(per, 0.5))
    lps = np.vstack([lps, np.zeros(len(per))]).T.astype(np.float32)  # those of words outside the tree: 0
    known = spark.sparkContext.broadcast((pa.array(list(at), pa.binary()), np.append(base, 0.0), np.ascontiguousarray(lps)))
    tree = Tree([*(max(1, int(x)) for x in c[:, 0]), max(1, m)])
    held_tree, leaves = spark.sparkContext.broadcast(tree), len(at) + 1

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")

    def read(batches):
        at, base, lps = known.value
        for b in batches:
            for part in portions(b):
                place, distinct, size = encoded(part["text"])
                ids = pc.index_in(distinct, at).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
                ids[ids < 0] = -1 - (hashes(distinct.filter(pa.array(ids < 0))) & np.uint64(0x3FFFFFFF)).astype(np.int32)
                ids = ids[place]
                leaf, start = np.where(ids < 0, len(at), ids), np.cumsum(size) - size
                best, kinds = np.full(len(ids), -np.inf), np.zeros(len(ids), np.uint8)
                for k, x in enumerate(lps):
                    so_far = np.concatenate([[0.0], np.cumsum(_of(x, leaf[:-1]), dtype=float)])  # before each token
                    so_far += np.repeat(share[k] - so_far[start], size)
                    so_far[start] = share[k]
                    kinds[so_far > best] = k
                    np.maximum(best, so_far, out=best)
                other = np.flatnonzero(ids < 0)
                other, times = np.unique(np.repeat(np.arange(len(size)), size)[other] * len(distinct) + place[other], return_counts=True)
                rare = np.concatenate([[0], np.searchsorted(other, np.arange(1, len(size) + 1) * len(distinct))])
                seen = np.add.reduceat((ids >= 0).astype(np.int64), start) if n else np.zeros(len(size), np.int64)
                held = [held_out(x) for x in part["doc_id"].to_pylist()]
                columns = [part["dk"], part["doc_id"], held, size, seen, np.add.reduceat(base.take(leaf), start), part["n_bytes"]]
                columns += [slices_of(ids.astype("<i4"), size), slices_of(kinds, size)]
                columns += [pa.ListArray.from_arrays(pa.array(rare, pa.int32()), x) for x in (distinct.take(pa.array(other % len(distinct))), pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

    schema = "dk long, doc_id long, held_out boolean, n_tokens long, seen long, base double, n_bytes long, ids binary, kinds binary, rare array<binary>, times array<int>"
    names = [x.split()[0] for x in schema.split(", ")]
    got = written(docs.select(F.xxhash64("doc_id", "text").alias("dk"), "doc_id", "text", size.alias("n_bytes")).mapInArrow(read, schema), "read")
    tables, state = coding(got, held_tree, leaves, far, n)

    def coded(batches):
        mixer = TextMixer(held_tree.value, tables.value, far, state)
        for b, place, leaf, ctx, _ in read_back(batches, leaves, len(far) - 1):
            size = b["n_tokens"].to_numpy()
            lp = np.bincount(np.repeat(np.arange(len(b)), size), mixer.score(leaf, ctx)[place], len(b))
            yield b[kept].assign(lp=lp)

    kept = ["dk", "doc_id", "held_out", "n_tokens", "seen", "base", "n_bytes"]
    short = got.select("dk", F.col("doc_id"), "held_out", "n_tokens", "seen", "base", "n_bytes", "ids", "kinds")
    done = written(short.mapInPandas(lambda x: (y.astype({"doc_id": "Int64"}) for y in coded(x)), short.drop("ids", "kinds").withColumn("lp", F.lit(0.0)).schema), "coded")
    for x in (known, held_tree, tables):
        x.unpersist()

    few = max(1, min(16, -(-total[0] // 50_000)))  # tables are of fixed size, but each task sends its own
    held = spark.sparkContext.broadcast([packed(t) for t in _sums(vocab.where("c > 0").select("word").repartition(few).mapInPandas(_tables(bits), "part int, counts binary"), bits)])
    spelling, _ = learned(vocab.where("c > 0"), v, held, bits, sample)

    def rate(batches):
        mixer = Mixer(held.value, bits, spelling)
        for b in gathered(batches):
            p = mixer.score(b["word"].tolist()) * np.log(10)
            if m:
                with np.errstate(divide="ignore"):
                    p = np.logaddexp(np.log(np.maximum(b["c"].to_numpy() - DISCOUNT, 0) / m), np.log(DISCOUNT * u / m) + p)
            yield b.assign(lp=p)

    rated = vocab.where(~inside).select("word", "c").repartition(max(spark.sparkContext.defaultParallelism, few), "word")
    rated = written(rated.mapInPandas(rate, "word binary, c long, lp double"), "rated")
    dropped(spark, vocab)
    rows = got.select("dk", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("dk", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    sums = {"base2": F.col("k") * F.log10((F.col("c") + 0.1) / (n + 0.1 * (v + 1))), "seen2": F.when(F.col("c") > 0, F.col("k")).otherwise(0), "lp2": F.col("k") * F.col("lp")}
    rest = rows.join(rated, "word").groupBy("dk").agg(*(F.sum(x).alias(k) for k, x in sums.items()))
    copies = got.groupBy("dk").agg(F.count("*").alias("copies"))  # equal rows share a key, and their words were joined as often
    rest = rest.join(copies, "dk").select("dk", *((F.col(x) / F.col("copies")).alias(x) for x in sums))
    d = done.join(rest, "dk", "left")
    d = d.withColumn("score", (F.col("lp") + F.coalesce("lp2", F.lit(0.0))) / float(np.log(10))).withColumn("base_score", F.col("base") + F.coalesce("base2", F.lit(0.0)))
    bpb = F.when(F.col("n_bytes") > 0, -F.col("score") / float(np.log10(2)) / F.col("n_bytes"))
    seen = F.round(F.col("seen") + F.coalesce("seen2", F.lit(0.0))).cast("long")
    d = d.withColumns({"n_known": seen, "train_tokens": F.lit(n).cast("long"), "bits_per_byte": bpb})
    return d.select("doc_id", *(x for x, _ in _COLUMNS))


_COLUMNS = [("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("bits_per_byte", "double")]


def op8_lm_score(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
