"""Best-fit packing with Martello-Toth dominance reduction.

Only the sizes of pieces matter, so the instance is its histogram: at most `capacity` counts, whatever the number of
documents. On it, sets of up to three pieces that provably dominate every other set with the same piece are fixed for
good; what remains is packed best-fit decreasing. Both work on whole counts at once and give slots: ranges of ranks
of one size that fill a range of sequences at one offset. Pieces then look up their slot by (size, rank).

Defined results: a null text is empty and still gives its end token; very long texts are cut into full pieces, the first
one shorter; repeated rows are packed each; an empty table gives no rows; ties go by doc_id, then piece; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import bounded, table, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SPECIAL = "<|endoftext|>"
_cache: dict = {}


def _encoder(path: str):
    """Text to ids as tokenizers gives them. The same vocabulary, where it lies beside as .tiktoken, is several times
    faster there and gives the same ids, except for texts with the special token's string, which tokenizers takes."""
    if path not in _cache:
        import base64
        import os

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        exact = Tokenizer.from_file(path)
        fast, ranks = None, path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})

        def encode(text: str):
            if fast is None or _SPECIAL in text:
                return exact.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _cache[path] = encode
    return _cache[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes the remainder."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 2) -> DataFrame:
    def run(batches):
        encode = _encoder(tokenizer)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"].tolist(), b["text"].tolist()):
                ids = np.array([*(encode(text) if text else ()), end_id], "<u4")
                out += [(doc, k, s, m, zlib.crc32(ids[s : s + m].tobytes())) for k, (s, m) in enumerate(cut(len(ids), capacity))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECES)


class _Packer:
    """Counts by size, and the slots given out: (size, rank, sequences, pieces in each, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.c, self.left = capacity, {s: n for s, n in counts.items() if n}
        self.sizes, self.rank = sorted(self.left), dict.fromkeys(self.left, 0)
        self.slots, self.sequences = [], 0

    def put(self, size, bins, each, first, offset):
        self.slots.append((size, self.rank[size], bins, each, first, offset))
        self.rank[size] += bins * each
        self.left[size] -= bins * each
        if not self.left[size]:
            self.sizes.remove(size)

    def fix(self, members: list[int]) -> None:
        """As many sequences as there are of exactly these sizes."""
        need = {s: members.count(s) for s in members}
        bins, first, offset = min(self.left[s] // k for s, k in need.items()), self.sequences, 0
        for s, k in need.items():
            self.put(s, bins, k, first, offset)
            offset += s * k
        self.sequences += bins

    def largest(self, room: int, used: list[int]) -> int:
        """The largest size within room of which a piece is left beside those used; 0: none."""
        i = bisect_left(self.sizes, room + 1) - 1
        while i >= 0 and self.left[self.sizes[i]] <= used.count(self.sizes[i]):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, k: int, used: list[int]) -> int:
        """Sum of the k smallest pieces left beside those used; over the capacity if there are not so many."""
        total = 0
        for s in self.sizes:
            m = min(k, self.left[s] - used.count(s))
            total, k = total + m * s, k - m
            if not k:
                return total
        return self.c + 1

    def dominant(self, j: int) -> list[int] | None:
        """Sizes of a set with j that dominates every feasible set with j, if one is found."""
        room = self.c - j
        a = self.largest(room, [j])
        if not a:
            return [j]
        if a == room or self.smallest(2, [j]) > room:
            return [j, a]
        if self.smallest(3, [j]) > room:
            b = self.largest(room - a, [j, a])
            if b:  # {x, y} with x <= a is no better if y <= b; both above b must not fit
                i = bisect_left(self.sizes, b + 1)
                if i >= len(self.sizes) or 2 * self.sizes[i] > room:
                    return [j, a, b]
        return None

    def reduce(self) -> None:
        again = True
        while again:
            again = False
            for j in reversed(list(self.sizes)):
                while self.left[j] and (f := self.dominant(j)):
                    self.fix(f)
                    again = True

    def best_fit(self) -> None:
        open_, rooms = {}, []

        def free(room, first, bins):
            if room and bins:
                if room not in open_:
                    open_[room] = []
                    insort(rooms, room)
                open_[room].append((first, bins))

        while self.sizes:
            s = self.sizes[-1]
            while self.left[s]:
                n, i = self.left[s], bisect_left(rooms, s)
                if i == len(rooms):
                    each = self.c // s
                    bins = n // each or 1
                    first, room = self.sequences, self.c
                    self.sequences += bins
                else:
                    room = rooms[i]
                    first, bins = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[i]
                    each = room // s
                use = min(bins, n // each)
                if not use:
                    use, each = 1, n
                self.put(s, use, each, first, self.c - room)
                free(room - each * s, first, use)
                free(room, first + use, bins - use)


def pack_counts(counts: dict[int, int], capacity: int):
    """Slots and the number of sequences for so many pieces of each size."""
    p = _Packer(counts, capacity)
    p.reduce()
    p.best_fit()
    return p.slots, p.sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, bucket_rows: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    bounded(docs.sparkSession)
    p = written(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r.length: r["count"] for r in p.groupBy("length").count().collect()}  # at most `capacity` rows
    slots, _ = pack_counts(counts, capacity)
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    p = p.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    # a size may be common: ranks run inside (size, bucket), after the pieces of the buckets before
    order = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = p.groupBy("length", "_b").count().select("length", "_b", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("_ahead"))
    inner = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    p = p.join(ahead, ["length", "_b"]).withColumn("_rank", F.col("_ahead") + F.row_number().over(inner) - 1)
    by_size: dict[int, np.ndarray] = {}
    for s in counts:
        by_size[s] = np.array(sorted(x[1:] for x in slots if x[0] == s), np.int64)
    held = docs.sparkSession.sparkContext.broadcast(by_size)  # bounded by the capacity, not by the data

    def place(batches):
        for b in batches:
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            size, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                t = held.value[int(s)]
                k = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                inside = rank[at] - k[:, 0]
                seq[at], off[at] = k[:, 3] + inside // k[:, 2], k[:, 4] + inside % k[:, 2] * s
            yield b.drop(columns="_rank").assign(sequence_id=seq, offset=off)

    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return p.select(*cols, "_rank").mapInPandas(place, PIECES + ", sequence_id long, offset long")


def op3_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
