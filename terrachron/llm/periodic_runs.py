"""Maximal periodic runs of words, by Lyndon arrays over the ordered alphabet of a text's words.

A run is a stretch of consecutive words with smallest period q and at least `least` times q words (and `floor` words), which no
neighbouring word extends keeping period q. Words become numbers by sorting alone, so that only comparisons are made: no suffix
array or tree, no fingerprint.

Every run has a Lyndon root: the smallest rotation of its period, in the order of words or in the reverse order, whichever makes
the suffix that ends the run's periodicity smaller. At each root but the last, the next smaller suffix begins one period on.
`lyndon()` finds the next smaller suffix of every place from right to left and keeps how far the two suffixes match; both are
used again. A suffix that is compared with a second one takes over what the first comparison has shown; and a match that
has gone on for a whole period reaches a pair whose match is known. A place is read about as often as the shorter part of
each pair that becomes one Lyndon word, so that the work is linear up to a logarithm in the worst case, and linear on periodic texts.

A run's first root starts in its first period, so that it matches the next place of its root for more than `least` - 2
periods: only such pairs are looked at further. Each place of a run shares its word with `floor(least)` places at least, so that words
that are rarer in the text end every run; the stretches between them are searched apart, which changes nothing in the result.

Defined results: a null or blank text has no words and no runs; texts of any length are taken whole, one at a time; equal rows have
equal results; an empty table gives no rows; further columns come along, and may have any name but those of the result.
"""

from __future__ import annotations

import math
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import bound, bounded, table

WORD = r"[^\x20\x09-\x0D]+"


def ranks(words: list) -> np.ndarray:
    """Place of each word in the sorted alphabet, equal words alike."""
    n = len(words)
    order = sorted(range(n), key=words.__getitem__)
    s = [words[i] for i in order]
    out = np.zeros(n, np.int64)
    out[order[1:]] = np.cumsum(np.fromiter(map(ne, s[1:], s), np.int64, n - 1))
    return out


def lyndon(w: list[int], ended: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Of each suffix the next smaller one (len(w) if none; the end of the text is the smallest letter) and the length of their match.
    ended: w with -1 behind, if it is there already."""
    n = len(w)
    after, match = [n] * n, [0] * n  # the next smaller suffix
    before, taken = [-1] * n, [0] * n  # the suffix that passed over this one, being smaller
    w = [*w, -1] if ended is None else ended
    for i in range(n - 2, -1, -1):
        j, m, look = i + 1, 0, True
        here = w[i]
        while True:
            if look:
                if m or w[j] == here:
                    p = j - i
                    while j + m < n and w[i + m] == w[j + m]:
                        m += 1
                        if m == p and j + p < n:  # (j, j + p) may have been compared
                            if after[j] == j + p:
                                m += match[j]
                                break
                            if before[j + p] == j:
                                m += taken[j + p]
                                break
                if w[i + m] > w[j + m]:
                    after[i], match[i] = j, m
                    break
            before[j], taken[j] = i, m
            k, known = after[j], match[j]
            if k == n:
                break
            if m > known:
                after[i], match[i] = k, known
                break
            look, j = m == known, k
    return after, match


def runs(w: np.ndarray, least: float = 4, floor: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of w that is long enough, in order. least: 2 periods or more."""
    if least < 2:
        raise ValueError("a run has two periods at least")
    n, found = len(w), set()
    if n < floor:
        return []
    values = w.tolist()
    for v in (values, (int(w.max()) - w).tolist()):
        after, match = lyndon(v)
        a, m = np.array(after), np.array(match)
        p = a - np.arange(n)
        ends: dict[int, int] = {}
        for i in np.flatnonzero((a < n) & (m > (least - 2) * p)).tolist():
            q = after[i] - i
            end = after[i] + match[i]
            if ends.get(q) == end:  # a later root of the same run
                continue
            ends[q] = end
            start = i
            while start and values[start - 1] == values[start - 1 + q]:
                start -= 1
            if end - start >= max(floor, least * q):
                found.add((start, end - start, q))
    return sorted(found)


def text_runs(words: list, least: float = 4, floor: int = 6) -> list[tuple[int, int, int]]:
    """Runs of a text: those of the stretches between words too rare to be in any."""
    n = len(words)
    if n < floor:
        return []
    w = ranks(words)
    often = np.bincount(w)[w] >= math.floor(least)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], often.view(np.int8), [0]))))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= floor:
            out += [(a + s, length, q) for s, length, q in runs(w[a:b], least, floor)]
    return out


def collapsed(words: list, found) -> list:
    """The words that lie in no run beyond its first period."""
    stay = np.ones(len(words), bool)
    for s, length, q in found:
        stay[s + q : s + length] = False
    return [x for x, k in zip(words, stay.tolist()) if k]


_SPANS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))


def find(docs: DataFrame, text: Column | str = "text", least: float = 4, floor: int = 6, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (all columns, or those in keep) with runs (by start, then period) and collapsed (words in no run beyond its first period, joined by one space)."""
    keep = docs.columns if keep is None else keep
    if clash := {"runs", "collapsed"} & set(keep):
        raise ValueError(f"results have the names {sorted(clash)}")
    bounded(docs.sparkSession)
    own = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    given = docs.select(*own, (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))
    width = len(keep)

    def run(batches):
        for b in batches:
            spans, left = [], []
            for t in b.column(width):
                t = t.as_py()
                # bytes.split() parts at exactly \x20 and \x09-\x0D
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                got = text_runs(words, least, floor)
                spans.append([dict(zip(("start", "length", "period"), x)) for x in got])
                left.append(b" ".join(collapsed(words, got) if got else words).decode("utf-8", "surrogatepass"))
            new = {"runs": pa.array(spans, _RUNS), "collapsed": pa.array(left, pa.string())}
            yield pa.RecordBatch.from_pydict({f"k{i}": b.column(i) for i in range(width)} | new)

    kinds = ", ".join(f"k{i} {dict(docs.dtypes)[c]}" for i, c in enumerate(keep))
    out = given.mapInArrow(run, f"{kinds}, runs {_SPANS}, collapsed string")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "runs", "collapsed")


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The text, every tenth one by the crc32 of its doc_id with its words repeating from some place on."""
    h = F.crc32(doc_id.cast("string"))
    g, div = F.floor(h / 10).cast("long"), lambda x, y: F.floor(x / y).cast("long")

    def repeated(s):  # w: words, n: their number, a: the first that repeats
        def from_a(t):  # w, a, p: words in a period
            word = lambda i: F.get(t["w"], F.when(i < t["a"], i).otherwise(t["a"] + (i - t["a"]) % t["p"]).cast("int"))
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(t["w"]).cast("long") - 1), word), " ")

        a = g % F.greatest(s["n"], F.lit(1))
        return F.when(s["n"] > 0, bound(F.struct(s["w"].alias("w"), a.alias("a"), (1 + div(s["n"] - a, 3 + g % 8)).alias("p")), from_a))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    once = bound(words, lambda w: bound(F.struct(w.alias("w"), F.size(w).cast("long").alias("n")), repeated))
    return F.when(h % 10 == 0, once).otherwise(text)


def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d = find(docs, made_periodic(F.col("doc_id"), F.col("text")), keep=("doc_id",))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(F.transform("runs", line), "").alias("r"), "collapsed")
    period = -F.col("b.p")
    return d.select(
        "doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length"), period.alias("period"), F.floor(1000 * F.col("b.length") / period).cast("long").alias("exponent_milli"),
        F.sha2("r", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
