"""Suffix-array dedup with a logarithmic family of indexes.

A byte goes if it lies in a string of `window` bytes that also starts anywhere else. Suffixes are sampled where every copy
of such a string agrees: each window names the smallest hash of its `gram`-byte grams (the first, if several are equal) as
its anchor. Consecutive windows with one anchor are a run; the suffix at the anchor, led by its gram, stands for them all.
New batches of documents become sorted runs of such suffixes (sparse suffix arrays, in order of the gram's fingerprint: any
order serves that keeps equal prefixes together). A batch is scanned against itself and all levels for prefixes
met twice, by a hash aggregation over fingerprints that doesn't use the order; levels of equal size then merge into one sorted table, so that n batches leave about log2(n) levels.

Suffixes with a repeated prefix are matched further: runs whose whole context (all bytes of their windows) occurs twice
go entirely; in groups with differing contexts every window is compared, one representative per context. Groups
of over `wide` contexts are not compared in one task but by grouped counts: first of blocks of `block` windows by the bytes that a block's
windows share, then of the windows of blocks met twice.

Defined results: a null text is empty; texts shorter than the window keep everything; repeated rows are copies of each
other, so their windows go; very long texts are cut into overlapping segments for hashing only; an empty table gives no
rows; further columns are ignored. Strings are compared by 64-bit fingerprints of gram and window together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mixed
from ._util import bounded, dropped, semi, sized, sliced, table
from ._util import written as _written

_CHUNK = 1 << 18
_POS = np.uint64((1 << 22) - 1)
_TABLE = np.random.default_rng(20_240_501).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


class Hashes:
    """Fingerprints of any substring of a buffer, independent of where it lies."""

    def __init__(self, buf: np.ndarray):
        self.up, down = _power(max(len(buf), 3 * _CHUNK) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * down[: len(buf)], out=self.sums[1:])

    def at(self, start, end):
        return (self.sums[end] - self.sums[start]) * self.up[start]


def runs(buf: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """(first window, last window, anchor) of each run over the segments that end at `ends` in buf, and the hashes."""
    h, w, n = Hashes(buf), window - gram + 1, len(buf) - gram + 1
    key = np.full(-(-(n + w) // w) * w, ~np.uint64(0), np.uint64)
    i = np.arange(n, dtype=np.int64)
    key[:n] = (mixed(h.at(i, i + gram)) & ~_POS) | i.astype(np.uint64)
    k = key.reshape(-1, w)
    ahead, behind = np.minimum.accumulate(k, 1).ravel(), np.minimum.accumulate(k[:, ::-1], 1)[:, ::-1].ravel()
    ok = np.ones(len(buf) + 1, bool)
    for e in ends:
        ok[max(0, e - window + 1) : e] = False
    ok[len(buf) - window + 1 :] = False
    s = np.flatnonzero(ok)
    a = (np.minimum(behind[s], ahead[s + w - 1]) & _POS).astype(np.int64)
    new = np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1 if len(s) else first
    return s[first], s[last], a[first], h


def _chunks(keys, texts, window):
    """Whole documents, or segments of very long ones that share window - 1 bytes, about _CHUNK bytes at a time."""
    now, total = [], 0
    for key, t in zip(keys, texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if len(b) < window:
            continue
        for s in range(0, len(b) - window + 1, _CHUNK - window + 1):
            part = b[s : s + _CHUNK]
            now.append((key, s, part))
            total += len(part)
            if total >= _CHUNK:
                yield now
                now, total = [], 0
    if now:
        yield now


def _suffixes(window: int, gram: int):
    def run(batches):
        for b in sliced(batches, 2000):
            for chunk in _chunks(b["dk"].tolist(), b["text"].tolist(), window):
                ends = np.cumsum([len(x) for _, _, x in chunk])
                buf = np.frombuffer(b"".join(x for _, _, x in chunk), np.uint8)
                s1, s2, a, h = runs(buf, ends, window, gram)
                o, r = a - s1, s2 - s1
                ctx = mixed(h.at(s1, s2 + window) + o.astype(np.uint64) * np.uint64(_BASE) + (r << 20).astype(np.uint64))
                doc = np.searchsorted(ends, s1, "right")
                shift = np.array([s for _, s, _ in chunk]) - np.append(0, ends[:-1])
                yield pd.DataFrame({
                    "g": mixed(h.at(a, a + gram)).view(np.int64), "ctx": ctx.view(np.int64), "dk": np.array([k for k, _, _ in chunk], np.int64)[doc],
                    "s": (s1 + shift[doc]).astype(np.int32), "o": o.astype(np.int16), "r": r.astype(np.int16),
                })

    return run


_SUFFIX = "g long, ctx long, dk long, s int, o short, r short"


class SuffixIndex:
    """Levels of sorted suffixes; add() scans a batch against all of them, then merges levels of equal size."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []  # number of batches in it, table
        self.hits: list[DataFrame] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Prefixes that this batch repeats, within itself or from a level."""
        new = batch.select("g", F.lit(1).alias("new"))
        for _, t in self.levels:
            new = new.unionByName(t.select("g", F.lit(0).alias("new")))
        met = new.groupBy("g").agg(F.count("*").alias("n"), F.max("new").alias("new")).where("n > 1 and new = 1").select("g", "n")
        self.hits.append(_written(met, "hits"))
        self.levels.append((1, batch))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels[-2:]
            order = ["g", "ctx", "dk", "s"]  # ranges of all four, so that a common prefix doesn't lie in one task
            both = a.unionByName(b).repartitionByRange(*order).sortWithinPartitions(*order)
            self.levels[-2:] = [(n + m, _written(both, "level"))]
            for old in (a, b):
                dropped(old.sparkSession, old)
        return self.hits[-1]

    def drop(self) -> None:
        """Delete the tables."""
        for t in [*(t for _, t in self.levels), *self.hits]:
            dropped(t.sparkSession, t)

    def repeated(self) -> DataFrame:
        """Suffixes whose prefix was met twice, in any scan."""
        every, hits = self.levels[0][1], self.hits[0]
        for _, t in self.levels[1:]:
            every = every.unionByName(t)
        for t in self.hits[1:]:
            hits = hits.unionByName(t)
        self.hits.append(_written(hits.groupBy("g").agg(F.max("n").alias("n")), "hits"))
        return semi(every, self.hits[-1], ["g"])


def _contexts(window: int):
    """From documents with their representative suffixes: the bytes of each context."""

    def run(batches):
        for b in sliced(batches, 200):
            out = []
            for dk, text, members in zip(b["dk"].tolist(), b["text"].tolist(), b["m"]):
                t = text.encode("utf-8", "surrogatepass")
                for m in members:
                    g, s, o, r, c = (int(m[x]) for x in ("g", "s", "o", "r", "c"))
                    out.append((g, dk, s, o, r, c, bool(m["wide"]), t[s : s + r + window]))
            yield pd.DataFrame(out, columns=["g", "dk", "s", "o", "r", "c", "wide", "x"])

    return run


def _named(d, row, at, to, place):
    """Fingerprints of the bytes [at, to) of the contexts d[row], together with their gram and their place about it."""
    size = np.array([len(x) for x in d["x"]], np.int64)
    base = (np.cumsum(size) - size)[row]
    h = Hashes(np.frombuffer(b"".join(d["x"]), np.uint8)).at(base + at, base + to)
    return mixed(mixed(h + place.astype(np.uint64) * np.uint64(_BASE)) ^ d["g"].to_numpy().view(np.uint64)[row]).view(np.int64)


def _each(first, last):
    """(row, value) of the whole numbers from first to last of every row."""
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _blocks(window: int, block: int):
    """Contexts of wide groups, by blocks of windows that start as far before the gram: windows of a block that are equal have
    equal cores, which are the bytes that all windows of the block have."""

    def run(batches):
        for d in sliced(batches, 500):
            o, r = (d[c].to_numpy().astype(np.int64) for c in "or")
            row, q = _each((o - r) // block, o // block)
            at = o[row] - q * block
            key = _named(d, row, at, at + window - block + 1, q)
            yield pd.DataFrame({"key": key, "dk": d["dk"].to_numpy()[row], "s": d["s"].to_numpy()[row], "q": q.astype(np.int16), "c": d["c"].to_numpy()[row]})

    return run


def _windows(window: int, block: int):
    """The windows in the blocks qs of each context."""

    def run(batches):
        for d in sliced(batches, 500):
            o, r, s = (d[c].to_numpy().astype(np.int64) for c in "ors")
            k = np.repeat(np.arange(len(d)), [len(x) for x in d["qs"]])
            q = np.concatenate([np.asarray(x, np.int64) for x in d["qs"]])
            i, l = _each(np.maximum(q * block, (o - r)[k]), np.minimum(q * block + block - 1, o[k]))
            row = k[i]
            at = o[row] - l
            yield pd.DataFrame({"h": _named(d, row, at, at + window, l), "dk": d["dk"].to_numpy()[row], "b": (s[row] + at).astype(np.int32), "c": d["c"].to_numpy()[row]})

    return run


def _compare(window: int, most: int = 4_000):
    """Groups come sorted by g, each whole: windows that occur in two contexts of one group, of contexts met once."""

    def windows(d):
        size = d["r"].to_numpy().astype(np.int64) + 1
        length = size + window - 1
        buf = np.frombuffer(b"".join(d["x"]), np.uint8)
        base = np.cumsum(length) - length
        member = np.repeat(np.arange(len(d)), size)
        j = np.arange(len(member)) - np.repeat(np.cumsum(size) - size, size)
        h = Hashes(buf).at(base[member] + j, base[member] + j + window)
        l = d["o"].to_numpy().astype(np.int64)[member] - j
        h = mixed(mixed(h + l.astype(np.uint64) * np.uint64(_BASE)) ^ d["g"].to_numpy().view(np.uint64)[member])
        _, inv, cnt = np.unique(h, return_inverse=True, return_counts=True)
        ok = np.flatnonzero((cnt[inv] > 1) & (d["c"].to_numpy()[member] == 1))
        if not len(ok):
            return None
        m, j = member[ok], j[ok]
        new = np.append(True, (m[1:] != m[:-1]) | (j[1:] != j[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(m)) - 1
        s = d["s"].to_numpy().astype(np.int64)[m[first]]
        return pd.DataFrame({"dk": d["dk"].to_numpy()[m[first]], "b": s + j[first], "e": s + j[last] + window})

    def run(batches):
        carry = None
        for b in batches:
            d = b if carry is None else pd.concat([carry, b], ignore_index=True)
            g = d["g"].to_numpy()
            tail = int(np.searchsorted(g, g[-1]))
            carry = d.iloc[tail:]
            at = 0
            while at < tail:  # some groups at a time
                to = min(tail, at + most)
                to = tail if to == tail else max(int(np.searchsorted(g, g[to])), int(np.searchsorted(g, g[at], "right")))
                if (r := windows(d.iloc[at:to].reset_index(drop=True))) is not None:
                    yield r
                at = to
        if carry is not None and len(carry) and (r := windows(carry.reset_index(drop=True))) is not None:
            yield r

    return run


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted((int(x["b"]), int(x["e"])) for x in spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def repeats(docs: DataFrame, window: int = 400, gram: int = 200, batches: int = 3, wide: int = 2_000, block: int = 16) -> DataFrame:
    """dk (hash of doc_id and text) and its spans [b, e) of bytes to remove, for documents that have any."""
    spark, block, made = docs.sparkSession, min(block, window), []
    bounded(spark)

    def written(df, name, by=None):  # tables that go when the spans are there
        made.append(t := _written(df, name, by))
        return t

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("dk"), "text")
    s = keyed.mapInPandas(_suffixes(window, gram), _SUFFIX).withColumn("batch", F.pmod("dk", F.lit(batches)).cast("int"))
    index = SuffixIndex()
    path = written(s.sortWithinPartitions("batch", "g", "ctx"), "suffixes", "batch")
    for i in range(batches):
        index.add(spark.read.schema(_SUFFIX).parquet(f"{path}/batch={i}") if _there(spark, f"{path}/batch={i}") else spark.createDataFrame([], _SUFFIX))
    f = written(index.repeated(), "repeated")
    rep = F.min(F.struct("dk", "s", "o", "r")).alias("m")
    ctx = f.groupBy("g", "ctx").agg(F.count("*").alias("n"), rep).select("g", "ctx", "n", "m.*")
    ctx = written(ctx, "contexts")
    whole = semi(f, ctx.where("n > 1").select("g", "ctx", "n"), ["g", "ctx"])
    whole = whole.select("dk", F.col("s").alias("b"), (F.col("s") + F.col("r") + window).cast("int").alias("e"))
    # groups with several contexts, of which one is met once: compared in one task each, but for wide ones
    open_ = ctx.groupBy("g").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1")
    open_ = written(open_.select("g", F.col("k").alias("n")), "open")
    few = ctx.join(open_.where(F.col("n") <= wide).select("g"), "g", "left_semi").withColumn("wide", F.lit(False))
    many = semi(ctx, open_.where(F.col("n") > wide), ["g"]).withColumn("wide", F.lit(True))
    member = F.struct("g", "s", "o", "r", F.least("n", F.lit(2)).cast("int").alias("c"), "wide")
    reps = written(few.unionByName(many).groupBy("dk").agg(F.collect_list(member).alias("m")), "members")
    x = sized(keyed.where("text is not null"), reps, "dk").select("dk", "text", "m")
    shape = "g long, dk long, s int, o short, r short, c int, wide boolean, x binary"
    x = written(x.mapInPandas(_contexts(window), shape), "windows")
    one = x.where("not wide").drop("wide").repartition("g").sortWithinPartitions("g").mapInPandas(_compare(window), "dk long, b int, e int")
    x = x.where("wide")
    cores = written(x.mapInPandas(_blocks(window, block), "key long, dk long, s int, q short, c int"), "cores")
    met = cores.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("least")).where("n > 1 and least = 1").select("key", "n")
    left = semi(cores, written(met, "met"), ["key"]).groupBy("dk", "s").agg(F.collect_set("q").alias("qs"))
    every = written(x.join(left, ["dk", "s"]).mapInPandas(_windows(window, block), "h long, dk long, b int, c int"), "every")
    met = every.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("least")).where("n > 1 and least = 1").select("h", "n")
    many = semi(every, written(met, "met"), ["h"]).where("c = 1").select("dk", "b", (F.col("b") + window).alias("e"))
    spans = whole.unionByName(one).unionByName(many).groupBy("dk").agg(F.collect_set(F.struct("b", "e")).alias("spans"))
    out = _written(spans, "spans")
    index.drop()
    for t in made:
        dropped(spark, spark.read.schema(_SUFFIX).option("recursiveFileLookup", "true").parquet(t) if isinstance(t, str) else t)
    return out


def _there(spark, path) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_SPAN = "array<struct<b: int, e: int>>"


def _joined(column):
    """Spans that overlap or touch as one, in order."""

    @F.pandas_udf(_SPAN)
    def merged(column: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None else [{"b": b, "e": e} for b, e in _merged(x)] for x in column])

    return merged(column)


def _remaining(text, spans, as_text: bool):
    """What is left of the texts whose spans are not null; the others are for the caller, so that their texts stay in the JVM."""

    @F.pandas_udf("string" if as_text else "binary")
    def remaining(texts: pd.Series, column: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, column):
            if text is None or cuts is None:
                out.append(None)
                continue
            t, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
            for b, e in _merged(cuts):
                parts.append(t[at:b])
                at = e
            left = b"".join([*parts, t[at:]])
            out.append(left.decode("utf-8", "ignore") if as_text else left)
        return pd.Series(out, dtype=object)

    every = F.coalesce(text, F.lit(""))
    return F.coalesce(remaining(F.when(spans.isNotNull(), text), spans), every if as_text else F.encode(every, "UTF-8"))


def _cut(docs: DataFrame, as_text: bool, **options) -> tuple[DataFrame, list[str]]:
    """docs with columns named c0, c1 and so on (also given), so that none clashes, and kept, spans, n_bytes. Only texts that lose
    something go to Python."""
    spans = repeats(docs.select("doc_id", "text"), **options).select(F.col("dk").alias("_dk"), F.col("spans").alias("_spans"))
    own = [f"c{i}" for i in range(len(docs.columns))]
    key = F.xxhash64("doc_id", "text").alias("_dk")
    d = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)), F.col("text").cast("string").alias("_text"), key)
    both = sized(d, spans, "_dk", how="left")
    kept = _remaining(F.col("_text"), F.col("_spans"), as_text)  # both functions see one step of Python
    n_bytes = F.octet_length(F.coalesce("_text", F.lit(""))).cast("long")
    return both.select(*own, kept.alias("kept"), _joined(F.col("_spans")).alias("spans"), n_bytes.alias("n_bytes")), own


def dedup(docs: DataFrame, keep: tuple[str, ...] = (), as_text: bool = False, **options) -> DataFrame:
    """doc_id, kept (the remaining bytes; as_text: without what a cut leaves of a character), spans removed, n_bytes of every
    document, and its columns in keep; those named like a result are not to be asked for."""
    if clash := {"kept", "spans", "n_bytes"} & set(keep):
        raise ValueError(f"results have the names {sorted(clash)}")
    cols = list(dict.fromkeys(("doc_id", *keep)))
    d, own = _cut(docs.select(*dict.fromkeys((*cols, "text"))), as_text, **options)
    return d.select(*(F.col(o).alias(c) for c, o in zip(cols, own)), "kept", "spans", "n_bytes")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs, whatever its columns, with what remains of each text; n_chars, if there is one, follows it."""
    d, own = _cut(docs, True, **options)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return d.select(*(new.get(c, F.col(o)).alias(c) for c, o in zip(docs.columns, own)))


def two_lengths(docs: DataFrame, window: int = 400, short: int = 200, gram: int = 200, short_gram: int = 100, **options) -> DataFrame:
    """doc_id, text, spans and spans_short of every document: what repeats at either length.

    Strings of `window` bytes that are met twice lie in documents of which as many bytes in a row repeat at the shorter
    length, so that only those are searched for them."""
    key = F.xxhash64("doc_id", "text").alias("dk")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), key)
    few = repeats(docs.select("doc_id", "text"), window=short, gram=short_gram, **options)
    few = _written(few.select("dk", _joined(F.col("spans")).alias("spans_short")), "spans")
    far = few.where(F.exists("spans_short", lambda x: x["e"] - x["b"] >= window)).select("dk")
    some = _written(sized(docs, _written(far, "far"), "dk", how="left_semi").select("doc_id", "text"), "some")
    long = repeats(some, window=window, gram=gram, **options)
    dropped(docs.sparkSession, some)
    return sized(docs, _written(few.join(long, "dk", "left"), "spans"), "dk", how="left").drop("dk")


def _bytes(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + (x["e"] - x["b"]))


def both_cuts(text, spans, short):
    """spans as one each, the hash of what they leave, and what the shorter ones leave as text: each text goes to Python once, and only
    the hash comes back of the first cut."""

    @F.pandas_udf(f"spans {_SPAN}, kept_sha256 string, text string")
    def cut(texts: pd.Series, spans: pd.Series, short: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, spans, short):
            if text is None:
                out.append((None, None, None))
                continue
            t, far = text.encode("utf-8", "surrogatepass"), _merged(a) if a is not None else []
            near = b"".join(_left(t, [(int(x["b"]), int(x["e"])) for x in b])) if b is not None else t
            kept = hashlib.sha256()
            for part in _left(t, far):
                kept.update(part)
            out.append(([{"b": x, "e": y} for x, y in far], kept.hexdigest(), near.decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["spans", "kept_sha256", "text"])

    return cut(F.when(spans.isNotNull() | short.isNotNull(), text), spans, short)


def _left(t: bytes, cuts: list[tuple[int, int]]):
    at = 0
    for b, e in cuts:
        yield t[at:b]
        at = e
    yield t[at:]


def op1_suffix_dedup(spark, sf_dir):
    """The contract's columns are those of 400 bytes; n_repeated_200 and text say what a cut at 200 bytes removes and leaves."""
    d = two_lengths(table(spark, sf_dir, "documents"))
    every, short = F.coalesce("text", F.lit("")), F.coalesce(_bytes(F.col("spans_short")), F.lit(0))
    d = d.select("doc_id", every.alias("own"), short.alias("n_repeated_200"), both_cuts(F.col("text"), F.col("spans"), F.col("spans_short")).alias("cut"))
    spans = F.coalesce("cut.spans", F.array().cast(_SPAN))
    return d.select(
        "doc_id", F.octet_length("own").cast("long").alias("n_bytes"), _bytes(spans).alias("n_removed"), F.size(spans).cast("long").alias("n_spans"),
        F.coalesce("cut.kept_sha256", F.sha2("own", 256)).alias("kept_sha256"), "n_repeated_200", F.coalesce("cut.text", "own").alias("text"),
    )
