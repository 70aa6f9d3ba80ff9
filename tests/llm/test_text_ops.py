"""Operators on documents against brute force, with nulls, blanks, copies, ties, clashing columns and empty tables."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrachron.llm import _text, lm_score, mixing, ngram_join, packing, quality, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, n int, spans int, low int, taken int, g int"


def docs_of(spark, texts):
    rows = [(i, t, "en" if i and i % 3 else None, None if i == 3 else f"s{(i or 0) % 3}", len(t or ""), 1, "k", 2, 3, 4, 5, 6) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["alpha", "beta,", "Gamma", "delta", "eps", "zeta", "etaé", "theta", "iota", "kappa", "lam", "mu"]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = make(60), make(30)
    out = [(0, base), (1, base), (2, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "one two"), (7, "one two")]
    for i in range(8, 30):
        w = base.split()
        for _ in range(i % 4):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append((i, " ".join(w)))
    for i in range(30, 45):
        out.append((i, make(r.randrange(1, 40)) + " " + passage + " " + make(r.randrange(1, 40))))
    out += [(45, "ab" * 200), (46, "ab" * 150 + "x"), (47, "é" * 90), (48, make(3000)), (0, base), (50, "one two")]
    return out


def brute_repeats(texts, window):
    every = [(i, (t or "").encode()) for i, t in texts]
    c = Counter(t[s : s + window] for _, t in every for s in range(len(t) - window + 1))
    out = []
    for i, t in every:
        gone = bytearray(len(t))
        for s in range(len(t) - window + 1):
            if c[t[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("wide", [20_000, 3])
def test_suffix_dedup(spark, texts, wide):
    d = suffix_dedup.dedup(docs_of(spark, texts).repartition(3), keep=("source",), window=24, gram=10, batches=5, wide=wide)
    removed = F.aggregate("spans", F.lit(0), lambda n, x: n + (x["e"] - x["b"]))
    got = d.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute_repeats(texts, 24)


@pytest.mark.parametrize("long,short", [(24, 12), (40, 20)])
def test_suffix_dedup_at_two_lengths(spark, texts, long, short):
    d = suffix_dedup.two_lengths(docs_of(spark, texts).repartition(3), long, short, gram=10, short_gram=6, batches=3)
    for column, window in (("spans", long), ("spans_short", short)):
        removed = suffix_dedup._bytes(suffix_dedup._joined(F.col(column)))
        kept = F.sha2(suffix_dedup._remaining(F.col("text"), F.col(column), False), 256)
        got = d.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))), removed, F.size(suffix_dedup._joined(F.col(column))), kept).collect()
        assert sorted(map(tuple, got)) == brute_repeats(texts, window)


def test_suffix_dedup_query(spark, tmp_path):
    """The registered query at its own lengths, with passages shorter and longer than 400 bytes and cuts inside characters."""
    r = random.Random(9)
    word = lambda n: " ".join("".join(r.choice("abcdefghijé") for _ in range(r.randrange(2, 9))) for _ in range(n))
    long, short = word(120), word(48)
    rows = [(i, word(r.randrange(1, 90)) + " " + ([long, short, short + " " + long, ""][i % 4]) + " " + word(r.randrange(1, 90))) for i in range(40)]
    rows += [(40, rows[1][1]), (41, None), (42, ""), (43, "é" * 500), (44, "x"), (1, rows[1][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == brute_repeats(rows, 400)
    cut = brute_repeats(rows, 200)
    assert sorted((x.doc_id, x.n_repeated_200) for x in got) == sorted((c[0], c[2]) for c in cut)
    assert sum(x.n_repeated_200 > x.n_removed for x in got) > 5 and all((x.text == (dict(rows)[x.doc_id] or "")) == (x.n_repeated_200 == 0) for x in got)


def test_suffix_dedup_leaves_no_tables_but_its_spans(spark, texts, tmp_path, monkeypatch):
    import os

    from terrachron.llm import _util

    monkeypatch.setattr(_util, "shared_dir", lambda spark: str(tmp_path))
    suffix_dedup.repeats(docs_of(spark, texts).select("doc_id", "text"), window=24, gram=10)
    assert {x.split("-")[0] for x in os.listdir(tmp_path) if any(f.endswith(".parquet") for _, _, fs in os.walk(f"{tmp_path}/{x}") for f in fs)} == {"spans"}


def test_index_levels_grow_by_doubling(spark):
    index, rows = suffix_dedup.SuffixIndex(), "g long, ctx long, dk long, s int, o short, r short"
    from terrachron.llm._util import written

    for i in range(5):
        hits = index.add(written(spark.createDataFrame([(i % 4, 1, i, 0, 0, 0), (100 + i, 1, i, 5, 0, 0)], rows)))
        assert [r.g for r in hits.collect()] == ([0] if i == 4 else [])
    assert [n for n, _ in index.levels] == [4, 1]
    assert index.repeated().count() == 2


def shingle_set(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_classes(texts, k, percent):
    ids = [i for i, _ in texts]
    sets = [shingle_set(t, k) for _, t in texts]
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y, key=lambda z: ids[z])] = min(x, y, key=lambda z: ids[z])
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), least[find(i)]) for i in range(len(ids)))


@pytest.mark.parametrize("k,percent,hot,block", [(3, 90, 64, 768), (5, 80, 3, 4), (1, 60, 2, 3)])
def test_ngram_join(spark, texts, k, percent, hot, block):
    got = ngram_join.classes(docs_of(spark, texts).repartition(4), k, percent, hot=hot, block=block).collect()
    assert sorted(map(tuple, got)) == brute_classes(texts, k, percent)


def test_prefixes_share_enough():
    r = np.random.default_rng(1)
    counts = r.integers(0, 50, 1 << ngram_join.BITS)
    for _ in range(200):
        x = np.unique(r.integers(0, 1 << 63, 80, np.uint64))
        y = np.unique(np.append(r.choice(x, 70, replace=False), r.integers(0, 1 << 63, 3, np.uint64)))
        percent = 100 * len(np.intersect1d(x, y)) // len(np.union1d(x, y))
        (p, at, l), (q, bt, m) = (ngram_join.prefix(s, counts, 5.0, percent, 4) for s in (x, y))
        low = min(l, m)
        assert len(np.intersect1d(p[at <= low], q[bt <= low])) >= low


def test_mixing_equals_sql(spark, texts):
    d = docs_of(spark, texts)
    got = mixing.mix(d).toPandas()
    documents = d.toPandas()  # noqa: F841  (DuckDB reads it by name)
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(mixing.SQL).df()
    key = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).values.tolist()))
    assert key(got) == key(want)
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(t=("target", "first"), k=("taken", "sum"), s=("source_size", "first"))
    assert (abs(by.t - by.k) <= 16 + 0.02 * by.t).all() and (by.t <= 3 * by.s).all()


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*texts, (60, "a <|endoftext|> b")]
    got = packing.pack(docs_of(spark, texts), path, capacity=64, bucket_rows=10).toPandas()
    tk = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == want
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
    assert g.groupby("sequence_id").length.sum().max() <= 64


@pytest.mark.parametrize("seed", range(8))
def test_packing_counts(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 101, 300) if seed % 2 else r.integers(20, 60, 300)
    counts = dict(Counter(sizes.tolist()))
    slots, n = packing.pack_counts(counts, 100)
    fill, ranks = Counter(), {s: [] for s in counts}
    for size, rank, bins, each, first, offset in slots:
        ranks[size] += range(rank, rank + bins * each)
        for b in range(bins):
            for k in range(each):
                fill[first + b] += size
    assert all(sorted(ranks[s]) == list(range(c)) for s, c in counts.items())
    assert max(fill.values()) <= 100 and len(fill) == n
    assert n <= math.ceil(sizes.sum() / 100 * 1.08) + 2


def test_lm_score(spark, texts):
    got = lm_score.score(docs_of(spark, texts), bits=(10, 12, 12, 14, 14), sample=500, frequent=4).collect()
    tok = [(i, [*(t or "").encode().lower().split(), None]) for i, t in texts]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(x for i, w in tok if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in tok)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(-1e6 < r.score < 0 for r in got)
    assert len({(r.doc_id, round(r.score, 9)) for r in got if r.doc_id == 0}) == 1


def test_long_unseen_words_cost_their_length(spark, texts):
    ids = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    r = random.Random(9)
    made = {i: "".join(r.choice("qwxyz0123456789") for _ in range(2000 * 2**k)) for k, i in enumerate(ids)}
    got = lm_score.score(docs_of(spark, [*texts, *made.items()]), bits=(10, 12, 12, 14, 14), sample=500, frequent=4)
    got = {x.doc_id: x for x in got.where(F.col("doc_id").isin(ids)).collect()}
    a, b, c = (got[i].score for i in ids)
    assert all(x.held_out and x.n_known == 1 for x in got.values()) and a < -1000
    assert 1.9 < b / a < 2.1 and 1.9 < c / b < 2.1


def test_spelling_is_a_distribution():
    words = [b"", b"ab", b"ba", b"aab", b"b"] * 3
    bits = (8, 8, 10, 10, 10)
    t = [np.zeros(2 << k) for k in bits]
    codes, _, place = lm_score.grams(words)
    for cells, bit in lm_score.steps(codes, bits):
        for o in range(lm_score.ORDERS):
            np.add.at(t[o], cells[o] * 2 + bit.astype(np.int64), np.bincount(place))
    m = lm_score.Mixer([lm_score.packed(x) for x in t], bits)
    m.learn(sorted(set(words)))
    total = [sum(10 ** m.score([b"", *(bytes([a]) for a in range(256) if a != 32)]))]
    two = [bytes([a, b]) for a in range(256) for b in range(256) if a != 32 and b != 32]
    total.append(total[0] + (10 ** m.score(two)).sum())
    assert 0 < total[0] < total[1] <= 1 + 1e-9
    assert (lm_score.packed(np.array([400_000.0, 1.0, 65_536.0, 0.0])) == [65535, 1, 65535, 0]).all()


def test_mixer_inputs_are_the_plain_ones_for_less():
    r = np.random.default_rng(1)
    bits, n = (10, 12, 12, 14, 14), 25_000
    m = lm_score.Mixer([lm_score.packed(r.choice([0, 1, 2, 3, 9, 10, 400, 70_000], 2 << b).astype(float)) for b in bits], bits)
    cells, bit = np.stack([r.integers(0, 1 << b, n) for b in bits]), r.integers(0, 2, n).astype(float)

    def plain(cells, bit=None):
        n = np.stack([m.t[o].reshape(-1, 2)[c] for o, c in enumerate(cells)]).astype(float)
        if bit is not None:
            at, w = bit.astype(int), np.arange(len(bit))
            for o in range(lm_score.ORDERS):
                n[o, w, at] = np.maximum(0, n[o, w, at] - (n[o].max(1) < 65535))
        seen = np.searchsorted((1, 2, 4, 10, 100, 1000), n.sum(2), "right")
        gate = seen[-1] * 3 + np.minimum(2, (seen[-3] + 2) // 3)
        return np.log((n[..., 1] + 0.02) / (n[..., 0] + 0.02)), (gate * 5 + np.arange(5)[:, None]) * 7 + seen, gate

    for b in (None, bit):
        got, want = m.inputs(cells, b), plain(cells, b)
        assert np.allclose(got[0], want[0], rtol=0, atol=1e-12) and (got[1] == want[1]).all() and (got[2] == want[2]).all()

    def seconds(f):
        t = time.process_time()
        f(cells, bit)
        return time.process_time() - t

    assert min(seconds(m.inputs) for _ in range(9)) < 0.7 * min(seconds(plain) for _ in range(9))


def test_lm_learns_from_every_word(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abcdefg") for _ in range(r.randrange(2, 9))).encode() for _ in range(600)})
    bits = (8, 10, 10, 12, 12)
    t = [np.zeros(2 << k, np.float32) for k in bits]
    codes, _, place = lm_score.grams(words)
    for cells, bit in lm_score.steps(codes, bits):
        for o in range(lm_score.ORDERS):
            np.add.at(t[o], cells[o] * 2 + bit.astype(np.int64), np.bincount(place))
    held = spark.sparkContext.broadcast([lm_score.packed(x) for x in t])

    def learned(words):
        d = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").repartition(3)
        return lm_score.learned(d, 600, held, bits, 100)

    state, n = learned(words)
    assert n == len(words) and (learned(words)[0] == state).all()
    for w in r.sample(words, 3):
        less, m = learned([x for x in words if x != w])
        assert m == n - 1 and abs(less - state).max() > 0


def test_lm_slices_do_not_cost_the_unseen(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice(x) for x in ("bdfgk", "aeiou", "lmnr", "aeiou", "pst")[: r.randrange(2, 6)])
    d = docs_of(spark, [(i, " ".join(word() for _ in range(60))) for i in range(100)])
    few, every = (lm_score.score(d, bits=(10, 12, 12, 14, 14), sample=s).where("held_out").agg(F.sum("score")).first()[0] for s in (40, 100_000))
    assert few > 1.01 * every


def coded_by(tree, tables, far, contexts, w, leaf):
    """Logarithm of a leaf's probability, bit by bit."""
    total = 0.0
    for i in range(tree.size[leaf]):
        cells, bit, _ = tree.coded(np.array([leaf]), [np.array([c]) for c in contexts], far)
        zero, one = zip(*((int(t[c[i]]) & 63, int(t[c[i]]) >> 6) for t, c in zip(tables, cells)))
        value = lambda q: np.flatnonzero(lm_score._QUANT == q).mean()
        zero, one = [value(q) for q in zero], [value(q) for q in one]
        seen = [sum(a + b >= x for x in (1, 2, 4, 10, 100, 1000)) for a, b in zip(zero, one)]
        gate = seen[-1] * 3 + min(2, (seen[-2] + 2) // 3)
        weights, bias = w[0, : -lm_score.GATES].reshape(lm_score.GATES, len(far), 7), w[0, -lm_score.GATES :]
        z = bias[gate] + sum(weights[gate, o, k] * math.log((b + 0.02) / (a + 0.02)) for o, (k, a, b) in enumerate(zip(seen, zero, one)))
        total -= math.log1p(math.exp(-z if bit[i] else z))
    return total


def test_tree_codes_every_bit():
    r = np.random.default_rng(5)
    tree, far = lm_score.Tree([90, 1, 1, 40, 7, 7, 7, 3, 2, 1, 1, 30]), (8, 10, 10)
    assert sum(0.5**tree.size) == 1 and tree.size[0] < tree.size[4] < tree.size[1]
    ids, size = r.integers(0, 12, 3000), np.array([1000, 1, 1999])
    ctx = lm_score.contexts(ids, np.zeros(3000, np.uint8), size, 2)
    assert ctx[2][1000] == ctx[2][1001] == ctx[2][0] and len(set(ctx[2].tolist())) > 100
    t = [np.zeros(2 << k, np.float32) for k in far]
    cells, bit, _ = tree.coded(ids, ctx, far)
    for o, c in enumerate(cells):
        np.add.at(t[o], c * 2 + bit, 1)
        assert t[o].sum() == tree.size[ids].sum()
    t = [lm_score.coarse(x) for x in t]
    m = lm_score.TextMixer(tree, t, far)
    m.learn(ids, ctx, np.ones(3000, np.int64))
    every = np.array([m.score(np.full(3000, x), ctx) for x in range(12)])
    assert abs(np.exp(every).sum(0) - 1).max() < 1e-5
    for i in (0, 1, 1000, 2500):
        assert abs(every[ids[i], i] - coded_by(tree, t, far, [c[i] for c in ctx], m.x, ids[i])) < 1e-4


def test_tree_counts_and_scores_by_groups_are_the_plain_ones_for_less():
    r = np.random.default_rng(7)
    tree, far = lm_score.Tree((1e6 / np.arange(1, 5001)).astype(int).tolist()), (12, 14, 14)
    ids = np.minimum(r.zipf(1.3, 40_000), 5000) - 1
    ctx, times = lm_score.contexts(ids, r.integers(0, 3, 40_000).astype(np.uint8), np.array([40_000]), 2), r.integers(1, 5, 40_000)

    def plain(t):
        for e in lm_score.pieces(40_000):
            cells, bit, size = tree.coded(ids[e], [c[e] for c in ctx], far)
            for x, c in zip(t, cells):
                np.add.at(x, c * 2 + bit, np.repeat(times[e].astype(np.float32), size))

    def grouped(t):
        for e in lm_score.pieces(40_000):
            tree.count(t, ids[e], [c[e] for c in ctx], far, times[e])

    def seconds(f):
        s = time.process_time()
        f([np.zeros(2 << k, np.float32) for k in far])
        return time.process_time() - s

    a, b = ([np.zeros(2 << k, np.float32) for k in far] for _ in range(2))
    plain(a), grouped(b)
    assert all((x == lm_score.spread(y)).reshape(-1, 32)[:, 2:].all() for x, y in zip(a, b))
    assert min(seconds(grouped) for _ in range(5)) < 0.7 * min(seconds(plain) for _ in range(5))

    t = [lm_score.coarse(x) for x in a]
    m = lm_score.TextMixer(tree, t, far)
    m.learn(ids, ctx, times)
    got = m.score(ids[:300], [c[:300] for c in ctx])
    assert abs(got - [coded_by(tree, t, far, [c[i] for c in ctx], m.x, ids[i]) for i in range(300)]).max() < 1e-4


def test_words_by_columns_are_those_of_each_text():
    texts = ["Ab c", None, "", "c", "c\x0bÉé \x00\t", " ab", "x" * 50, "c\x85d\x1cE", "ab"]
    for some in (texts, texts[2:8], [None, ""], ["b"]):
        batch = pa.RecordBatch.from_pydict({"n": list(range(len(some))), "text": pa.array(some, pa.string())})
        for most in (5, 1000):
            got, rows = [], []
            for part in _text.portions(batch.slice(0), most):
                place, distinct, size = _text.encoded(part["text"])
                w, ends = distinct.take(pa.array(place)).to_pylist(), np.cumsum(size).tolist()
                got += [w[b - n : b] for b, n in zip(ends, size.tolist())]
                rows += part["n"].to_pylist()
                assert len(part) == 1 or len("".join(t or "" for t in part["text"].to_pylist()).encode()) <= most
            assert rows == list(range(len(some))) and got == [[*_text.words(t), b""] for t in some]
    assert list(_text.portions(batch.slice(0, 0))) == []
    cut = _text.encoded(pa.array(texts).slice(3, 4))
    assert cut[1].take(pa.array(cut[0])).to_pylist() == [x for t in texts[3:7] for x in (*_text.words(t), b"")]


def test_lm_word_order_counts(spark):
    r = random.Random(8)

    def text():
        at, w = 0, []
        for _ in range(60):
            at = (at + r.choice((1, 3))) % 8
            w.append("abcdefgh"[at] * 3)
        return w

    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = {i: text() for i in range(500)}
    mixed = {1000 + k: r.sample(rows[i], len(rows[i])) for k, i in enumerate(held)}
    ids = iter(i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0)
    mixed = {next(ids): w for w in mixed.values()}
    got = lm_score.score(docs_of(spark, [(i, " ".join(w)) for i, w in (rows | mixed).items()]), bits=(10, 12, 12, 14, 14), sample=500, far=(12, 14, 14))
    got = {x.doc_id: x for x in got.collect()}
    for a, b in zip(held, mixed):
        assert got[a].held_out and got[b].held_out and abs(got[a].base_score - got[b].base_score) < 1e-6
        assert got[a].score > 0.7 * got[b].score and got[a].score > 0.6 * got[a].base_score


def test_quality(spark):
    r = random.Random(2)
    make = lambda bad, toxic: " ".join(r.choice(["river", "stone", "field", "light"]) + ("$$$" if bad else "") for _ in range(60)) + (" idiot trash" if toxic else "")
    kinds = [(i % 5 == 0, i % 7 == 0) for i in range(300)]
    d = docs_of(spark, [*((i, make(*k)) for i, k in enumerate(kinds)), (400, None), (401, "")])
    lab = spark.createDataFrame([(i, int(not b), int(t)) for i, (b, t) in enumerate(kinds) if i % 2] + [(None, 1, 1), (9999, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.keep for x in quality.judge(d, lab).collect()}
    assert len(got) == 302
    assert sum(got[i] == (not b and not t) for i, (b, t) in enumerate(kinds)) >= 298
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {i for i, k in got.items() if k}
    assert all(x.keep for x in quality.judge(d, lab.limit(0)).collect())


def test_shrinkage_follows_group_size(spark):
    rows = [("a", "x", 9.0, -9.0)] * 1000 + [("b", "x", -9.0, -9.0)] * 1000 + [("c", "x", 9.0, -9.0)]
    d = quality.combine(spark.createDataFrame(rows, "source string, lang string, low double, toxic double"))
    p = {r.source: r.host_posterior for r in d.select("source", "host_posterior").distinct().collect()}
    assert p["a"] < 0.05 < p["c"] < p["b"] and p["b"] > 0.95


def test_empty_tables(spark):
    d = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    import public_tokenizers

    assert suffix_dedup.dedup(d).count() == 0
    assert ngram_join.classes(d).count() == 0
    assert mixing.mix(d).count() == 0
    assert packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert lm_score.score(d, bits=(8, 8, 8, 8, 8)).count() == 0
    assert quality.judge(d, labels).count() == 0
    assert pd.DataFrame(d.collect()).empty


def fewest(sizes, c):
    """The least number of bins, by trying."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] >= sizes[i]:
                go(i + 1, [*bins[:k], bins[k] - sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, c - sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    r = random.Random(7)
    for _ in range(150):
        c = r.randrange(6, 20)
        sizes = sorted((r.randrange(1, c + 1) for _ in range(r.randrange(1, 9))), reverse=True)
        p = packing._Packer(Counter(sizes), c)
        p.reduce()
        left = [s for s, n in p.left.items() for _ in range(n)]
        assert p.sequences + fewest(sorted(left, reverse=True), c) == fewest(sizes, c)


def test_quality_posteriors(spark):
    """Posteriors and scores from the evidence, by hand, with sources and languages that are null, sparse or common."""
    r = random.Random(3)
    word = lambda bad: r.choice(["zap$$", "junk##"] if bad else ["fine", "good", "text"])
    rows = []
    for i in range(300):
        source, lang = r.choice(["a", "a", "a", "b", None]) if i % 50 else f"rare{i}", r.choice(["en", "de", None])
        bad = r.random() < (0.7 if source == "b" else 0.2)
        rows.append((i, " ".join(word(bad) for _ in range(30)), lang, source, int(not bad)))
    d = spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(x[0], x[4], 0) for x in rows if x[0] % 3 == 0], "doc_id long, quality int, toxic int")
    got = quality.judge(d, labels).toPandas().sort_values("doc_id")
    p = 1 / (1 + np.exp(got.low)) / (1 + np.exp(got.toxic))
    host, path = got.source.fillna("?"), got.source.fillna("?") + "|" + got.lang.fillna("?")

    def shrunk(group, prior):
        n, g = p.groupby(group).count(), p.groupby(group).sum()
        m = g.sum() / n.sum()
        k = min(1e4, max(10.0, m * (1 - m) / max((g * g / n).sum() / n.sum() - m * m, 1e-6) - 1))
        return group.map((g + k * (m if prior is None else group.map(dict(zip(group, prior))).groupby(group).first())) / (n + k)), m

    h, m = shrunk(host, None)
    q, _ = shrunk(path, h)
    logit = lambda x: np.log(x / (1 - x))
    assert np.allclose(got.host_posterior, h) and np.allclose(got.path_posterior, q)
    assert np.allclose(got.score, logit(p.clip(1e-9, 1 - 1e-9)) + logit(q) - logit(m))
    assert (got.keep == (got.score >= 0)).all() and 0 < got.keep.sum() < len(got)
