"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

Equal shingle sets are one class. Shingles are ordered by a fixed-size table of corpus counts, then hash: rare first. For
similarity t a set of n has n - ceil(t n) + l first shingles, and two similar sets share at least l of them, for any l. Each
set takes the l with the least estimated cost: reading its posting lists, plus verifying at most (postings / l)
candidates. Two sets meet with the smaller of their l: sharing that many makes a candidate pair. Posting lists of over
`hot` sets are not paired up: their members only become one candidate group. Candidate groups are verified whole, in
blocks of about `block` shingles (and 768 sets at most) in order of size, of which only those near in size meet. No cap applies: every pair of similar
sets shares a candidate group.

Defined results: null and empty texts, and those without words, have the empty set and link with nothing; shorter texts are
one shingle; repeated rows and copies share a class; a text without doc_id links others and takes the component of those it links
with, null if none has a doc_id; ties in the order fall to the hash; an empty table gives no
rows; further columns are ignored. A class is named by a 64-bit hash of its shingles.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import WordHashes, shingles
from ._util import bounded, sized, sliced, table, written
from .graph import components

BITS = 20  # of the table of counts: 4 or 8 MB whatever the corpus
_PART = 1 << 16


def _key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BITS)).astype(np.int64)


def _first_pass(k: int):
    """Per document its set's size and class; at the end of a partition its counts, in parts."""

    def run(batches):
        cache, seen, counts = WordHashes(), set(), np.zeros(1 << BITS, np.int64)
        for b in batches:
            n, key = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for i, t in enumerate(b["text"].tolist()):
                s = shingles(t, k, cache)
                n[i] = len(s)
                if len(s):
                    key[i] = x = _key(s)
                    if x not in seen:
                        seen.add(x)
                        np.add.at(counts, _slot(s), 1)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n": n, "key": key, "part": -1, "counts": None})
        if seen:
            for p in range(0, 1 << BITS, _PART):
                packed = zlib.compress(counts[p : p + _PART].astype("<u4").tobytes(), 1)
                yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "n": 0, "key": 0, "part": p // _PART, "counts": [packed]})

    return run


def _sum_parts(batches):
    """Streams the parts of a partition into sums, so that memory doesn't follow their number."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for p, c in zip(b["part"], b["counts"]):
            x = np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64)
            total[p] = total[p] + x if p in total else x
    for p, x in total.items():
        yield pd.DataFrame({"part": [p], "counts": [x.astype("<i8").tobytes()]})


def prefix(s: np.ndarray, counts: np.ndarray, noise: float, percent: int, levels: int):
    """(shingles of the chosen prefix, the level from which each counts, chosen level)."""
    n = len(s)
    need = -(-percent * n // 100)
    c = counts[_slot(s)]
    order = np.lexsort((s, c))[: n - need + levels]
    s, c = s[order], np.maximum(0.0, c[order] - noise)
    base, top = n - need, min(levels, need)
    total = np.cumsum(c)
    cost = [total[min(base + l, len(s)) - 1] * (1 + n / 16 / l) for l in range(1, top + 1)]
    l = int(np.argmin(cost)) + 1
    s = s[: base + l]
    return s, np.maximum(1, np.arange(len(s)) - base + 1), l


def _postings(k: int, percent: int, levels: int, held):
    def run(batches):
        counts, noise = held.value
        cache, seen = WordHashes(), set()
        for b in sliced(batches, 2000):
            out = []
            for t in b["text"].tolist():
                s = shingles(t, k, cache)
                if not len(s) or (key := _key(s)) in seen:
                    continue
                seen.add(key)
                p, at, l = prefix(s, counts, noise, percent, levels)
                m = len(p)
                out.append((p.view(np.int64), np.full(m, key), np.full(m, len(s), np.int32), at.astype(np.int8), np.full(m, l, np.int8), np.full(m, m, np.int32)))
            if out:
                yield pd.DataFrame(dict(zip(("token", "key", "n", "at", "l", "p"), map(np.concatenate, zip(*out)))))

    return run


def _pairs(percent: int, hot: int):
    """From postings sorted by token: pairs of short lists, links to the first of long lists (need 0). Of a pair: whether the
    match counts at the pair's level, the matches needed there, and those needed over the whole prefixes: in one of the two
    sets, that whose prefix ends first, all prefix shingles but as many as the overlap lets go must be in the other."""

    def emit(d, start):
        """d: whole lists, but that `start` says the first list's first key where it began before."""
        token, key, n, at, l, p = (d[c].to_numpy().astype(np.int64) for c in ("token", "key", "n", "at", "l", "p"))
        new = np.append(True, token[1:] != token[:-1])
        run = np.cumsum(new) - 1
        first, size = np.flatnonzero(new), np.bincount(run)
        long = size > hot
        if start is not None:
            long[0] = True
        out = []
        cold = np.flatnonzero(~long[run] & (size[run] > 1))
        for step in range(1, hot):
            a = cold[:-step] if step < len(cold) else cold[:0]
            b = cold[step:]
            if not len(a):
                break
            ok = run[a] == run[b]
            if not ok.any():
                break
            a, b = a[ok], b[ok]
            lv = np.minimum(l[a], l[b])
            ok = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b, lv = a[ok], b[ok], lv[ok]
            least = -(-percent * (n[a] + n[b]) // (100 + percent))  # overlap of similar sets
            every = np.minimum(p[a] - (n[a] - least), p[b] - (n[b] - least))
            out.append((key[a], key[b], ((at[a] <= lv) & (at[b] <= lv)).astype(np.int64), lv, every))
        h = np.flatnonzero(long[run])
        if len(h):
            head = key[first].copy()
            if start is not None:
                head[0] = start
            none = np.zeros(len(h), np.int64)
            out.append((key[h], head[run[h]], none, none, none))
        if out:
            return pd.DataFrame(dict(zip(("u", "v", "counts", "need", "every"), map(np.concatenate, zip(*out)))))

    def run(batches):
        carry, start = None, None
        for b in batches:
            d = b if carry is None else pd.concat([carry, b], ignore_index=True)
            d = d[~((d.token == d.token.shift()) & (d.key == d.key.shift()))].reset_index(drop=True)
            tail = int(np.searchsorted(d.token.to_numpy(), d.token.iloc[-1]))
            last = d.iloc[tail:]
            if len(last) > hot or tail == 0 and start is not None:  # a long list passes through in parts
                now, carry = d, last.iloc[-1:]
                then = start if tail == 0 and start is not None else last.key.iloc[0]
            else:
                now, carry, then = d.iloc[:tail], last, None
            if len(now) and (r := emit(now.reset_index(drop=True), start)) is not None:
                yield r
            start = then
        if carry is not None and len(carry) and (r := emit(carry.reset_index(drop=True), start)) is not None:
            yield r

    return run


def linked(sets: list[np.ndarray], percent: int, chunk: int = 4096) -> np.ndarray:
    """Matrix of which of these sets are similar, exactly."""
    n = np.array([len(s) for s in sets], np.float64)
    if len(sets) == 2:
        both = np.array([[n[0], len(np.intersect1d(*sets, assume_unique=True))], [0, n[1]]])
        both[1, 0] = both[0, 1]
    else:
        _, inv, cnt = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n.astype(int))
        ok = cnt[inv] > 1
        row, col = row[ok], (np.cumsum(cnt > 1) - 1)[inv[ok]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(sets), len(sets)))
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, chunk):
            a, b = np.searchsorted(col, (c, c + chunk))
            m = np.zeros((len(sets), chunk), np.float32)
            m[row[a:b], col[a:b] - c] = 1
            both += m @ m.T
    return 100 * both >= percent * (n[:, None] + n[None] - both)


def _verify(percent: int):
    """Groups come sorted; links of each, as stars to the smallest class of its parts."""

    def stars(keys, sets):
        keys, at = np.unique(np.array(keys, np.int64), return_index=True)
        if len(keys) < 2:
            return None
        link = linked([sets[i] for i in at], percent)
        np.fill_diagonal(link, True)
        label = np.arange(len(keys))
        while True:
            new = np.where(link, label[None], len(keys)).min(1)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        far = np.flatnonzero(label != np.arange(len(keys)))
        return pd.DataFrame({"u": keys[far], "v": keys[label[far]]}) if len(far) else None

    def run(batches):
        now, keys, sets = None, [], []
        for b in batches:
            for g, i, j, key, s in zip(b["g"].tolist(), b["i"].tolist(), b["j"].tolist(), b["key"].tolist(), b["tokens"].tolist()):
                if (g, i, j) != now:
                    if len(keys) > 1 and (r := stars(keys, sets)) is not None:
                        yield r
                    now, keys, sets = (g, i, j), [], []
                keys.append(key)
                sets.append(np.frombuffer(s, np.uint64))
        if len(keys) > 1 and (r := stars(keys, sets)) is not None:
            yield r

    return run


def classes(docs: DataFrame, k: int = 5, percent: int = 80, levels: int = 4, hot: int = 64, block: int = 384_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; similar: 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    bounded(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = written(docs.mapInPandas(_first_pass(k), "doc_id long, n long, key long, part int, counts binary"), "sets")
    t = first.where("part = -1").select("doc_id", "n", "key")
    parts = first.where("part >= 0").select("part", "counts").repartition((1 << BITS) // _PART, "part").mapInPandas(_sum_parts, "part int, counts binary").collect()
    counts = np.zeros(1 << BITS, np.int64)
    for r in parts:  # a table of fixed size
        counts[r.part * _PART : (r.part + 1) * _PART] = np.frombuffer(r.counts, "<i8")
    held = spark.sparkContext.broadcast((counts, float(counts.mean())))
    post = docs.select("text").mapInPandas(_postings(k, percent, levels, held), "token long, key long, n int, at byte, l byte, p int")
    post = post.repartition("token").sortWithinPartitions("token", "key")
    met = written(post.mapInPandas(_pairs(percent, hot), "u long, v long, counts int, need int, every int"), "met")
    met = met.where("u != v").groupBy("u", "v").agg(F.sum("counts").alias("c"), F.count("*").alias("k"), F.min("need").alias("need"), F.min("every").alias("every"))
    cand = components(met.where("c >= need and k >= every").select("u", "v")).select(F.col("node").alias("key"), F.col("component").alias("g"))
    # blocks of each candidate group, and which of them are near enough in size
    reps = t.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    cand = cand.join(reps, "key")
    weight = F.sum(F.col("n") + block // 768).over(Window.partitionBy("g").orderBy("n", "key"))
    cand = written(cand.withColumn("i", F.floor(weight / block)), "cand")
    b = cand.groupBy("g", "i").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    c = b.select("g", F.col("i").alias("j"), F.col("lo").alias("lo2"))
    meet = b.join(c, "g").where(f"i <= j and 100 * hi >= {percent} * lo2").select("g", "i", "j")
    own = meet.select("g", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("b"))
    to = cand.withColumnRenamed("i", "b").join(own, ["g", "b"]).select("g", "i", "j", "key")
    need = cand.where("doc_id is not null").select("doc_id", "key")

    def sets(batches):
        cache = WordHashes()
        for x in sliced(batches, 500):
            s = [shingles(y, k, cache) for y in x["text"].tolist()]
            names = [_key(y) if len(y) else None for y in s]
            ok = [a is not None and (b is None or pd.isna(b) or a == b) for a, b in zip(names, x["key"])]
            yield pd.DataFrame({"key": pd.array(names, "Int64"), "tokens": [y.tobytes() for y in s]})[ok]

    shape = "key long, tokens binary"
    tokens = sized(docs, need, "doc_id").select("key", "text").mapInPandas(sets, shape)
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("key"), "text").mapInPandas(sets, shape)  # known by their sets alone
    tokens = tokens.unionByName(nameless.join(cand.where("doc_id is null").select("key"), "key", "left_semi").dropDuplicates(["key"]))
    groups = to.join(tokens, "key").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "key")
    links = components(groups.mapInPandas(_verify(percent), "u long, v long"))
    low = links.withColumnRenamed("node", "key").join(reps.select("key", "doc_id"), "key")
    least = low.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = reps.join(links.withColumnRenamed("node", "key").join(least, "component").select("key", "component_id"), "key", "left")
    named = named.select("key", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = t.join(named, (t["key"] == named["key"]) & (t["n"] > 0), "left")
    return out.select("doc_id", t["n"].alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_ngram_join(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"), k=3, percent=90)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.d)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = documents.doc_id
"""
