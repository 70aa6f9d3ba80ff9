"""Quality classifier with hierarchical empirical Bayes.

Two logistic models (low quality, toxic) over text statistics and words give each document its evidence. They are fitted
on about `sample` labelled documents, at most twice that and 64 MB (one in so many by hash of doc_id; a document labelled twice counts as
the worse); everything else covers all rows. Expected good documents
are summed by path (source, lang) and by host (source). A host's share of good documents is shrunk toward the global
share, a path's toward its host's, each with a strength from the spread between groups (method of moments), so that
sparse sites follow their parents. A document's log-odds are its evidence's plus its path's shift from the global share.

Defined results: null and empty texts have zero statistics and no words; null source or lang are groups of their own;
without labels nothing is rejected; repeated rows are scored each; an empty table gives no rows; very long texts count
whole; further columns are ignored (or kept, by keep_good).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded, drawn, table, written

N_STATS = 12


def stats(b: bytes, words: list[bytes]) -> list[float]:
    """Statistics of a text, each between 0 and about 1."""
    n, w = max(1, len(b)), max(1, len(words))
    lines = [x for x in b.split(b"\n") if x.strip()]
    upper = len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(b) - len(b.translate(None, b"0123456789"))
    symbols = len(b) - len(b.translate(None, b"#$%&*@^_~=+<>{}[]\\/"))
    counts = Counter(words)
    top = counts.most_common(1)[0][1] / w if words else 0.0
    return [
        np.log1p(len(words)) / 12, symbols / n * 5, upper / n, digits / n, b.count(b"|") / w, b.count(b"!") / w,
        n / w / 20, len(counts) / w, top, 1 - len(set(lines)) / max(1, len(lines)), (b.count(b".") + b.count(b",")) / w, len(lines) / w,
    ]


def _flat(texts, vocab):
    """Statistics, and (row, word index) pairs of the distinct known words."""
    s, row, col = np.zeros((len(texts), N_STATS)), [], []
    get = vocab.get
    for i, t in enumerate(texts):
        b = t.encode() if t else b""
        words = b.split()
        s[i] = stats(b, words)
        ids = [j for j in map(get, set(b.lower().split())) if j is not None]
        row += [i] * len(ids)
        col += ids
    return s, np.array(row, np.int64), np.array(col, np.int64)


def fit(texts, targets, min_docs: int = 3, epochs: int = 150, rate: float = 0.2, decay: float = 1e-4):
    """Vocabulary, scaling and a weight vector (statistics, words, bias) for each target that has both kinds of labels."""
    df = Counter()
    for t in texts:
        df.update(set((t or "").encode().lower().split()))
    vocab = {w: i for i, w in enumerate(sorted(w for w, n in df.items() if n >= min_docs))}
    s, row, col = _flat(texts, vocab)
    mean, sd = (s.mean(0), s.std(0) + 1e-3) if len(s) else (np.zeros(N_STATS), np.ones(N_STATS))
    z, m, v = (s - mean) / sd, len(texts), len(vocab)
    heads = []
    for y in targets:
        y = np.asarray(y, float)
        w = np.zeros(N_STATS + v + 1)
        if not m or y.min() == y.max():
            w[-1] = 6.0 if m and y[0] else -6.0
        else:
            g2 = np.full_like(w, 1e-6)
            for _ in range(epochs):
                f = z @ w[:N_STATS] + np.bincount(row, w[N_STATS:-1][col], m) + w[-1]
                err = (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y) / m
                g = np.concatenate([z.T @ err, np.bincount(col, err[row], v), [err.sum()]]) + decay * w / max(1, v) ** 0.5
                g2 += g * g
                w -= rate * g / np.sqrt(g2)
        heads.append(w)
    return vocab, mean, sd, heads


def evidence(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """docs with low and toxic, the log-odds of the two models; only the text goes to Python, and two numbers come back."""
    spark = docs.sparkSession
    bounded(spark)
    lab = labels.where("doc_id is not null and quality is not null and toxic is not null")
    every = max(1, lab.count() // sample)
    lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.col("doc_id").alias("_id"), "quality", "toxic")
    lab = lab.groupBy("_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id")).limit(2 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("_id"))  # at most 2 * sample labels
    rows = drawn(rows, "_id", F.octet_length("text"), 2 * sample).select("text", "quality", "toxic").collect()
    model = fit([r.text for r in rows], [[r.quality == 0 for r in rows], [r.toxic == 1 for r in rows]])
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("low double, toxic double")
    def rate(text: pd.Series) -> pd.DataFrame:
        vocab, mean, sd, heads = held.value
        parts = []
        for a in range(0, len(text), 500):
            part = text.iloc[a : a + 500]
            s, row, col = _flat(part.tolist(), vocab)
            z = (s - mean) / sd
            parts.append(np.stack([z @ w[:N_STATS] + np.bincount(row, w[N_STATS:-1][col], len(part)) + w[-1] for w in heads], 1))
        return pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 2)), columns=["low", "toxic"])

    d = docs.withColumn("_e", rate(F.col("text")))
    return d.select(*docs.columns, F.col("_e.low").alias("low"), F.col("_e.toxic").alias("toxic"))


def _logit(p):
    return F.log(p / (1 - p))


def combine(scored: DataFrame) -> DataFrame:
    """scored with p_good, host_posterior, path_posterior, score and keep."""
    p = (1 / (1 + F.exp("low"))) * (1 / (1 + F.exp("toxic")))
    scored = scored.withColumn("p_good", p)
    path = scored.groupBy("source", "lang").agg(F.sum("p_good").alias("_g"), F.count("*").alias("_n"))

    def strength(groups, key):
        """Beta strength from group rates: m (1 - m) / between-group variance - 1, within bounds."""
        a = groups.agg((F.sum("_g") / F.sum("_n")).alias("_m"), (F.sum(F.col("_g") * F.col("_g") / F.col("_n")) / F.sum("_n")).alias("_s2"))
        var = F.greatest(F.col("_s2") - F.col("_m") * F.col("_m"), F.lit(1e-6))
        k = F.least(F.lit(1e4), F.greatest(F.lit(10.0), F.col("_m") * (1 - F.col("_m")) / var - 1))
        return a.select(F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), "_m")).alias("_m" + key), k.alias("_k" + key))

    host = path.groupBy("source").agg(F.sum("_g").alias("_g"), F.sum("_n").alias("_n"))
    h = host.crossJoin(F.broadcast(strength(host, "h")))  # one row
    h = h.select(F.col("source").alias("_hs"), ((F.col("_g") + F.col("_kh") * F.col("_mh")) / (F.col("_n") + F.col("_kh"))).alias("host_posterior"), "_mh")
    q = path.crossJoin(F.broadcast(strength(path, "p"))).join(h, F.col("source").eqNullSafe(F.col("_hs")))
    post = (F.col("_g") + F.col("_kp") * F.col("host_posterior")) / (F.col("_n") + F.col("_kp"))
    q = written(q.select(F.col("source").alias("_hs"), F.col("lang").alias("_hl"), "host_posterior", post.alias("path_posterior"), "_mh"), "sites")
    small = q.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("_hs"), F.lit(0)) + F.coalesce(F.octet_length("_hl"), F.lit(0)))).first()
    d = scored.join(F.broadcast(q) if small[0] * 64 + (small[1] or 0) <= 1_000_000 else q, F.col("source").eqNullSafe(F.col("_hs")) & F.col("lang").eqNullSafe(F.col("_hl")))
    odds = _logit(F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), "p_good"))) + _logit(F.col("path_posterior")) - _logit(F.col("_mh"))
    return d.withColumn("score", odds).withColumn("keep", F.col("score") >= 0).drop("_hs", "_hl", "_mh")


def judge(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """doc_id, source, lang, evidence, posteriors, score and keep of every document."""
    e = evidence(docs.select("doc_id", "source", "lang", "text"), labels, sample).drop("text")
    return combine(written(e, "evidence"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """The documents kept, with all their columns."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # so that none clashes with a column made here
    d = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)))
    d = d.withColumns({c: F.col(own[docs.columns.index(c)]) for c in ("doc_id", "text", "source", "lang")})
    d = combine(written(evidence(d, labels, sample).drop("doc_id", "text"), "evidence"))
    return d.where("keep").select(*(F.col(o).alias(c) for c, o in zip(docs.columns, own)))


def op9_quality(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
