"""Approximate nearest neighbours with learned partitions.

On a sample of about `sample` vectors the neighbour graph is built and cut into balanced parts by recursive bisection
(power iteration for the split, then swaps of the nodes with most neighbours on the other side). A small network learns
each vector's part. Every row is indexed under its most probable part; a query goes to its `probes` most probable parts, whose
rows are ranked exactly. The number of probes is the least that reaches `recall` on held-back sample queries by brute
force over the sample. Parts of many rows are dealt into blocks, so that no task holds more than about `block` rows.

Defined results: vectors that are null, all zero, hold null or non-finite components, or differ in length from most, take no
part, neither as queries nor as candidates; a query never finds its own row; repeated rows are candidates each, but rows
with the query's id are its own; ties go to the smaller vec_id; an empty table gives no rows; fewer candidates than k give
what there is; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import bounded, table, written


def usable(rows: DataFrame) -> DataFrame:
    """Rows with v, the vector in double precision, where it can take part."""
    v = rows.where("vec_id is not null").withColumn("v", F.col("embedding").cast("array<double>"))
    ok = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("v").isNotNull() & ok).drop("embedding")
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("v") == (size[0].n if size else 0))


def stacked(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest of each row, by inner product."""
    k, out = min(k, len(x) - 1), []
    for a in range(0, len(x), 256):
        s = x[a : a + 256] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, 1)[:, :k])
    return np.concatenate(out)


def bisected(nbrs: np.ndarray, parts: int, rng) -> np.ndarray:
    """Balanced parts of the neighbour graph."""
    label = np.zeros(len(nbrs), np.int64)

    def split(nodes, first, parts):
        if parts < 2 or len(nodes) < 2:
            label[nodes] = first
            return
        at = np.full(len(nbrs), -1)
        at[nodes] = np.arange(len(nodes))
        local = at[nbrs[nodes]]
        inside = local >= 0
        deg = np.maximum(1, inside.sum(1))
        x = rng.standard_normal(len(nodes))
        for _ in range(40):
            x = 0.5 * x + 0.5 * (x[local] * inside).sum(1) / deg
            x -= x.mean()
            x /= np.linalg.norm(x) + 1e-30
        left, half = parts // 2, len(nodes) * (parts // 2) // parts
        side = np.zeros(len(nodes), bool)
        side[np.argsort(x, kind="stable")[half:]] = True
        for _ in range(8):  # swap nodes that have more neighbours beyond the cut
            gain = ((side[local] != side[:, None]) * inside).sum(1) * 2 - inside.sum(1)
            a, b = (np.flatnonzero(m)[np.argsort(-gain[m], kind="stable")] for m in (side, ~side))
            n = min(len(a), len(b), max(1, len(nodes) // 20))
            ok = np.flatnonzero(gain[a[:n]] + gain[b[:n]] <= 0)
            n = ok[0] if len(ok) else n
            if not n:
                break
            side[a[:n]], side[b[:n]] = False, True
        split(nodes[~side], first, left)
        split(nodes[side], first + left, parts - left)

    split(np.arange(len(nbrs)), 0, parts)
    return label


class Router:
    """Two-layer network from a vector to the log-odds of each part."""

    def __init__(self, x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 128, epochs: int = 25, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.scale = 1 / (x.std() + 1e-12)
        shapes = [(x.shape[1], hidden), (hidden,), (hidden, parts), (parts,)]
        self.w = [rng.standard_normal(s) * (0 if len(s) == 1 else s[0] ** -0.5) for s in shapes]
        m, v, t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for _ in range(epochs if parts > 1 else 0):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 256):
                i = order[a : a + 256]
                z = x[i] * self.scale
                h = np.maximum(0, z @ self.w[0] + self.w[1])
                p = h @ self.w[2] + self.w[3]
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(i)), label[i]] -= 1
                p /= len(i)
                back = (p @ self.w[2].T) * (h > 0)
                t += 1
                for j, g in enumerate((z.T @ back, back.sum(0), h.T @ p, p.sum(0))):
                    m[j] += 0.1 * (g - m[j])
                    v[j] += 0.01 * (g * g - v[j])
                    self.w[j] -= 3e-3 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, x * self.scale @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3]


def fit(x: np.ndarray, parts: int, k: int, recall: float, seed: int = 7):
    """Router and number of probes for a sample of vectors."""
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, len(x) // 32))
    if parts == 1:
        return Router(x, np.zeros(len(x), int), 1), 1
    label = bisected(neighbours(x, 16), parts, rng)
    held = rng.permutation(len(x))[: min(400, len(x) // 8)]  # queries that the network doesn't see
    seen = np.setdiff1d(np.arange(len(x)), held)
    router = Router(x[seen], label[seen], parts)
    at, odds = router(x).argmax(1), router(x[held])
    s = x[held] @ x.T
    s[np.arange(len(held)), held] = -np.inf
    best = np.argpartition(-s, k - 1, 1)[:, :k]
    place = np.argsort(np.argsort(-odds, 1), 1)[np.arange(len(held))[:, None], at[best]]  # rank of the part of each
    share = np.cumsum(np.bincount(place.ravel(), minlength=parts)) / place.size
    return router, int(np.searchsorted(share, recall) + 1)


def nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int):
    """(query, row, score): the k best rows for each query, ties to the smaller id."""
    out = []
    order = np.argsort(xid, kind="stable")
    x, xid = x[order], xid[order]
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        s[qid[a : a + 256, None] == xid[None]] = -np.inf
        kth = np.partition(s, len(xid) - min(k, len(xid)), 1)[:, len(xid) - min(k, len(xid))]
        i, j = np.nonzero((s >= kth[:, None] - 1e-9) & (s > -np.inf))
        score = (q[a + i] * x[j]).sum(1)  # the same for equal vectors, wherever they lie
        o = np.lexsort((xid[j], -score, i))
        i, j, score = i[o], j[o], score[o]
        ok = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((qid[a + i[ok]], xid[j[ok]], score[ok]))
    return [np.concatenate(c) for c in zip(*out)]


def search(rows: DataFrame, queries, k: int = 20, sample: int = 4096, parts: int = 64, recall: float = 0.97, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row that the condition `queries` picks, among all rows."""
    spark = rows.sparkSession
    bounded(spark)
    v = written(usable(rows).select("vec_id", "v", F.expr(queries).alias("asks") if isinstance(queries, str) else queries.alias("asks")), "vectors")
    n = v.count()
    every = max(1, n // sample)
    order = F.xxhash64("vec_id", "v")
    some = v.where(F.pmod(order, F.lit(every)) == 0).orderBy(order, "vec_id").limit(2 * sample).toPandas()
    if len(some) < 64:
        some = v.orderBy(order, "vec_id").limit(256).toPandas()
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = some.sort_values("vec_id")
    router, probes = fit(stacked(some.v), parts, min(k, max(1, len(some) - 1)), recall)
    held = spark.sparkContext.broadcast(router)

    def route(batches):
        for b in batches:
            for a in range(0, len(b), 4096):
                c = b.iloc[a : a + 4096]
                odds = held.value(stacked(c["v"]))
                first = np.argsort(-odds, 1, kind="stable")
                yield c.assign(part=first[:, 0].astype(np.int32), to=[r.tolist() for r in first[:, :probes].astype(np.int32)])

    r = written(v.mapInPandas(route, "vec_id long, v array<double>, asks boolean, part int, to array<int>"), "routed")
    sizes = {x.part: x["count"] for x in r.groupBy("part").count().collect()}  # at most `parts` rows
    blocks = spark.createDataFrame([(p, -(-c // block)) for p, c in sizes.items()], "part int, blocks int")
    index = r.join(F.broadcast(blocks), "part").select("part", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("b"), "vec_id", "v", F.lit(False).alias("asks"))
    asked = r.where("asks").select("vec_id", "v", F.explode("to").alias("part")).join(F.broadcast(blocks), "part")
    asked = asked.select("part", F.explode(F.expr("sequence(0, blocks - 1)")).alias("b"), "vec_id", "v", F.lit(True).alias("asks"))

    def rank(batches):
        """Blocks come sorted, rows before queries; queries are answered some at a time."""
        now, ids, vecs, x = None, [], [], None
        for batch in batches:
            key = batch["part"].to_numpy().astype(np.int64) << 32 | batch["b"].to_numpy()
            asks = batch["asks"].to_numpy()
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (asks[1:] != asks[:-1])))
            for a, e in zip(cuts, np.append(cuts[1:], len(batch))):
                c = batch.iloc[a:e]
                if key[a] != now:
                    now, ids, vecs, x = key[a], [], [], None
                if not asks[a]:
                    ids.append(c["vec_id"].to_numpy())
                    vecs.append(stacked(c["v"]))
                    x = None
                elif ids:
                    if x is None:
                        x, i = np.concatenate(vecs), np.concatenate(ids)
                    got = nearest(stacked(c["v"]), c["vec_id"].to_numpy(), x, i, k)
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got)))

    both = index.unionByName(asked).repartition("part", "b").sortWithinPartitions("part", "b", "asks")
    found = both.mapInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
