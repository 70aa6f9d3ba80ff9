"""Embedding near-dedup over a robust-pruned flat graph.

Vectors with the same label and values are one class. Each class joins the shards of its nearest centres (a bounded sample of
vectors), inside its label: of so many that, of pairs made at just the similarity asked for, all but `miss` share a shard.
Shards of over `block` classes are dealt into blocks that meet in pairs. Every shard links each class to its nearest ones
and prunes them robustly (a neighbour goes if one kept before is nearer to it, times `alpha`, than the class is); reverse
links are added. The adjacency lists of overlapping shards are united. Then every class searches: greedily from the medoid and its
own node, keeping `beam` candidates, and expanding every node found within the range until none is left. Where the united
graph leads out of the shards, to a node that can be in range by the angles on the way, the search goes on by joins. What
it finds is verified in double precision. A pair that meets in several shards counts in the first they share. audit() measures
the share of links found against brute force; below `recall` everything is done again with twice as many shards for each class.

Defined results: null labels, and vectors that are null, zero, hold null or non-finite components or differ in length from most,
link with nothing; labels are of any type that can be compared; vectors are scaled before their length is taken, so that none is too
large or small; rows that repeat a vec_id and its vector are one vector, listed as often as given; a vec_id with several vectors counts once
in each group of equal vectors, and has the most links that one of its vectors has and the smallest component; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded, table, written
from .ann import stacked, usable
from .graph import components


def units(column) -> np.ndarray:
    """The vectors at length 1, by way of their largest component, whose square might not be a number of this precision."""
    x = stacked(column)
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def shards_needed(x: np.ndarray, centres: np.ndarray, least: float, miss: float, seed: int = 5) -> int:
    """Of how many nearest centres a vector must join the shards, so that pairs at similarity `least` share one, but for `miss`."""
    rng = np.random.default_rng(seed)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    y = least * x + np.sqrt(1 - least * least) * side / (np.linalg.norm(side, axis=1, keepdims=True) + 1e-30)
    a, b = (np.argsort(np.argsort(-(z @ centres.T), 1, kind="stable"), 1) for z in (x, y))
    worst = np.maximum(a, b).min(1)  # both are within so many
    return int(np.quantile(worst, 1 - miss, method="higher")) + 1


def pruned(x: np.ndarray, k: int = 32, degree: int = 16, alpha: float = 1.2) -> list[np.ndarray]:
    """Adjacency of unit vectors x: k nearest, robustly pruned to `degree`, with reverse links."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return [np.zeros(0, np.int64)] * n
    near = np.empty((n, k), np.int64)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        c = np.argpartition(-s, k - 1, 1)[:, :k]
        near[a : a + 512] = np.take_along_axis(c, np.argsort(-np.take_along_axis(s, c, 1), 1, kind="stable"), 1)
    to = 1 - np.einsum("nd,nkd->nk", x, x[near])
    alive, kept = np.ones((n, k), bool), np.zeros((n, k), bool)
    rows = np.arange(n)
    for _ in range(min(degree, k)):
        first = np.where(alive.any(1), alive.argmax(1), -1)
        ok = rows[first >= 0]
        if not len(ok):
            break
        f = first[ok]
        kept[ok, f] = True
        between = 1 - np.einsum("nd,nkd->nk", x[near[ok, f]], x[near[ok]])
        alive[ok] &= alpha * between > to[ok]
        alive[ok, f] = False
    i, j = np.nonzero(kept)
    a, b = np.concatenate([i, near[i, j]]), np.concatenate([near[i, j], i])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    a, b = a[new], b[new]
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def found(x: np.ndarray, adjacency: list[np.ndarray], least: float, beam: int = 32) -> np.ndarray:
    """Matrix of similarities seen by each node's range-expanding greedy search (-2: not seen)."""
    n = len(x)
    degree = np.array([len(v) for v in adjacency])
    start = np.cumsum(degree) - degree
    nbrs = np.concatenate(adjacency).astype(np.int64) if degree.sum() else np.zeros(0, np.int64)
    medoid = int((x @ x.sum(0)).argmax())
    sim = np.full((n, n), -2.0, np.float32)
    open_ = np.zeros((n, n), bool)

    def visit(q, node):
        new = sim[q, node] < -1.5
        q, node = q[new], node[new]
        for a in range(0, len(q), 100_000):
            e = slice(a, a + 100_000)
            sim[q[e], node[e]] = np.einsum("ij,ij->i", x[q[e]], x[node[e]])
        open_[q, node] = True

    rows = np.arange(n)
    visit(rows, np.full(n, medoid))
    visit(rows, rows)
    live = rows
    while len(live):
        s = np.where(open_[live], sim[live], -2.0)
        best = s.max(1)
        m = min(beam, n)
        floor = np.partition(sim[live], n - m, 1)[:, n - m]
        go = (best > -1.5) & ((best >= floor) | (best >= least))
        live, s, best = live[go], s[go], best[go]
        if not len(live):
            break
        i, node = np.nonzero((s >= least) | (s >= best[:, None]))
        q = live[i]
        open_[q, node] = False
        size = degree[node]
        part = np.cumsum(size) // 1_000_000  # so many links at a time
        for k in range(int(part[-1]) + 1):
            e = slice(*np.searchsorted(part, (k, k + 1)))
            d = size[e]
            at = np.repeat(start[node[e]] - np.cumsum(d) + d, d) + np.arange(d.sum())
            pair = np.unique(np.repeat(q[e], d) * n + nbrs[at])
            visit(pair // n, pair % n)
    return sim


def _groups(batches, names):
    """Whole groups, one data frame each, from batches sorted by the columns g, i, j."""
    carry = None
    for b in batches:
        d = b if carry is None else pd.concat([carry, b], ignore_index=True)
        key = d[names].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for a, e in zip(np.append(0, cuts[:-1]), cuts):
            yield d.iloc[a:e].reset_index(drop=True)
        carry = d.iloc[cuts[-1] if len(cuts) else 0 :]
    if carry is not None and len(carry):
        yield carry.reset_index(drop=True)


def near_duplicates(rows: DataFrame, least: float = 0.93, overlap: int = 3, per_centre: int = 2048, most_centres: int = 1024, block: int = 1024, miss: float = 0.003, recall: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; overlap: the least number of shards for a class."""
    spark = rows.sparkSession
    bounded(spark)
    label = rows.schema["label"].dataType.simpleString()
    v = usable(rows.where("label is not null").select("vec_id", "embedding", "label")).withColumn("ck", F.xxhash64("label", "v"))
    of = written(v.select("vec_id", "ck", "label", "v"), "vectors")
    ids = written(of.select("ck", "vec_id").distinct().groupBy("ck").agg(F.min("vec_id").alias("cid"), F.count("*").alias("m")), "ids")
    classes = written(of.groupBy("ck").agg(F.first("label").alias("label"), F.first("v").alias("v")).join(ids, "ck"), "classes")
    n = classes.count()
    every = max(1, min(n // 64, per_centre)) if n <= per_centre * most_centres else n // most_centres
    pick = lambda seed, many: classes.orderBy(F.xxhash64("ck", F.lit(seed)), "cid").limit(many).select("v").toPandas()
    some = pick(1, -(-n // every)) if n else []
    centres = units(some.v) if len(some) else None
    if centres is not None and len(centres) > overlap:
        overlap = max(overlap, shards_needed(units(pick(2, 2000).v), centres, least, miss))
    while True:
        met = _links(classes, label, centres, least, overlap, block)
        links = met.groupBy("cid").agg(F.sum("links").alias("links"))
        comp = components(met.select(F.col("cid").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cid"), "component")
        per = ids.join(links, "cid", "left").join(comp, "cid", "left")
        per = per.select("ck", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
        linked = of.select("vec_id", "ck").join(per, "ck").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
        out = rows.select("vec_id").join(linked, "vec_id", "left")
        comp = F.coalesce("component_id", "vec_id")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))
        out = written(out, "result")
        got = audit(rows, out, least)
        if got is None or got >= recall or centres is None or overlap >= len(centres):
            return out
        overlap *= 2


def _links(classes: DataFrame, label: str, centres, least: float, overlap: int, block: int) -> DataFrame:
    """(cid, links, root): links of each class, and a class that it is linked with, for the components."""
    held = classes.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for b in batches:
            for a in range(0, len(b), 1024):
                d = b.iloc[a : a + 1024]
                if held.value is None:
                    to = np.zeros((len(d), 1), np.int64)
                else:
                    to = np.argsort(-(units(d["v"]) @ held.value.T), 1, kind="stable")[:, :overlap]
                yield d.assign(shards=[sorted(x.tolist()) for x in to])

    c = classes.select("cid", "m", "label", "v").mapInPandas(assign, f"cid long, m long, label {label}, v array<double>, shards array<long>")
    at = written(c, "assigned")
    c = at.withColumn("g", F.explode("shards"))
    size = c.groupBy("label", "g").agg(F.ceil(F.count("*") / block).alias("blocks"))
    c = c.join(size, ["label", "g"]).withColumn("own", F.pmod(F.xxhash64("cid"), "blocks"))
    other = F.explode(F.expr("sequence(0L, greatest(blocks, 1L) - 1)"))
    c = c.select("*", other.alias("b")).withColumn("i", F.least("own", "b")).withColumn("j", F.greatest("own", "b")).drop("b", "blocks")
    c = written(c, "meet")
    key = ["label", "g", "i", "j"]

    def build(batches):
        for d in _groups(batches, key):
            x, cid = units(d["v"]), d["cid"].to_numpy()
            lists = pruned(x)
            yield pd.DataFrame({"cid": cid, "to": [[{"w": int(cid[j]), "s": float(x[i] @ x[j])} for j in a] for i, a in enumerate(lists)]})

    sorted_ = c.repartition(*key).sortWithinPartitions(*key, "cid")
    shape = "array<struct<w: long, s: double>>"
    adj = sorted_.select(*key, "cid", "v").mapInPandas(build, f"cid long, to {shape}").select("cid", F.explode("to").alias("to"))
    adj = adj.groupBy("cid", F.col("to.w").alias("w")).agg(F.max("to.s").alias("s")).groupBy("cid").agg(F.collect_list(F.struct("w", "s")).alias("to"))
    adj = written(adj, "adjacency")
    reach = np.arccos(least) * 2  # an edge leads from one in range to another one in range only below this angle

    def search(batches):
        for d in _groups(batches, key):
            cid, m, g = d["cid"].to_numpy(), d["m"].to_numpy(), int(d["g"][0])
            x = units(d["v"])
            order = np.argsort(cid)
            lists, leads = [], []
            for to in d["to"]:
                w = np.array([y["w"] for y in to], np.int64)
                at = order[np.minimum(np.searchsorted(cid, w, sorter=order), len(cid) - 1)]
                here = cid[at] == w
                lists.append(at[here])
                far = np.array([np.arccos(min(1.0, max(-1.0, y["s"]))) <= reach + 1e-6 for y in to], bool)
                leads.append(w[~here & far])
            link = found(x, lists, least - 1e-4) >= least - 1e-4
            np.fill_diagonal(link, False)
            link |= link.T
            p, q = np.nonzero(link)
            for a in range(0, len(p), 100_000):
                e = slice(a, a + 100_000)
                link[p[e], q[e]] = np.einsum("ij,ij->i", x[p[e]], x[q[e]]) >= least  # verified in double precision
            before = np.zeros((len(cid), len(cid)), bool)  # pairs that meet in an earlier shard
            first = np.array([[s for s in z if s < g] + [-1 - k for k in range(overlap + 1 - len([s for s in z if s < g]))] for z in d["shards"]])
            for a in range(first.shape[1]):
                for b in range(first.shape[1]):
                    before |= (first[:, a, None] == first[None, :, b]) & (first[:, a, None] >= 0)
            counts = link & ~before
            if d["i"][0] != d["j"][0]:
                side = d["own"].to_numpy()
                counts &= side[:, None] != side[None]
            links = counts @ m
            name = cid.copy()
            both = link | np.eye(len(cid), dtype=bool)
            while True:
                new = np.where(both, name[None], np.iinfo(np.int64).max).min(1)
                if (new == name).all():
                    break
                name = new
            out = [sorted({int(w) for j in np.flatnonzero(both[i]) for w in leads[j]}) if any(len(z) for z in leads) else [] for i in range(len(cid))]
            ok = (links > 0) | (name != cid) | np.array([len(o) > 0 for o in out])
            yield pd.DataFrame({"cid": cid[ok], "links": links[ok], "root": name[ok], "out": pd.Series([o for o, k in zip(out, ok) if k], dtype=object)})

    s = c.join(adj, "cid", "left").withColumn("to", F.coalesce("to", F.array().cast(shape)))
    s = s.select(*key, "cid", "m", "v", "shards", "own", "to").repartition(*key).sortWithinPartitions(*key, "cid")
    met = written(s.mapInPandas(search, "cid long, links long, root long, out array<long>"), "links")
    every = met.select("cid", "links", "root")
    # the search goes on beyond the shards: pairs that share none, each once
    near = np.cos(min(np.pi, reach + 1e-6))
    edge = adj.select("cid", F.explode("to").alias("e")).where(F.col("e.s") >= float(near)).select("cid", F.col("e.w").alias("w"))
    node = at.select("cid", "m", "v", "shards")
    ask, seen = met.select(F.col("cid").alias("p"), F.explode("out").alias("q")), None
    while True:
        ask = ask.where("p != q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
        if seen is not None:
            ask = ask.join(seen.select("p", "q"), ["p", "q"], "left_anti")
        d = ask.join(node.select(F.col("cid").alias("p"), F.col("v").alias("x"), F.col("m").alias("pm"), F.col("shards").alias("ps")), "p")
        d = d.join(node.select(F.col("cid").alias("q"), F.col("v").alias("y"), F.col("m").alias("qm"), F.col("shards").alias("qs")), "q").where(~F.arrays_overlap("ps", "qs"))

        @F.pandas_udf("double")
        def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(np.einsum("ij,ij->i", units(x), units(y)) if len(x) else np.zeros(0))

        d = written(d.select("p", "q", "pm", "qm", cosine("x", "y").alias("s")), "beyond")
        if not d.count():
            return every
        seen = d.select("p", "q") if seen is None else seen.unionByName(d.select("p", "q"))
        hit = d.where(F.col("s") >= least)
        every = every.unionByName(hit.select(F.col("p").alias("cid"), F.col("qm").alias("links"), F.col("q").alias("root"))).unionByName(hit.select(F.col("q").alias("cid"), F.col("pm").alias("links"), F.col("p").alias("root")))
        both = hit.select("p", "q").unionByName(hit.select(F.col("q").alias("p"), F.col("p").alias("q")))
        ask = both.join(edge.withColumnRenamed("cid", "q"), "q").select("p", F.col("w").alias("q"))


def audit(rows: DataFrame, result: DataFrame, least: float = 0.93, queries: int = 256) -> float | None:
    """Share of the links of a bounded set of query vectors, by brute force over all rows, that n_links has; None if they have none."""
    v = usable(rows.where("label is not null").select("vec_id", "embedding", "label"))
    q = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).toPandas()
    if not len(q):
        return None
    x, ids, labels = units(q.v), q.vec_id.to_numpy(), q.label.to_numpy()

    def count(batches):
        true = np.zeros(len(ids), np.int64)
        for b in batches:
            y = units(b["v"])
            hit = (x @ y.T >= least) & (labels[:, None] == b["label"].to_numpy()[None]) & (ids[:, None] != b["vec_id"].to_numpy()[None])
            true += hit.sum(1)
        yield pd.DataFrame({"vec_id": ids, "true": true})

    true = v.select("vec_id", "label", "v").mapInPandas(count, "vec_id long, true long").groupBy("vec_id").agg(F.sum("true").alias("true"))
    r = true.join(result, "vec_id").agg(F.sum(F.least("true", "n_links")).alias("got"), F.sum("true").alias("all")).first()
    return r["got"] / r["all"] if r["all"] else None


def op2_embed_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS d, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.d),
n AS (SELECT x, count(DISTINCT y) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, vec_id = m.c AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = vec_id
"""
