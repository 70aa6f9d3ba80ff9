"""Mixing sources to target weights by Sainte-Lague apportionment, in SQL operations only.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share all words. No source gets more
than `cap` times its size; the excess goes to the others by weight. The target is cut into blocks of
`block_words` words. Each source is dealt by a seeded hash into shards of about `shard_docs` documents, and the
blocks go to (source, shard) by highest quotients target / (2k + 1). Inside a shard documents lie end to end in
seeded order; the mix takes whole passes over that order, then its first words as far as the quota goes.

Nulls and the like: a null or blank text has size 0 and is never taken; a null source is a source of its own; an
empty table gives no rows; repeated rows count each; further columns are ignored. Ties in the seeded order fall to
doc_id, then size; equal rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import table, written

WORD = r"[^\x20\x09-\x0D]+"


def _md5(seed: str):
    return F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def targets(sources: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, ...) with the target of each source: water filling in one pass over the sorted caps."""
    every = Window.partitionBy()
    w = sources.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = w.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", F.col("source_size") * cap)
    up = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_i")).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(up), F.lit(0)))
    w = w.withColumn("_share", F.col("_left") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(up), F.lit(0))))
    w = w.withColumn("_full", F.col("_cap") / F.col("_w") <= F.col("_share"))
    level = F.max(F.when(~F.col("_full"), F.col("_share"))).over(every)
    w = w.withColumn("target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * level))
    return w.drop("_i", "_w", "_cap", "_left", "_share", "_full")


def quotas(parties: DataFrame, block_words: int) -> DataFrame:
    """Blocks of each (source, shard) with share _t: highest quotients, listing only those near the threshold."""
    every = Window.partitionBy()
    p = parties.where("_t > 0")
    p = p.withColumn("_n", F.round(F.sum("_size").over(every) / block_words)).withColumn("_s", F.count("*").over(every))
    p = p.withColumn("_sum", F.sum("_t").over(every))
    sure = F.when(F.col("_n") > F.col("_s") / 2, F.floor(F.col("_t") * (F.col("_n") - F.col("_s") / 2) / F.col("_sum") + 0.5))
    p = p.withColumn("_lo", F.coalesce(sure, F.lit(0)).cast("long"))
    p = p.withColumn("_hi", (F.floor(F.col("_t") * (F.col("_n") + F.col("_s") / 2) / F.col("_sum") + 0.5) + 1).cast("long"))
    p = p.withColumn("_open", F.col("_n") - F.sum("_lo").over(every))
    q = p.select("*", F.explode(F.sequence("_lo", "_hi")).alias("_k")).withColumn("_q", F.col("_t") / (2 * F.col("_k") + 1))
    order = Window.orderBy(F.col("_q").desc(), F.col("source").asc_nulls_last(), "_shard", "_k")
    q = q.withColumn("_won", (F.row_number().over(order) <= F.col("_open")).cast("long"))
    return q.groupBy("source", "_shard").agg((F.first("_lo") + F.sum("_won")).alias("_blocks"), F.first("_size").alias("_size"))


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, block_words: int = 16, shard_docs: int = 20_000, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document, and source."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select("doc_id", "source", size.alias("size"), _md5(seed).alias("_h"), *keep), "sized")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / shard_docs).alias("_shards"))
    t = targets(per, weights, cap).withColumnRenamed("source", "_source")
    d = sized.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("_shard", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % F.col("_shards"))
    parties = d.groupBy("source", "_shard").agg(F.sum("size").alias("_size"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    q = quotas(parties.withColumn("_t", F.col("target") * F.col("_size") / F.nullif(F.col("source_size"), F.lit(0))), block_words)
    q = q.select(F.col("source").alias("_source"), F.col("_shard").alias("_qshard"), F.least(F.col("_blocks") * block_words, F.col("_size") * cap).alias("_words"), "_size")
    d = d.join(q, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_qshard")), "left")
    order = Window.partitionBy("source", "_shard").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_words") % F.col("_size") - F.col("_before")))
    taken = F.when(F.col("size") > 0, F.floor(F.col("_words") / F.col("_size")) * F.col("size") + part)
    return d.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "source", *keep)


def op4_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix/' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, ceil(count(*) / 20000)::BIGINT AS shards FROM sized GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM per),
w2 AS (SELECT *, i % 3 + 1 AS w, source_size * 3 AS cap FROM w),
w3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER up, 0))::DOUBLE AS share
  FROM w2 WINDOW up AS (ORDER BY cap::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, shards, CASE WHEN cap::DOUBLE / w <= share THEN cap::DOUBLE
  ELSE w * max(CASE WHEN cap::DOUBLE / w > share THEN share END) OVER () END AS target FROM w3),
d AS (SELECT s.*, t.source_size, t.target, ('0x' || substr(h, 1, 8))::BIGINT % shards AS shard
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
p0 AS (SELECT source, shard, sum(size)::BIGINT AS ssize, any_value(target) * sum(size)::DOUBLE / nullif(any_value(source_size), 0)::DOUBLE AS t
  FROM d GROUP BY source, shard),
p1 AS (SELECT *, round(sum(ssize) OVER ()::DOUBLE / 16) AS n, count(*) OVER () AS s, sum(t) OVER () AS st FROM p0 WHERE t > 0),
p2 AS (SELECT *, CASE WHEN n > s / 2 THEN floor(t * (n - s / 2) / st + 0.5) ELSE 0 END::BIGINT AS lo,
  (floor(t * (n + s / 2) / st + 0.5) + 1)::BIGINT AS hi FROM p1),
p3 AS (SELECT *, n - sum(lo) OVER () AS open FROM p2),
q AS (SELECT *, unnest(generate_series(lo, hi)) AS k FROM p3),
r AS (SELECT *, row_number() OVER (ORDER BY t / (2 * k + 1) DESC, source NULLS LAST, shard, k) <= open AS won FROM q),
a AS (SELECT source, shard, ssize, least((lo + sum(won::BIGINT))::BIGINT * 16, ssize * 3) AS words FROM r GROUP BY source, shard, ssize, lo),
e AS (SELECT d.*, a.words, a.ssize, coalesce(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY h, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d LEFT JOIN a ON d.source IS NOT DISTINCT FROM a.source AND d.shard = a.shard)
SELECT doc_id, size, source_size, target, source, CASE WHEN size > 0 AND ssize IS NOT NULL
  THEN ((words // ssize) * size + greatest(0, least(size, words % ssize - before)))::BIGINT ELSE 0 END AS taken FROM e
"""
