"""Counts and file statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(elements: DataFrame, kind: str = "type") -> DataFrame:
    return elements.agg(*(F.count_if(F.col(kind) == k).alias(f"{k}s") for k in ("node", "way", "relation")))


def file_statistics(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: counts, ranges of time, place and id, and the greatest version, tag, node and member counts with their owners
    (of equals the smallest id)."""
    parts = []
    for kind, t in (("node", nodes), ("way", ways), ("relation", relations)):
        null = lambda c, ty, t=t: (F.col(c) if c in t.columns else F.lit(None)).cast(ty)
        size = lambda c, t=t: F.coalesce(F.size(c), F.lit(0)) if c in t.columns else F.lit(0)
        parts.append(t.select(F.lit(kind).alias("type"), "id", "version", "timestamp", null("lat", "double").alias("lat"), null("lon", "double").alias("lon"), size("tags").alias("n_tags"), size("nodes").alias("n_nodes"), size("members").alias("n_members")))
    e = parts[0].unionByName(parts[1]).unionByName(parts[2])
    of = lambda k: F.col("type") == k
    out = [F.count_if(of(k)).alias(f"{k}s") for k in ("node", "way", "relation")]
    out += [F.min("timestamp").alias("min_timestamp"), F.max("timestamp").alias("max_timestamp")]
    out += [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    for k in ("node", "way", "relation"):
        out += [F.min(F.when(of(k), F.col("id"))).alias(f"min_{k}_id"), F.max(F.when(of(k), F.col("id"))).alias(f"max_{k}_id")]
    out.append(F.max("version").alias("max_version"))
    for c, k in (("n_tags", None), ("n_nodes", "way"), ("n_members", "relation")):
        own = F.struct(c, -F.col("id"))
        out += [F.max(c).cast("bigint").alias(f"max_{c}"), F.max_by("id", own if k is None else F.when(of(k), own)).alias(f"max_{c}_id")]
    return e.agg(*out)
