"""Joins between nodes, ways and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_of_each(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row per id: that with the greatest order column (version by default)."""
    best = df.groupBy("id").agg(F.max_by(F.struct(*df.columns), F.coalesce(order or "version", F.lit(0))).alias("_r"))
    return best.select("_r.*")


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """ways with points (own coordinates, else the node's, else none) and tainted (a node was not there)."""
    n = last_of_each(nodes.select("id", "version", "lat", "lon")).select(F.col("id").alias("ref"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    r = ways.select("id", F.posexplode("nodes").alias("_i", "_n")).select("id", "_i", F.col("_n.ref").alias("ref"), F.col("_n.lat").alias("lat"), F.col("_n.lon").alias("lon"))
    own = (F.coalesce("lat", F.lit(0.0)) != 0) | (F.coalesce("lon", F.lit(0.0)) != 0)
    j = r.join(n, "ref", "left")
    lon = F.when(own, F.coalesce("lon", F.lit(0.0))).otherwise(F.col("_lo"))
    lat = F.when(own, F.coalesce("lat", F.lit(0.0))).otherwise(F.col("_la"))
    p = j.select("id", "_i", lon.alias("lon"), lat.alias("lat"), (own | F.col("_lo").isNotNull()).alias("ok"))
    p = p.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("_i", "lon", "lat")))).alias("_p"), F.max(~F.col("ok")).alias("tainted"))
    p = p.select("id", F.transform("_p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"), "tainted")
    none = F.array().cast("array<struct<lon: double, lat: double>>")
    return ways.join(p, "id", "left").withColumns({"points": F.coalesce("points", none), "tainted": F.coalesce("tainted", F.lit(False))})


def member_rows(relations: DataFrame) -> DataFrame:
    """One row per member: id, idx, and the member's columns."""
    return relations.select("id", F.posexplode("members").alias("idx", "_m")).select("id", "idx", "_m.*")


def member_ways(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Way members with their way's row w; null if it is not there."""
    w = ways.select(F.col("id").alias("ref"), F.struct(*ways.columns).alias("w"))
    return member_rows(relations).where("type = 'way'").join(w, "ref", "left")


def nodes_in_ways(nodes: DataFrame, ways: DataFrame, anti: bool = False) -> DataFrame:
    refs = ways.select(F.explode("nodes.ref").alias("id"))
    return nodes.join(refs, "id", "left_anti" if anti else "left_semi")


def memberships(relations: DataFrame, ways: DataFrame | None = None, nodes_only: bool = False) -> DataFrame:
    """type, ref, relations: what each feature is a member of. Of ways, only those present; nodes_only keeps no others."""
    r = relations.select(F.col("id").alias("rel"), F.col("tags").alias("_t"), F.posexplode("members").alias("_i", "_m"))
    r = r.select("rel", "_i", "_t", F.col("_m.type").alias("type"), F.col("_m.ref").alias("ref"), F.col("_m.role").alias("role"))
    if nodes_only:
        r = r.where("type = 'node'")
    elif ways is not None:
        there = ways.select(F.lit("way").alias("type"), F.col("id").alias("ref"))
        r = r.where("type != 'way'").unionByName(r.where("type = 'way'").join(there, ["type", "ref"], "left_semi"))
    item = F.struct(F.col("rel").alias("id"), "_i", F.coalesce("role", F.lit("")).alias("role"), F.col("_t").alias("tags"))
    g = r.groupBy("type", "ref").agg(F.array_sort(F.collect_list(item)).alias("relations"))
    return g.select("type", "ref", F.transform("relations", lambda x: F.struct(x["id"].alias("id"), x["role"].alias("role"), x["tags"].alias("tags"))).alias("relations"))


def ways_of_node(ways: DataFrame, node_id: int) -> DataFrame:
    return ways.where(F.array_contains("nodes.ref", F.lit(node_id).cast("bigint")))


def relations_of(relations: DataFrame, kind: str, ref: int) -> DataFrame:
    return relations.where(F.exists("members", lambda m: (m["type"] == kind) & (m["ref"] == ref)))


def way_full(ways: DataFrame, nodes: DataFrame, way_id: int):
    """The way and its nodes."""
    w = ways.where(F.col("id") == way_id)
    return w, nodes_in_ways(nodes, w)


def relation_full(relations: DataFrame, ways: DataFrame, nodes: DataFrame, rel_id: int):
    """The relation with its member relations; its member ways; its member nodes and those of the ways."""
    r = relations.where(F.col("id") == rel_id)
    m = member_rows(r).select("type", "ref")
    of = lambda df, kind: df.join(m.where(F.col("type") == kind).select(F.col("ref").alias("id")), "id", "left_semi")
    w = of(ways, "way")
    every = m.where("type = 'node'").select(F.col("ref").alias("id")).unionByName(w.select(F.explode("nodes.ref").alias("id")))
    return r.unionByName(of(relations, "relation")).distinct(), w, nodes.join(every, "id", "left_semi")
