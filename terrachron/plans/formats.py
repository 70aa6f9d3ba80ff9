"""Sources and sinks over the driver's tables: what is written as a document and read back, each with the same rows in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import cells
from ..sources import json as js
from ..sources import sinks, xml, xmlscan
from ..tables import shared_dir, written
from .workload import node_history, nodes, query, ways

SPLIT = 4 << 20  # bytes of a document that one task parses


def _folder(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _tag(d, *columns):
    return d.select("id", "version", *columns, F.get("tags", F.lit(0))["v"].alias("tag"))


@query("xml_round_trip", """SELECT 'node' AS kind, id, CAST(version AS INT) AS version, lat, lon, brand AS tag FROM node_v
  UNION ALL SELECT 'way', id, 1, NULL, NULL, status FROM way_v WHERE id IN (SELECT way_id FROM ref_v)""")
def _(t):
    p = _folder(t, "xml")
    sinks.write_document({"node": nodes(t), "way": ways(t)}, p, version="0.6")
    got = xmlscan.tables(written(xmlscan.scan(t.spark, p, SPLIT, parts=True), "scan"))  # one parse for both
    none = [F.lit(None).cast("double").alias(c) for c in ("lat", "lon")]
    n, w = _tag(got["node"], "lat", "lon"), _tag(got["way"], *none)
    return n.select(F.lit("node").alias("kind"), "*").unionByName(w.select(F.lit("way").alias("kind"), "*"))


@query("xml_by_kind", "SELECT way_id AS id, count(*) + CASE WHEN (way_id - 1) % 3 = 0 THEN 1 ELSE 0 END AS n, CAST(sum(ref) + CASE WHEN (way_id - 1) % 3 = 0 THEN arg_min(ref, idx) ELSE 0 END AS BIGINT) AS refs FROM ref_v GROUP BY way_id")
def _(t):
    p = _folder(t, "xml")
    sinks.write_document({"way": ways(t)}, p)  # in as many parts as there are: their rows are whole elements
    d = xml.read(t.spark, p, "way", parts=True)
    return d.select("id", F.size("nodes").cast("long").alias("n"), F.aggregate("nodes", F.lit(0).cast("long"), lambda s, x: s + x["ref"]).alias("refs"))


@query("change_round_trip", "SELECT CASE id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'modify' ELSE 'delete' END AS action, id, CAST(version AS INT) AS version, lat FROM node_v")
def _(t):
    p = _folder(t, "change")
    action = F.when(F.col("id") % 3 == 0, "create").when(F.col("id") % 3 == 1, "modify").otherwise("delete")
    sinks.write_change({"node": nodes(t).withColumn("action", action)}, p)
    return xmlscan.changes(xmlscan.scan(t.spark, p, SPLIT, parts=True))["node"].select("action", "id", "version", "lat")


@query("diff_round_trip", """SELECT CASE WHEN lag(version) OVER w IS NULL THEN 'create' WHEN visible THEN 'modify' ELSE 'delete' END AS action, id, CAST(version AS INT) AS version,
  CAST(lag(version) OVER w AS INT) AS before, visible FROM node_hist WINDOW w AS (PARTITION BY id ORDER BY version)""")
def _(t):
    h = node_history(t).withColumns({"user": F.lit("u"), "uid": F.lit(1), "tags": F.array().cast("array<struct<k: string, v: string>>")})
    h = h.withColumn("new_xml", sinks.element_xml("node", h)).withColumn("old_xml", F.lag("new_xml").over(Window.partitionBy("id").orderBy("version")))
    h = h.withColumn("action", F.when(F.col("old_xml").isNull(), "create").when(F.col("visible"), "modify").otherwise("delete"))
    rows = sinks.diff_lines(h).select(F.lit(1).alias("o"), "id", "version", "value")
    ends = t.spark.createDataFrame([(0, None, None, "<osm>"), (2, None, None, "</osm>")], "o int, id long, version int, value string")
    p = _folder(t, "diff")
    sinks.write_parts(rows.withColumn("version", F.col("version").cast("int")).unionByName(ends), ["o", "id", "version"], p)
    d = xmlscan.diffs(xmlscan.scan(t.spark, p, SPLIT, parts=True))
    return d.select("action", "id", F.col("new_node.version").alias("version"), F.col("old_node.version").alias("before"), F.col("new_node.visible").alias("visible"))


@query("json_round_trip", "SELECT id, CAST(version AS INT) AS version, lat, lon, brand AS tag FROM node_v")
def _(t):
    p = _folder(t, "json")
    js.write_document({"node": nodes(t)}, p, version="0.6")
    d = js.read(t.spark, p, parts=True)["node"]
    brand = F.get(F.filter("tags", lambda x: x["k"] == "brand"), F.lit(0))["v"]
    return d.select("id", "version", "lat", "lon", brand.alias("tag"))


@query("nodes_near", """SELECT a.id, count(*) AS near, min(b.id) AS first FROM node_v a JOIN node_v b
  ON b.lat BETWEEN a.lat - 1 AND a.lat + 1 AND b.lon BETWEEN a.lon - 2 AND a.lon + 2 GROUP BY a.id""")
def _(t):
    n = nodes(t).select("id", "lat", "lon")
    box = F.struct((F.col("lat") - 1).alias("minlat"), (F.col("lat") + 1).alias("maxlat"), (F.col("lon") - 2).alias("minlon"), (F.col("lon") + 2).alias("maxlon"))
    d = cells.within_boxes(n, n.select(F.col("id").alias("box"), box.alias("bounds")))
    return d.groupBy(F.col("box").alias("id")).agg(F.count("*").alias("near"), F.min("id").alias("first"))


@query("box_by_cells", "SELECT id, lat, lon FROM node_v WHERE lat BETWEEN -10 AND 10 AND lon BETWEEN -20 AND 20")
def _(t):
    p = _folder(t, "cells")
    cells.lay_out(nodes(t).select("id", "lat", "lon"), p, 4)
    return cells.in_box(t.spark, p, -10, -20, 10, 20, 4)
