"""GeoJSON features of nodes, ways and relations: one row per feature, geometry as GeoJSON text.

Relations come first (routes as lines, multipolygons and boundaries as polygons), then ways that no relation has used up,
then nodes that stand for something. Nodes and ways are built by expressions; only relations, whose rings depend on
the order of members, go through a function per relation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, tags
from . import joins, rings

FEATURE = "type string, id bigint, geometry string, tags map<string, string>, tainted boolean"


def _geometry(kind: str, coordinates):
    return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))


def _pairs(points):
    return F.transform(points, lambda p: F.array(p["lon"], p["lat"]))


def node_features(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Nodes but those that are in ways, in no relation, and without interesting tags, and those without any place."""
    w = ways.select(F.explode("nodes.ref").alias("id")).distinct().withColumn("_w", F.lit(True))
    r = joins.member_rows(relations).where("type = 'node'").select(F.col("ref").alias("id")).distinct().withColumn("_r", F.lit(True))
    z = lambda c: F.coalesce(c, F.lit(0)) == 0
    d = nodes.where(~(z("lon") & z("lat") & z("version"))).join(w, "id", "left").join(r, "id", "left")
    d = d.where(F.col("_w").isNull() | F.col("_r").isNotNull() | tags.interesting("tags"))
    return d.select(F.lit("node").alias("type"), "id", _geometry("Point", F.array("lon", "lat")).alias("geometry"), tags.as_map("tags").alias("tags"), F.lit(False).alias("tainted"))


def way_features(ways: DataFrame, nodes: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Ways of two points or more: polygons where they are areas, else lines; used: ids that relations have used up."""
    d = joins.way_points(ways, nodes)
    if used is not None:
        d = d.join(used.select("id").distinct(), "id", "left_anti")
    d = d.where(F.size("points") > 1)
    ring = geo.turned(geo.ring(F.col("points")), 1)
    g = F.when(tags.way_is_area("nodes", "tags"), _geometry("Polygon", F.array(_pairs(ring)))).otherwise(_geometry("LineString", _pairs(F.col("points"))))
    return d.select(F.lit("way").alias("type"), "id", g.alias("geometry"), tags.as_map("tags").alias("tags"), "tainted")


def _member_structs(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    w = joins.way_points(ways, nodes).select(F.col("id").alias("ref"), "points", "tainted", F.col("tags").alias("way_tags"))
    m = relations.select("id", F.posexplode("members").alias("idx", "m")).where("m.type = 'way'")
    m = m.select("id", "idx", F.col("m.ref").alias("ref"), F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.orientation", F.lit(0)).cast("int").alias("o"), geo.line("m.nodes").alias("own"))
    j = m.join(w, "ref", "left").withColumn("there", F.col("points").isNotNull())
    extra = tags.interesting("way_tags")
    s = F.struct("idx", "ref", "role", F.col("o").alias("orientation"), F.coalesce("points", "own").alias("points"), F.coalesce("tainted", F.lit(True)).alias("tainted"), "there", extra.alias("extra"), "way_tags")
    g = j.groupBy("id").agg(F.array_sort(F.collect_list(s)).alias("ms"))
    return relations.select("id", "tags").join(g, "id")


def _last(t):
    return {x["k"]: x["v"] for x in (t if t is not None else ())}


def _interesting(t, ignore):
    return any(x["k"] not in tags.UNINTERESTING and not (ignore.get(x["k"]) == "true" or ignore.get(x["k"]) == x["v"]) for x in (t if t is not None else ()))


def relation_features(relations: DataFrame, ways: DataFrame, nodes: DataFrame, invalid: bool = False) -> tuple[DataFrame, DataFrame]:
    """(features, ids of ways used up by them)."""
    kind = tags.find_or_empty("tags", "type")
    m = _member_structs(relations.where(kind.isin("route", "multipolygon", "boundary")), ways, nodes)

    def build(rid, rt, ms):
        own = _last(rt)
        return (_route if own.get("type") == "route" else _area)(rid, own, ms)

    def points(x):
        return [(p["lon"], p["lat"]) for p in x["points"]] if x["points"] is not None else []

    def segment(x):
        return rings.Segment(x["idx"], points(x), x["orientation"])

    def _route(rid, own, ms):
        used = [("used", "way", int(x["ref"]), None, {}, False) for x in ms if x["there"] and not x["extra"]]
        lines = [rings.line_of(c) for c in rings.join([segment(x) for x in ms if x["points"] is not None])]
        if not lines:
            return used
        g = {"type": "LineString", "coordinates": lines[0]} if len(lines) == 1 else {"type": "MultiLineString", "coordinates": lines}
        return [*used, ("feature", "relation", rid, json.dumps(g), own, any(not x["there"] or x["tainted"] for x in ms))]

    def _area(rid, own, ms):
        sides = {"outer": [], "inner": []}
        used, outers, tainted = [], 0, False
        for x in ms:
            if x["role"] not in sides:
                continue
            outers += x["role"] == "outer"
            if not x["there"] and not points(x):
                tainted = True
                continue
            tainted |= bool(x["tainted"]) and bool(x["there"])
            if x["there"] and not _interesting(x["way_tags"], own if x["role"] == "outer" else {}):
                used.append(int(x["ref"]))
            s = segment(x)
            if s.orientation and s.orientation == (-1 if x["role"] == "outer" else 1):
                s.turn()
                s.orientation, s.reversed = -s.orientation, False
            sides[x["role"]].append((s, x))
        outer, inner = ([s for s, _ in sides[k]] for k in ("outer", "inner"))
        if not outer and not invalid:
            return []
        what = ("relation", rid, own)
        if len(outer) == 1 and outers == 1:
            r = rings.ring_of(outer, 1)
            if not rings.closed(r):
                return []
            polys = [[r, *(rings.ring_of(c, -1) for c in rings.join(inner))]]
            x = sides["outer"][0][1]
            if x["there"] and not any(k not in tags.UNINTERESTING and k != "type" for k in own):
                what = ("way", int(x["ref"]), _last(x["way_tags"]))
                used.append(int(x["ref"]))
        else:
            polys = rings.polygons(outer, inner, invalid)
        if not polys:
            return []
        g = {"type": "Polygon", "coordinates": polys[0]} if len(polys) == 1 else {"type": "MultiPolygon", "coordinates": polys}
        done = [("used", "way", u, None, {}, False) for u in dict.fromkeys(used)]
        return [*done, ("feature", *what[:2], json.dumps(g), what[2], tainted)]

    both = rings.by_slices(m, build, ["id", "tags", "ms"], "what string, " + FEATURE)
    return both.where("what = 'feature'").drop("what"), both.where("what = 'used'").select("id").distinct()


def convert(nodes: DataFrame, ways: DataFrame, relations: DataFrame, ids: bool = True, meta: bool = True, membership: bool = True, invalid: bool = False) -> DataFrame:
    """order, feature_id, type, id, geometry, properties (JSON) of every feature."""
    rel, used = relation_features(relations, ways, nodes, invalid)
    parts = [rel, way_features(ways, nodes, used), node_features(nodes, ways, relations)]
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("order", F.lit(k))
        out = p if out is None else out.unionByName(p)
    props = [F.col("id"), F.col("type"), F.col("tags"), F.when(F.col("tainted"), F.lit(True)).alias("tainted")]
    if membership:
        member = joins.memberships(relations, ways).select(F.col("type").alias("_t"), F.col("ref").alias("_r"), "relations")
        out = out.join(member, (F.col("type") == F.col("_t")) & (F.col("id") == F.col("_r")), "left")
        empty = F.array().cast(member.schema["relations"].dataType)
        props.append(F.transform(F.coalesce("relations", empty), lambda r: F.struct(r["id"].alias("rel"), r["role"].alias("role"), tags.as_map(r["tags"]).alias("reltags"))).alias("relations"))
    if meta:
        zero = lambda c: F.when(F.col(c) != 0, F.col(c))
        m = None
        for kind, t in (("node", nodes), ("way", ways), ("relation", relations)):
            x = joins.last_of_each(t.select("id", "version", "timestamp", "changeset", "user", "uid"))
            x = x.select(F.lit(kind).alias("_mt"), F.col("id").alias("_mi"), F.struct("timestamp", zero("version").alias("version"), zero("changeset").alias("changeset"), F.when(F.col("user") != "", F.col("user")).alias("user"), zero("uid").alias("uid")).alias("meta"))
            m = x if m is None else m.unionByName(x)
        out = out.join(m, (F.col("type") == F.col("_mt")) & (F.col("id") == F.col("_mi")), "left")
        props.append(F.col("meta"))
    fid = F.concat_ws("/", "type", F.col("id").cast("string")) if ids else F.lit(None).cast("string")
    return out.select("order", fid.alias("feature_id"), "type", "id", "geometry", F.to_json(F.struct(*props)).alias("properties"))


def as_text(features: DataFrame) -> DataFrame:
    """One line of GeoJSON per feature."""
    fid = F.when(F.col("feature_id").isNotNull(), F.concat(F.lit('"id":"'), "feature_id", F.lit('",'))).otherwise("")
    return features.select("order", "type", "id", F.concat(F.lit("{"), fid, F.lit('"type":"Feature","geometry":'), "geometry", F.lit(',"properties":'), "properties", F.lit("}")).alias("value"))
