"""Operators on lists of updates, lines, rings, relations, notes and changes, each over the driver's tables and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, tags, times
from ..operators import container, diff, features, history, joins, rings, stats
from ..operators.store import Store
from .views import BASE
from .workload import _AS_OF, _AS_OF_MANY, _nd, node_history, nodes, query, relations, way_history, ways

_U = "u AS (SELECT way_id AS id, idx, (way_id * 31 + idx * 17) % 48 AS h, (way_id + idx) % 9 AS val FROM ref_v)"
_N = "n AS (SELECT way_id AS id, count(*) AS n, arg_min(ref, idx) AS first, arg_max(ref, idx) AS last FROM ref_v GROUP BY way_id)"
_P = "p AS (SELECT r.way_id AS id, r.idx, n.lon, n.lat FROM ref_v r JOIN node_v n ON r.ref = n.id)"
NOON = "2024-01-02"


def _updated(t):
    """id, nodes (version 1, at 100 east) and updates (hour h of two days, to val) of each order."""
    r = t.ref_v.groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", "ref"))).alias("r"))
    zero = F.lit(0).cast("bigint").alias("changeset")
    nd = F.transform("r", lambda x: F.struct(x["ref"].alias("ref"), F.lit(1).alias("version"), zero, F.lit(0.0).alias("lat"), F.lit(100.0).alias("lon")))

    def update(x):
        at = F.lit(BASE).cast("timestamp") + F.make_interval(hours=((F.col("id") * 31 + x["idx"] * 17) % 48).cast("int"))
        to = ((F.col("id") + x["idx"]) % 9).cast("double").alias("lon")
        return F.struct(x["idx"].alias("index"), F.lit(2).alias("version"), at.alias("timestamp"), zero, F.lit(0.0).alias("lat"), to, (x["idx"] % 2 == 1).alias("reverse"))

    return r.select("id", nd.alias("nodes"), F.reverse(F.transform("r", update)).alias("updates"))


def _hour(u):
    return ((F.unix_timestamp(u["timestamp"]) - F.unix_timestamp(F.lit(BASE).cast("timestamp"))) / 3600).cast("bigint")


# updates


@query("updates_until", f"WITH {_U} SELECT id, count(*) FILTER (WHERE h <= 24) AS until, count(*) FILTER (WHERE h > 24) AS later FROM u GROUP BY id")
def _(t):
    at = F.lit(NOON).cast("timestamp")
    size = lambda x: F.size(x).cast("bigint")
    return _updated(t).select("id", size(geo.updates_until("updates", at)).alias("until"), size(geo.updates_after("updates", at)).alias("later"))


@query("nodes_updated", f"WITH {_U} SELECT id, sum(CASE WHEN h <= 24 THEN val ELSE 100 END)::DOUBLE AS total, sum(CASE WHEN h <= 24 THEN 2 ELSE 1 END)::BIGINT AS versions FROM u GROUP BY id")
def _(t):
    d = _updated(t).select("id", geo.nodes_updated("nodes", "updates", F.lit(NOON).cast("timestamp")).alias("n"))
    add = lambda c, zero: F.aggregate("n", zero, lambda s, x: s + x[c])
    return d.select("id", add("lon", F.lit(0.0)).alias("total"), add("version", F.lit(0)).cast("bigint").alias("versions"))


@query("members_updated", f"WITH {_U} SELECT id, sum(CASE WHEN h <= 24 AND idx % 2 = 1 THEN -1 ELSE 1 END)::BIGINT AS sides, sum(CASE WHEN h <= 24 THEN val ELSE 0 END)::DOUBLE AS total FROM u GROUP BY id")
def _(t):
    none = {"changeset": "bigint", "lat": "double", "nodes": "array<struct<ref: bigint, version: int, changeset: bigint, lat: double, lon: double>>"}
    member = lambda n: F.struct(F.lit("way").alias("type"), n["ref"].alias("ref"), F.lit("").alias("role"), F.lit(1).alias("version"), *(F.lit(None).cast(none[c]).alias(c) for c in ("changeset", "lat")), F.lit(0.0).alias("lon"), F.lit(1).cast("tinyint").alias("orientation"), F.lit(None).cast(none["nodes"]).alias("nodes"))
    d = _updated(t).withColumn("members", F.transform("nodes", member))
    d = d.select("id", geo.members_updated("members", "updates", F.lit(NOON).cast("timestamp")).alias("m"))
    sides = F.aggregate("m", F.lit(0), lambda s, x: s + x["orientation"])
    return d.select("id", sides.cast("bigint").alias("sides"), F.aggregate("m", F.lit(0.0), lambda s, x: s + x["lon"]).alias("total"))


@query("updates_in_order", f"WITH {_U} SELECT id, idx, row_number() OVER (PARTITION BY id ORDER BY h, idx DESC) - 1 AS by_time, row_number() OVER (PARTITION BY id ORDER BY idx, h) - 1 AS by_index, h FROM u")
def _(t):
    d = _updated(t)
    one = d.select("id", F.posexplode(container.updates_by_time(F.col("updates"))).alias("by_time", "u")).select("id", F.col("u.index").alias("idx"), F.col("by_time").cast("bigint"), _hour(F.col("u")).alias("h"))
    two = d.select("id", F.posexplode(history.sorted_updates(F.col("updates"))).alias("by_index", "u")).select("id", F.col("u.index").alias("idx"), F.col("by_index").cast("bigint"))
    return one.join(two, ["id", "idx"])


# lines and rings


@query("annotated_line", "SELECT way_id AS id, count(*) FILTER (WHERE idx % 3 > 0) AS n, coalesce(max(idx) FILTER (WHERE idx % 3 > 0), -1)::BIGINT AS last FROM ref_v GROUP BY way_id")
def _(t):
    r = t.ref_v.groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", "ref"))).alias("r"))
    place = lambda x: F.when(x["idx"] % 3 == 1, x["idx"].cast("double"))
    nd = F.transform("r", lambda x: F.struct(x["ref"].alias("ref"), F.when(x["idx"] % 3 == 2, x["idx"]).otherwise(0).alias("version"), place(x).alias("lon"), F.lit(None).cast("double").alias("lat"), x["idx"].alias("idx")))
    used = F.filter(nd, geo.annotated)
    return r.select("id", F.size(geo.line(nd)).cast("bigint").alias("n"), F.coalesce(F.array_max(F.transform(used, lambda x: x["idx"])), F.lit(-1)).cast("bigint").alias("last"))


_TURN = "WITH {p}, a AS (SELECT id, idx, lon, lat, first_value(lon) OVER w AS x0, first_value(lat) OVER w AS y0, lag(lon) OVER w AS px, lag(lat) OVER w AS py FROM p WINDOW w AS (PARTITION BY id ORDER BY idx)), s AS (SELECT id, count(*) AS n, sum(coalesce((px - x0) * (lat - y0) - (lon - x0) * (py - y0), 0)) / 2 AS area, arg_min(struct_pack(lon := lon, lat := lat), idx) AS f, arg_max(struct_pack(lon := lon, lat := lat), idx) AS l FROM a GROUP BY id)"


@query("turned_rings", _TURN.format(p=_P) + " SELECT id, (n + CASE WHEN f <> l THEN 1 ELSE 0 END)::BIGINT AS n, f.lon AS lon, (CASE WHEN area > 0.000001 THEN 1 ELSE -1 END)::TINYINT AS side, abs(round(area, 4)) + 0 AS area FROM s WHERE abs(area) > 0.000001")
def _(t):
    w = joins.way_points(ways(t).withColumn("nodes", F.when((F.col("id") - 1) % 3 == 0, F.slice("nodes", F.lit(1), F.size("nodes") - 1)).otherwise(F.col("nodes"))), nodes(t))
    d = w.where(F.abs(geo.signed_area("points")) > 0.000001).withColumn("ring", geo.turned(geo.ring("points"), 1))
    return d.select("id", F.size("ring").cast("bigint").alias("n"), F.col("ring")[0]["lon"].alias("lon"), geo.orientation("points").alias("side"), (F.round(geo.signed_area("ring"), 4) + 0).alias("area"))


@query("reversals", f"WITH {_N} SELECT id, n > 1 AND first <> last AND id % 2 = 1 AS reverse FROM n")
def _(t):
    r = t.ref_v.groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", "ref"))).alias("r"))
    refs = F.transform("r", lambda x: x["ref"])
    none = F.array().cast("array<struct<lon: double, lat: double>>")
    return r.select("id", geo.is_reverse(refs, F.when(F.col("id") % 2 == 1, F.reverse(refs)).otherwise(refs), none, none).alias("reverse"))


_SEGMENTS = f"""WITH {_P}, q AS (SELECT id, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY id ORDER BY idx)),
  d AS (SELECT *, 2 * 6378137.0 * asin(sqrt(least(1.0, power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2)))) AS w FROM q WHERE x2 IS NOT NULL),
  c AS (SELECT id, sum(w * (x1 + x2) / 2) / sum(w) AS lon, sum(w * (y1 + y2) / 2) / sum(w) AS lat, sum(w) AS length FROM d GROUP BY id HAVING sum(w) > 0)"""


def _open_lines(t):
    return joins.way_points(ways(t).withColumn("nodes", F.when((F.col("id") - 1) % 3 == 0, F.slice("nodes", F.lit(1), F.size("nodes") - 1)).otherwise(F.col("nodes"))), nodes(t))


def _centred(t):
    """Lines with their centroid c, if they have one; exploded, as a filter on it would work it out again."""
    return _open_lines(t).select("id", "points", F.explode(F.array_compact(F.array(geo.centroid("points")))).alias("c"))


@query("centroids", _SEGMENTS + " SELECT id, round(lon, 6) + 0 AS lon, round(lat, 6) + 0 AS lat FROM c")
def _(t):
    d = _centred(t)
    return d.select("id", (F.round("c.lon", 6) + 0).alias("lon"), (F.round("c.lat", 6) + 0).alias("lat"))


@query("points_on_lines", _SEGMENTS + """ SELECT p.id, round(min(2 * 6378137.0 * asin(sqrt(least(1.0, power(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * power(sin(radians(c.lon - p.lon) / 2), 2))))), 2) + 0 AS metres FROM p JOIN c ON p.id = c.id GROUP BY p.id""")
def _(t):
    d = _centred(t).select("id", geo.point_on_line("points", "c").alias("p"), "c")
    return d.select("id", (F.round(geo.distance("p.lat", "p.lon", "c.lat", "c.lon"), 2) + 0).alias("metres"))


def _pieces(t):
    """Relations whose ways are the steps from each place of an order to the next, every other one backwards, and ways round."""
    n = t.ref_v.groupBy(F.col("way_id").alias("id")).agg(F.count("*").alias("n")).where("n > 2")
    step = n.select("id", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i")).where((F.col("i") < F.col("n") - 1) | (F.col("id") % 2 == 0))
    point = lambda x: F.struct(x.cast("double").alias("lon"), F.col("id").cast("double").alias("lat"))
    there = F.array(point(F.col("i")), point((F.col("i") + 1) % F.col("n")))
    w = step.select((F.col("id") * 1000 + F.col("i")).alias("id"), F.when(F.col("i") % 2 == 1, F.reverse(there)).otherwise(there).alias("points"))
    none = {"version": "int", "changeset": "bigint", "lat": "double", "lon": "double", "orientation": "tinyint", "nodes": "array<struct<ref: bigint, version: int, changeset: bigint, lat: double, lon: double>>"}
    m = F.struct("i", F.lit("way").alias("type"), (F.col("id") * 1000 + F.col("i")).alias("ref"), F.lit("outer").alias("role"), *(F.lit(None).cast(c).alias(k) for k, c in none.items()))
    r = step.groupBy("id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    return r.select("id", F.transform("m", lambda x: x.dropFields("i")).alias("members")), w


@query("joined_chains", f"WITH {_N} SELECT id, 0 AS chain, (n + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS points, (n - CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END)::BIGINT AS members, (n - 1)::DOUBLE AS east, id % 2 = 0 AS is_ring FROM n WHERE n > 2")
def _(t):
    r, w = _pieces(t)
    d = rings.joined(r, w)
    east = F.array_max(F.transform("points", lambda p: p["lon"]))
    return d.select("id", "chain", F.size("points").cast("bigint").alias("points"), F.size("indexes").cast("bigint").alias("members"), east.alias("east"), "is_ring")


def _squares(t, kind):
    """Multipolygons of two squares and a smaller one, inside the first but for every third; squares of odd ids run clockwise."""
    ids = t.node_v.select("id")
    node = lambda x, y: F.struct(F.lit(None).cast("bigint").alias("ref"), F.lit(1).alias("version"), F.lit(0).cast("bigint").alias("changeset"), (F.lit(float(y))).alias("lat"), x.cast("double").alias("lon"))

    def square(x, y, size):
        c = F.array(node(x, y), node(x + size, y), node(x + size, y + size), node(x, y + size), node(x, y))
        return F.when(F.col("id") % 2 == 1, F.reverse(c)).otherwise(c)

    shift = F.when(F.col("id") % 3 == 0, 20).otherwise(2)
    both = ids.select("id", F.explode(F.array(F.struct(F.lit(1).alias("k"), square(F.lit(0), 1, 10).alias("nodes")), F.struct(F.lit(2).alias("k"), square(shift, 3, 4).alias("nodes")), F.struct(F.lit(3).alias("k"), square(F.lit(40), 1, 10).alias("nodes")))).alias("x"))
    empty = F.array().cast("array<struct<k: string, v: string>>")
    w = both.select((F.col("id") * 10 + F.col("x.k")).alias("id"), F.lit(1).alias("version"), F.lit("2016-01-01").cast("timestamp").alias("timestamp"), F.lit(True).alias("visible"), F.lit(None).cast("timestamp").alias("committed"), F.lit(0).cast("bigint").alias("changeset"), empty.alias("tags"), F.col("x.nodes").alias("nodes"))
    none = {"version": "int", "changeset": "bigint", "lat": "double", "lon": "double", "orientation": "tinyint", "nodes": "array<struct<ref: bigint, version: int, changeset: bigint, lat: double, lon: double>>"}
    m = lambda k, role: F.struct(F.lit("way").alias("type"), (F.col("id") * 10 + k).alias("ref"), F.lit(role).alias("role"), *(F.lit(1 if c == "version" else None).cast(d).alias(c) for c, d in none.items()))
    r = ids.select("id", F.lit(1).alias("version"), F.array(F.struct(F.lit("type").alias("k"), F.lit(kind).alias("v")), F.struct(F.lit("name").alias("k"), F.lit("x").alias("v"))).alias("tags"), F.array(m(1, "outer"), m(2, "inner"), m(3, "outer")).alias("members"))
    return r, w


@query("polygons", "SELECT 'relation' AS type, id, 'MultiPolygon' AS kind, (CASE WHEN id % 3 = 0 THEN 2 ELSE 3 END)::BIGINT AS rings, false AS tainted, (CASE WHEN id % 3 = 0 THEN 200 ELSE 184 END)::DOUBLE AS area FROM node_v")
def _(t):
    r, w = _squares(t, "multipolygon")
    f, _used = features.relation_features(r, w, nodes(t))
    shape = F.from_json("geometry", "type string, coordinates array<array<array<array<double>>>>")
    d = f.select("type", "id", "tainted", shape.alias("g")).withColumn("r", F.flatten("g.coordinates"))
    points = F.transform("r", lambda c: F.transform(c, lambda q: F.struct(q[0].alias("lon"), q[1].alias("lat"))))
    area = F.aggregate(points, F.lit(0.0), lambda s, c: s + geo.signed_area(c))
    return d.select("type", "id", F.col("g.type").alias("kind"), F.size("r").cast("bigint").alias("rings"), "tainted", area.alias("area"))


@query("member_orientations", "SELECT id, i AS idx, (CASE WHEN id % 2 = 1 THEN -1 ELSE 1 END)::TINYINT AS side FROM node_v, (VALUES (0), (1), (2)) v(i)")
def _(t):
    r, w = _squares(t, "boundary")
    d = rings.member_orientations(r, w)
    return d.select("id", F.posexplode("members").alias("idx", "m")).select("id", "idx", F.col("m.orientation").alias("side"))


_WAYS = f"WITH {_N}, s AS (SELECT id, n + CASE WHEN (id - 1) % 3 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN (id - 1) % 3 = 0 THEN n > 2 ELSE n > 3 AND first = last END AS area FROM n)"


@query("way_features", _WAYS + " SELECT s.id, CASE WHEN s.area THEN 'Polygon' ELSE 'LineString' END AS kind, s.size::BIGINT AS points, false AS tainted, w.status FROM s JOIN way_v w ON w.id = s.id WHERE s.size > 1 AND s.id % 5 > 0")
def _(t):
    f = features.way_features(ways(t), nodes(t), t.way_v.select("id").where("id % 5 = 0"))
    flat = F.from_json("geometry", "coordinates array<array<double>>")["coordinates"]
    deep = F.from_json("geometry", "coordinates array<array<array<double>>>")["coordinates"]
    kind = F.get_json_object("geometry", "$.type")
    n = F.when(kind == "Polygon", F.size(deep[0])).otherwise(F.size(flat))
    return f.select("id", kind.alias("kind"), n.cast("bigint").alias("points"), "tainted", F.col("tags")["status"].alias("status"))


@query("node_features", "SELECT 'node' AS type, id, lon, lat, brand, false AS tainted FROM node_v WHERE id % 4 > 0")
def _(t):
    zero = F.col("id") % 4 == 0  # without place or version: no feature
    n = nodes(t).withColumns({"lat": F.when(zero, 0.0).otherwise(F.col("lat")), "lon": F.when(zero, 0.0).otherwise(F.col("lon")), "version": F.when(zero, 0).otherwise(F.greatest("version", F.lit(1)))})
    f = features.node_features(n, ways(t), relations(t))
    at = F.from_json("geometry", "coordinates array<double>")["coordinates"]
    return f.select("type", "id", at[0].alias("lon"), at[1].alias("lat"), F.col("tags")["brand"].alias("brand"), "tainted")


@query("route_features", _WAYS + " SELECT DISTINCT m.rel_id AS id, bool_or(r.id IS NULL) OVER (PARTITION BY m.rel_id) AS tainted FROM member_v m LEFT JOIN s r ON m.ref = r.id WHERE m.rel_id % 2 = 0 AND m.rel_id IN (SELECT rel_id FROM member_v JOIN s ON ref = s.id WHERE s.size > 1)")
def _(t):
    f, _used = features.relation_features(relations(t), ways(t), nodes(t))
    return f.where("type = 'relation' and get_json_object(geometry, '$.type') in ('LineString', 'MultiLineString')").select("id", "tainted")


@query("geojson_properties", "SELECT w.id, w.status, (SELECT count(*) FROM member_v m WHERE m.ref = w.id)::BIGINT AS relations, 1::BIGINT AS version FROM way_v w JOIN (" + _WAYS + " SELECT id FROM s WHERE size > 1) s ON s.id = w.id")
def _(t):
    routes = relations(t).withColumn("tags", F.transform("tags", lambda x: x.withField("v", F.lit("other"))))
    d = features.convert(nodes(t), ways(t), routes).where("type = 'way'")
    p = F.from_json("properties", "tags map<string, string>, relations array<struct<rel: bigint, role: string>>, meta struct<version: bigint>")
    d = d.select("id", p.alias("p"))
    return d.select("id", F.col("p.tags")["status"].alias("status"), F.size("p.relations").cast("bigint").alias("relations"), F.col("p.meta.version").alias("version"))


# relations and parts of annotation


@query("relation_areas", "SELECT DISTINCT rel_id AS id, rel_id % 2 = 1 AS area FROM member_v")
def _(t):
    return relations(t).select("id", tags.relation_is_area("tags").alias("area"))


_SEEN = ", s AS (SELECT r.id, r.version, r.idx, r.ref, max(h.version) FILTER (WHERE h.ts <= r.ts) AS v FROM r {join} node_hist h ON h.id = r.ref GROUP BY r.id, r.version, r.idx, r.ref)"


def _as_relations(t):
    member = lambda n: F.struct(F.lit("node").alias("type"), n["ref"].alias("ref"), F.lit("").alias("role"), *(F.lit(None).cast(c).alias(k) for k, c in (("version", "int"), ("changeset", "bigint"), ("lat", "double"), ("lon", "double"), ("orientation", "tinyint"))))
    return way_history(t).withColumn("members", F.transform("nodes", member)).drop("nodes").withColumn("tags", F.array().cast("array<struct<k: string, v: string>>"))


@query("annotate_relations", _AS_OF + _SEEN.format(join="JOIN") + """ SELECT s.id, CAST(s.version AS INT) AS version, s.idx, s.ref, h.version AS seen, h.lat FROM s LEFT JOIN node_hist h ON h.id = s.ref AND h.version = s.v AND h.visible""")
def _(t):
    d = history.annotate_relations(_as_relations(t), nodes=node_history(t), ignore_inconsistency=True, ignore_missing=True)
    m = F.col("m")
    return d.select("id", "version", F.posexplode("members").alias("idx", "m")).select("id", "version", "idx", m["ref"].alias("ref"), m["version"].alias("seen"), m["lat"].alias("lat"))


@query("annotate_missing", _AS_OF_MANY + _SEEN.format(join="LEFT JOIN") + """ SELECT s.id, CAST(s.version AS INT) AS version, s.idx, s.ref, h.version AS seen FROM s LEFT JOIN node_hist h ON h.id = s.ref AND h.version = s.v AND h.visible""")
def _(t):
    d = history.annotate_ways(way_history(t, many=2), node_history(t), ignore_inconsistency=True, ignore_missing=True)
    d = d.select("id", "version", F.posexplode("nodes").alias("idx", "n"))
    return d.select("id", "version", "idx", F.col("n.ref").alias("ref"), F.col("n.version").alias("seen"))


@query("annotate_filtered", _AS_OF + _SEEN.format(join="JOIN") + """ SELECT s.id, CAST(s.version AS INT) AS version, s.idx, s.ref, CASE WHEN s.idx % 2 = 0 AND s.ref % 2 = 1 THEN 9999 ELSE h.version END AS seen FROM s LEFT JOIN node_hist h ON h.id = s.ref AND h.version = s.v AND h.visible WHERE NOT (s.idx % 2 = 0 AND s.ref % 2 = 0 AND h.version IS NULL)""")
def _(t):
    some = lambda n, i: n.withField("version", F.when(i % 2 == 0, 9999))
    w = way_history(t).withColumn("nodes", F.transform("nodes", some))
    d = history.annotate_ways(w, node_history(t), ignore_inconsistency=True, ignore_missing=True, child_filter=F.col("ref") % 2 == 0)
    d = d.select("id", "version", F.posexplode("nodes").alias("idx", "n"))
    d = d.select("id", "version", "idx", F.col("n.ref").alias("ref"), F.col("n.version").alias("seen"))
    return d.where("not (idx % 2 = 0 and ref % 2 = 0 and seen = 9999)")  # nothing visible yet: left as it was


# lookups


@query("element_history", "SELECT id, version, changeset, visible FROM node_hist WHERE id = 5")
def _(t):
    return Store(node_history(t), ways(t), relations(t)).history("node", 5).select("id", "version", "changeset", "visible")


@query("element_version", "SELECT id, version, changeset FROM node_hist WHERE id = 7 AND version = 3")
def _(t):
    return Store(node_history(t), ways(t), relations(t)).version("node", 7, 3).select("id", "version", "changeset")


_BOX = "b AS (SELECT id FROM node_v WHERE lat BETWEEN -10 AND 10 AND lon BETWEEN -20 AND 20), w AS (SELECT DISTINCT way_id AS id FROM ref_v WHERE ref IN (SELECT id FROM b)), n AS (SELECT id FROM b UNION SELECT ref FROM ref_v WHERE way_id IN (SELECT id FROM w))"


@query("map_call", f"WITH {_BOX} SELECT 'node' AS type, id FROM n UNION ALL SELECT 'way', id FROM w UNION ALL SELECT DISTINCT 'relation', rel_id FROM member_v WHERE ref IN (SELECT id FROM w)")
def _(t):
    n, w, r = Store(nodes(t), ways(t), relations(t)).map(-10.0, -20.0, 10.0, 20.0)
    out = None
    for kind, d in (("node", n), ("way", w), ("relation", r)):
        d = d.select(F.lit(kind).alias("type"), "id")
        out = d if out is None else out.unionByName(d)
    return out


@query("relation_full", "WITH w AS (SELECT ref AS id FROM member_v WHERE rel_id = 8 AND ref IN (SELECT way_id FROM ref_v)) SELECT 'way' AS type, id FROM w UNION ALL SELECT DISTINCT 'node', ref FROM ref_v WHERE way_id IN (SELECT id FROM w)")
def _(t):
    _r, w, n = joins.relation_full(relations(t), ways(t), nodes(t), 8)
    return w.select(F.lit("way").alias("type"), "id").unionByName(n.select(F.lit("node").alias("type"), "id"))


def _notes(t):
    said = F.array(F.struct(F.lit(None).cast("timestamp").alias("date"), F.lit(1).cast("bigint").alias("uid"), F.lit("u").alias("user"), F.lit("").alias("user_url"), F.lit("opened").alias("action"), F.col("event_type").alias("text"), F.lit("").alias("html")))
    e = t.events.select(F.col("event_id").alias("id"), F.col("value").alias("lat"), (F.col("value") / 2).alias("lon"), F.col("ts").cast("timestamp").alias("date_created"), "event_type")
    return e.select("id", "lat", "lon", "date_created", F.when(F.col("event_type") == "error", F.col("date_created") + F.expr("interval 1 day")).alias("date_closed"), said.alias("comments"))


@query("notes_in", "SELECT event_id AS id FROM events WHERE value BETWEEN 10 AND 60 AND value / 2 BETWEEN 8 AND 25 AND (event_type <> 'error' OR ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-13 00:00:00') ORDER BY ts DESC, event_id LIMIT 100")
def _(t):
    return Store(None, None, None, notes=_notes(t)).notes_in(10, 8, 60, 25, now="2024-01-20 00:00:00").select("id")


@query("notes_by_text", "SELECT event_id AS id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 40")
def _(t):
    return Store(None, None, None, notes=_notes(t)).notes_in(text="CHASE", limit=40, closed_days=-1).select("id")


# tags, times, containers, changes


@query("changeset_fields", "SELECT event_id AS id, event_type AS comment, 'app' AS created_by, '' AS locale, '' AS host, '' AS imagery_used, 's' AS source, event_type = 'view' AS bot FROM events")
def _(t):
    kv = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    bot = F.when(F.col("event_type") == "view", "yes").otherwise("no")
    g = F.array(kv("comment", F.col("event_type")), kv("created_by", F.lit("app")), kv("source", F.lit("s")), kv("bot", bot), kv("comment", F.lit("second")))
    return t.events.withColumn("tags", g).select(F.col("event_id").alias("id"), *tags.changeset_fields())


@query("sorted_tags", "SELECT id, least(brand, usr) || '|' || greatest(brand, usr) AS pairs FROM node_v")
def _(t):
    kv = lambda c: F.struct(F.lit("k").alias("k"), F.col(c).alias("v"))
    s = tags.by_key_value(F.array(kv("usr"), kv("brand")))
    return t.node_v.select("id", F.concat_ws("|", F.transform(s, lambda x: x["v"])).alias("pairs"))


@query("tag_round_trip", "SELECT id, 2::BIGINT AS n, kind AS last FROM node_v")
def _(t):
    kv = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))
    back = tags.from_map(tags.as_map(F.array(kv("a", "brand"), kv("b", "usr"), kv("a", "kind"))))
    return t.node_v.select("id", F.size(back).cast("bigint").alias("n"), tags.find(back, "a").alias("last"))


@query("note_dates", "SELECT event_id AS id, date_trunc('second', ts) AS at FROM events")
def _(t):
    return t.events.select(F.col("event_id").alias("id"), times.note_date(F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss 'UTC'")).cast("timestamp_ntz").alias("at"))


@query("changeset_states", "SELECT seq, ts AS timestamp, seq + 1 AS next FROM state_v")
def _(t):
    text = F.concat(F.lit("---\nlast_run: "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSSSSS"), F.lit(" +00:00\nsequence: "), F.col("seq").cast("string"), F.lit("\n"))
    own, now = times.changeset_state(text, "seq"), times.changeset_state(text)
    return t.state_v.select(own["seq"].alias("seq"), own["timestamp"].cast("timestamp_ntz").alias("timestamp"), now["seq"].alias("next"))


@query("committed_at", "SELECT id, version, CASE WHEN version % 2 = 0 THEN ts ELSE ts + INTERVAL 5 MINUTE END AS at FROM node_hist")
def _(t):
    late = F.when(F.col("version") % 2 == 1, F.col("timestamp") + F.expr("interval 5 minutes"))
    h = node_history(t).withColumn("committed", late)
    return h.select("id", "version", times.committed_at().cast("timestamp_ntz").alias("at"))


@query("appended", "SELECT id, version, usr AS name FROM node_v UNION ALL SELECT way_id, 1, NULL FROM (SELECT DISTINCT way_id FROM ref_v) r")
def _(t):
    both = container.append({"x": t.node_v.select("id", "version", F.col("usr").alias("name"))}, "x", ways(t).select("id", "version"))
    return both["x"]


@query("container_objects", "SELECT 0 AS rank, 'node' AS type, id, version FROM node_v UNION ALL SELECT 1, 'way', way_id, 1 FROM (SELECT DISTINCT way_id FROM ref_v) r UNION ALL SELECT 5, 'note', event_id, 0 FROM events")
def _(t):
    return container.objects({"node": nodes(t), "way": ways(t), "note": _notes(t)})


@query("change_history", "SELECT action, id, event_id, action <> 'delete' AS visible, CASE action WHEN 'create' THEN 0 WHEN 'modify' THEN 1 ELSE 2 END AS action_rank FROM change_v")
def _(t):
    return diff.change_history(t.change_v.select("action", "id", "event_id"))


@query("member_sizes", "SELECT max(n)::BIGINT AS max_n_members, arg_min(id, struct_pack(a := -n, b := id)) AS max_n_members_id FROM (SELECT rel_id AS id, count(*) AS n FROM member_v GROUP BY rel_id) x")
def _(t):
    return stats.file_statistics(nodes(t), ways(t), relations(t)).select("max_n_members", "max_n_members_id")


@query("partly_annotated", "SELECT id, n, (n + 1) // 2 AS known FROM (SELECT way_id AS id, count(*) AS n FROM ref_v GROUP BY way_id) x")
def _(t):
    r = t.ref_v.groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", "ref"))).alias("r"))
    nd = F.transform("r", lambda x: _nd(x["ref"]).withField("version", F.when(x["idx"] % 2 == 0, 3)))
    return r.select("id", F.size(nd).cast("bigint").alias("n"), F.size(F.filter(nd, geo.annotated)).cast("bigint").alias("known"))
