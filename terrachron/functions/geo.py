"""Geometry in column expressions: points are structs with lon and lat, lines arrays of them."""

import math

from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0  # metres, fixed value


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def _once(value, f):
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def contains(bounds, lat, lon):
    """Whether the point lies in the bounds, edges included."""
    b = _c(bounds)
    return _c(lat).between(b["minlat"], b["maxlat"]) & _c(lon).between(b["minlon"], b["maxlon"])


def tile_bounds(x, y, z):
    """Bounds of a web-mercator tile; null where x or y don't exist at zoom z."""
    x, y, n = _c(x), _c(y), F.pow(F.lit(2.0), _c(z))
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    lon = lambda v: v / n * 360.0 - 180.0
    b = F.struct(lat(y + 1).alias("minlat"), lat(y).alias("maxlat"), lon(x).alias("minlon"), lon(x + 1).alias("maxlon"))
    return F.when((x >= 0) & (y >= 0) & (x < n) & (y < n), b)


def bounds_of(points):
    """Bounds of a list of points; null if it is empty."""
    p = _c(points)
    lat, lon = F.transform(p, lambda x: x["lat"]), F.transform(p, lambda x: x["lon"])
    b = F.struct(F.array_min(lat).alias("minlat"), F.array_max(lat).alias("maxlat"), F.array_min(lon).alias("minlon"), F.array_max(lon).alias("maxlon"))
    return F.when(F.size(p) > 0, b)


def annotated(node):
    """Whether a way's node carries its location: a version or coordinates that are not zero."""
    z = lambda c: F.coalesce(node[c], F.lit(0))
    return (z("version") != 0) | (z("lon") != 0) | (z("lat") != 0)


def line(nodes):
    """Points of the nodes that carry their location."""
    at = F.filter(_c(nodes), annotated)
    return F.transform(at, lambda n: F.struct(F.coalesce(n["lon"], F.lit(0.0)).alias("lon"), F.coalesce(n["lat"], F.lit(0.0)).alias("lat")))


def updates_until(updates, t):
    return F.filter(_c(updates), lambda u: u["timestamp"] <= _c(t))


def line_at(nodes, updates, t):
    """Points as of t: updates apply in their order until the first after t; nodes without a location at first stay out."""
    nodes, t = _c(nodes), _c(t)

    def until(updates):
        late = F.transform(updates, lambda u: F.coalesce(u["timestamp"] > t, F.lit(False)))
        first = F.array_position(late, F.lit(True))
        return _once(first, lambda k: F.when(k > 0, F.slice(updates, F.lit(1), (k - 1).cast("int"))).otherwise(updates))

    def place(n, own):
        got, u = F.size(own) > 0, F.try_element_at(own, F.lit(-1))
        return F.struct(F.when(got, u["lon"]).otherwise(F.coalesce(n["lon"], F.lit(0.0))).alias("lon"), F.when(got, u["lat"]).otherwise(F.coalesce(n["lat"], F.lit(0.0))).alias("lat"), annotated(n).alias("ok"))

    def points(used):
        each = F.transform(nodes, lambda n, i: _once(F.filter(used, lambda u: u["index"] == i), lambda own: place(n, own)))
        return F.transform(F.filter(each, lambda p: p["ok"]), lambda p: F.struct(p["lon"], p["lat"]))

    return _once(_once(_c(updates), until), points)


def nodes_updated(nodes, updates, t):
    """Way nodes with the updates up to t applied in order; an index out of range raises."""
    nodes, used = _c(nodes), updates_until(updates, t)
    bad = F.exists(used, lambda u: (u["index"] < 0) | (u["index"] >= F.size(nodes)))

    def one(n, i):
        u = F.try_element_at(F.filter(used, lambda u: u["index"] == i), F.lit(-1))
        new = F.struct(n["ref"].alias("ref"), u["version"].alias("version"), u["changeset"].alias("changeset"), u["lat"].alias("lat"), u["lon"].alias("lon"))
        return F.when(u.isNotNull(), new).otherwise(n)

    return F.when(bad, F.raise_error(F.lit("update index out of range")).cast("array<struct<ref: bigint, version: int, changeset: bigint, lat: double, lon: double>>")).otherwise(F.transform(nodes, one))


def members_updated(members, updates, t):
    """Relation members with the updates up to t applied; a reverse turns the orientation, every time."""
    members, used = _c(members), updates_until(updates, t)
    bad = F.exists(used, lambda u: (u["index"] < 0) | (u["index"] >= F.size(members)))

    def one(m, i):
        own = F.filter(used, lambda u: u["index"] == i)
        u = F.try_element_at(own, F.lit(-1))
        turns = F.size(F.filter(own, lambda x: F.coalesce(x["reverse"], F.lit(False))))
        side = F.when(turns % 2 == 1, -m["orientation"]).otherwise(m["orientation"]).cast("tinyint")
        m2 = m.withField("version", u["version"]).withField("changeset", u["changeset"]).withField("lat", u["lat"]).withField("lon", u["lon"]).withField("orientation", side)
        return F.when(u.isNotNull(), m2).otherwise(m)

    return F.when(bad, F.raise_error(F.lit("update index out of range"))).otherwise(F.transform(members, one))


def updates_after(updates, t):
    return F.filter(_c(updates), lambda u: ~F.coalesce(u["timestamp"] <= _c(t), F.lit(False)))


def signed_area(points):
    """Shoelace sum over the points moved to the first one; positive counterclockwise."""
    p = _c(points)
    o = F.get(p, F.lit(0))
    moved = F.transform(p, lambda q: F.struct((q["lon"] - o["lon"]).alias("x"), (q["lat"] - o["lat"]).alias("y")))
    step = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    s = F.aggregate(moved, step, lambda s, q: F.struct((s["a"] + s["x"] * q["y"] - q["x"] * s["y"]).alias("a"), q["x"].alias("x"), q["y"].alias("y")))
    return s["a"] / 2


def orientation(points):
    """1 counterclockwise, -1 clockwise or without area."""
    return F.when(signed_area(points) > 0, 1).otherwise(-1).cast("tinyint")


def ring(points):
    """The points, closed by the first one where they aren't."""
    p = _c(points)
    open_ = (F.size(p) > 0) & (F.element_at(p, 1) != F.element_at(p, -1))
    return F.when(open_, F.concat(p, F.slice(p, 1, 1))).otherwise(p)


def turned(points, want):
    """The ring in the orientation wanted (1 or -1)."""
    p = _c(points)
    return F.when(orientation(p) != want, F.reverse(p)).otherwise(p)


def is_reverse(before, now, line_before, line_now):
    """Whether a way turned round between versions: rings by the sign of their areas, lines by swapped ends."""
    b, n = _c(before), _c(now)
    two = (F.size(b) > 1) & (F.size(n) > 1)
    e = lambda a, i: F.try_element_at(a, F.lit(i))
    a_ring = (e(b, 1) == e(b, -1)) | (e(n, 1) == e(n, -1))
    opposite = signed_area(line_before) * signed_area(line_now) < 0
    swapped = (e(b, 1) == e(n, -1)) & (e(b, -1) == e(n, 1))
    return F.coalesce(two & F.when(a_ring, opposite).otherwise(swapped), F.lit(False))


def distance(lat1, lon1, lat2, lon2):
    """Great-circle metres (haversine)."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def centroid(points):
    """Mean of the midpoints of a line's segments, weighted by their lengths; null without length."""
    p = _c(points)
    part = lambda a, b: F.struct(distance(a["lat"], a["lon"], b["lat"], b["lon"]).alias("w"), (a["lon"] + b["lon"]).alias("lon"), (a["lat"] + b["lat"]).alias("lat"))
    parts = F.zip_with(F.slice(p, F.lit(1), F.greatest(F.lit(0), F.size(p) - 1)), F.slice(p, F.lit(2), F.greatest(F.lit(0), F.size(p) - 1)), part)
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    add = lambda s, q: F.struct((s["w"] + q["w"]).alias("w"), (s["lon"] + q["w"] * q["lon"] / 2).alias("lon"), (s["lat"] + q["w"] * q["lat"] / 2).alias("lat"))
    return _once(F.aggregate(parts, zero, add), lambda s: F.when(s["w"] > 0, F.struct((s["lon"] / s["w"]).alias("lon"), (s["lat"] / s["w"]).alias("lat"))))


def point_on_line(points, centre=None):
    """The vertex nearest the centroid (or the centre given); the first of equals."""
    p = _c(points)
    far = lambda c: F.array_min(F.transform(p, lambda q, i: F.struct(distance(q["lat"], q["lon"], c["lat"], c["lon"]).alias("d"), i.alias("i"), q.alias("p"))))
    return _once(centroid(p) if centre is None else _c(centre), far)["p"]
