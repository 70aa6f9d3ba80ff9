"""Identifiers, tags, times and geometry."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terrachron.functions import geo, ids, tags, times

TAG = "array<struct<k: string, v: string>>"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def tag_list(*kv):
    return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in kv)).cast(TAG)


def test_pack_and_text(spark):
    p = ids.pack(F.lit("node"), F.lit(4343778904), F.lit(7))
    r = one(spark, p, ids.type_name(p), ids.ref_of(p), ids.version_of(p), ids.element_text(p), ids.feature_text(p), ids.element_text(ids.feature_of(p)))
    assert tuple(r) == (0x100102E8CE580007, "node", 4343778904, 7, "node/4343778904:7", "node/4343778904", "node/4343778904:-")


@pytest.mark.parametrize("text,kind,ref,version", [("way/3:4", "way", 3, 4), ("relation/9", "relation", 9, 0), ("changeset/5:-", "changeset", 5, 0), ("way3", None, None, None), ("way/x", None, None, None), ("pond/1", None, None, None), ("way/1:a", None, None, None)])
def test_parse(spark, text, kind, ref, version):
    p = ids.parse_text(F.lit(text))
    assert tuple(one(spark, ids.type_name(p), ids.ref_of(p), ids.version_of(p))) == (kind, ref, version)


def test_packed_order_is_type_ref_version(spark):
    rows = [("way", 1, 1), ("node", 9, 2), ("node", 9, 1), ("relation", 0, 0), ("node", 2, 65535)]
    d = spark.createDataFrame(rows, "t string, r long, v int")
    assert [tuple(r) for r in d.orderBy(ids.pack("t", "r", "v")).collect()] == sorted(rows, key=lambda x: (["node", "way", "relation"].index(x[0]), x[1], x[2]))


def test_tags(spark):
    t = tag_list(("a", "1"), ("b", "2"), ("a", "3"))
    r = one(spark, tags.find(t, "a"), tags.find(t, "x"), tags.find_or_empty(t, "x"), tags.has(t, "b"), tags.as_map(t), F.transform(tags.by_key_value(t), lambda x: x["k"]))
    assert tuple(r) == ("1", None, "", True, {"a": "3", "b": "2"}, ["a", "a", "b"])


@pytest.mark.parametrize("kv,ignore,want", [([], None, False), ([("source", "x")], None, False), ([("name", "x")], None, True), ([("name", "x")], {"name": "true"}, False), ([("name", "x")], {"name": "x"}, False), ([("name", "x")], {"name": "y"}, True)])
def test_interesting(spark, kv, ignore, want):
    m = None if ignore is None else F.create_map(*(F.lit(x) for p in ignore.items() for x in p))
    assert one(spark, tags.interesting(tag_list(*kv), m))[0] is want


@pytest.mark.parametrize("kv,want", [([("building", "yes")], True), ([("building", "no")], False), ([("area", "no"), ("building", "yes")], False), ([("area", "yes")], True), ([("highway", "primary")], False), ([("highway", "services")], True), ([("natural", "coastline")], False), ([("natural", "water")], True), ([("power", "")], False), ([("barrier", "fence"), ("barrier", "wall")], False), ([], False)])
def test_area(spark, kv, want):
    n = lambda *refs: F.array(*(F.struct(F.lit(x).alias("ref")) for x in refs))
    r = one(spark, tags.way_is_area(n(1, 2, 3, 1), tag_list(*kv)), tags.way_is_area(n(1, 2, 3, 4), tag_list(*kv)), tags.way_is_area(n(1, 2, 1), tag_list(*kv)))
    assert tuple(r) == (want, False, False)


def test_relation_area_and_changeset(spark):
    assert tuple(one(spark, *(tags.relation_is_area(tag_list(("type", x))) for x in ("multipolygon", "boundary", "route")))) == (True, True, False)
    d = spark.range(1).select(tag_list(("comment", "c"), ("bot", "yes"), ("created_by", "me")).alias("tags"))
    assert d.select(*tags.changeset_fields()).first().asDict() == {"comment": "c", "created_by": "me", "locale": "", "host": "", "imagery_used": "", "source": "", "bot": True}


def test_times(spark):
    r = one(spark, times.note_date(F.lit("2014-05-08 23:05:02 UTC")), times.feed_time(F.lit(r"2016-07-02T22\:46\:01Z")), times.feed_time(F.lit("2016-07-02 22:46:01.422137422 Z")), times.feed_time(F.lit("2016-07-02 22:46:01.422137422 +00:00")), times.feed_time(F.lit("?")))
    assert tuple(r) == (datetime(2014, 5, 8, 23, 5, 2), datetime(2016, 7, 2, 22, 46, 1), datetime(2016, 7, 2, 22, 46, 1, 422137), datetime(2016, 7, 2, 22, 46, 1, 422137), None)
    s = one(spark, times.interval_state(F.lit("#Sat\ntxnMaxQueried=836439235\nsequenceNumber=2010594\ntimestamp=2016-07-16T06\\:16\\:02Z\ntxnMax=836439235\n")).alias("s")).s
    assert tuple(s) == (2010594, datetime(2016, 7, 16, 6, 16, 2), 836439235, 836439235)
    text = "---\nlast_run: 2016-07-02 22:46:01.422137422 Z\nsequence: 1912325\n"
    r = one(spark, times.changeset_state(F.lit(text)).alias("a"), times.changeset_state(F.lit(text), F.lit(5)).alias("b"))
    assert (r.a.seq, r.b.seq) == (1912326, 5)
    assert one(spark, times.feed_path("http://h", "minute", F.lit(1234567)))[0] == "http://h/replication/minute/001/234/567.osc.gz"


def pts(*p):
    return F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in p))


def test_areas_and_rings(spark):
    sq = [(0, 0), (2, 0), (2, 1), (0, 1)]
    r = one(spark, geo.signed_area(pts(*sq)), geo.orientation(pts(*sq[::-1])), geo.orientation(pts((0, 0), (1, 1))), F.size(geo.ring(pts(*sq))), F.size(geo.ring(pts(*sq, (0, 0)))), geo.orientation(geo.turned(pts(*sq), -1)))
    assert tuple(r) == (2.0, -1, -1, 5, 5, -1)


@pytest.mark.parametrize("b,n,want", [([1, 2, 3], [3, 2, 1], True), ([1, 2, 3], [1, 2, 3], False), ([1, 2, 3], [3, 9, 1], True), ([1], [1, 2], False), ([1, 2, 3, 1], [1, 3, 2, 1], True)])
def test_reverse(spark, b, n, want):
    place = {1: (0, 0), 2: (1, 0), 3: (1, 1), 9: (5, 5)}
    arr = lambda a: F.array(*map(F.lit, a))
    assert one(spark, geo.is_reverse(arr(b), arr(n), pts(*(place[i] for i in b)), pts(*(place[i] for i in n))))[0] is want


def test_tile_and_distance(spark):
    b = one(spark, geo.tile_bounds(F.lit(7), F.lit(8), F.lit(9)).alias("b"), geo.tile_bounds(F.lit(512), F.lit(0), F.lit(9)).alias("none"))
    assert b.none is None and b.b.minlon == 7 / 512 * 360 - 180 and 84 < b.b.minlat < b.b.maxlat < 85.1
    assert abs(one(spark, geo.distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))[0] - math.pi * geo.EARTH_RADIUS) < 1
    p = pts((0, 0), (0, 10), (0, 20), (1, 20))
    r = one(spark, geo.centroid(p).alias("c"), geo.point_on_line(p).alias("p"), geo.bounds_of(p).alias("b"), geo.bounds_of(F.slice(p, 1, 0)).alias("e"))
    assert 9 < r.c.lat < 11.2 and tuple(r.p) == (0.0, 10.0) and tuple(r.b) == (0.0, 20.0, 0.0, 1.0) and r.e is None


NODES = "array<struct<ref: bigint, version: int, changeset: bigint, lat: double, lon: double>>"
UP = "array<struct<index: int, version: int, timestamp: timestamp, changeset: bigint, lat: double, lon: double, reverse: boolean>>"


def test_lines_and_updates(spark):
    t = lambda h: datetime(2020, 1, 1, h)
    d = spark.createDataFrame([([(1, 1, 1, 1.0, 1.0), (2, None, None, None, None), (3, 1, 1, 3.0, 3.0)], [(0, 2, t(1), 5, 1.5, 1.5, False), (2, 2, t(9), 6, 3.5, 3.5, False), (1, 2, t(2), 7, 2.5, 2.5, False), (7, 2, t(23), 7, 2.5, 2.5, False)])], f"nodes {NODES}, updates {UP}")
    at = F.lit(t(3))
    r = d.select(geo.line("nodes").alias("a"), geo.line_at("nodes", "updates", at).alias("b"), geo.nodes_updated("nodes", "updates", at).alias("c"), F.size(geo.updates_after("updates", at)).alias("n")).first()
    assert [x.lon for x in r.a] == [1.0, 3.0] and [x.lon for x in r.b] == [1.5, 3.0]
    assert [x.version for x in r.c] == [2, 2, 1] and r.n == 2
    with pytest.raises(Exception, match="out of range"):
        d.select(geo.nodes_updated("nodes", "updates", F.lit(datetime(2021, 1, 1)))).collect()


def test_levels_of_diamonds_and_cycles(spark):
    from terrachron.operators import order

    kids = {}
    for k in range(3):  # each diamond doubles the number of ways down
        kids |= {10 * k: [10 * k + 1, 10 * k + 2], 10 * k + 1: [10 * k + 10], 10 * k + 2: [10 * k + 10]}
    kids |= {30: [99], 50: [51], 51: [50], 52: [51], 53: [53]}  # 99 is not there; a cycle, what is above it, a loop
    rows = [(i, 1, [("relation", k, "") for k in c]) for i, c in kids.items()]
    d = spark.createDataFrame(rows, "id long, version int, members array<struct<type: string, ref: long, role: string>>")
    got = {r.id: r.level for r in order.levels(d).collect()}
    assert got == {**{10 * k: 6 - 2 * k for k in range(4)}, **{10 * k + j: 5 - 2 * k for k in range(3) for j in (1, 2)}, 50: None, 51: None, 52: None, 53: None}
