"""Sources, sinks, rings, features, streams and lookups."""

import json
import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terrachron.operators import container, features, joins, rings, stats
from terrachron.operators.rings import Segment
from terrachron.operators.store import NotFound, Store
from terrachron.sources import json as js
from terrachron.sources import pbf, replication, sinks, xml
from terrachron.streaming import feed

MAP = """<?xml version="1.0"?><osm version="0.6">
<bounds minlat="0" maxlat="9" minlon="0" maxlon="9"/>
<node id="1" version="1" lat="0" lon="0" visible="true" timestamp="2012-01-01T00:00:00Z" user="u" uid="5" changeset="7"/>
<node id="2" version="1" lat="0" lon="4" visible="true"><tag k="name" v="a &amp; b"/></node>
<node id="3" version="1" lat="4" lon="4"/><node id="4" version="1" lat="4" lon="0"/>
<node id="5" version="1" lat="1" lon="1"/><node id="6" version="1" lat="2" lon="1"/><node id="7" version="1" lat="2" lon="2"/><node id="8" version="2" lat="8" lon="8"/>
<way id="10" version="3"><nd ref="1"/><nd ref="2"/><nd ref="3"/></way>
<way id="11" version="1"><nd ref="1"/><nd ref="4"/><nd ref="3"/></way>
<way id="12" version="1"><nd ref="5"/><nd ref="6"/><nd ref="7"/><nd ref="5"/></way>
<way id="13" version="1"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="yes"/></way>
<way id="14" version="1"><nd ref="3"/><nd ref="99"/><nd ref="4"/></way>
<relation id="20" version="1"><member type="way" ref="10" role="outer"/><member type="way" ref="11" role="outer"/><member type="way" ref="12" role="inner"/><tag k="type" v="multipolygon"/><tag k="landuse" v="wood"/></relation>
<relation id="21" version="1"><member type="way" ref="10" role=""/><member type="way" ref="11" role=""/><member type="node" ref="8" role="stop"/><tag k="type" v="route"/></relation>
<changeset id="30" user="u" open="false" created_at="2012-01-01T00:00:00Z"><tag k="comment" v="c"/><discussion><comment uid="1" user="z" date="2012-01-02T00:00:00Z"><text>hi</text></comment></discussion></changeset>
<note lat="1" lon="2"><id>40</id><date_created>2014-05-08 23:05:02 UTC</date_created><status>open</status><comments><comment><date>2014-05-08 23:05:02 UTC</date><action>opened</action><text>Help</text></comment></comments></note>
<user id="50" display_name="me" account_created="2012-01-01T00:00:00Z"><languages><lang>en</lang></languages></user>
</osm>"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("x") / "map.xml"
    p.write_text(MAP)
    return {k: v.cache() for k, v in xml.read_all(spark, str(p)).items()} | {"path": str(p)}


def test_xml(spark, tables):
    n = {r.id: r for r in tables["node"].collect()}
    assert len(n) == 8 and n[1].visible and not n[3].visible and n[1].timestamp == datetime(2012, 1, 1) and n[2].tags[0].v == "a & b" and n[3].tags == []
    assert [x.ref for x in tables["way"].where("id = 12").first().nodes] == [5, 6, 7, 5]
    assert [(m.type, m.ref, m.role) for m in tables["relation"].where("id = 21").first().members][2] == ("node", 8, "stop")
    assert tables["changeset"].first().discussion[0].text == "hi" and tables["user"].first().languages == ["en"]
    note = tables["note"].first()
    assert (note.id, note.date_created, note.comments[0].action) == (40, datetime(2014, 5, 8, 23, 5, 2), "opened")
    assert tuple(xml.read_bounds(spark, tables["path"]).first()) == (0.0, 9.0, 0.0, 9.0)
    s = stats.file_statistics(tables["node"], tables["way"], tables["relation"]).first()
    assert (s.nodes, s.ways, s.relations, s.max_version, s.max_n_nodes_id, s.max_n_members_id) == (8, 5, 2, 3, 12, 20)


def test_container(spark, tables):
    t = {k: v for k, v in tables.items() if k != "path"}
    more = container.append(t, "node", spark.createDataFrame([(1, 2)], "id long, version int"))
    e = container.elements(more)
    assert [(r.type, r.id, r.version) for r in e.orderBy("packed").limit(3).collect()] == [("node", 1, 1), ("node", 1, 2), ("node", 2, 1)] and e.count() == 16
    assert container.features(more).count() == 15
    assert [r.type for r in container.objects(t).orderBy("rank", "id").collect()][-3:] == ["changeset", "user", "note"]
    u = spark.createDataFrame([([(5, datetime(2020, 1, 2)), (6, datetime(2020, 1, 1)), (4, datetime(2020, 1, 2))],)], "u array<struct<index: int, timestamp: timestamp>>")
    assert [x["index"] for x in u.select(container.updates_by_time(F.col("u")).alias("u")).first().u] == [6, 5, 4]


def test_xml_round_trip(spark, tables, tmp_path):
    t = {k: tables[k] for k in ("node", "way", "relation")}
    text = sinks.document(t, version="0.6", generator="g").first().value
    assert text.startswith('<osm version="0.6" generator="g"><node id="1" lat="0" lon="0" user="u" uid="5" visible="true" version="1" changeset="7" timestamp="2012-01-01T00:00:00Z"></node>')
    assert '<nd ref="1"></nd>' in text and '<member type="node" ref="8" role="stop"></member>' in text and 'v="a &amp; b"' in text
    (tmp_path / "r.xml").write_text(text)
    for k in t:
        back = xml.read(spark, str(tmp_path / "r.xml"), k)
        drop = [c for c in ("timestamp", "user", "uid", "changeset") if c in back.columns]
        assert sorted(map(str, back.drop(*drop).collect())) == sorted(map(str, t[k].drop(*drop).collect()))


def test_change_and_diff(spark, tmp_path):
    text = """<osmChange><modify><node id="1" version="2" lat="1" lon="1"/></modify><create><node id="2" version="1" lat="1" lon="1"/><way id="3" version="1"><nd ref="1"/></way></create>
    <modify><node id="4" version="3" lat="1.5" lon="1"/></modify><delete><node id="5" version="6"/></delete></osmChange>"""
    (tmp_path / "c.osc").write_text(text)
    c = xml.read_change(spark, str(tmp_path / "c.osc"))
    assert sorted((r.action, r.id) for r in c["node"].collect()) == [("create", 2), ("delete", 5), ("modify", 1), ("modify", 4)]
    assert [r.id for r in c["way"].collect()] == [3]
    out = sinks.change_document({k: c[k] for k in ("node", "way", "relation")}).first().value
    assert out.index("<create>") < out.index("<modify>") < out.index("<delete>") and out.count("<modify>") == 1 and 'lat="1.5"' in out
    (tmp_path / "d.xml").write_text('<osm><action type="create"><node id="1" version="1" lat="1" lon="1"/></action><action type="modify"><old><way id="2" version="1"/></old><new><way id="2" version="2"/></new></action></osm>')
    d = {r.id: r for r in xml.read_diff(spark, str(tmp_path / "d.xml")).collect()}
    assert d[1].old is None and json.loads(d[1].new)["version"] == 1 and json.loads(d[2].old)["version"] == 1
    one = spark.createDataFrame([("create", None, "<n/>"), ("modify", "<a/>", "<b/>")], "action string, old_xml string, new_xml string")
    assert [r.value for r in sinks.diff_lines(one).collect()] == ['<action type="create"><n/></action>', '<action type="modify"><old><a/></old><new><b/></new></action>']


def test_json(spark, tables, tmp_path):
    t = {k: tables[k] for k in ("node", "way", "relation")}
    text = js.document(t, version="0.6").first().value
    doc = json.loads(text)
    assert doc["version"] == "0.6" and len(doc["elements"]) == 15
    assert {"type": "way", "id": 12, "visible": False, "version": 1, "timestamp": "0001-01-01T00:00:00Z", "nodes": [5, 6, 7, 5]} in doc["elements"]
    (tmp_path / "j.json").write_text(text)
    back = js.read(spark, str(tmp_path / "j.json"))
    assert {k: v.count() for k, v in back.items()} == {"node": 8, "way": 5, "relation": 2}
    (tmp_path / "k.json").write_text('{"elements":[{"type":"node","id":1,"lat":1,"lon":2,"version":"4"},{"type":"node","id":2}]}')
    assert {r.id: r.version for r in js.read(spark, str(tmp_path / "k.json"))["node"].collect()} == {1: 4, 2: None}


def test_xml_element_case(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<osm><Node id="3" lat="1" lon="2" version="5"><tag k="a" v="b"/></Node><node id="4" lat="1" lon="2"/><NODE id="5" lat="0" lon="0"/></osm>')
    got = {r.id: (r.version, len(r.tags)) for r in xml.read(spark, str(tmp_path / "c.xml"), "node", any_case=True).collect()}
    assert got == {3: (5, 1), 4: (None, 0), 5: (None, 0)}
    assert xml.read(spark, str(tmp_path / "c.xml"), "node").count() == 1


def bare(spark):
    from terrachron import schema

    ids = {kind: 40 + n for n, kind in enumerate(schema.TABLES)}  # our own
    out = {}
    for kind, i in ids.items():
        empty = spark.createDataFrame([], schema.TABLES[kind])
        out[kind] = spark.range(1).select(*(F.lit(i).cast("bigint").alias("id") if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema))
    return out


def test_bare_json(spark):
    """What the format demands of a record even where nothing is known of it, by the kinds' order."""
    zero = "0001-01-01T00:00:00Z"
    place, none = {"lat": 0, "lon": 0}, {"count": 0}
    own = {
        "node": place | {"visible": False, "timestamp": zero},
        "way": {"visible": False, "timestamp": zero, "nodes": []},
        "relation": {"visible": False, "timestamp": zero, "members": []},
        "changeset": {"created_at": zero, "closed_at": zero, "open": False},
        "user": {"name": "", "img": {"href": ""}, "changesets": none, "traces": none, "home": place | {"zoom": 0}, "languages": None}
        | {"blocks": {"received": none | {"active": 0}}, "messages": {"received": none | {"unread": 0}, "sent": none}, "created_at": zero},
        "note": place | {"date_created": None, "date_closed": None, "comments": None},
    }
    tables = bare(spark)
    want = {"version": "0.7", "generator": "ours", "elements": [{"type": k, "id": tables[k].first().id} | v for k, v in own.items()]}
    assert js.document(tables, version="0.7", generator="ours").first().value == json.dumps(want, separators=(",", ":"))


def test_all_kinds_round_trip(spark, tables, tmp_path):
    t = {k: v for k, v in tables.items() if k != "path"}
    text = sinks.document(t, bounds={"minlat": 0, "maxlat": 9, "minlon": 0, "maxlon": 9.5}).first().value
    assert text.startswith('<osm><bounds minlat="0" maxlat="9" minlon="0" maxlon="9.5"></bounds><node') and text.index("<changeset") < text.index("<note") < text.index("<user")
    (tmp_path / "a.xml").write_text(text)
    back = xml.read_all(spark, str(tmp_path / "a.xml"))
    assert back["changeset"].first().discussion == tables["changeset"].first().discussion and back["changeset"].first().tags == tables["changeset"].first().tags
    assert (back["note"].first().date_created, back["note"].first().comments[0].text) == (tables["note"].first().date_created, "Help")
    assert back["user"].first().languages == ["en"] and back["user"].first().created_at == tables["user"].first().created_at
    (tmp_path / "a.json").write_text(js.document(t).first().value)
    got = js.read_others(spark, str(tmp_path / "a.json"))
    for kind in ("changeset", "note", "user"):
        assert got[kind].columns == back[kind].columns and got[kind].count() == back[kind].count()
    assert got["changeset"].first().discussion == tables["changeset"].first().discussion and got["changeset"].first().tags == tables["changeset"].first().tags
    assert got["note"].first().comments[0].text == "Help" and got["user"].first().languages == ["en"]
    feed_file = tmp_path / "feed/000/002"
    feed_file.mkdir(parents=True)
    (feed_file / "417.osm").write_text(text)
    c = replication.changesets(spark, str(tmp_path / "feed")).first()
    assert (c.seq, c.id, c.tags) == (2417, tables["changeset"].first().id, tables["changeset"].first().tags)
    b = bare(spark)["changeset"]
    z = "0001-01-01T00:00:00Z"
    assert b.select(sinks.changeset_xml()).first()[0] == f'<changeset id="{b.first().id}" user="" uid="0" created_at="{z}" closed_at="{z}" open="false" min_lat="0" max_lat="0" min_lon="0" max_lon="0"></changeset>'
    node = bare(spark)["node"]
    assert sinks.document({"node": node}, version="0.7", generator="g", copyright="c").first().value == f'<osm version="0.7" generator="g" copyright="c"><node id="{node.first().id}" lat="0" lon="0" user="" uid="0" visible="false" version="0" changeset="0" timestamp="{z}"></node></osm>'


def V(x):
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


def Z(x):
    return V((x << 1) ^ (x >> 63) if x < 0 else x << 1)


def L(k, b):
    return V(k << 3 | 2) + V(len(b)) + b


def I(k, x):  # noqa: E743
    return V(k << 3) + V(x)


def D(xs):
    return b"".join(Z(a - b) for a, b in zip(xs, [0, *xs]))


def blob(kind, data, packed=True):
    body = I(2, len(data)) + L(3, zlib.compress(data)) if packed else L(1, data)
    head = L(1, kind.encode()) + I(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def pbf_file():
    head = L(1, V(1 << 3) + Z(-511482000) + V(2 << 3) + Z(335437000) + V(3 << 3) + Z(51693440000) + V(4 << 3) + Z(51285540000)) + L(4, b"OsmSchema-V0.6") + L(4, b"DenseNodes") + L(16, b"me") + I(33, 12)
    strings = b"".join(L(1, s) for s in (b"", b"name", b"x", b"bob", b"outer"))
    info = L(1, V(1) + V(2)) + L(2, D([1000, 2000])) + L(3, D([7, 8])) + L(4, D([5, 5])) + L(5, D([3, 3]))
    dense = L(1, D([100, 90])) + L(5, info) + L(8, D([384504300, -5])) + L(9, D([-755500000, 70])) + L(10, V(1) + V(2) + V(0) + V(0))
    winfo = I(1, 4) + I(2, 3000) + I(3, 9) + I(4, 5) + I(5, 3)
    way = I(1, 77) + L(2, V(1)) + L(3, V(2)) + L(4, winfo) + L(8, D([100, 90, 100]))
    rel = I(1, 88) + L(4, winfo + I(6, 0)) + L(8, V(4) + V(0)) + L(9, D([77, 90])) + L(10, V(1) + V(0))
    block = lambda *groups: L(1, strings) + b"".join(L(2, g) for g in groups)
    return blob("OSMHeader", head, False) + blob("OSMData", block(L(2, dense))) + blob("OSMData", block(L(3, way), L(4, rel)))


def test_pbf(spark, tmp_path):
    path = str(tmp_path / "a.pbf")
    with open(path, "wb") as f:
        f.write(pbf_file())
    h = pbf.header(path)
    assert h["bounds"]["minlat"] == 1e-9 * 51285540000 and h["writing_program"] == "me" and h["replication_seq_num"] == 12
    spark.dataSource.register(pbf.PbfSource)
    read = lambda kind, **o: spark.read.format("pbf").option("type", kind).options(**o).load(path)
    n = read("node").collect()
    assert [(r.id, r.version, r.user, r.uid, r.changeset, r.visible, r.timestamp) for r in n] == [(100, 1, "bob", 5, 7, True, datetime(1970, 1, 1, 0, 16, 40)), (90, 2, "bob", 5, 8, True, datetime(1970, 1, 1, 0, 33, 20))]
    assert n[0].lat == 1e-9 * (100 * 384504300) and n[0].tags[0].v == "x" and n[1].tags == []
    w = read("way").first()
    assert (w.id, [x.ref for x in w.nodes], w.version, w.tags[0].k) == (77, [100, 90, 100], 4, "name")
    r = read("relation").first()
    assert (r.id, r.visible, [(m.type, m.ref, m.role) for m in r.members]) == (88, False, [("way", 77, "outer"), ("node", 90, "")])
    starts = [at for *_, at in pbf.frames(path)]
    assert read("node", startOffset=starts[2]).count() == 0 and read("way", startOffset=starts[2]).count() == 1
    with pytest.raises(pbf.FormatError, match="capability"):
        bad = str(tmp_path / "b.pbf")
        with open(bad, "wb") as f:
            f.write(blob("OSMHeader", L(4, b"Other")))
        pbf.header(bad)
    with pytest.raises(pbf.FormatError):
        list(pbf.Block(L(2, L(1, b""))).rows("node"))
    with pytest.raises(pbf.FormatError, match="unknown"):
        pbf.payload(L(7, b"x"))


@pytest.mark.parametrize("lines,want", [
    ([[(0, 0), (1, 0)], [(1, 0), (1, 1)]], [[(0, 0), (1, 0), (1, 1)]]),
    ([[(1, 1), (1, 0)], [(0, 0), (1, 0)]], [[(0, 0), (1, 0), (1, 1)]]),
    ([[(0, 0), (1, 0)], [(2, 0), (3, 0)]], [[(2, 0), (3, 0)], [(0, 0), (1, 0)]]),
    ([[(0, 0)], [(0, 0), (1, 0), (0, 0)]], [[(0, 0), (1, 0), (0, 0)]]),
    ([[(0, 0), (1, 0), (1, 1)], [(0, 0), (0, 1), (1, 1)]], [[(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]]),
])
def test_join(lines, want):
    assert [rings.line_of(c) for c in rings.join([Segment(i, x) for i, x in enumerate(lines)])] == want


def test_polygons():
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    p = rings.polygons([Segment(0, sq(0, 10)), Segment(1, sq(20, 30)[::-1])], [Segment(2, sq(21, 22)), Segment(3, sq(50, 51))])
    assert len(p) == 2 and {len(x) for x in p} == {1, 2} and all(rings.side(x[0]) == 1 for x in p)
    assert len(rings.polygons([], [Segment(0, sq(0, 1))], invalid=True)) == 1


def test_geojson(spark, tables):
    out = {(r.type, r.id): json.loads(r.value) for r in features.as_text(features.convert(tables["node"], tables["way"], tables["relation"])).collect()}
    area = out["relation", 20]["geometry"]
    assert area["type"] == "Polygon" and len(area["coordinates"]) == 2 and rings.side([tuple(p) for p in area["coordinates"][0]]) == 1
    assert out["relation", 21]["geometry"]["type"] == "LineString"
    assert ("way", 10) not in out and ("way", 12) not in out
    assert out["way", 13]["geometry"]["type"] == "Polygon" and out["way", 13]["properties"]["tags"] == {"building": "yes"}
    assert out["way", 14]["properties"]["tainted"] and out["way", 14]["geometry"] == {"type": "LineString", "coordinates": [[4.0, 4.0], [0.0, 4.0]]}
    assert {i for k, i in out if k == "node"} == {2, 8}
    assert out["node", 8]["properties"]["relations"][0]["role"] == "stop" and out["node", 2]["id"] == "node/2"
    bare = features.convert(tables["node"], tables["way"], tables["relation"], ids=False, meta=False, membership=False).where("type = 'node'").first()
    assert bare.feature_id is None and set(json.loads(bare.properties)) == {"id", "type", "tags"}


def test_store_and_joins(spark, tables):
    s = Store(tables["node"].withColumn("visible", F.lit(True)), tables["way"].withColumn("visible", F.lit(True)), tables["relation"].withColumn("visible", F.lit(True)), tables["changeset"], tables["note"], tables["user"])
    assert s.one(s.get("way", 10)).id == 10
    with pytest.raises(NotFound):
        s.get_many("node", [1, 1000])
    with pytest.raises(NotFound):
        s.one(s.version("node", 1, 9))
    assert {r.id for r in s.ways_of_node(1).collect()} == {10, 11, 13}
    assert {r.id for r in s.relations_of("way", 10).collect()} == {20, 21}
    w, n = s.way_full(10)
    assert w.count() == 1 and {r.id for r in n.collect()} == {1, 2, 3}
    r, w, n = s.relation_full(21)
    assert {x.id for x in w.collect()} == {10, 11} and {x.id for x in n.collect()} == {1, 2, 3, 4, 8}
    n, w, r = s.map(7, 7, 9, 9)
    assert [x.id for x in n.collect()] == [8] and w.count() == 0 and [x.id for x in r.collect()] == [21]
    assert s.notes_in(0, 0, 5, 5, closed_days=0).count() == 1 and s.notes_in(text="HELP").count() == 1
    with pytest.raises(ValueError):
        s.notes_in(limit=0)
    assert "discussion" not in s.changeset(30).columns and s.user(50).count() == 1
    m = {(r.type, r.ref): r.relations for r in joins.memberships(tables["relation"], tables["way"]).collect()}
    assert [x.id for x in m["way", 10]] == [20, 21] and m["node", 8][0].role == "stop"
    assert {(r.type, r.ref) for r in joins.memberships(tables["relation"], nodes_only=True).collect()} == {("node", 8)}


def test_replication(spark, tmp_path):
    import gzip

    d = tmp_path / "000" / "001"
    d.mkdir(parents=True)
    for i in (2, 3):
        with gzip.open(d / f"00{i}.osc.gz", "wt") as f:
            f.write(f'<osmChange><create><node id="{i}" version="1" lat="1" lon="1"/></create></osmChange>')
        (d / f"00{i}.state.txt").write_text(f"sequenceNumber=100{i}\ntimestamp=2016-07-16T0{i}\\:16\\:02Z\n")
    assert {(r.seq, r.timestamp.hour) for r in replication.states(spark, str(tmp_path)).collect()} == {(1002, 2), (1003, 3)}
    assert {r.id for r in replication.changes(spark, str(tmp_path))["node"].collect()} == {2, 3}
    assert spark.range(1).select(replication.seq_of_path(F.lit("/x/000/001/002.osc.gz"))).first()[0] == 1002


def test_streams(spark, tmp_path):
    rows = [(1, "create", "node", 1, 1, datetime(2020, 1, 1, 1), 1, "u", 0.0, 0.0), (2, "modify", "node", 1, 2, datetime(2020, 1, 1, 2), 1, "u", 1.0, 0.0), (2, "modify", "node", 1, 2, datetime(2020, 1, 1, 2), 1, "u", 1.0, 0.0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows[:1], feed.CHANGE).write.mode("append").parquet(src)
    q = feed.keep_latest(feed.edits(spark, src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    spark.createDataFrame(rows[1:], feed.CHANGE).write.mode("append").parquet(src)
    q = feed.keep_latest(feed.edits(spark, src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert [(r.id, r.version) for r in spark.read.parquet(str(tmp_path / "out" / "batch=1")).collect()] == [(1, 2)]
    q = feed.once(feed.edits(spark, src)).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
    q = feed.counts(feed.edits(spark, src)).writeStream.format("memory").queryName("edits2").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.start.hour, r.edits) for r in spark.table("edits2").collect()} == {(1, 1), (2, 2)}
