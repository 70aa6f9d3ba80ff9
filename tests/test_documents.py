"""Documents in parts equal documents in one row; the reader of all kinds in one parse."""

import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from terrachron import schema
from terrachron.sources import json as js
from terrachron.sources import sinks, xml, xmlscan


def nodes(spark, n):
    at = F.timestamp_seconds(F.col("id") + 1_000_000)
    tags = F.array(F.struct(F.lit("name").alias("k"), F.concat(F.lit("x & <y> "), F.col("id").cast("string")).alias("v"))).cast(schema.TAGS)
    d = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("id"))
    return d.select(
        "id", (F.col("id") / 7).alias("lat"), (-F.col("id") / 9).alias("lon"), F.lit("u").alias("user"), F.lit(1).cast("long").alias("uid"), F.lit(True).alias("visible"), F.lit(1).alias("version"),
        F.lit(5).cast("long").alias("changeset"), at.alias("timestamp"), tags.alias("tags"), F.lit(None).cast("timestamp").alias("committed"),
    )


def ways(spark, n):
    d = nodes(spark, n).drop("lat", "lon")
    refs = F.array(*(F.struct((F.col("id") + k).alias("ref"), *(F.lit(None).cast(t).alias(c) for c, t in (("version", "int"), ("changeset", "bigint"), ("lat", "double"), ("lon", "double")))) for k in (0, 1)))
    return d.withColumn("nodes", refs.cast(schema.WAY_NODES)).withColumn("updates", F.array().cast(schema.UPDATES)).withColumn("bounds", F.lit(None).cast(schema.BOUNDS))


def read_parts(path):
    names = sorted(glob.glob(f"{path}/part-*"))
    text = "".join(open(p, encoding="utf-8", newline="").read() for p in names)
    return text.replace("\n", ""), len(names)  # elements have line ends as references


def test_xml_parts_are_the_document(spark, tmp_path):
    t = {"way": ways(spark, 300), "node": nodes(spark, 2000).unionByName(nodes(spark, 3))}
    box = {"minlat": 0, "maxlat": 9, "minlon": -0.5, "maxlon": 9.5}
    sinks.write_document(t, str(tmp_path / "a"), bounds=box, parts=7, version="0.6", generator="g")
    text, many = read_parts(tmp_path / "a")
    assert many == 7 and text == sinks.document(t, bounds=box, version="0.6", generator="g").first().value
    sinks.write_document({"node": nodes(spark, 0)}, str(tmp_path / "b"))
    assert read_parts(tmp_path / "b")[0] == "<osm></osm>"


def test_change_parts_are_the_document(spark, tmp_path):
    act = lambda d: d.withColumn("action", F.when(F.col("id") % 3 == 0, "delete").otherwise("create"))
    t = {"node": act(nodes(spark, 500)), "way": act(ways(spark, 90))}
    sinks.write_change(t, str(tmp_path / "c"), parts=5, version="0.6")
    text, many = read_parts(tmp_path / "c")
    assert many == 5 and text == sinks.change_document(t, version="0.6").first().value and "<modify>" not in text


def test_json_parts_are_the_document(spark, tmp_path):
    for name, t in (("a", {"node": nodes(spark, 400), "way": ways(spark, 50)}), ("b", {"node": nodes(spark, 9).unionByName(nodes(spark, 9)).unionByName(nodes(spark, 1))}), ("c", {"node": nodes(spark, 0)})):
        js.write_document(t, str(tmp_path / name), version="0.6", parts=4)
        assert read_parts(tmp_path / name)[0] == js.document(t, version="0.6").first().value


def test_large_documents_come_in_ranges(spark, tmp_path):
    """No row holds more than one element, whatever the size: parts hold their own ranges of ids."""
    sinks.write_document({"node": nodes(spark, 100_000)}, str(tmp_path / "big"), parts=10)
    parts = spark.read.text(str(tmp_path / "big")).where("value LIKE '<node %'")
    ids = parts.select(F.regexp_extract("value", r'id="(\d+)"', 1).cast("long").alias("id"), F.input_file_name().alias("f"))
    ranges = sorted((r.a, r.b, r.n) for r in ids.groupBy("f").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).collect())
    assert sum(r[2] for r in ranges) == 100_000 and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:])) and max(r[2] for r in ranges) < 20_000


def whole_and_cut(path, size):
    """Units of a file in one range, and in ranges of so many bytes."""
    n = os.path.getsize(path)
    shown = lambda us: [(at, kind, action, side, e.attrs, sorted(e.children)) for at, kind, action, side, e in us]
    one = shown(xmlscan.units(path, 0, n, n))
    return one, [x for a in range(0, n, size) for x in shown(xmlscan.units(path, a, min(n, a + size), n, 64))]


MIXED = """<?xml version="1.0" encoding="UTF-8"?>
<!-- made by hand -->
<OSM version="0.6"><bounds minlat="0" maxlat="1" minlon="0" maxlon="1"/>
<Node id="1" lat="1.5" lon="-2" version="3" visible="true" timestamp="2012-01-01T00:00:00Z" user="ü &amp; x"><Tag k="a" v="1"/><tag k="b" v="&lt;node id=&quot;9&quot;&gt;"/></Node>
<RELATION id="7"><member type="node" ref="1" role=""><nd ref="4" lat="1"/></member><tag k="type" v="route"/></RELATION><node id="2" lat="x" lon="0" timestamp="never"/>
<way id="5" visible="false"><nd ref="1"/><nd ref="2" version="3" changeset="4" lat="0.5" lon="1"/><update index="1" version="2" timestamp="2013-01-01T00:00:00Z" reverse="true"/></way>
<note lat="1" lon="2"><id>40</id><date_created>2014-05-08 23:05:02 UTC</date_created><status>open</status><comments><comment><date>2014-05-08 23:05:02 UTC</date><uid>3</uid><user>me</user><action>opened</action><text>Help &amp; go</text></comment></comments></note>
<user id="50" display_name="me" account_created="2012-01-01T00:00:00Z"><changesets count="4"/><home lat="1" lon="2" zoom="3"/><languages><lang>en</lang><lang>de</lang></languages><blocks><received count="1" active="0"/></blocks></user>
<changeset id="30" user="u" open="false" created_at="2012-01-01T00:00:00Z" closed_at="0001-01-01T00:00:00Z"><tag k="comment" v="c"/><discussion><comment uid="1" user="z" date="2012-01-02T00:00:00Z"><text>hi</text></comment></discussion></changeset>
</OSM>"""
CHANGE = """<osmChange version="0.6"><modify><node id="1" version="2" lat="1" lon="1"/></modify><Create><node id="2" version="1" lat="1" lon="1"/><Way id="3" version="1"><nd ref="1"/></Way></Create>
<modify><node id="4" version="3" lat="1.5" lon="1"/><relation id="9" version="2"/></modify><delete><node id="5" version="6"/></delete><create><node id="6" version="1"/></create></osmChange>"""
DIFF = """<osm><note>text</note><action type="create"><node id="1" version="1" lat="1" lon="1"/></action><action type="modify"><old><way id="2" version="1"><nd ref="1"/></way></old><new><way id="2" version="2"><nd ref="1"/><nd ref="3"/></way></new></action>
<action type="delete"><old><relation id="3" version="4" visible="true"/></old><new><relation id="3" version="5" visible="false"/></new></action></osm>"""


def test_ranges_find_the_same_units(tmp_path):
    for name, text, many in (("a.osm", MIXED, 7), ("b.osc", CHANGE, 7), ("c.osm", DIFF, 5)):
        (tmp_path / name).write_text(text, encoding="utf-8")
        for size in (1, 7, 50, 333, 10_000):
            one, cut = whole_and_cut(str(tmp_path / name), size)
            assert one == cut and len(one) == many, (name, size)


def rows_of(d):
    return sorted(map(str, d.collect()))


def test_one_parse_gives_what_a_parse_for_each_kind_gives(spark, tmp_path):
    p = str(tmp_path / "m.osm")
    (tmp_path / "m.osm").write_text(MIXED, encoding="utf-8")
    small = MIXED.replace("Node", "node").replace("Tag", "tag").replace("RELATION", "relation").replace('lat="x"', "").replace('timestamp="never"', "")
    (tmp_path / "s.xml").write_text(small, encoding="utf-8")
    for size in (xmlscan.SPLIT, 200):
        got = xmlscan.tables(xmlscan.scan(spark, p, size))
        for kind, want in xml.read_all(spark, str(tmp_path / "s.xml")).items():
            assert got[kind].columns == want.columns and got[kind].dtypes == want.dtypes and rows_of(got[kind]) == rows_of(want), kind
    text = got["node"].join(got["way"], "id", "full")._jdf.queryExecution().toString()
    assert xmlscan.scan(spark, p)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and text
    with gzip.open(tmp_path / "z.osm.gz", "wt", encoding="utf-8") as f:
        f.write(MIXED)
    assert rows_of(xmlscan.tables(xmlscan.scan(spark, str(tmp_path / "z.osm.gz")))["way"]) == rows_of(got["way"])
    (tmp_path / "bad.osm").write_text("<osm><node id='1'></osm>")
    with pytest.raises(Exception, match="mismatched"):
        xmlscan.scan(spark, str(tmp_path / "bad.osm")).collect()


def test_changes_and_diffs_in_one_parse(spark, tmp_path):
    (tmp_path / "c.osc").write_text(CHANGE)
    (tmp_path / "s.xml").write_text(CHANGE.replace("Create", "create").replace("Way", "way"))
    want = xml.read_change(spark, str(tmp_path / "s.xml"))
    for size in (xmlscan.SPLIT, 60):
        got = xmlscan.changes(xmlscan.scan(spark, str(tmp_path / "c.osc"), size))
        for kind in want:
            assert got[kind].columns == want[kind].columns and rows_of(got[kind]) == rows_of(want[kind])
    (tmp_path / "d.osm").write_text(DIFF)
    d = {r.id: r for r in xmlscan.diffs(xmlscan.scan(spark, str(tmp_path / "d.osm"), 40)).collect()}
    assert [(d[i].action, d[i].type) for i in (1, 2, 3)] == [("create", "node"), ("modify", "way"), ("delete", "relation")]
    assert d[1].old_node is None and d[1].new_node.lat == 1.0 and [n.ref for n in d[2].new_way.nodes] == [1, 3] and d[2].old_way.version == 1
    assert (d[3].old_relation.visible, d[3].new_relation.visible, d[3].new_node) == (True, False, None)


def test_parts_are_read_back(spark, tmp_path):
    """What write_document() puts in parts, joined to a file and read in ranges, is what was written."""
    t = {"node": nodes(spark, 3000), "way": ways(spark, 500)}
    sinks.write_document(t, str(tmp_path / "parts"), parts=4)
    (tmp_path / "one.osm").write_text(read_parts(tmp_path / "parts")[0], encoding="utf-8")
    got = xmlscan.tables(xmlscan.scan(spark, str(tmp_path / "one.osm"), 50_000))
    key = lambda d: d.select("id", "version", "timestamp", F.get("tags", F.lit(0))["v"].alias("v"))
    for kind in t:
        assert key(got[kind]).exceptAll(key(t[kind])).count() == 0 and got[kind].count() == t[kind].count()


def test_each_part_is_read_by_kind(spark, tmp_path):
    """Parts have no root of their own; Spark's XML source gave the elements of the first part only."""
    w = ways(spark, 901).where("id > 0")  # zero references are left out
    sinks.write_document({"way": w, "node": nodes(spark, 50)}, str(tmp_path / "a"), parts=5, version="0.6")
    got = xml.read(spark, str(tmp_path / "a"), "way", parts=True)
    keep = lambda d: rows_of(d.select("id", "user", "version", "timestamp", "tags", "nodes"))
    assert keep(got) == keep(w) and got.count() == 900
    assert xml.read(spark, str(tmp_path / "a"), "node", parts=True).count() == 50


def test_parts_are_scanned_as_one_document(spark, tmp_path):
    act = lambda d: d.withColumn("action", F.when(F.col("id") % 3 == 0, "delete").when(F.col("id") % 3 == 1, "create").otherwise("modify"))
    sinks.write_change({"node": act(nodes(spark, 900)), "way": act(ways(spark, 90))}, str(tmp_path / "c"), parts=7)
    sinks.write_document({"node": nodes(spark, 900), "way": ways(spark, 90)}, str(tmp_path / "d"), parts=7, version="0.6")
    for name, size in (("c", 1 << 20), ("c", 30_000), ("d", 30_000)):
        whole = tmp_path / f"{name}{size}.osm"
        whole.write_text("".join(open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(f"{tmp_path / name}/part-*"))), encoding="utf-8")
        shape = xmlscan.changes if name == "c" else xmlscan.tables
        got, want = shape(xmlscan.scan(spark, str(tmp_path / name), size, parts=True)), shape(xmlscan.scan(spark, str(whole)))
        assert rows_of(got["node"]) == rows_of(want["node"]) and rows_of(got["way"]) == rows_of(want["way"]) and got["node"].count() == 900
    cut = tmp_path / "e"
    cut.mkdir()
    (cut / "part-0").write_text("<osm><node id='1' lat='1'>")
    (cut / "part-1").write_text("</node></osm>")
    with pytest.raises(Exception, match="not closed"):
        xmlscan.scan(spark, str(cut), parts=True).collect()


def test_blocks_are_not_looked_for_before_the_range(tmp_path, monkeypatch):
    """A document without blocks was read back to its first byte for every range."""
    p = tmp_path / "a.osm"
    p.write_text("<osm>" + "".join(f"<node id='{i}' lat='1'/>" for i in range(5000)) + "</osm>")
    n, lows, before = p.stat().st_size, [], xmlscan._before
    monkeypatch.setattr(xmlscan, "_before", lambda f, at, low=0, piece=1 << 20: lows.append(low) or before(f, at, low, piece))
    got = [x for a in range(0, n, 1000) for x in xmlscan.units(str(p), a, min(n, a + 1000), n, block="")]
    assert len(got) == 5000 and lows and min(lows) >= 1000


def test_edges_of_blocks_at_the_ends_of_ranges(tmp_path):
    for text in (CHANGE, MIXED):
        p = tmp_path / "x.osc"
        p.write_text(text, encoding="utf-8")
        n = p.stat().st_size
        for size in (1, 5, 40, 333):
            block, out = "", []
            for a in range(0, n, size):
                out += [(at, kind, action) for at, kind, action, _side, _e in xmlscan.units(str(p), a, min(n, a + size), n, 64, block=block)]
                edge = xmlscan._open_at_end(str(p), a, min(n, a + size))
                block = block if edge is None else edge
            assert out == [(at, kind, action) for at, kind, action, _side, _e in xmlscan.units(str(p), 0, n, n)]


def test_json_parts_are_read_by_lines(spark, tmp_path):
    js.write_document({"node": nodes(spark, 400), "way": ways(spark, 50)}, str(tmp_path / "j"), version="0.6", parts=4)
    (tmp_path / "w.json").write_text(js.document({"node": nodes(spark, 400), "way": ways(spark, 50)}, version="0.6").first().value, encoding="utf-8")
    got, want = js.read(spark, str(tmp_path / "j"), parts=True), js.read(spark, str(tmp_path / "w.json"))
    for kind in ("node", "way"):
        assert rows_of(got[kind]) == rows_of(want[kind]) and got[kind].dtypes == want[kind].dtypes
