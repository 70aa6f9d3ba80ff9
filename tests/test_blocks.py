"""The block-file source: pushed filters, index, columns, offsets, streams."""

import struct
import zlib
from datetime import datetime, timezone

import pytest
from pyspark.sql import datasource
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrachron import schema
from terrachron.sources import pbf


def varint(x):
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


def number(k, x):
    return varint(k << 3) + varint(x)


def part(k, b):
    return varint(k << 3 | 2) + varint(len(b)) + b


def steps(xs):
    return b"".join(varint((a - b) << 1 if a >= b else ((b - a) << 1) - 1) for a, b in zip(xs, [0, *xs]))


def framed(kind, data, packed=True):
    body = number(2, len(data)) + part(3, zlib.compress(data)) if packed else part(1, data)
    head = part(1, kind.encode()) + number(3, len(body))
    return struct.pack(">I", len(head)) + head + body


HEAD = framed("OSMHeader", part(4, b"OsmSchema-V0.6") + part(4, b"DenseNodes") + part(16, b"made by a rule") + number(33, 7), False)
WORDS = ["", "name", "kind", "a", "b", "Zoë", "stop"]
PER = 50


def table_of_words():
    return part(1, b"".join(part(1, w.encode()) for w in WORDS))


def node_block(first, n=PER):
    """Nodes first, first + 1, ...: every third has a tag, every seventh two, and the last one an empty value."""
    ids = list(range(first, first + n))
    kv = b""
    for i in ids:
        kv += (varint(1) + varint(3 + i % 3) if i % 3 == 0 else b"") + (varint(2) + varint(0) if i % 50 == 49 else b"") + varint(0)
    info = part(1, b"".join(varint(1 + i % 4) for i in ids)) + part(2, steps([1_000_000 + 60 * i for i in ids])) + part(3, steps([i // 10 for i in ids]))
    info += part(4, steps([i % 5 for i in ids])) + part(5, steps([3 + i % 3 for i in ids])) + part(6, b"".join(varint(int(i % 11 != 0)) for i in ids))
    dense = part(1, steps(ids)) + part(5, info) + part(8, steps([i * 1000 for i in ids])) + part(9, steps([-i * 2000 for i in ids])) + part(10, kv)
    return framed("OSMData", table_of_words() + part(2, part(2, dense)))


def way_block(first, n=PER):
    out = b""
    for i in range(first, first + n):
        info = number(1, 1 + i % 3) + number(2, 2_000_000 + i) + number(3, i) + number(4, i % 5) + number(5, 4)
        places = part(9, steps([5, 6, 7])) + part(10, steps([8, 9, 7])) if i % 2 else b""
        out += part(3, number(1, i) + part(2, varint(1)) + part(3, varint(5)) + (part(4, info) if i % 4 else b"") + part(8, steps([i, i + 1, i])) + places)
    return framed("OSMData", table_of_words() + part(2, out))


def relation_block(first, n=PER):
    out = b""
    for i in range(first, first + n):
        out += part(4, number(1, i) + part(8, varint(6) + varint(0)) + part(9, steps([i, 2])) + part(10, varint(i % 3) + varint(1)))
    return framed("OSMData", table_of_words() + part(2, out))


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    p = str(tmp_path_factory.mktemp("blocks") / "made.pbf")
    with open(p, "wb") as f:
        f.write(HEAD + b"".join(node_block(i * PER) for i in range(20)) + b"".join(way_block(i * PER) for i in range(4)) + relation_block(10))
    return p


def node(i):
    tags = ([("name", WORDS[3 + i % 3])] if i % 3 == 0 else []) + ([("kind", "")] if i % 50 == 49 else [])
    t = datetime.fromtimestamp(1_000_000 + 60 * i, timezone.utc).replace(tzinfo=None)
    return (i, 1e-9 * (100 * i * 1000), 1e-9 * (100 * -i * 2000), WORDS[3 + i % 3], i % 5, i % 11 != 0, 1 + i % 4, i // 10, t, tags, None)


def plain(rows):
    return sorted((tuple([tuple(x) for x in v] if isinstance(v, list) else v for v in r) for r in rows), key=lambda r: r[0])


def test_every_column(spark, file):
    assert plain(pbf.read(spark, file).collect()) == [node(i) for i in range(20 * PER)]
    ways = pbf.read(spark, file, "way").orderBy("id").collect()
    assert [(w.id, [n.ref for n in w.nodes], w.version, w.tags[0].v, w.user) for w in ways[:2]] == [(0, [0, 1, 0], None, "Zoë", None), (1, [1, 2, 1], 2, "Zoë", "b")]
    assert ways[0].nodes[0].lat is None and ways[1].nodes[1].lat == 1e-9 * 600 and ways[1].nodes[2].lon == 1e-9 * 700
    assert ways[0].updates == [] and ways[0].bounds is None and len(ways) == 200
    relations = pbf.read(spark, file, "relation").orderBy("id").collect()
    assert [(m.type, m.ref, m.role, m.nodes) for m in relations[1].members] == [("relation", 11, "stop", None), ("way", 2, "", None)]


FILTERS = {
    "id = 333": lambda r: r[0] == 333,
    "id IN (7, 8, 900, 5000)": lambda r: r[0] in (7, 8, 900),
    "id >= 120 AND id < 260 AND lat > 0.0149": lambda r: 120 <= r[0] < 260 and r[1] > 0.0149,
    "timestamp < TIMESTAMP '1970-01-12 16:00:00' AND visible": lambda r: r[8] < datetime(1970, 1, 12, 16) and r[5],
    "version = 2 AND get(tags, 0).v = 'a'": lambda r: r[6] == 2 and r[9] and r[9][0][1] == "a",
    "lon BETWEEN -0.01 AND -0.009 OR id = 1": lambda r: -0.01 <= r[2] <= -0.009 or r[0] == 1,
    "user IS NULL": lambda r: False,
    "changeset > 98 OR uid IS NULL": lambda r: r[7] > 98,
}


@pytest.mark.parametrize("indexed", [False, True])
def test_filtered_scans_equal_whole_ones(spark, file, indexed, tmp_path):
    index = str(tmp_path / "index")
    if indexed:
        assert pbf.build_index(spark, file, index).where("kind = 'node'").agg(F.sum("count")).first()[0] == 20 * PER
    for where, test in FILTERS.items():
        got = pbf.read(spark, file, index=index).where(where).collect()
        assert plain(got) == [node(i) for i in range(20 * PER) if test(node(i))], where


def blocks(file, filters, **options):
    r = pbf._PushingReader({"path": file, **options}, StructType.fromDDL(schema.TABLES[options.get("type", "node")]))
    assert list(r.pushFilters(filters)) == filters
    return sum(len(p.blocks) for p in r.partitions()), sum(b.num_rows for p in r.partitions() for b in r.read(p))


def test_only_blocks_that_fit_are_read(spark, file, tmp_path):
    index = str(tmp_path / "index")
    assert blocks(file, []) == (25, 1000)
    assert blocks(file, [datasource.EqualTo(("id",), 333)]) == (25, 1)  # without an index every block is opened, but one row is made
    pbf.build_index(spark, file, index)
    assert blocks(file, [], index=index) == (20, 1000)  # only those with nodes
    assert blocks(file, [datasource.EqualTo(("id",), 333)], index=index) == (1, 1)
    assert blocks(file, [datasource.In(("id",), (7, 8, 900))], index=index) == (2, 3)
    assert blocks(file, [datasource.GreaterThan(("lat",), 0.0899), datasource.LessThanOrEqual(("id",), 940)], index=index) == (2, 42)
    edge = datetime.fromtimestamp(1_000_000 + 60 * 100, timezone.utc)
    assert blocks(file, [datasource.LessThan(("timestamp",), edge)], index=index) == (2, 100)
    assert blocks(file, [datasource.GreaterThanOrEqual(("id",), 150)], index=index, type="way") == (1, 50)
    assert blocks(file, [datasource.GreaterThanOrEqual(("id",), 5000)], index=index)[1] == 0
    assert blocks(file, [datasource.IsNotNull(("id",)), datasource.StringContains(("user",), "a")], index=index) == (20, 1000)  # left to Spark
    plan = pbf.read(spark, file, index=index).where("id = 333")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "id" in plan


def test_an_index_of_another_file_is_passed_over(spark, tmp_path):
    p = str(tmp_path / "a.pbf")
    with open(p, "wb") as f:
        f.write(HEAD + node_block(0))
    pbf.build_index(spark, p)
    with open(p, "ab") as f:
        f.write(node_block(50))
    assert pbf.read(spark, p).where("id = 77").count() == 1


def test_columns_offsets_and_grouping(spark, file):
    d = pbf.read(spark, file, columns=["version", "id"], offset="true", taskBytes=1)
    assert d.columns == ["version", "id", "block_offset"] and d.rdd.getNumPartitions() == 25
    starts = [at for kind, _, _, at in pbf.frames(file) if kind == "OSMData"]
    assert {(r.id // PER, r.block_offset) for r in d.collect()} == {(i, starts[i]) for i in range(20)}
    assert pbf.read(spark, file).rdd.getNumPartitions() == 1
    again = pbf.read(spark, file, columns=["id"], startOffset=starts[18])
    assert sorted(r.id for r in again.collect()) == list(range(900, 1000))
    with pytest.raises(Exception, match="no column"):
        pbf.read(spark, file, columns=["other"])


def test_headers_and_contents_that_spark_reads(spark, file):
    h = pbf.headers(spark, file).first()
    assert (h.path, h.writing_program, h.replication_seq_num, h.required_features, h.bounds) == (file, "made by a rule", 7, ["OsmSchema-V0.6", "DenseNodes"], None)
    whole = spark.read.format("binaryFile").load(file)
    for kind in ("node", "way", "relation"):
        assert sorted(map(str, pbf.decode(whole, kind).collect())) == sorted(map(str, pbf.read(spark, file, kind).collect()))
    with pytest.raises(Exception, match="no header"):
        pbf.decode(spark.createDataFrame([("x", bytearray(node_block(1)))], "path string, content binary")).collect()


def test_a_stream_goes_on_in_mid_file(spark, tmp_path):
    p, checkpoint, out = str(tmp_path / "grows.pbf"), str(tmp_path / "checkpoint"), str(tmp_path / "out")
    parts = [HEAD, *(node_block(i * PER) for i in range(6))]
    whole = b"".join(parts)
    spark.dataSource.register(pbf.PbfSource)

    def run():
        q = spark.readStream.format("pbf").option("type", "node").load(p).select("id").writeStream
        q.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    at = 0
    for cut in (len(HEAD) + 10, len(whole) // 3, len(whole) * 2 // 3, len(whole)):  # in the middle of frames
        with open(p, "ab") as f:
            f.write(whole[at:cut])
        at = cut
        seen = run()
        frames_in = sum(len(b"".join(parts[: k + 1])) <= cut for k in range(1, 7))
        assert seen == list(range(frames_in * PER))
    assert seen == list(range(6 * PER))
