"""As-of joins against a plain reading of the rules, and annotation by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrachron.operators import diff, history, order

EARLY, LATE = datetime(2010, 1, 1), datetime(2014, 1, 1)
EPS = history.THRESHOLD_US


def visible(hist, changeset, at, eps):
    """Index seen, read straight from the rules."""
    best, near = -1, None
    for i, c in enumerate(hist):
        if c["cm"] is None or c["cm"] < history.FROM:
            off = c["ts"] - at
            if off > eps:
                break
            if off < -eps:
                best = i if c["visible"] else -1
                continue
            if near is not None and abs(off) > near:
                continue
            if not c["visible"]:
                if near is None and off == -eps:
                    best = -1
                near = abs(off)
            elif off <= 0 or c["changeset"] == changeset:
                best, near = i, abs(off)
        else:
            if c["cm"] > at:
                break
            best = i if c["visible"] else -1
    return best


def test_find_visible_and_version_before(spark):
    r = random.Random(9)
    base, rows = history.FROM, []
    for k in range(1500):
        hist = []
        for v in range(r.randrange(0, 7)):
            ts = base + r.randrange(-6, 7) * EPS // 2
            hist.append({"version": v, "changeset": r.randrange(3), "visible": r.random() < 0.7, "ts": ts, "cm": ts + r.randrange(3) if r.random() < 0.4 else None})
        rows.append((k, hist, r.randrange(3), base + r.randrange(-5, 6) * EPS // 2))
    s = "k int, hist array<struct<version: int, changeset: long, visible: boolean, ts: long, cm: long>>, cs long, at long"
    d = spark.createDataFrame(rows, s).select("k", history.find_visible("hist", "cs", "at", EPS).alias("a"), history.version_before("hist", "at").alias("b"))
    got = {x.k: (x.a, x.b) for x in d.collect()}
    for k, hist, cs, at in rows:
        before = -1
        for i, c in enumerate(hist):
            if not (c["cm"] if c["cm"] is not None and c["cm"] >= history.FROM else c["ts"]) < at:
                break
            before = i
        assert got[k] == (visible(hist, cs, at, EPS), before)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


NODE = "id long, version int, visible boolean, changeset long, timestamp timestamp, committed timestamp, lat double, lon double"
WAY = "id long, version int, visible boolean, changeset long, timestamp timestamp, committed timestamp, nodes array<struct<ref: bigint, version: int, changeset: bigint, lat: double, lon: double>>"


def nd(*refs, version=None):
    return [(r, version, None, None, None) for r in refs]


def at(base, h):
    return base + timedelta(hours=h)


def annotated(spark, nodes, ways, **kw):
    d = history.annotate_ways(spark.createDataFrame(ways, WAY), spark.createDataFrame(nodes, NODE), **kw)
    return {(r.id, r.version): r for r in d.collect()}


@pytest.mark.parametrize("committed", [False, True])
def test_versions_and_updates(spark, committed):
    base = LATE if committed else EARLY
    c = lambda h: at(base, h) if committed else None
    nodes = [(1, v, True, v, at(base, h), c(h), float(v), 0.0) for v, h in ((1, 0), (2, 5), (3, 20), (4, 30))]
    nodes += [(2, 1, True, 1, at(base, 0), c(0), 9.0, 9.0)]
    ways = [(7, 1, True, 50, at(base, 6), c(6), nd(1, 2, 1)), (7, 2, True, 51, at(base, 25), c(25), nd(2, 1))]
    got = annotated(spark, nodes, ways)
    a, b = got[7, 1], got[7, 2]
    assert [n.version for n in a.nodes] == [2, 1, 2] and [n.lat for n in a.nodes] == [2.0, 9.0, 2.0]
    assert [(u["index"], u.version, u.timestamp) for u in a.updates] == [(0, 3, at(base, 20)), (2, 3, at(base, 20))]
    assert [n.version for n in b.nodes] == [1, 3]
    assert [(u["index"], u.version) for u in b.updates] == [(1, 4)]


def before(hist, end):
    n = -1
    for i, c in enumerate(hist):
        if not effective(c) < end:
            break
        n = i
    return n


def effective(c):
    return c["cm"] if c["cm"] is not None and c["cm"] >= history.FROM else c["ts"]


def computed(parents, hist, eps):
    """Of one child in every version of one parent: version seen, and versions until the next; read straight from the rules."""
    out = {}
    for k, p in enumerate(parents):
        if not p["visible"] or not p["has"]:
            continue
        at = effective(p)
        c = visible(hist, p["changeset"], at, eps)
        if k + 1 == len(parents):
            end = len(hist)
        else:
            q = parents[k + 1]
            soon = effective(q) if q["cm"] is not None and q["cm"] >= history.FROM else q["ts"] - eps  # only timestamps have a threshold
            n = visible(hist, q["changeset"], effective(q), eps)
            if n >= 0:
                end = n + 1 if effective(hist[n]) < soon else n
            elif c >= 0 and soon <= effective(hist[c]):
                end = 0
            else:
                end = before(hist, soon) + 1
        start = c + 1 if c >= 0 else before(hist, at) + 1
        out[k] = (hist[c]["version"] if c >= 0 else None, [hist[i]["version"] for i in range(start, end) if hist[i]["visible"]])
    return out


def random_map(r, n_nodes, n_ways, most_versions, regime):
    """Children and parents with times about the start of commit times, close together, many equal and some falling."""
    def moment(v):
        ts = history.FROM + (r.randrange(-6, 7) if r.random() < 0.5 else 2 * v - 6) * EPS // 2
        cm = {"none": None, "all": abs(ts) + history.FROM, "some": ts + r.randrange(3) if r.random() < 0.5 else None}[regime]
        return ts if regime != "all" else cm, cm

    nodes, ways = {}, {}
    for i in range(n_nodes):
        nodes[i] = [dict(zip(("ts", "cm"), moment(v)), version=v, changeset=r.randrange(3), visible=r.random() < 0.75) for v in range(1, r.randrange(2, most_versions))]
    for i in range(n_ways):
        ways[i] = [dict(zip(("ts", "cm"), moment(v)), version=v, changeset=r.randrange(3), visible=r.random() < 0.85, refs=[r.randrange(n_nodes + 1) for _ in range(r.randrange(1, 5))]) for v in range(1, r.randrange(2, 6))]
    return nodes, ways


@pytest.mark.parametrize("most", [200_000, 6])
@pytest.mark.parametrize("regime", ["none", "all", "some"])
def test_annotation_against_the_rules(spark, regime, most):
    """Whole annotations, with children in one stretch and cut into several."""
    r = random.Random(17)
    nodes, ways = random_map(r, 25, 120, 14, regime)
    stamp = lambda us: None if us is None else datetime(1970, 1, 1) + timedelta(microseconds=us)
    n = spark.createDataFrame([(i, c["version"], c["visible"], c["changeset"], stamp(c["ts"]), stamp(c["cm"]), float(c["version"]), float(i)) for i, h in nodes.items() for c in h], NODE)
    w = spark.createDataFrame([(i, c["version"], c["visible"], c["changeset"], stamp(c["ts"]), stamp(c["cm"]), nd(*c["refs"])) for i, h in ways.items() for c in h], WAY)
    d = history.annotate_ways(w.withColumn("seq", F.col("version")), n, ignore_inconsistency=True, ignore_missing=True, most=most)
    got = {(x.id, x.version): x for x in d.collect()}
    found = 0
    for i, h in ways.items():
        per = {ref: computed([{**p, "has": ref in p["refs"]} for p in h], nodes[ref], EPS) for ref in {x for p in h for x in p["refs"]} if nodes.get(ref)}
        for k, p in enumerate(h):
            x = got[i, p["version"]]
            seen = [per[ref][k][0] if p["visible"] and ref in per else None for ref in p["refs"]]
            assert [y.version for y in x.nodes] == seen
            assert [y.lat for y in x.nodes] == [None if v is None else float(v) for v in seen]
            want = sorted((at_, v) for at_, ref in enumerate(p["refs"]) if p["visible"] and ref in per for v in per[ref][k][1])
            assert sorted((u["index"], u.version) for u in x.updates or []) == want
            found += len(want) + sum(v is not None for v in seen)
    assert found > 300


def test_no_row_holds_a_history(spark):
    """One node with very many versions and many ways, cut into stretches; and no array of versions in the plan."""
    many = 30_000
    nodes = spark.range(1, many + 1).select(F.lit(1).cast("long").alias("id"), F.col("id").cast("int").alias("version"), F.lit(True).alias("visible"), F.col("id").alias("changeset"), F.timestamp_seconds(F.col("id") * 7200 + 1_400_000_000).alias("timestamp"), F.timestamp_seconds(F.col("id") * 7200 + 1_400_000_000).alias("committed"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    one = F.array(F.struct(F.lit(1).cast("long").alias("ref"), F.lit(None).cast("int").alias("version"), F.lit(None).cast("bigint").alias("changeset"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")))
    t = F.timestamp_seconds((F.col("id") % many + 1) * 7200 + 1_400_000_060)
    ways = spark.range(2 * many).select((F.col("id") % many).alias("id"), F.lit(1).alias("x"), (F.col("id") >= many).cast("int").alias("seq"), F.when(F.col("id") < many, t).otherwise(t + F.expr("INTERVAL 10 HOURS")).alias("timestamp"))
    ways = ways.select("id", F.col("seq").alias("version"), "seq", (F.col("seq") == 0).alias("visible"), F.lit(0).cast("long").alias("changeset"), "timestamp", F.col("timestamp").alias("committed"), one.alias("nodes"))
    d = history.annotate_ways(ways, nodes, most=5_000)
    got = d.where("seq = 0").select("id", F.get("nodes", F.lit(0))["version"].alias("v"), F.size("updates").alias("n"), F.get("updates", F.lit(0))["version"].alias("u"))
    assert got.where(f"v = id + 1 AND n = least(5, {many} - v) AND (n = 0 OR u = v + 1)").count() == many
    text = d._jdf.queryExecution().optimizedPlan().toString()
    collected = [x for x in text.splitlines() if "collect_list" in x and "few" not in x and "updates" not in x and "idx" not in x]
    assert not collected


def test_parents_are_worked_out_once(spark):
    """However often they are read; and what a child's history tells goes back as rows of what parents keep."""
    nodes = spark.createDataFrame([(i, v, True, v, at(LATE, v), at(LATE, v), float(v), 0.0) for i in range(20) for v in range(1, 9)], NODE)
    ways = spark.createDataFrame([(i, v, True, 1, at(LATE, 3 * v), at(LATE, 3 * v), nd(*range(20))) for i in range(30) for v in (1, 2)], WAY)
    many = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            many.add(b.num_rows)
            yield b

    got = history.annotate_ways(ways.mapInArrow(counted, ways.schema), nodes)
    assert got.where("forall(nodes, n -> n.version = 3 * version) AND size(updates) = 20 * 2").count() == 60
    assert many.value == 60


@pytest.mark.parametrize("most", [200_000, 6])
def test_updates_as_rows(spark, most):
    """The same as those gathered by parent; also where they begin, end and lie across blocks of versions."""
    top = 3 * history.BLOCK + 2
    nodes = [(i, v, v % 7 > 0, v, at(LATE, v), at(LATE, v), float(v), float(i)) for i in (1, 2) for v in range(1, top + i)]
    starts = [0, history.BLOCK - 1, history.BLOCK, history.BLOCK + 1, 3 * history.BLOCK, top + 9]
    ways = [(w, v, w < 3 or v != 2, 1, at(LATE, h), at(LATE, h), nd(1, 2, 1)) for w in (1, 2, 3) for v, h in enumerate(starts[w - 1 :], 1)]
    n, w = spark.createDataFrame(nodes, NODE), spark.createDataFrame(ways, WAY)
    option = {"ignore_inconsistency": True, "ignore_missing": True, "most": most}
    rows = history.way_updates(w, n, **option)
    got = sorted((r.id, r.seq, r["index"], r.version, r.timestamp, r.changeset, r.lat, r.lon, r.reverse) for r in rows.collect())
    d = history.annotate_ways(w, n, **option).where("visible").collect()
    assert got == sorted((r.id, r.seq, *u) for r in d for u in r.updates)
    first = [(r[2], r[3]) for r in got if r[:2] == (1, 1)]  # it begins before the first version and ends before the one at the next one's time
    assert first == [(i, v) for i in range(3) for v in range(1, history.BLOCK - 1) if v % 7]
    assert len(got) > 200


def test_errors_and_options(spark):
    nodes = [(1, 1, True, 1, at(EARLY, 0), None, 1.0, 1.0), (1, 2, False, 2, at(EARLY, 5), None, 1.0, 1.0)]
    ways = [(7, 1, True, 50, at(EARLY, 8), None, nd(1, 3))]
    with pytest.raises(Exception, match="no history of child 3"):
        annotated(spark, nodes[:1], ways)
    with pytest.raises(Exception, match="no visible version of child 1"):
        annotated(spark, nodes, ways, ignore_missing=True)
    got = annotated(spark, nodes, ways, ignore_missing=True, ignore_inconsistency=True)[7, 1]
    assert [n.version for n in got.nodes] == [None, None] and got.updates == []


def test_child_filter_and_invisible_parents(spark):
    nodes = [(i, v, True, 1, at(EARLY, v), None, 1.0, 1.0) for i in (1, 2, 3) for v in (1, 2)]
    way = [(1, 1, 9, 5.0, 5.0), (2, 1, 9, 5.0, 5.0), (3, None, None, None, None)]
    ways = [(7, 1, True, 50, at(EARLY, 8), None, way), (7, 2, False, 51, at(EARLY, 9), None, nd(1))]
    got = annotated(spark, nodes, ways, child_filter=F.col("ref") == 2)
    assert [n.version for n in got[7, 1].nodes] == [1, 2, 2] and [n.version for n in got[7, 2].nodes] == [None]


def test_relations_get_reversals_and_orientation(spark):
    place = {1: (0.0, 0.0), 2: (1.0, 0.0), 3: (1.0, 1.0), 4: (0.0, 1.0)}
    line = lambda *r: [(i, 1, 1, place[i][1], place[i][0]) for i in r]
    ways = spark.createDataFrame([(1, 1, True, 1, at(EARLY, 0), None, line(1, 2, 3)), (1, 2, True, 2, at(EARLY, 10), None, line(3, 2, 1)), (2, 1, True, 1, at(EARLY, 0), None, line(1, 4, 3))], WAY)
    m = "array<struct<type: string, ref: bigint, role: string, version: int, changeset: bigint, lat: double, lon: double, orientation: tinyint, nodes: array<struct<ref: bigint, version: int, changeset: bigint, lat: double, lon: double>>>>"
    mem = lambda i: ("way", i, "outer", None, None, None, None, None, None)
    rel = spark.createDataFrame([(5, 1, True, 9, at(EARLY, 2), None, [("type", "multipolygon")], [mem(1), mem(2)])], f"id long, version int, visible boolean, changeset long, timestamp timestamp, committed timestamp, tags array<struct<k: string, v: string>>, members {m}")
    r = history.annotate_relations(rel, ways=ways).first()
    assert [x.version for x in r.members] == [1, 1]
    assert [(u["index"], u.version, u.reverse) for u in r.updates] == [(0, 2, True)]
    only = ways.where("version = 1")
    r = history.annotate_relations(rel, ways=only).first()
    assert [x.orientation for x in r.members] == [1, -1]


def test_diff(spark):
    c = spark.createDataFrame([("create", "node", 1, 1, "a"), ("modify", "node", 2, 5, "b"), ("delete", "way", 3, 2, "c"), ("modify", "node", 4, 9, "d")], "action string, type string, id long, version int, element string")
    h = spark.createDataFrame([("node", 2, 3, "b3"), ("node", 2, 1, "b1"), ("way", 3, 1, "c1"), ("node", 3, 1, "x"), ("node", 2, 6, "b6")], "type string, id long, version int, element string")
    got = {r.id: (r.action, r.visible, r.old, r.new) for r in diff.change_to_diff(c, h, ignore_missing=True).collect()}
    assert got == {1: ("create", True, None, "a"), 2: ("modify", True, "b3", "b"), 3: ("delete", False, "c1", "c"), 4: ("create", True, None, "d")}
    with pytest.raises(Exception, match="no previous version of node/4"):
        diff.change_to_diff(c, h).collect()


def test_order(spark):
    m = "array<struct<type: string, ref: bigint>>"
    rows = [(1, 1, [("relation", 2), ("way", 9)]), (2, 1, [("relation", 3)]), (3, 1, []), (4, 1, [("relation", 5)]), (5, 1, [("relation", 4), ("relation", 3)]), (6, 1, [("relation", 77)]), (6, 2, [("relation", 3)])]
    d = spark.createDataFrame(rows, f"id long, version int, members {m}")
    got = order.child_first([1, 6, 4, 5, 88], d)
    assert got[:4] == [3, 2, 1, 6] and 88 not in got and len(set(got)) == len(got)
    lv = {r.id: r.level for r in order.levels(d.where("id not in (4, 5)")).collect()}
    assert lv == {1: 2, 2: 1, 3: 0, 6: 1}


def test_sequence_and_latest(spark):
    s = spark.createDataFrame([(i, at(LATE, 2 * i)) for i in range(5)], "seq long, timestamp timestamp")
    assert [history.sequence_at(s, str(at(LATE, h))).first().seq for h in (-5, 0, 3, 8, 99)] == [0, 0, 2, 4, 4]
    n = spark.createDataFrame([(1, 1, True, 1, LATE, None, 0.0, 0.0), (1, 2, False, 1, at(LATE, 5), None, 0.0, 0.0), (2, 1, True, 1, LATE, None, 0.0, 0.0)], NODE)
    assert [r.id for r in history.latest(n).collect()] == [2]
    assert sorted(r.id for r in history.latest(n, str(at(LATE, 1))).collect()) == [1, 2]
