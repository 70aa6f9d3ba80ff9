"""The bucketed latest state: only touched buckets are written, and a batch done again gives the same."""

import os
import random
from datetime import datetime, timedelta

from terrachron.operators import inverted, joins
from terrachron.streaming import feed


def change(i, version, action="modify", hour=0):
    return (version, action, "node", i, version, datetime(2020, 1, 1) + timedelta(hours=hour), 1, "u", float(version), 0.0)


def state(latest):
    return {r.id: (r.version, r.action) for r in latest.read().collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    latest = feed.Latest(spark, str(tmp_path / "latest"), buckets=8)
    r, want, batches = random.Random(3), {}, []
    assert latest.read().count() == 0
    for n in range(5):
        some = [change(i, r.randrange(1, 9), r.choice(["modify", "delete"]), n) for i in r.sample(range(40), [40, 3, 1, 5, 2][n])]
        batches.append(spark.createDataFrame(some, feed.CHANGE))
        touched = latest.merge(batches[-1], n)
        assert sorted(int(x[7:]) for x in os.listdir(tmp_path / f"latest/batch={n}") if x.startswith("bucket=")) == touched and len(touched) <= len(some)
        for c in some:
            if c[3] not in want or (c[4], c[5]) > want[c[3]][:2]:
                want[c[3]] = (c[4], c[5], c[1])
        assert state(latest) == {i: (v, a) for i, (v, _, a) in want.items()}
        assert all(len(ns) <= 2 for ns in latest.versions().values())  # the one before stays, no others
    before = state(latest)
    latest.merge(batches[-1], 4)  # done again
    assert state(latest) == before
    os.remove(tmp_path / "latest/batch=4/_DONE")  # lost before it was whole: the version before counts
    without = feed.Latest(spark, str(tmp_path / "other"), buckets=8)
    for n in range(4):
        without.merge(batches[n], n)
    assert state(latest) == state(without)
    latest.merge(batches[-1], 4)
    assert state(latest) == before


def test_stream_and_cleaning(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for rows in ([change(1, 1), change(2, 1), change(3, 1)], [change(1, 2, "delete", 1), change(2, 2, "modify", 1)]):
        spark.createDataFrame(rows, feed.CHANGE).coalesce(1).write.mode("append").parquet(src)
        feed.upsert(feed.edits(spark, src), out, mark, buckets=4).awaitTermination()
    latest = feed.Latest(spark, out, buckets=4)
    assert state(latest) == {1: (2, "delete"), 2: (2, "modify"), 3: (1, "modify")}
    for n, rows in enumerate([[change(1, 1), change(2, 1, "delete")], [change(3, 1, "delete", 2)], [change(4, 1, "modify", 3)], [change(2, 1, "modify", 9)]]):
        some = feed.Latest(spark, str(tmp_path / "some"), buckets=1, forget="2 hours")
        some.merge(spark.createDataFrame(rows, feed.CHANGE), n)
        assert set(state(some)) == [{1, 2}, {1, 2, 3}, {1, 3, 4}, {1, 2, 4}][n]


WAY = "id long, version int, visible boolean, timestamp timestamp, nodes array<struct<ref: bigint>>"
RELATION = "id long, version int, visible boolean, timestamp timestamp, members array<struct<type: string, ref: bigint>>"


def test_inverted_index_follows_the_feed(spark, tmp_path):
    """After ten batches lookups are what a scan of the latest ways and relations gives, from one bucket."""
    r, at = random.Random(8), datetime(2020, 1, 1)
    index, ways, relations = inverted.Inverted(spark, str(tmp_path / "index"), buckets=16), {}, {}
    for n in range(10):
        w = [(i, r.randrange(1, 12), r.random() < 0.85, at, [(r.randrange(12),) for _ in range(r.randrange(6))]) for i in r.sample(range(25), 9)]
        m = [(i, r.randrange(1, 12), r.random() < 0.85, at, [(r.choice(["way", "node", "relation"]), r.randrange(12)) for _ in range(r.randrange(5))]) for i in r.sample(range(9), 3)]
        batch = inverted.parents_of("way", spark.createDataFrame(w, WAY)).unionByName(inverted.parents_of("relation", spark.createDataFrame(m, RELATION)))
        for _ in range(2 if n in (3, 9) else 1):  # done again
            index.merge(batch, n)
        for have, rows in ((ways, w), (relations, m)):
            for x in rows:
                if x[0] not in have or x[1] > have[x[0]][1]:
                    have[x[0]] = x
    ws, rs = (spark.createDataFrame([x for x in have.values() if x[2]], shape).cache() for have, shape in ((ways, WAY), (relations, RELATION)))
    seen = 0
    for ref in range(0, 12, 2):
        got = index.having("node", ref, "way")
        want = sorted(x.id for x in joins.ways_of_node(ws, ref).collect())
        assert sorted(x.id for x in got.collect()) == want
        assert len({f.rsplit("/", 2)[-2] for f in got.inputFiles()}) <= 1
        kind = ("way", "node", "relation")[ref // 2 % 3]
        more = sorted(x.id for x in joins.relations_of(rs, kind, ref).collect())
        assert sorted(x.id for x in index.having(kind, ref, "relation").collect()) == more
        seen += len(want) + len(more)
    assert seen > 10 and index.having("node", 999).count() == 0
