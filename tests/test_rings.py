"""Chains of segments: the same as by looking through all that is left, and in time that grows with their number."""

import random
import time
from types import SimpleNamespace

from terrachron.operators import rings
from terrachron.operators.rings import Segment
from terrachron.plans import shapes


def looked_through(segments):
    """The rule read straight: from the last segment on, the first of the others that touches an end."""
    rest = [Segment(s.index, s.line, s.orientation, s.reversed) for s in segments if len(s.line) > 1]
    out = []
    while rest:
        chain = [rest.pop()]
        while rings.line_of(chain)[0] != rings.line_of(chain)[-1]:
            first, last = rings.line_of(chain)[0], rings.line_of(chain)[-1]
            k = next((k for k, s in enumerate(rest) if {first, last} & {s.line[0], s.line[-1]}), None)
            if k is None:
                break
            s = rest.pop(k)
            at_end = last in (s.line[0], s.line[-1])
            if s.line[0] != last if at_end else s.line[0] == first:
                s.turn()
            s.line = s.line[1:] if at_end else s.line[:-1]
            chain = [*chain, s] if at_end else [s, *chain]
        out.append(chain)
    return out


def test_same_chains_on_random_segments():
    r = random.Random(6)
    for _ in range(3000):
        some = [Segment(i, [(r.randrange(5), r.randrange(2)) for _ in range(r.randrange(1, 4))], r.randrange(-1, 2), r.random() < 0.3) for i in range(r.randrange(9))]
        assert rings.join(some) == looked_through(some)


def test_many_segments_in_seconds():
    n = 50_000
    ring = [Segment(i, [(i, 0), (i, 1), ((i + 1) % n, 0)]) for i in range(n)]
    random.Random(1).shuffle(ring)
    began = time.time()
    assert [len(c) for c in rings.join(ring)] == [n]
    star = [Segment(i, [(0, 0), (i + 1, 0)]) for i in range(n)]
    assert sum(map(len, rings.join(star))) == n
    assert time.time() - began < 20


def test_members_are_objects_a_slice_at_a_time(spark):
    """A whole batch of 10,000 relations became Python objects at once."""
    d = spark.range(0, 5000, 1, 1).selectExpr("id", "array(id) AS segs")

    def many(i, segs):
        import sys

        live = sys._getframe(1).f_locals.get("part")
        yield i, live.num_rows

    got = rings.by_slices(d, many, ["id", "segs"], "id bigint, n bigint").collect()
    assert sorted(r.id for r in got) == list(range(5000)) and max(r.n for r in got) <= rings.ROWS


def test_lines_of_ways_are_not_broadcast(spark):
    """Ways that are short in their files and long as lines were broadcast whole, which took more than the driver's memory."""
    small = {"spark.sql.maxBroadcastTableSize": "256k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        r, w = shapes._squares(SimpleNamespace(node_v=spark.range(3000)), "boundary")
        got = rings.member_orientations(r, w).selectExpr("id", "posexplode(members) AS (idx, m)").selectExpr("id", "idx", "m.orientation").collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert sorted(map(tuple, got)) == [(i, k, -1 if i % 2 else 1) for i in range(3000) for k in range(3)]
