"""The distributed child-first order is that of the walk; centroids are worked out once."""

import random

from pyspark.sql import functions as F

from terrachron.functions import geo
from terrachron.operators import order

MEMBER = "array<struct<type: string, ref: bigint, role: string>>"


def some(spark, edges):
    rows = [(i, v, [("relation", k, "") for k in kids]) for (i, v), kids in edges.items()]
    return spark.createDataFrame(rows, f"id long, version int, members {MEMBER}")


def test_child_first_rows_are_the_walk(spark):
    for seed, cyclic in ((1, False), (2, False), (3, True)):
        r = random.Random(seed)
        ids = range(14)
        edges = {(i, v): [r.choice(ids) if cyclic else r.randint(i + 1, i + 6) for _ in range(r.randint(0, 3))] for i in ids for v in (1, 2)}
        d, ask = some(spark, edges), [3, 0, 40, 0, 5]
        got = [x.id for x in order.child_first_rows(ask, d).orderBy("rank").collect()]
        assert got == order.child_first(ask, d) and len(got) > 5


def test_child_first_rows_gathers_nothing(spark, monkeypatch):
    """Without cycles nothing comes to the driver but the first row of a round."""
    monkeypatch.setattr(order, "child_first", None)
    d = some(spark, {(1, 1): [2, 3], (2, 1): [4], (3, 1): [4, 2], (4, 1): []})
    assert [x.id for x in order.child_first_rows([1], d).orderBy("rank").collect()] == [4, 2, 3, 1]


def test_distances_are_in_the_plan_once(spark):
    p = F.from_json(F.lit("[]"), "array<struct<lon: double, lat: double>>")
    d = spark.range(1).select(p.alias("points"))
    for c, many in ((geo.centroid("points"), 1), (geo.point_on_line("points"), 2)):
        assert d.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().lower().count("asin(") == many
