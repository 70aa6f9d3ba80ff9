"""Joins by cells against all pairs; tables laid out by cell."""

import random
import re

from pyspark.sql import functions as F

from terrachron.operators import cells, rings

NAN = float("nan")


def test_points_in_boxes(spark):
    r = random.Random(2)
    points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(150)] + [(i, round(r.uniform(-2, 2)), round(r.uniform(-2, 2))) for i in range(150, 220)]
    points += [(220, 90.0, 180.0), (221, -90.0, -180.0), (222, None, 0.0), (223, NAN, 0.0), (224, 91.0, 0.0), (225, 0.0, 181.0), (150, points[150][1], points[150][2])]
    boxes = []
    for i in range(120):
        a, b, h, w = r.uniform(-90, 90), r.uniform(-180, 180), r.choice([0, 0.01, 1, 40, 179]), r.choice([0, 0.02, 3, 100, 359])
        boxes.append((i, (a, a + h, b, b + w)))
    boxes += [(120 + i, (float(i - 2), float(i - 1), -1.0, 1.0)) for i in range(4)] + [(130, (-90.0, 90.0, -180.0, 180.0)), (131, (5.0, 1.0, 0.0, 1.0)), (132, (None, 1.0, 0.0, 1.0)), (133, (0.0, NAN, 0.0, 1.0)), (134, (90.0, 90.0, 180.0, 180.0)), (134, (90.0, 90.0, 180.0, 180.0))]
    p = spark.createDataFrame([(i, a if a is None else float(a), float(b)) for i, a, b in points], "id long, lat double, lon double")
    b = spark.createDataFrame(boxes, "box long, bounds struct<minlat: double, maxlat: double, minlon: double, maxlon: double>")
    got = sorted((x.id, x.box) for x in cells.within_boxes(p, b).collect())
    there = lambda a, o: a is not None and abs(a) <= 90 and abs(o) <= 180
    want = sorted((i, k) for i, a, o in points if there(a, o) for k, (s, n, w, e) in boxes if s is not None and n == n and s <= a <= n and w <= o <= e)
    assert got == want and len(want) > 500
    assert cells.within_boxes(p, b.limit(0)).count() == 0 == cells.within_boxes(p.limit(0), b).count()


def test_points_in_rings(spark):
    r = random.Random(5)
    shapes = [[(r.randrange(8), r.randrange(8)) for _ in range(n)] for n in (3, 3, 4, 5, 6, 8, 12, 1, 2) for _ in range(6)]
    shapes += [[*s, s[0]] for s in shapes]
    points = [(x / 2, y / 2) for x in range(-1, 17) for y in range(-1, 17)]
    p = spark.createDataFrame([(i, float(y), float(x)) for i, (x, y) in enumerate(points)], "id long, lat double, lon double")
    q = spark.createDataFrame([(k, [(float(y), float(x)) for x, y in s]) for k, s in enumerate(shapes)] + [(999, []), (998, None)], "shape long, ring array<struct<lat: double, lon: double>>")
    got = sorted((x.id, x["shape"]) for x in cells.within_rings(p, q).collect())
    assert got == sorted((i, k) for i, a in enumerate(points) for k, s in enumerate(shapes) if rings.inside(s, a))


def test_a_box_reads_its_folders(spark, tmp_path):
    r = random.Random(7)
    d = spark.createDataFrame([(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(4000)] + [(9000 + i, 47.5 + i / 1e4, 8.5) for i in range(2000)], "id long, lat double, lon double")
    path = str(tmp_path / "laid")
    cells.lay_out(d, path, 4)
    for box in ((47.0, 8.0, 47.6, 9.0), (-10.0, -20.0, 10.0, 20.0), (89.0, 179.0, 90.0, 180.0), (5.0, 5.0, 4.0, 6.0)):
        got = cells.in_box(spark, path, *box, 4)
        want = d.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
        assert sorted(x.id for x in got.collect()) == sorted(x.id for x in want.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*cell", plan) or box[0] > box[2]
        folders = {f.rsplit("/", 2)[-2] for f in got.select("id", F.input_file_name().alias("f")).select("f").distinct().toPandas()["f"]}
        assert len(folders) <= len(cells.touched(*box, 4)) <= 12
