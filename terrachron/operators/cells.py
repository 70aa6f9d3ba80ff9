"""Points in boxes and rings by cells of a grid, and tables laid out by cell, so that neither meets all of the other.

Level L cuts the degrees of longitude and of latitude into 2^L parts each. A box takes the finest level at which it covers few cells, and a
point its one cell at each level that some box has; they meet by an equi-join on the cell, each pair once, and are then compared exactly.
A small box thus never meets far points, and a large one is no more than a few rows.

Defined results: points with a null or NaN coordinate, or one beyond 90 or 180 degrees, lie nowhere; boxes with a null or NaN edge, or with
a minimum above its maximum, hold nothing; edges belong to boxes and rings; repeated rows meet each other's partners each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import bounds_of, contains

FINEST, ACROSS = 20, 4


def _part(v: Column, half: float, level: Column) -> Column:
    """Number of the part of a coordinate from -half to half."""
    n = F.pow(F.lit(2.0), level)
    return F.least(F.floor((v + half) / (2 * half) * n), n - 1).cast("bigint")


def _number(level: Column, x: Column, y: Column) -> Column:
    return F.shiftleft(level.cast("bigint"), 56).bitwiseOR(F.shiftleft(x, 28)).bitwiseOR(y)


def cell(lat: Column, lon: Column, level) -> Column:
    """The cell of a point, null if it is nowhere."""
    level = F.lit(level) if isinstance(level, int) else level
    fine = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(fine, _number(level, _part(lon, 180.0, level), _part(lat, 90.0, level)))


def level_of(bounds: Column) -> Column:
    """The finest level at which a box covers at most ACROSS cells in each direction."""
    size = F.greatest((bounds["maxlon"] - bounds["minlon"]) / 360, (bounds["maxlat"] - bounds["minlat"]) / 180)
    return F.when(size > 0, F.least(F.lit(FINEST), F.greatest(F.lit(0), F.floor(F.log2((ACROSS - 1) / size)).cast("int")))).otherwise(F.lit(FINEST))


def cells_of(bounds: Column, level: Column) -> Column:
    """All cells that a box touches."""
    clamp = lambda v, half: F.greatest(F.lit(-half), F.least(F.lit(half), v))
    at = lambda name, half: _part(clamp(bounds[name], half), half, level)
    xs, ys = F.sequence(at("minlon", 180.0), at("maxlon", 180.0)), F.sequence(at("minlat", 90.0), at("maxlat", 90.0))
    fine = (bounds["minlat"] <= bounds["maxlat"]) & (bounds["minlon"] <= bounds["maxlon"]) & ~F.isnan(bounds["maxlat"]) & ~F.isnan(bounds["maxlon"])
    return F.when(fine, F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: _number(level, x, y)))))


def within_boxes(points: DataFrame, boxes: DataFrame, bounds: str = "bounds") -> DataFrame:
    """points (lat, lon and others) with the boxes that they lie in; the tables share no other column names."""
    b = boxes.withColumn("_level", level_of(F.col(bounds)))
    levels = sorted(r[0] for r in b.select("_level").distinct().collect())  # one for each level at most
    b = b.withColumn("_cell", F.explode(cells_of(F.col(bounds), F.col("_level")))).drop("_level")
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    p = points.withColumn("_cell", F.explode(F.array(*(cell(lat, lon, level) for level in levels)) if levels else F.array().cast("array<bigint>")))
    return p.join(b, "_cell").where(contains(bounds, "lat", "lon")).drop("_cell")


def inside(ring: Column, lat: Column, lon: Column) -> Column:
    """Whether a point lies in a ring (an array of structs with lat and lon); points of its edges do."""

    def edge(i):
        a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        x1, y1, x2, y2 = a["lon"], a["lat"], b["lon"], b["lat"]
        on = lon.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2)) & ((x2 - x1) * (lat - y1) == (y2 - y1) * (lon - x1))
        over = F.when((y1 > lat) != (y2 > lat), lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1).otherwise(False)
        return F.when(on, 2).when(over, 1).otherwise(0)

    edges = F.transform(F.sequence(F.lit(0), F.size(ring) - 1), edge)
    inner = F.exists(edges, lambda e: e == 2) | (F.size(F.filter(edges, lambda e: e == 1)) % 2 == 1)
    return F.when(F.size(ring) > 0, inner).otherwise(False)


def within_rings(points: DataFrame, rings: DataFrame, ring: str = "ring") -> DataFrame:
    """points with the rings that they lie in."""
    r = rings.where(F.size(ring) > 0).withColumn("_bounds", bounds_of(ring))
    return within_boxes(points, r, "_bounds").drop("_bounds").where(inside(F.col(ring), F.col("lat"), F.col("lon")))


def lay_out(points: DataFrame, path: str, level: int = 6, mode: str = "errorifexists") -> None:
    """Write points in folders by their cell (4^level of them at most); crowded cells are several files."""
    d = points.withColumn("cell", cell(F.col("lat").cast("double"), F.col("lon").cast("double"), level))
    d.repartitionByRange("cell", "lat", "lon").sortWithinPartitions("cell", "lat", "lon").write.mode(mode).partitionBy("cell").parquet(path)


def touched(minlat: float, minlon: float, maxlat: float, maxlon: float, level: int) -> list[int]:
    """The cells of a box, for a filter that prunes folders."""
    if not (minlat <= maxlat and minlon <= maxlon):
        return []
    n = 2.0**level
    part = lambda v, half: int(min(math.floor((max(-half, min(half, v)) + half) / (2 * half) * n), n - 1))
    return [level << 56 | x << 28 | y for x in range(part(minlon, 180.0), part(maxlon, 180.0) + 1) for y in range(part(minlat, 90.0), part(maxlat, 90.0) + 1)]


def in_box(spark: SparkSession, path: str, minlat: float, minlon: float, maxlat: float, maxlon: float, level: int = 6) -> DataFrame:
    """Points of a table that lay_out() wrote, in a box; only folders of its cells are read."""
    box = F.struct(F.lit(float(minlat)).alias("minlat"), F.lit(float(maxlat)).alias("maxlat"), F.lit(float(minlon)).alias("minlon"), F.lit(float(maxlon)).alias("maxlon"))
    d = spark.read.parquet(path)
    return d.where(F.col("cell").isin(touched(minlat, minlon, maxlat, maxlon, level))).where(contains(box, "lat", "lon")).drop("cell")
