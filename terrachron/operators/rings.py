"""Segments to rings: joining depends on order, so each relation's members go through one function.

A segment is (index, orientation, reversed, points)."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Segment:
    __slots__ = ("index", "orientation", "reversed", "line")

    def __init__(self, index, line, orientation=0, reversed_=False):
        self.index, self.line, self.orientation, self.reversed = index, [tuple(p) for p in line], orientation or 0, bool(reversed_)

    def turn(self):
        self.line.reverse()
        self.reversed = not self.reversed

    def __eq__(self, other):
        return all(getattr(self, k) == getattr(other, k) for k in self.__slots__)

    def __repr__(self):
        return f"Segment({self.index}, {self.line}, {self.orientation}, {self.reversed})"


class _Ends:
    """Which segments begin or end at a point: the first of those that are left."""

    def __init__(self, segments: list[Segment]):
        self.left, self.at = [True] * len(segments), {}
        for k in range(len(segments) - 1, -1, -1):  # so that the first is at the end of each list
            for p in {segments[k].line[0], segments[k].line[-1]}:
                self.at.setdefault(p, []).append(k)

    def first(self, p) -> int | None:
        found = self.at.get(p, [])
        while found and not self.left[found[-1]]:
            found.pop()
        return found[-1] if found else None


def join(segments: list[Segment]) -> list[list[Segment]]:
    """Chains of segments end to end, from the last one on; of several that fit, the first. Shared points are dropped from
    the segment added; one that fits backwards is turned. Lines of one point take no part. Each segment is looked up by its ends, so
    that the work grows with the number of points."""
    rest = [Segment(s.index, s.line, s.orientation, s.reversed) for s in segments if len(s.line) > 1]
    ends, out = _Ends(rest), []
    for start in range(len(rest) - 1, -1, -1):
        if not ends.left[start]:
            continue
        ends.left[start] = False
        chain = deque([rest[start]])
        first, last = rest[start].line[0], rest[start].line[-1]
        while first != last:
            behind, before = ends.first(last), ends.first(first)
            if behind is None and before is None:
                break
            at_end = before is None or behind is not None and behind <= before
            k = behind if at_end else before
            s = rest[k]
            ends.left[k] = False
            if (last != s.line[0]) if at_end else (first == s.line[0]):
                s.turn()
            if at_end:
                s.line = s.line[1:]
                chain.append(s)
                last = s.line[-1]
            else:
                s.line = s.line[:-1]
                chain.appendleft(s)
                first = s.line[0]
        out.append(list(chain))
    return out


def line_of(chain: list[Segment]) -> list[tuple]:
    return [p for s in chain for p in s.line]


def area(points) -> float:
    """Signed area, positive counterclockwise."""
    if len(points) < 3:
        return 0.0
    p = np.asarray(points, float) - np.asarray(points[0], float)
    q = np.roll(p, -1, 0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def side(points) -> int:
    return 1 if area(points) > 0 else -1


def ring_of(chain: list[Segment], want: int) -> list[tuple]:
    """The chain as a ring in the orientation wanted: told by annotated segments if there are any, else by its area."""
    r = line_of(chain)
    told = [s for s in chain if s.orientation]
    turn = any((s.orientation == want) == s.reversed for s in told) if told else side(r) != want
    return r[::-1] if turn else r


def inside(ring, p) -> bool:
    """Whether p lies in the ring; points of its edges do."""
    x, y = p
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) and (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def closed(r) -> bool:
    return len(r) >= 4 and r[0] == r[-1]


def polygons(outer: list[Segment], inner: list[Segment], invalid: bool = False) -> list[list[list[tuple]]]:
    """Polygons (outer ring first) of a multipolygon: each inner ring goes to the first outer one that contains any of its
    points. invalid keeps open rings, and inner ones without an outer."""
    out = [[r] for r in (ring_of(c, 1) for c in join(outer)) if invalid or closed(r)]
    for c in join(inner):
        r = ring_of(c, -1)
        if not invalid and not closed(r):
            continue
        for p in out:
            if p[0] and closed(p[0]) and any(inside(p[0], q) for q in r):
                p.append(r)
                break
        else:
            if invalid:
                if out and out[0][0] and not closed(out[0][0]):
                    out[0].append(r)
                elif (e := next((p for p in out if not p[0]), None)) is not None:
                    e.append(r)
                else:
                    out.append([[], r])
    return out


_SEG = "array<struct<index: int, orientation: int, role: string, points: array<struct<lon: double, lat: double>>>>"


def _segments(column, role=None):
    return [Segment(s["index"], [(p["lon"], p["lat"]) for p in s["points"]], s["orientation"]) for s in column if role is None or s["role"] == role]


def member_segments(relations: DataFrame, ways: DataFrame, versions: bool = False) -> DataFrame:
    """id, segs of each relation: its way members in order, with the points of ways that carry them (column points or nodes);
    versions: ways are histories, and each member's version picks its own. The join is by shuffle: Spark estimates ways from the files they are
    made from, and would broadcast millions of lines where those are short."""
    from ..functions.geo import line

    more = ["version"] if versions else []
    w = ways.select(F.col("id").alias("ref"), *more, (F.col("points") if "points" in ways.columns else line("nodes")).alias("points")).hint("merge")
    m = relations.select("id", F.posexplode("members").alias("idx", "m")).where("m.type = 'way'")
    m = m.select("id", "idx", F.col("m.ref").alias("ref"), *(F.col("m.version").alias(c) for c in more), F.coalesce("m.orientation", F.lit(0)).cast("int").alias("o"), F.coalesce("m.role", F.lit("")).alias("role"), line("m.nodes").alias("own"))
    j = m.join(w, ["ref", *more], "left").withColumn("points", F.coalesce("points", "own"))
    s = F.struct(F.col("idx").alias("index"), F.col("o").alias("orientation"), "role", "points")
    return j.where("points is not null").groupBy("id").agg(F.array_sort(F.collect_list(s)).cast(_SEG).alias("segs"))


#: Relations whose members are Python objects at one time.
ROWS = 200


def by_slices(df: DataFrame, make, columns: list[str], ddl: str) -> DataFrame:
    """The rows that make gives for each row's columns. An Arrow batch becomes Python objects a slice at a time, so that they take as much memory
    as its size allows, whatever the batch has."""
    shape = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(shape)
    entries = lambda v: list(v.items()) if isinstance(v, dict) else v

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                out = [r for row in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns)) for r in make(*row)]
                if out:
                    yield pa.RecordBatch.from_pylist([{n: entries(v) for n, v in zip(arrow.names, r)} for r in out], schema=arrow)

    return df.mapInArrow(run, shape)


def joined(relations: DataFrame, ways: DataFrame, role: str | None = None) -> DataFrame:
    """id, chain, indexes, points, is_ring: the chains that each relation's way members form."""

    def chains(i, segs):
        for k, c in enumerate(join(_segments(segs, role))):
            p = line_of(c)
            yield i, k, [s.index for s in c], [{"lon": x, "lat": y} for x, y in p], p[0] == p[-1]

    s = member_segments(relations, ways).select("id", "segs")
    return by_slices(s, chains, ["id", "segs"], "id bigint, chain int, indexes array<int>, points array<struct<lon: double, lat: double>>, is_ring boolean")


def member_orientations(relations: DataFrame, ways: DataFrame, versions: bool = True) -> DataFrame:
    """Relations that are areas with the orientation of their way members: 1 if the way runs counterclockwise round its
    ring, -1 if clockwise. ways: histories, or with versions=False their state at the time."""
    from ..functions.tags import relation_is_area

    cols = ["id", "seq"] if "seq" in relations.columns else ["id"]
    r = relations.where(relation_is_area("tags")).withColumn("_key", F.xxhash64(*cols))
    keyed = r.select(F.col("_key").alias("id"), "members")

    def sides(i, segs):
        for role, want in (("outer", 1), ("inner", -1)):
            for c in join(_segments(segs, role)):
                turned = side(line_of(c)) != want
                for s in c:
                    yield i, s.index, -want if turned != s.reversed else want

    got = by_slices(member_segments(keyed, ways, versions), sides, ["id", "segs"], "id bigint, idx int, o int")
    got = got.groupBy(F.col("id").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("idx", "o"))).alias("_o"))
    d = relations.withColumn("_key", F.xxhash64(*cols)).join(got, "_key", "left")
    one = lambda m, i: m.withField("orientation", F.coalesce(F.try_element_at(F.col("_o"), i).cast("tinyint"), m["orientation"]))
    return d.withColumn("members", F.when(F.col("_o").isNull(), F.col("members")).otherwise(F.transform("members", one))).drop("_key", "_o")
