"""The lookups of a map service over tables, without a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import contains
from . import history, joins


class NotFound(LookupError):
    """No such element, or of several asked for not all."""


class Store:
    """Histories of nodes, ways and relations, changesets, notes and users, with the service's verbs; at: as of a time."""

    def __init__(self, nodes, ways, relations, changesets=None, notes=None, users=None, changes=None, at=None):
        self.tables = {"node": nodes, "way": ways, "relation": relations}
        self.changesets, self.notes, self.users, self.changes, self.at = changesets, notes, users, changes, at

    def history(self, kind: str, ref: int) -> DataFrame:
        return self.tables[kind].where(F.col("id") == ref).orderBy("version")

    def version(self, kind: str, ref: int, version: int) -> DataFrame:
        return self.tables[kind].where((F.col("id") == ref) & (F.col("version") == version))

    def latest(self, kind: str) -> DataFrame:
        return history.latest(self.tables[kind], self.at)

    def get(self, kind: str, ref: int) -> DataFrame:
        return history.latest(self.tables[kind].where(F.col("id") == ref), self.at)

    def get_many(self, kind: str, refs: list[int]) -> DataFrame:
        d = history.latest(self.tables[kind].where(F.col("id").isin(*refs)), self.at)
        if d.count() != len(set(refs)):
            raise NotFound(f"{kind}: not all of {refs}")
        return d

    def one(self, df: DataFrame):
        rows = df.limit(2).collect()
        if len(rows) != 1:
            raise NotFound(f"{len(rows)} rows where one is needed")
        return rows[0]

    def ways_of_node(self, ref: int) -> DataFrame:
        return joins.ways_of_node(self.latest("way"), ref)

    def relations_of(self, kind: str, ref: int) -> DataFrame:
        return joins.relations_of(self.latest("relation"), kind, ref)

    def way_full(self, ref: int):
        return joins.way_full(self.latest("way"), self.latest("node"), ref)

    def relation_full(self, ref: int):
        return joins.relation_full(self.latest("relation"), self.latest("way"), self.latest("node"), ref)

    def map(self, minlat: float, minlon: float, maxlat: float, maxlon: float):
        """Nodes in the bounds, ways with one of them, their other nodes, and relations with any of those nodes or ways."""
        nodes, ways, relations = (self.latest(k) for k in ("node", "way", "relation"))
        box = F.struct(F.lit(minlat).alias("minlat"), F.lit(maxlat).alias("maxlat"), F.lit(minlon).alias("minlon"), F.lit(maxlon).alias("maxlon"))
        inside = nodes.where(contains(box, "lat", "lon"))
        hit = ways.select("id", F.explode("nodes.ref").alias("ref")).join(inside.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()
        w = ways.join(hit, "id", "left_semi")
        every = inside.select("id").unionByName(w.select(F.explode("nodes.ref").alias("id"))).distinct()
        n = nodes.join(every, "id", "left_semi")
        keys = n.select(F.lit("node").alias("type"), F.col("id").alias("ref")).unionByName(w.select(F.lit("way").alias("type"), F.col("id").alias("ref")))
        r = joins.member_rows(relations).join(keys, ["type", "ref"], "left_semi").select("id").distinct()
        return n, w, relations.join(r, "id", "left_semi")

    def changeset(self, ref: int, discussion: bool = False) -> DataFrame:
        d = self.changesets.where(F.col("id") == ref)
        return d if discussion else d.drop("discussion")

    def changeset_download(self, ref: int) -> DataFrame:
        return self.changes.where(F.col("element.changeset") == ref)

    def note(self, ref: int) -> DataFrame:
        return self.notes.where(F.col("id") == ref)

    def notes_in(self, minlat=None, minlon=None, maxlat=None, maxlon=None, text=None, limit: int = 100, closed_days: int = 7, now=None) -> DataFrame:
        """Notes by bounds or text, newest first; closed_days: of closed ones those closed that recently, 0 none, -1 all."""
        if not 1 <= limit <= 10000:
            raise ValueError("limit must be between 1 and 10000")
        d = self.notes
        if minlat is not None:
            d = d.where(F.col("lat").between(minlat, maxlat) & F.col("lon").between(minlon, maxlon))
        if text is not None:
            d = d.where(F.exists("comments", lambda c: F.contains(F.lower(c["text"]), F.lit(text.lower()))))
        if closed_days >= 0:
            open_ = F.col("date_closed").isNull()
            now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
            d = d.where(open_ if closed_days == 0 else open_ | (F.col("date_closed") >= now - F.make_interval(days=F.lit(closed_days))))
        return d.orderBy(F.desc("date_created"), "id").limit(limit)

    def user(self, ref: int) -> DataFrame:
        return self.users.where(F.col("id") == ref)
