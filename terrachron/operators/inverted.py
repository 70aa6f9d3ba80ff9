"""From members to what has them, kept in buckets: a lookup reads one, and a batch of a feed writes those that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.feed import Latest

PARENTS = "type string, id bigint, version int, timestamp timestamp, children array<struct<type: string, ref: bigint>>"
LINKS = "child_type string, ref bigint, type string, id bigint, version int, timestamp timestamp, present boolean"


def parents_of(kind: str, rows: DataFrame) -> DataFrame:
    """Ways or relations as rows of PARENTS; those that are not visible have no children."""
    if kind == "way":
        children = F.transform("nodes", lambda n: F.struct(F.lit("node").alias("type"), n["ref"].alias("ref")))
    else:
        children = F.transform("members", lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref")))
    none = F.array().cast("array<struct<type: string, ref: bigint>>")
    there = F.coalesce("visible", F.lit(True)) & children.isNotNull()
    return rows.select(F.lit(kind).alias("type"), "id", F.col("version").cast("int").alias("version"), "timestamp", F.when(there, F.array_distinct(children)).otherwise(none).alias("children"))


class Inverted:
    """Two tables under a folder: the newest version of each parent with its children, by parent; and the links, by child.

    A new version adds the links of its children and ends those of children that it no longer has. Versions that are older than
    what is known change nothing. merge() may be done again with the same number and gives the same."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark = spark
        self.parents = Latest(spark, f"{folder.rstrip('/')}/parents", buckets)
        self.links = Latest(spark, f"{folder.rstrip('/')}/links", buckets, ("child_type", "ref", "type", "id"), by=("child_type", "ref"))

    def merge(self, batch: DataFrame, number: int) -> list[int]:
        """Take rows of PARENTS in; the buckets of links that were written."""
        newest = batch.groupBy("type", "id").agg(F.max_by(F.struct("version", "timestamp", "children"), F.struct("version", "timestamp")).alias("n")).select("type", "id", "n.*")
        touched = [r[0] for r in newest.select(self.parents.bucket()).distinct().collect()]  # no more than there are buckets
        old = self.parents.read(PARENTS, number, touched).select("type", "id", F.col("version").alias("_version"), F.col("children").alias("_children"))
        newest = newest.join(old, ["type", "id"], "left").where("_version IS NULL OR version > _version")
        both = F.concat(
            F.transform("children", lambda c: F.struct(c.alias("c"), F.lit(True).alias("present"))),
            F.transform(F.array_except(F.coalesce("_children", F.array().cast("array<struct<type: string, ref: bigint>>")), "children"), lambda c: F.struct(c.alias("c"), F.lit(False).alias("present"))),
        )
        links = newest.select("type", "id", "version", "timestamp", F.explode(both).alias("x"))
        links = links.select(F.col("x.c.type").alias("child_type"), F.col("x.c.ref").alias("ref"), "type", "id", "version", "timestamp", F.col("x.present").alias("present"))
        written = self.links.merge(links, number)  # first, as it needs what the parents were
        self.parents.merge(newest.select("type", "id", "version", "timestamp", "children"), number)
        return written

    def having(self, child_type: str, ref: int, kind: str | None = None) -> DataFrame:
        """type, id and version of what has the child now, by one bucket."""
        b = self.spark.range(1).select(self.links.bucket(F.lit(child_type), F.lit(ref).cast("long"))).first()[0]
        d = self.links.read(LINKS, only=[b]).where((F.col("child_type") == child_type) & (F.col("ref") == ref) & F.col("present"))
        return (d if kind is None else d.where(F.col("type") == kind)).select("type", "id", "version")
