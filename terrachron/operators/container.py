"""A container of tables by kind, and what spans its kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids

ELEMENTS = ("node", "way", "relation")


def append(tables: dict[str, DataFrame], kind: str, rows: DataFrame) -> dict[str, DataFrame]:
    """The container with more rows of a kind; columns that one side lacks are null."""
    old = tables.get(kind)
    return tables | {kind: rows if old is None else old.unionByName(rows, allowMissingColumns=True)}


def elements(tables: dict[str, DataFrame]) -> DataFrame:
    """type, id, version, packed of all nodes, ways and relations; packed orders them by type, id and version."""
    parts = [tables[k].select(F.lit(k).alias("type"), "id", F.coalesce("version", F.lit(0)).alias("version")) for k in ELEMENTS if k in tables]
    return reduce(DataFrame.unionByName, parts).withColumn("packed", ids.pack("type", "id", "version"))


def features(tables: dict[str, DataFrame]) -> DataFrame:
    """type, id, packed (without version) of all elements, once each."""
    return elements(tables).select("type", "id", ids.feature_of("packed").alias("packed")).distinct()


def objects(tables: dict[str, DataFrame]) -> DataFrame:
    """type, id, version of rows of every kind, with rank, the place of the kind in a document."""
    order = ("node", "way", "relation", "changeset", "user", "note")
    parts = [
        tables[k].select(F.lit(i).alias("rank"), F.lit(k).alias("type"), "id", (F.coalesce("version", F.lit(0)) if "version" in tables[k].columns else F.lit(0)).alias("version"))
        for i, k in enumerate(order)
        if k in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def updates_by_time(updates):
    """Updates in order of time alone; of equals the one that came first."""
    key = F.transform(updates, lambda u, i: F.struct(u["timestamp"].alias("t"), i.alias("i"), u.alias("u")))
    return F.transform(F.array_sort(key), lambda x: x["u"])
