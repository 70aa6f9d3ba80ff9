"""Reading map XML, change files and diffs by Spark's XML source, with fixed schemas. Compressed files are read by suffix."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema

_TAG = "tag array<struct<k: string, v: string>>"
_ND = "nd array<struct<ref: bigint, version: int, changeset: bigint, lat: double, lon: double>>"
_UPDATE = f"update {schema.UPDATES}"
_META = "id bigint, user string, uid bigint, visible boolean, version int, changeset bigint, timestamp timestamp, committed timestamp"
_MEMBER = f"member {schema.MEMBERS.replace('nodes:', 'nd:')}"
_RAW = {
    "node": f"{_META}, lat double, lon double, {_TAG}",
    "way": f"{_META}, {_TAG}, {_ND}, {_UPDATE}, bounds {schema.BOUNDS}",
    "relation": f"{_META}, {_TAG}, {_MEMBER}, {_UPDATE}, bounds {schema.BOUNDS}",
    "changeset": "id bigint, user string, uid bigint, created_at timestamp, closed_at timestamp, open boolean, num_changes int, min_lat double, max_lat double, "
    f"min_lon double, max_lon double, comments_count int, {_TAG}, discussion struct<comment: array<struct<user: string, uid: bigint, date: timestamp, text: string>>>",
    "note": "id bigint, lat double, lon double, url string, comment_url string, close_url string, reopen_url string, date_created string, date_closed string, "
    "status string, comments struct<comment: array<struct<date: string, uid: bigint, user: string, user_url: string, action: string, text: string, html: string>>>",
    "user": "id bigint, display_name string, account_created timestamp, description string, img struct<href: string>, changesets struct<count: int>, traces struct<count: int>, "
    "home struct<lat: double, lon: double, zoom: int>, languages struct<lang: array<string>>, blocks struct<received: struct<count: int, active: int>>, "
    "messages struct<received: struct<count: int, unread: int>, sent: struct<count: int>>",
}


def _read(spark: SparkSession, path, tag: str, raw: str) -> DataFrame:
    names = re.sub(r"\bnd:", "nd:", raw)
    return spark.read.schema(T.StructType.fromDDL(names)).format("xml").option("rowTag", tag).option("attributePrefix", "").option("mode", "PERMISSIVE").load(path)


def _member(m):
    keep = ("type", "ref", "role", "version", "changeset", "lat", "lon", "orientation")
    return F.struct(*(m[k].alias(k) for k in keep), m["nd"].alias("nodes"))


def _set(t):
    """A time, null where it is the zero time that writers put for none."""
    return F.when(t >= F.lit("0002-01-01").cast("timestamp"), t)


def _shaped(kind: str, get, visible=None) -> list:
    """Columns of the table from the raw record; get(name) gives one."""
    from ..functions.times import note_date

    none = lambda ddl: F.array().cast(ddl)
    stamps = ("timestamp", "committed", "created_at", "closed_at")
    meta = lambda c: (_set(get(c)) if c in stamps else get(c)).alias(c)
    seen = F.coalesce(get("visible"), F.lit(False)) if kind in ("node", "way", "relation") else None
    if visible is not None:
        seen = visible
    tags = F.coalesce(get("tag"), none(schema.TAGS)).alias("tags") if kind in ("node", "way", "relation", "changeset") else None
    common = [meta("user"), meta("uid"), *([seen.alias("visible")] if seen is not None else []), meta("version"), meta("changeset"), meta("timestamp"), tags, meta("committed")] if kind in ("node", "way", "relation") else []
    if kind == "node":
        return [meta("id"), F.coalesce(get("lat"), F.lit(0.0)).alias("lat"), F.coalesce(get("lon"), F.lit(0.0)).alias("lon"), *common]
    if kind == "way":
        return [meta("id"), *common, F.coalesce(get("nd"), none(schema.WAY_NODES)).alias("nodes"), F.coalesce(get("update"), none(schema.UPDATES)).alias("updates"), meta("bounds")]
    if kind == "relation":
        return [meta("id"), *common, F.coalesce(F.transform(get("member"), _member), none(schema.MEMBERS)).alias("members"), F.coalesce(get("update"), none(schema.UPDATES)).alias("updates"), meta("bounds")]
    if kind == "changeset":
        names = ("id", "user", "uid", "created_at", "closed_at", "open", "num_changes", "min_lat", "max_lat", "min_lon", "max_lon", "comments_count")
        return [*map(meta, names), tags, get("discussion")["comment"].alias("discussion")]
    if kind == "note":
        names = ("id", "lat", "lon", "url", "comment_url", "close_url", "reopen_url")
        said = lambda c: F.struct(note_date(c["date"]).alias("date"), *(c[k].alias(k) for k in ("uid", "user", "user_url", "action", "text", "html")))
        return [*map(meta, names), note_date(get("date_created")).alias("date_created"), note_date(get("date_closed")).alias("date_closed"), meta("status"), F.transform(get("comments")["comment"], said).alias("comments")]
    names = ("description", "img", "changesets", "traces", "home")
    return [meta("id"), get("display_name").alias("name"), *map(meta, names), get("languages")["lang"].alias("languages"), meta("blocks"), meta("messages"), _set(get("account_created")).alias("created_at")]


def _lines(spark: SparkSession, path, tag: str, raw: str) -> DataFrame:
    """Records of the lines that are elements of the name."""
    d = spark.read.text(path).where(F.col("value").startswith(f"<{tag} "))
    return d.select(F.from_xml("value", T.StructType.fromDDL(raw), {"rowTag": tag, "attributePrefix": ""}).alias("r")).select("r.*")


def read(spark: SparkSession, path, kind: str, any_case: bool = False, parts: bool = False) -> DataFrame:
    """All records of one kind, at any depth: so change files are flattened. any_case: also those whose element is named Node or
    NODE, at the price of two more parses. Spark's source reads whole documents only: of a file with several roots, such as a part of a document, it gives
    no more than the first. parts: the files are parts as sinks writes them, a line for each element, and are read line by line."""
    read_ = _lines if parts else _read
    d = read_(spark, path, kind, _RAW[kind])
    for tag in (kind.capitalize(), kind.upper()) if any_case else ():
        d = d.unionByName(read_(spark, path, tag, _RAW[kind]))
    if kind == "user":  # comments of notes name their users in elements of the same name, without id
        d = d.where("id is not null")
    return d.select(*_shaped(kind, F.col))


def read_all(spark: SparkSession, path) -> dict[str, DataFrame]:
    return {k: read(spark, path, k) for k in _RAW}


def read_bounds(spark: SparkSession, path) -> DataFrame:
    return _read(spark, path, "bounds", "minlat double, maxlat double, minlon double, maxlon double")


def _blocks(spark, path, tag) -> DataFrame:
    inner = ", ".join(f"{k} array<struct<{_colons(_RAW[k])}>>" for k in ("node", "way", "relation"))
    return _read(spark, path, tag, inner)


def _colons(ddl: str) -> str:
    """A list of columns as the fields of a struct."""
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields)


def read_change(spark: SparkSession, path) -> dict[str, DataFrame]:
    """Per kind the changed elements with their action; blocks may repeat in any order."""
    out = {}
    for kind in ("node", "way", "relation"):
        d = None
        for action in ("create", "modify", "delete"):
            x = _blocks(spark, path, action).select(F.explode(kind).alias("x")).select(F.lit(action).alias("action"), *_shaped(kind, lambda c: F.col("x")[c]))
            d = x if d is None else d.unionByName(x)
        out[kind] = d
    return out


def read_diff(spark: SparkSession, path) -> DataFrame:
    """action, type, id, old, new (JSON of the raw records) from action elements with old and new or a bare element."""
    inner = ", ".join(f"{k}: struct<{_colons(_RAW[k])}>" for k in ("node", "way", "relation"))
    plain = ", ".join(f"{k} struct<{_colons(_RAW[k])}>" for k in ("node", "way", "relation"))
    d = _read(spark, path, "action", f"type string, old struct<{inner}>, new struct<{inner}>, {plain}")
    out = None
    for k in ("node", "way", "relation"):
        new = F.coalesce(F.col(f"new.{k}"), F.col(k))
        x = d.where(new.isNotNull() | F.col(f"old.{k}").isNotNull())
        x = x.select(F.col("type").alias("action"), F.lit(k).alias("type"), F.coalesce(new["id"], F.col(f"old.{k}.id")).alias("id"), F.to_json(F.col(f"old.{k}")).alias("old"), F.to_json(new).alias("new"))
        out = x if out is None else out.unionByName(x)
    return out
