"""Reading and writing the JSON form of map data: one document with a list of elements of all kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import tags
from .sinks import ZERO_TIME, number

_META = "user: string, uid: bigint, visible: boolean, version: string, changeset: bigint, timestamp: timestamp, committed: timestamp, tags: map<string, string>"
_ELEMENT = (
    f"struct<type: string, id: bigint, lat: double, lon: double, {_META}, nodes: array<bigint>, members: array<struct<type: string, ref: bigint, role: string, version: int, "
    f"changeset: bigint, lat: double, lon: double, orientation: tinyint>>, updates: {schema.UPDATES}, bounds: {schema.BOUNDS}>"
)


def _each(spark: SparkSession, path, shape: str, parts: bool) -> DataFrame:
    """A row for each element."""
    if parts:
        line = F.ltrim(F.col("value"), F.lit(","))
        lines = spark.read.text(path).select(line.alias("value")).where(F.col("value").startswith('{"type":'))
        return lines.select(F.from_json("value", shape).alias("e")).select("e.*")
    doc = spark.read.schema(f"elements array<{shape}>").option("multiLine", True).json(path)
    return doc.select(F.explode("elements").alias("e")).select("e.*")


def read(spark: SparkSession, path, parts: bool = False) -> dict[str, DataFrame]:
    """node, way and relation tables of documents; a version may be a number or a string, and is null where absent. A document is read whole by one
    task; parts: the files are parts of one as write_document makes them, a line for each element, and are read line by line."""
    e = _each(spark, path, _ELEMENT, parts).withColumn("version", F.col("version").try_cast("int"))
    e = e.withColumn("visible", F.coalesce("visible", F.lit(False))).withColumn("tags", F.coalesce(tags.from_map("tags"), F.array().cast(schema.TAGS)))
    unset = lambda c: F.when(F.col(c) >= F.lit("0002-01-01").cast("timestamp"), F.col(c))
    e = e.withColumns({c: unset(c) for c in ("timestamp", "committed")})
    meta = ["user", "uid", "visible", "version", "changeset", "timestamp", "tags", "committed"]
    ref = lambda n: F.struct(n.alias("ref"), *(F.lit(None).cast(t).alias(k) for k, t in (("version", "int"), ("changeset", "bigint"), ("lat", "double"), ("lon", "double"))))
    nodes = F.coalesce(F.transform("nodes", ref), F.array().cast(schema.WAY_NODES)).alias("nodes")
    member = lambda m: F.struct(*(m[k].alias(k) for k in ("type", "ref", "role", "version", "changeset", "lat", "lon", "orientation")), F.lit(None).cast(schema.WAY_NODES).alias("nodes"))
    members = F.coalesce(F.transform("members", member), F.array().cast(schema.MEMBERS)).alias("members")
    of = lambda k: e.where(F.col("type") == k)
    return {
        "node": of("node").select("id", "lat", "lon", *meta),
        "way": of("way").select("id", *meta, nodes, "updates", "bounds"),
        "relation": of("relation").select("id", *meta, members, "updates", "bounds"),
    }


def _others() -> T.StructType:
    """Fields of changesets, notes and users together."""
    out = T.StructType.fromDDL("type string, tags map<string, string>, discussion struct<comments: array<struct<user: string, uid: bigint, date: timestamp, text: string>>>")
    for ddl in (schema.CHANGESETS, schema.NOTES, schema.USERS):
        for f in T.StructType.fromDDL(ddl).fields:
            out = out if f.name in out.names else out.add(f)
    return out


def read_others(spark: SparkSession, path) -> dict[str, DataFrame]:
    """changeset, note and user tables of documents; times that are unset are null."""
    doc = spark.read.schema(T.StructType([T.StructField("elements", T.ArrayType(_others()))])).option("multiLine", True).json(path)
    e = doc.select(F.explode("elements").alias("e")).select("e.*")
    unset = lambda c: F.when(F.col(c) >= F.lit("0002-01-01").cast("timestamp"), F.col(c))
    e = e.withColumns({c: unset(c) for c in ("created_at", "closed_at", "date_created", "date_closed")})
    e = e.withColumns({"tags": F.coalesce(tags.from_map("tags"), F.array().cast(schema.TAGS)), "discussion": F.col("discussion")["comments"]})
    return {k: e.where(F.col("type") == k).select(*T.StructType.fromDDL(schema.TABLES[k]).names) for k in ("changeset", "note", "user")}


ORDER = ("node", "way", "relation", "changeset", "user", "note")


def text(c):
    """A string as JSON."""
    a = F.to_json(F.array(c))
    return F.substr(a, F.lit(2), F.length(a) - 2)


def _obj(*fields):
    """An object of (name, JSON column); null columns are left out."""
    parts = F.array(*(F.concat(F.lit(f'"{k}":'), v) for k, v in fields))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _list(items, one):
    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ","), F.lit("]"))


def _num(c):
    return number(F.coalesce(c, F.lit(0)))


def _some(c):
    """A number that is not zero, else nothing."""
    return F.when(c != 0, number(c))


def _word(c):
    return F.when(c != "", text(c))


def _time(c):
    return F.concat(F.lit('"'), F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(ZERO_TIME)), F.lit('"'))


def _date(c):
    return F.when(c.isNull(), "null").otherwise(_time(c))


def _flag(c):
    return F.coalesce(c, F.lit(False)).cast("string")


def _tags():
    return F.when(F.size("tags") > 0, F.to_json(tags.as_map("tags")))


def _element(kind: str, df: DataFrame) -> list:
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    meta = [("user", _word(c("user"))), ("uid", _some(c("uid"))), ("visible", _flag(c("visible"))), ("version", _some(c("version"))), ("changeset", _some(c("changeset"))), ("timestamp", _time(c("timestamp")))]
    if "committed" in df.columns:
        committed = ("committed", F.when(F.col("committed").isNotNull(), _time(F.col("committed"))))
    else:
        committed = ("committed", F.lit(None).cast("string"))

    def update(u):
        return _obj(("index", number(u["index"])), ("version", number(u["version"])), ("timestamp", _time(u["timestamp"])), ("changeset", _some(u["changeset"])), ("lat", _some(u["lat"])), ("lon", _some(u["lon"])), ("reverse", F.when(u["reverse"], "true")))

    updates = ("updates", F.when(F.size("updates") > 0, _list(F.col("updates"), update)) if "updates" in df.columns else F.lit(None).cast("string"))
    refs = lambda n: _list(n, lambda x: F.coalesce(x["ref"], F.lit(0)).cast("string"))
    if kind == "node":
        return [("lat", _num(c("lat"))), ("lon", _num(c("lon"))), *meta, ("tags", _tags()), committed]
    if kind == "way":
        return [*meta, ("nodes", F.coalesce(refs(F.col("nodes")), F.lit("[]"))), ("tags", _tags()), committed, updates]

    def member(m):
        own = F.when(F.size(m["nodes"]) > 0, refs(m["nodes"]))
        return _obj(("type", text(m["type"])), ("ref", number(m["ref"])), ("role", text(F.coalesce(m["role"], F.lit("")))), *((k, _some(m[k])) for k in ("version", "changeset", "lat", "lon", "orientation")), ("nodes", own))

    return [*meta, ("tags", _tags()), ("members", F.coalesce(_list(F.col("members"), member), F.lit("[]"))), committed, updates]


def _changeset() -> list:
    c = F.col
    said = lambda x: _obj(("user", text(F.coalesce(x["user"], F.lit("")))), ("uid", _num(x["uid"])), ("date", _time(x["date"])), ("text", text(F.coalesce(x["text"], F.lit("")))))
    some = [(k, _some(c(k))) for k in ("num_changes", "min_lat", "max_lat", "min_lon", "max_lon", "comments_count")]
    talk = F.when(c("discussion").isNotNull(), _obj(("comments", _list(c("discussion"), said))))
    return [("user", _word(c("user"))), ("uid", _some(c("uid"))), ("created_at", _time(c("created_at"))), ("closed_at", _time(c("closed_at"))), ("open", _flag(c("open"))), *some, ("tags", _tags()), ("discussion", talk)]


def _user() -> list:
    c = F.col
    n = lambda x: _obj(("count", _num(x["count"])))
    lang = F.coalesce(_list(c("languages"), text), F.lit("null"))
    home = _obj(*((k, _num(c("home")[k])) for k in ("lat", "lon", "zoom")))
    blocks = _obj(("received", _obj(*((k, _num(c("blocks")["received"][k])) for k in ("count", "active")))))
    got = _obj(*((k, _num(c("messages")["received"][k])) for k in ("count", "unread")))
    return [
        ("name", text(F.coalesce(c("name"), F.lit("")))), ("description", _word(c("description"))), ("img", _obj(("href", text(F.coalesce(c("img")["href"], F.lit("")))))), ("changesets", n(c("changesets"))), ("traces", n(c("traces"))),
        ("home", home), ("languages", lang), ("blocks", blocks), ("messages", _obj(("received", got), ("sent", n(c("messages")["sent"])))), ("created_at", _time(c("created_at"))),
    ]


def _note() -> list:
    c = F.col
    empty = lambda x: text(F.coalesce(x, F.lit("")))
    said = lambda x: _obj(("date", _date(x["date"])), ("uid", _some(x["uid"])), ("user", _word(x["user"])), ("user_url", _word(x["user_url"])), *((k, empty(x[k])) for k in ("action", "text", "html")))
    urls = [(k, _word(c(k))) for k in ("url", "comment_url", "close_url", "reopen_url")]
    dates = [(k, _date(c(k))) for k in ("date_created", "date_closed")]
    return [("lat", _num(c("lat"))), ("lon", _num(c("lon"))), *urls, *dates, ("status", _word(c("status"))), ("comments", F.coalesce(_list(c("comments"), said), F.lit("null")))]


def elements(kind: str, df: DataFrame) -> DataFrame:
    """id, value: the JSON object of each row; zero and empty fields are left out, a missing time is the zero time."""
    rest = {"changeset": _changeset, "user": _user, "note": _note}.get(kind, lambda: _element(kind, df))()
    return df.select("id", _obj(("type", F.lit(f'"{kind}"')), ("id", F.col("id").cast("string")), *rest).alias("value"))


def document(tables: dict[str, DataFrame], version: str | None = None, generator: str | None = None) -> DataFrame:
    """One row with the whole document, for data that fits one: nodes, ways, relations, changesets, users, notes, each by id."""
    parts = None
    for k, (kind, df) in enumerate(sorted(tables.items(), key=lambda t: ORDER.index(t[0]))):
        x = elements(kind, df).select(F.lit(k).alias("k"), "id", "value")
        parts = x if parts is None else parts.unionByName(x)
    head = "".join(f'"{n}":"{v}",' for n, v in (("version", version), ("generator", generator)) if v)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id", "value"))), lambda x: x["value"]), ",")
    return parts.agg(F.concat(F.lit("{" + head + '"elements":['), body, F.lit("]}")).alias("value"))


def write_document(tables: dict[str, DataFrame], path: str, version: str | None = None, generator: str | None = None, mode: str = "errorifexists", compression: str = "none", parts: int | None = None) -> None:
    """The document that document() makes, in parts that are it one after another, but for line ends between elements."""
    from .sinks import write_parts

    x = None
    for k, (kind, df) in enumerate(sorted(tables.items(), key=lambda t: ORDER.index(t[0]))):
        y = elements(kind, df).select(F.lit(k).alias("k"), "id", "value")
        x = y if x is None else x.unionByName(y)
    head = "".join(f'"{n}":"{v}",' for n, v in (("version", version), ("generator", generator)) if v)
    order = ["k", "id", "value"]
    first = x.agg(F.min(F.struct(*order)).alias("x")).first().x
    spark, shape = x.sparkSession, "k int, id long, value string"
    ends = [(-1, None, "{" + head + '"elements":['), (len(ORDER), None, "]}")]
    if first is None:
        return write_parts(spark.createDataFrame(ends, shape), order, path, mode, compression, parts)
    # a comma stands before each element but one of the first; rows that equal it are told apart by their number
    same = (F.col("k") == first.k) & F.col("id").eqNullSafe(F.lit(first.id)) & (F.col("value") == first.value)
    many = x.where(same).count()
    rest = x.where(~same).select("k", "id", F.concat(F.lit(","), "value").alias("value"))
    again = spark.range(many - 1).select(F.lit(-1).alias("k"), F.lit(1).cast("long").alias("id"), F.lit("," + first.value).alias("value"))
    ends.append((-1, 0, first.value))
    write_parts(rest.unionByName(again).unionByName(spark.createDataFrame(ends, shape)), order, path, mode, compression, parts)
