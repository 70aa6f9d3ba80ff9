"""Writing map XML, change files and diffs. Each element becomes its XML in column expressions. write_document() and
write_change() write documents of any size, in parts: ranges of the elements in order, the head in the first and the foot in the last, so that
the parts one after another are the document. document() and change_document() make one string, for data that fits one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO_TIME = "0001-01-01T00:00:00Z"


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def number(c: Column) -> Column:
    """The shortest form, without a fraction of zero."""
    c = c.cast("double")
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.regexp_replace(F.call_function("format_number", c, F.lit("0.##################")), "^-0$", "0"))


def attr(name: str, value: Column, omit: bool = False) -> Column:
    text = F.concat(F.lit(f' {name}="'), escaped(value.cast("string")), F.lit('"'))
    return F.coalesce(text, F.lit("" if omit else f' {name}=""'))


def _time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def _meta() -> list[Column]:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return [
        attr("user", F.coalesce("user", F.lit(""))), attr("uid", zero("uid")), attr("visible", F.coalesce("visible", F.lit(False))), attr("version", zero("version")),
        attr("changeset", zero("changeset")), attr("timestamp", F.coalesce(_time(F.col("timestamp")), F.lit(ZERO_TIME))),
    ]


def _joined(items: Column) -> Column:
    return F.coalesce(F.array_join(items, ""), F.lit(""))


def _tags() -> Column:
    return _joined(F.transform("tags", lambda t: F.concat(F.lit("<tag"), attr("k", t["k"]), attr("v", t["v"]), F.lit("></tag>"))))


def _nd(n: Column) -> Column:
    extra = [attr(k, _nonzero(n[k]), True) for k in ("version", "changeset")] + [attr(k, number(_nonzero(n[k])), True) for k in ("lat", "lon")]
    return F.concat(F.lit("<nd"), attr("ref", _nonzero(n["ref"]), True), *extra, F.lit("></nd>"))


def _update(u: Column) -> Column:
    rest = [attr("changeset", _nonzero(u["changeset"]), True), *(attr(k, number(_nonzero(u[k])), True) for k in ("lat", "lon")), attr("reverse", F.when(u["reverse"], u["reverse"]), True)]
    return F.concat(F.lit("<update"), attr("index", u["index"]), attr("version", u["version"]), attr("timestamp", F.coalesce(_time(u["timestamp"]), F.lit(ZERO_TIME))), *rest, F.lit("></update>"))


def _member(m: Column) -> Column:
    extra = [attr(k, _nonzero(m[k]), True) for k in ("version", "changeset")] + [attr(k, number(_nonzero(m[k])), True) for k in ("lat", "lon")] + [attr("orientation", _nonzero(m["orientation"]), True)]
    inner = F.coalesce(F.array_join(F.transform(m["nodes"], _nd), ""), F.lit(""))
    return F.concat(F.lit("<member"), attr("type", m["type"]), attr("ref", m["ref"]), attr("role", F.coalesce(m["role"], F.lit(""))), *extra, F.lit(">"), inner, F.lit("</member>"))


def element_xml(kind: str, df: DataFrame) -> Column:
    """XML of a node, way or relation row."""
    zero = lambda c: number(F.coalesce(F.col(c), F.lit(0.0)))
    committed = attr("committed", _time(F.col("committed")), True) if "committed" in df.columns else F.lit("")
    updates = _joined(F.transform("updates", _update)) if "updates" in df.columns else F.lit("")
    if kind == "node":
        return F.concat(F.lit("<node"), attr("id", F.col("id")), attr("lat", zero("lat")), attr("lon", zero("lon")), *_meta(), committed, F.lit(">"), _tags(), F.lit("</node>"))
    inner = [_joined(F.transform("nodes", _nd)), _tags()] if kind == "way" else [_tags(), _joined(F.transform("members", _member))]
    return F.concat(F.lit(f"<{kind}"), attr("id", F.col("id")), *_meta(), committed, F.lit(">"), *inner, updates, F.lit(f"</{kind}>"))


def _child(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), escaped(F.coalesce(value.cast("string"), F.lit(""))), F.lit(f"</{name}>"))


def _count(name: str, *fields: Column) -> Column:
    return F.concat(F.lit(f"<{name}"), *fields, F.lit(f"></{name}>"))


def changeset_xml() -> Column:
    c = F.col
    zero = lambda n: number(F.coalesce(c(n), F.lit(0.0)))
    when = lambda n: F.coalesce(_time(c(n)), F.lit(ZERO_TIME))
    head = [attr("id", c("id")), attr("user", F.coalesce("user", F.lit(""))), attr("uid", F.coalesce("uid", F.lit(0))), attr("created_at", when("created_at")), attr("closed_at", when("closed_at")), attr("open", F.coalesce("open", F.lit(False)))]
    box = [attr(n, zero(n)) for n in ("min_lat", "max_lat", "min_lon", "max_lon")]
    return F.concat(F.lit("<changeset"), *head, attr("num_changes", _nonzero(c("num_changes")), True), *box, attr("comments_count", _nonzero(c("comments_count")), True), F.lit(">"), _tags(), discussion_xml(c("discussion")), F.lit("</changeset>"))


def note_xml() -> Column:
    c = F.col
    date = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss 'UTC'")

    def said(x):
        return F.concat(F.lit("<comment>"), _child("date", date(x["date"])), *(_child(k, x[k]) for k in ("uid", "user", "user_url", "action", "text", "html")), F.lit("</comment>"))

    inner = [_child("id", c("id")), *(_child(k, c(k)) for k in ("url", "comment_url", "close_url", "reopen_url")), *(_child(k, date(c(k))) for k in ("date_created", "date_closed")), _child("status", c("status"))]
    talk = F.when(F.size("comments") > 0, F.concat(F.lit("<comments>"), _joined(F.transform("comments", said)), F.lit("</comments>"))).otherwise("")
    return F.concat(F.lit("<note"), attr("lat", number(F.coalesce("lat", F.lit(0.0)))), attr("lon", number(F.coalesce("lon", F.lit(0.0)))), F.lit(">"), *inner, talk, F.lit("</note>"))


def user_xml() -> Column:
    c = F.col
    n = lambda name, x, *keys: _count(name, *(attr(k, F.coalesce(number(x[k].cast("double")), F.lit("0"))) for k in keys))
    langs = F.when(F.size("languages") > 0, F.concat(F.lit("<languages>"), _joined(F.transform("languages", lambda x: _child("lang", x))), F.lit("</languages>"))).otherwise("")
    inner = [
        _child("description", c("description")), _count("img", attr("href", F.coalesce(c("img")["href"], F.lit("")))), n("changesets", c("changesets"), "count"), n("traces", c("traces"), "count"), n("home", c("home"), "lat", "lon", "zoom"), langs,
        F.lit("<blocks>"), n("received", c("blocks")["received"], "count", "active"), F.lit("</blocks><messages>"), n("received", c("messages")["received"], "count", "unread"), n("sent", c("messages")["sent"], "count"), F.lit("</messages>"),
    ]
    return F.concat(F.lit("<user"), attr("id", c("id")), attr("display_name", F.coalesce("name", F.lit(""))), attr("account_created", F.coalesce(_time(c("created_at")), F.lit(ZERO_TIME))), F.lit(">"), *inner, F.lit("</user>"))


def bounds_xml(b: Column) -> Column:
    return F.concat(F.lit("<bounds"), *(attr(k, number(b[k])) for k in ("minlat", "maxlat", "minlon", "maxlon")), F.lit("></bounds>"))


#: Kinds in the order of a document's body.
ORDER = ("node", "way", "relation", "changeset", "note", "user")


def lines(tables: dict[str, DataFrame], wrap: str | None = None) -> DataFrame:
    """kind_rank, id, version, value for every element; with an action column also action_rank, in order create, modify, delete."""
    out = None
    own = {"changeset": changeset_xml, "note": note_xml, "user": user_xml}
    for k, (kind, df) in enumerate(sorted(tables.items(), key=lambda t: ORDER.index(t[0]))):
        rank = F.lit(0)
        if "action" in df.columns:
            rank = F.when(F.col("action") == "create", 0).when(F.col("action") == "modify", 1).otherwise(2)
        x = df.select(rank.alias("action_rank"), F.lit(k).alias("kind_rank"), "id", F.col("version") if "version" in df.columns else F.lit(0).alias("version"), (own[kind]() if kind in own else element_xml(kind, df)).alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


def _head(root: str, attrs: dict) -> str:
    return f"<{root}" + "".join(f' {k}="{v}"' for k, v in attrs.items() if v) + ">"


def document(tables: dict[str, DataFrame], bounds: dict | None = None, **attrs) -> DataFrame:
    """One row with the whole document."""
    x = lines(tables).agg(F.array_sort(F.collect_list(F.struct("kind_rank", "id", "version", "value"))).alias("x"))
    box = bounds_xml(F.struct(*(F.lit(float(v)).alias(k) for k, v in bounds.items()))) if bounds else F.lit("")
    return x.select(F.concat(F.lit(_head("osm", attrs)), box, _joined(F.transform("x", lambda e: e["value"])), F.lit("</osm>")).alias("value"))


def change_document(tables: dict[str, DataFrame], **attrs) -> DataFrame:
    """One row with a change document; tables have an action column. Absent actions give no block."""
    x = lines(tables).agg(F.array_sort(F.collect_list(F.struct("action_rank", "kind_rank", "id", "version", "value"))).alias("x"))

    def block(k, name):
        own = F.filter("x", lambda e: e["action_rank"] == k)
        return F.when(F.size(own) > 0, F.concat(F.lit(f"<{name}>"), F.array_join(F.transform(own, lambda e: e["value"]), ""), F.lit(f"</{name}>"))).otherwise("")

    body = [block(k, name) for k, name in enumerate(("create", "modify", "delete"))]
    return x.select(F.concat(F.lit(_head("osmChange", attrs)), *body, F.lit("</osmChange>")).alias("value"))


def write_parts(pieces: DataFrame, order: list[str], path: str, mode: str = "errorifexists", compression: str = "none", parts: int | None = None) -> None:
    """The column value of pieces, in order and a line each, as text files that make one document when they are read by name. No row but a
    piece of its own is ever held, and Spark's writer puts all parts in place or none."""
    dealt = pieces.repartitionByRange(parts, *order) if parts else pieces.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("value").write.mode(mode).option("compression", compression).text(path)


#: Ranks before and behind those of all elements.
_BEFORE, _BEHIND = -1, 1_000


def _piece(spark, ranks: list[tuple[int, int]], texts: list[str]) -> DataFrame:
    rows = [(a, k, None, None, t) for (a, k), t in zip(ranks, texts)]
    return spark.createDataFrame(rows, "action_rank int, kind_rank int, id long, version int, value string")


def write_document(tables: dict[str, DataFrame], path: str, bounds: dict | None = None, mode: str = "errorifexists", compression: str = "none", parts: int | None = None, **attrs) -> None:
    """The document that document() makes, in parts and a line for each element."""
    x = lines(tables)
    spark = x.sparkSession
    head = _head("osm", attrs)
    if bounds:
        box = F.struct(*(F.lit(float(bounds[k])).alias(k) for k in ("minlat", "maxlat", "minlon", "maxlon")))
        head += spark.range(1).select(bounds_xml(box)).first()[0]
    x = x.withColumn("action_rank", F.lit(0))
    x = x.unionByName(_piece(spark, [(_BEFORE, 0), (_BEHIND, 0)], [head, "</osm>"]))
    write_parts(x, ["action_rank", "kind_rank", "id", "version", "value"], path, mode, compression, parts)


def write_change(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists", compression: str = "none", parts: int | None = None, **attrs) -> None:
    """The change document that change_document() makes, in parts and a line for each element."""
    x = lines(tables)
    there = sorted(r.action_rank for r in x.select("action_rank").distinct().collect())  # three at most
    names = ("create", "modify", "delete")
    ranks = [(_BEFORE, 0), *((k, side) for k in there for side in (_BEFORE, _BEHIND)), (_BEHIND, 0)]
    texts = [_head("osmChange", attrs), *(t for k in there for t in (f"<{names[k]}>", f"</{names[k]}>")), "</osmChange>"]
    x = x.unionByName(_piece(x.sparkSession, ranks, texts))
    write_parts(x, ["action_rank", "kind_rank", "id", "version", "value"], path, mode, compression, parts)


def diff_lines(diff: DataFrame, old_xml: str = "old_xml", new_xml: str = "new_xml") -> DataFrame:
    """value: an action element per row; without an old state the new one stands bare."""
    old, new = F.col(old_xml), F.col(new_xml)
    body = F.when(old.isNull(), new).otherwise(F.concat(F.lit("<old>"), old, F.lit("</old><new>"), F.coalesce(new, F.lit("")), F.lit("</new>")))
    return diff.select("*", F.concat(F.lit("<action"), attr("type", F.col("action")), F.lit(">"), body, F.lit("</action>")).alias("value"))


def discussion_xml(comments: Column) -> Column:
    """A changeset's discussion; nothing without comments."""
    one = lambda c: F.concat(F.lit("<comment"), attr("user", c["user"]), attr("uid", c["uid"]), attr("date", _time(c["date"])), F.lit("><text>"), escaped(F.coalesce(c["text"], F.lit(""))), F.lit("</text></comment>"))
    return F.when(F.size(comments) > 0, F.concat(F.lit("<discussion>"), F.array_join(F.transform(comments, one), ""), F.lit("</discussion>"))).otherwise("")
