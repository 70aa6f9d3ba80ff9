"""Temporal joins over version histories.

A history is read in order of versions, up to the first one that lies ahead of the parent: child versions with known commit times count
by the last one committed, the others by nearness to the parent's time within a threshold. Which versions were reached, which of them
lie before the threshold's range, and which came into effect before the next parent are as-of lookups, answered by one merge
of all versions and parents in order of time (`asof`); only where versions without commit times lie in a parent's range are these few
looked at together. The versions between two parents are found by their number, in blocks of `BLOCK`. Everything is built-in expressions, and no row
holds a history. Parents are worked out once and written; a child of a parent goes to its history as one short row, and back with what
the parent keeps of the version. Updates can be had as rows (`way_updates`), which need not come together by parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import effective_us
from ..schema import COMMIT_TIMES_FROM_US as FROM
from ..schema import UPDATES
from ..tables import written
from . import asof

THRESHOLD_US = 30 * 60 * 1_000_000
BLOCK = 16  # versions of a child that are looked up together
_C = ("version", "changeset", "lat", "lon")  # what a parent keeps of the version seen


def versions(children: DataFrame, key=("id",), reverse: Column | None = None) -> DataFrame:
    """key..., v: a struct for each version of a child."""
    item = F.struct(
        F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("changeset", F.lit(0)).cast("bigint").alias("changeset"), F.coalesce("visible", F.lit(False)).alias("visible"),
        F.unix_micros("timestamp").alias("ts"), F.unix_micros("committed").alias("cm"), _or_null(children, "lat").alias("lat"), _or_null(children, "lon").alias("lon"),
        (F.lit(False) if reverse is None else F.coalesce(reverse, F.lit(False))).alias("reverse"),
    )
    return children.select(*key, item.alias("v"))


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def find_visible(hist: str, changeset: str, at: str, eps: int) -> Column:
    """Index in hist of the version seen at `at` (SQL expressions); -1: none visible.

    The fold stops at the first version that is out of reach, in version order, as later ones may carry earlier times."""
    early = f"(c.cm IS NULL OR c.cm < {FROM}L)"
    off = f"(c.ts - {at})"
    keep = "s.d AS d, false AS stop, s.i + 1 AS i"
    return F.expr(f"""
      aggregate({hist}, named_struct('n', -1, 'd', -1L, 'stop', false, 'i', 0), (s, c) ->
        CASE WHEN s.stop THEN s
        WHEN {early} THEN
          CASE WHEN {off} > {eps}L THEN named_struct('n', s.n, 'd', s.d, 'stop', true, 'i', s.i + 1)
          WHEN {off} < -{eps}L THEN named_struct('n', IF(c.visible, s.i, -1), 'd', s.d, 'stop', false, 'i', s.i + 1)
          WHEN s.d >= 0 AND abs({off}) > s.d THEN named_struct('n', s.n, 'd', s.d, 'stop', false, 'i', s.i + 1)
          WHEN c.visible AND ({off} <= 0 OR c.changeset = {changeset}) THEN named_struct('n', s.i, 'd', abs({off}), 'stop', false, 'i', s.i + 1)
          WHEN c.visible THEN named_struct('n', s.n, 'd', s.d, 'stop', false, 'i', s.i + 1)
          ELSE named_struct('n', IF(s.d = -1 AND {off} = -{eps}L, -1, s.n), 'd', abs({off}), 'stop', false, 'i', s.i + 1) END
        WHEN c.cm > {at} THEN named_struct('n', s.n, 'd', s.d, 'stop', true, 'i', s.i + 1)
        ELSE named_struct('n', IF(c.visible, s.i, -1), 'd', s.d, 'stop', false, 'i', s.i + 1) END,
        s -> s.n)""")


def version_before(hist: str, end: str) -> Column:
    """Index of the last version, of those before the first that isn't, that took effect before `end`; -1: none."""
    eff = f"IF(c.cm >= {FROM}L, c.cm, c.ts)"
    return F.expr(f"""
      aggregate({hist}, named_struct('n', -1, 'stop', false, 'i', 0), (s, c) ->
        CASE WHEN s.stop OR NOT {eff} < {end} THEN named_struct('n', s.n, 'stop', true, 'i', s.i + 1)
        ELSE named_struct('n', s.i, 'stop', false, 'i', s.i + 1) END, s -> s.n)""")


def _raised(bad: Column, text: Column) -> Column:
    """A condition that is true, or an error where bad is."""
    return F.when(bad, F.raise_error(text).cast("boolean")).otherwise(True)


def _effective(v: Column) -> Column:
    return F.when(v["cm"] >= FROM, v["cm"]).otherwise(v["ts"])


def _history(child_versions: DataFrame, keys: list[str], threshold_us: int, most: int) -> DataFrame:
    """keys, n, v and from when on a version is reached, past the range, and in effect."""
    early = F.col("v.cm").isNull() | (F.col("v.cm") < FROM)
    reach = {
        "reached": F.when(early, F.col("v.ts") - threshold_us).otherwise(F.col("v.cm")),
        "past": F.when(early, F.col("v.ts") + threshold_us),
        "effect": _effective(F.col("v")),
    }
    h = child_versions.where(F.col(keys[-1]).isNotNull()).select(*keys, F.col("v.version").alias("_o"), "v")
    return written(asof.numbered(h, keys, ["_o", "v"], reach, most).drop("_o"), "history")


def _kept(v: Column) -> Column:
    types = {"version": "int", "changeset": "bigint", "lat": "double", "lon": "double"}
    return F.struct(*(v[x].cast(types[x]).alias(x) for x in _C))


def _events(keep: bool) -> Column:
    """What happens in the order of time: versions are reached (at their time, so before questions), get past the range or come
    into effect (behind questions). Each key begins with a sign that it has a history. keep: with what parents keep of a version."""
    v, n, no = F.col("v"), F.col("n"), F.lit(None).cast("bigint")
    seen = F.struct(n.alias("n"), v["visible"].alias("visible"), _effective(v).alias("e"), *([_kept(v).alias("c")] if keep else []))
    nothing = F.when(F.lit(False), seen)
    one = lambda t, o, seen=nothing, past=no, effect=no, there=no: F.struct(t.alias("t"), F.lit(o).alias("o"), n.alias("n"), seen.alias("seen"), past.alias("past"), effect.alias("effect"), there.alias("there"))
    return F.array(
        one(F.col("reached"), -1, seen=seen), one(F.coalesce("past", F.lit(asof.FIRST)), 1, past=n), one(F.col("effect"), 1, effect=n),
        one(F.when(n == 0, asof.FIRST - 1), -1, there=n),
    )


def _near(d: DataFrame, h: DataFrame, keys: list[str], threshold_us: int) -> DataFrame:
    """id, seq, idx, which, seen: the version that each parent saw (n null: none), where versions in its range have to be looked at
    together, from the last one before the range to the last one reached."""
    ask = F.array(*(F.struct(F.lit(i).alias("which"), *(F.col(f"_{c}{i}").alias(name) for c, name in (("past", "past"), ("last", "last"), ("t", "at"), ("cs", "cs")))) for i in (0, 1)))
    q = d.select("id", "seq", "idx", *keys, F.explode(ask).alias("q")).select("id", "seq", "idx", *keys, "q.*").where(F.col("last") > F.coalesce("past", F.lit(-1)))
    q = q.withColumn("n", F.explode(F.sequence(F.greatest(F.coalesce("past", F.lit(0)), F.lit(0)), "last")))
    q = q.join(h.select(*keys, "n", "v"), [*keys, "n"]).groupBy("id", "seq", "idx", "which", "at", "cs").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("few"))
    q = q.withColumn("hist", F.transform("few", lambda x: x["v"])).withColumn("i", find_visible("hist", "cs", "at", threshold_us))
    return q.select("id", "seq", "idx", "which", F.when(F.col("i") >= 0, F.get("few", F.col("i"))).alias("found"))


def _seen(parents: DataFrame, refs: str, child_versions: DataFrame, child_key=("ref",), threshold_us: int = THRESHOLD_US, ignore_inconsistency=False, ignore_missing=False, child_filter: Column | None = None, most: int = asof.MOST, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(id, seq, idx, c: what is kept of the version seen, or null), and id, seq, update: the versions between it and what the next
    parent version saw.

    parents: as of _parents(), with the array refs of structs. The
    next parent counts even if it is invisible or no longer has the child. child_versions: the child's key and v, as of
    versions(). child_filter: condition on the child's columns; what it refuses is left as it is, unless it has no version yet.
    most: rows of one child from which on it is cut into stretches. keep: False leaves out c."""
    keys = [f"_k{i}" for i in range(len(child_key))]
    r = parents.where("visible").select("id", "seq", "_at", "_cs", "_next", F.posexplode(refs).alias("idx", "_r")).select("id", "seq", "_at", "_cs", "_next", "idx", "_r.*")
    if child_filter is not None:
        r = r.where(child_filter | (F.coalesce("version", F.lit(0)) == 0))
    r = r.select("id", "seq", "idx", *(F.col(c).alias(k) for c, k in zip(child_key, keys)), "_at", "_cs", F.col("_next.at").alias("_nat"), F.col("_next.soon").alias("_soon"), F.col("_next.cs").alias("_ncs"))
    h = _history(child_versions.select(*(F.col(c).alias(k) for c, k in zip(child_versions.columns, keys)), "v"), keys, threshold_us, most)
    cs = lambda c: (F.lit(None) if c is None else F.col(c)).cast("bigint").alias("cs")
    when = F.array(*(F.struct(F.lit(i).alias("which"), t.alias("t"), cs(c)) for i, (t, c) in enumerate(((F.col("_at"), "_cs"), (F.col("_nat"), "_ncs"), (F.coalesce("_soon", F.lit(asof.LAST)), None)))))
    got = asof.answered(h, _events(keep), r, when, keys, ["id", "seq", "idx"], most)
    # the answers to one row come together where its child is; the table is read more than once
    of = lambda c, i, name: F.max(F.when(F.col("which") == i, F.col(c))).alias(name)
    d = got.select("*", "seen.n", "seen.visible", "seen.e", *([F.col("seen.c")[x].alias(f"_c_{x}") for x in _C] if keep else [])).groupBy(*keys, "id", "seq", "idx").agg(
        *(of(c, i, f"_{name}{i}") for i in (0, 1) for c, name in (("n", "last"), ("visible", "visible"), ("e", "e"), ("past", "past"), ("cs", "cs"), ("t", "t"))),
        *([of(f"_c_{x}", 0, f"_c_{x}") for x in _C] if keep else []), of("effect", 0, "_effect0"), of("effect", 2, "_effect2"), of("t", 2, "_soon"), F.max("there").alias("_there"),
    )
    d = written(d.withColumn("_soon", F.nullif("_soon", F.lit(asof.LAST))), "seen")
    child = F.col(keys[-1]).cast("string")
    d = d.where("_there IS NOT NULL") if ignore_missing else d.where(_raised(F.col("_there").isNull(), F.concat(F.lit("no history of child "), child)))
    kept = lambda c: [c.alias("c")] if keep else []
    c = F.struct(F.col("_last0").alias("n"), F.col("_e0").alias("e"), *kept(F.struct(*(F.col(f"_c_{x}").alias(x) for x in _C)) if keep else None))
    n = F.struct(F.col("_last1").alias("n"), F.col("_e1").alias("e"))
    fields = ["id", "seq", "idx", *keys, "_effect0", "_effect2", "_soon"]
    last = lambda df: df.withColumn("_c", F.when(F.col("_visible0"), c)).withColumn("_n", F.when(F.col("_visible1"), n))  # the last version reached, if visible
    in_range = F.coalesce(F.expr("_last0 > coalesce(_past0, -1) OR _last1 > coalesce(_past1, -1)"), F.lit(False))
    few, d = d.where(in_range), last(d.where(~in_range)).select(*fields, "_c", "_n")
    if few.limit(1).count():  # unless versions in the range say otherwise
        near = _near(few, h, keys, threshold_us).groupBy("id", "seq", "idx").agg(*(F.max(F.when(F.col("which") == i, F.struct(F.lit(True).alias("is"), "found"))).alias(f"_near{i}") for i in (0, 1)))
        few = last(few).join(near, ["id", "seq", "idx"], "left")
        for i, name in enumerate(("_c", "_n")):
            f = F.col(f"_near{i}.found")
            found = F.struct(f["n"].alias("n"), _effective(f["v"]).alias("e"), *(kept(_kept(f["v"])) if i == 0 else []))
            few = few.withColumn(name, F.when(F.col(f"_near{i}.is"), F.when(f.isNotNull(), found)).otherwise(F.col(name)))
        d = d.unionByName(few.select(*d.columns))
    c, n = F.col("_c"), F.col("_n")
    seen_next = F.when(n["e"] < F.col("_soon"), n["n"] + 1).otherwise(n["n"])
    behind = lambda x: F.coalesce(x + 1, F.lit(0))
    none_next = F.when(c.isNotNull() & (F.col("_soon") <= c["e"]), 0).otherwise(behind(F.col("_effect2")))
    end = F.when(F.col("_soon").isNull(), behind(F.col("_effect2"))).when(n.isNotNull(), seen_next).otherwise(none_next)
    start = F.when(c.isNotNull(), c["n"] + 1).otherwise(behind(F.col("_effect0")))
    text = F.concat(F.lit("no visible version of child "), child)
    if not ignore_inconsistency:
        d = d.where(_raised(c.isNull(), text))
    block = lambda x: F.floor(x / BLOCK)
    u = d.select("id", "seq", "idx", *keys, start.alias("_start"), end.alias("_end")).where("_end > _start")
    u = u.withColumn("_block", F.explode(F.sequence(block(F.col("_start")), block(F.col("_end") - 1))))
    u = u.join(h.select(*keys, block(F.col("n")).alias("_block"), "n", "v"), [*keys, "_block"]).where("n >= _start AND n < _end")
    u = u.where("v.visible") if ignore_inconsistency else u.where(_raised(~F.col("v.visible"), text))
    v = F.col("v")
    time = F.timestamp_micros(F.when((v["ts"] < FROM) | v["cm"].isNull(), v["ts"]).otherwise(v["cm"]))
    update = F.struct(F.col("idx").alias("index"), v["version"].alias("version"), time.alias("timestamp"), v["changeset"].alias("changeset"), v["lat"].alias("lat"), v["lon"].alias("lon"), v["reverse"].alias("reverse"))
    return d.select("id", "seq", "idx", *kept(F.col("_c.c"))), u.select("id", "seq", update.alias("update"))


def seen_versions(parents: DataFrame, refs: str, child_versions: DataFrame, child_key=("ref",), **options) -> DataFrame:
    """One row per parent version (id, seq): c, a map from child place to what is kept of the version seen (or null), and updates.
    Everything else as of _seen()."""
    d, u = _seen(parents, refs, child_versions, child_key, **options)
    u = u.groupBy("id", "seq").agg(F.collect_list("update").alias("updates"))
    d = d.repartition("id", "seq").groupBy("id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("idx", "c"))).alias("c"))
    return d.join(u, ["id", "seq"], "left").withColumn("updates", F.coalesce("updates", F.array().cast(UPDATES)))


def sorted_updates(updates):
    """By index, then time."""
    key = lambda u: F.struct(u["index"].alias("i"), u["timestamp"].alias("t"), u["version"].alias("v"), u.alias("u"))
    return F.transform(F.array_sort(F.transform(updates, key)), lambda x: x["u"])


_NEXT = ("_at", "_cs", "_next")


def _parents(p: DataFrame, threshold_us: int = THRESHOLD_US, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Parents with seq (order of versions), their time and changeset and the next one's, written as they are read more than once; only
    the fields, if given."""
    if "seq" not in p.columns:
        p = p.withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy("version", "timestamp")))
    p = p.withColumn("_at", effective_us("committed", "timestamp")).withColumn("_cs", F.coalesce("changeset", F.lit(0)).cast("bigint"))
    following = F.struct(F.col("_at").alias("at"), effective_us("committed", "timestamp", -threshold_us).alias("soon"), F.col("_cs").alias("cs"))
    p = p.withColumn("_next", F.lead(following).over(Window.partitionBy("id").orderBy("seq")))
    return written(p if fields is None else p.select(*fields, *_NEXT), "parents")


def annotate_ways(ways: DataFrame, nodes: DataFrame, **options) -> DataFrame:
    """Ways whose nodes carry the version, changeset and place that each version saw, and updates until the next version."""
    ways = _parents(ways, options.get("threshold_us", THRESHOLD_US))
    got = seen_versions(ways, "nodes", versions(nodes), ("ref",), **options).withColumnsRenamed({"c": "_c", "updates": "_u"})

    def one(n, i):
        c = F.try_element_at(F.col("_c"), i)
        new = F.struct(n["ref"].alias("ref"), c["version"].alias("version"), c["changeset"].alias("changeset"), c["lat"].alias("lat"), c["lon"].alias("lon"))
        return F.when(c.isNotNull(), new).otherwise(n)

    d = ways.drop(*_NEXT).join(got, ["id", "seq"], "left")
    nodes_ = F.when(F.col("_c").isNull(), F.col("nodes")).otherwise(F.transform("nodes", one))
    return d.withColumn("nodes", nodes_).withColumn("updates", F.when(F.col("_u").isNull(), F.col("updates") if "updates" in ways.columns else F.lit(None)).otherwise(sorted_updates(F.col("_u")))).drop("_c", "_u")


def way_updates(ways: DataFrame, nodes: DataFrame, **options) -> DataFrame:
    """id, seq and the columns of an update: those of annotate_ways() as rows, in no order."""
    ways = _parents(ways, options.get("threshold_us", THRESHOLD_US), ("id", "seq", "visible", "nodes"))
    return _seen(ways, "nodes", versions(nodes), ("ref",), keep=False, **options)[1].select("id", "seq", "update.*")


def relation_versions(nodes=None, ways=None, relations=None) -> DataFrame:
    """type, ref, v of all versions that relations can have; a way version is reversed if it turned round since the one before."""
    from ..functions.geo import is_reverse, line

    out = None
    for kind, t in (("node", nodes), ("way", ways), ("relation", relations)):
        if t is None:
            continue
        rev = None
        if kind == "way":
            w = Window.partitionBy("id").orderBy("version")
            refs = F.transform("nodes", lambda n: n["ref"])
            t = t.withColumn("_refs", refs).withColumn("_line", line("nodes"))
            t = t.withColumn("_rev", is_reverse(F.lag("_refs").over(w), F.col("_refs"), F.lag("_line").over(w), F.col("_line")))
            rev = F.col("_rev")
        h = versions(t, ("id",), rev).select(F.lit(kind).alias("type"), F.col("id").alias("ref"), "v")
        out = h if out is None else out.unionByName(h)
    return out


def annotate_relations(relations: DataFrame, nodes=None, ways=None, members_of=None, **options) -> DataFrame:
    """Relations whose members carry what each version saw, and updates; areas' way members also their orientation."""
    from .rings import member_orientations

    relations = _parents(relations, options.get("threshold_us", THRESHOLD_US))
    got = seen_versions(relations, "members", relation_versions(nodes, ways, members_of), ("type", "ref"), **options).withColumnsRenamed({"c": "_c", "updates": "_u"})

    def one(m, i):
        c = F.try_element_at(F.col("_c"), i)
        new = m.withField("version", c["version"]).withField("changeset", c["changeset"]).withField("lat", c["lat"]).withField("lon", c["lon"])
        return F.when(c.isNotNull(), new).otherwise(m)

    d = relations.drop(*_NEXT).join(got, ["id", "seq"], "left")
    d = d.withColumn("members", F.when(F.col("_c").isNull(), F.col("members")).otherwise(F.transform("members", one)))
    d = d.withColumn("updates", F.when(F.col("_u").isNull(), F.lit(None)).otherwise(sorted_updates(F.col("_u")))).drop("_c", "_u")
    return member_orientations(d, ways) if ways is not None else d


def latest(history: DataFrame, at=None) -> DataFrame:
    """The latest version of each element, or that as of a time; deleted ones are left out."""
    h = history if at is None else history.where(F.coalesce("committed", "timestamp") <= F.lit(at).cast("timestamp"))
    best = h.groupBy("id").agg(F.max_by(F.struct(*h.columns), F.struct("version", "timestamp")).alias("_r"))
    return best.select("_r.*").where(F.coalesce("visible", F.lit(True)))


def sequence_at(states: DataFrame, t) -> DataFrame:
    """The first state at or after t; the newest if none is."""
    t = F.lit(t).cast("timestamp")
    return states.agg(F.coalesce(F.min_by("seq", F.when(F.col("timestamp") >= t, F.struct("timestamp", "seq"))), F.max("seq")).alias("seq"))
