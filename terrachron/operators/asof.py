"""As-of lookups as a merge: versions and questions of one key in a single stream sorted by time, with the state carried along.

`numbered()` gives every version its place in its key's history and, as running maxima over it, from when on it is known to a reader
who goes through the history in order and stops at the first version that lies ahead. These never fall, so that one pass in order of time
answers every question of the key: the last version reached. No history is ever held in a row.

Keys with more rows than a task should have are cut into stretches, by version or by time, and each stretch starts from the state
that the ones before it leave: a row for each stretch, at most some ten thousand of them. The keys that this concerns have over
`most` rows and over one row in 20,000, and are known before the pass; usually there are none, and nothing is added to the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST, STRETCHES = 200_000, 1_000
FIRST, LAST = -(1 << 62), 1 << 62


def crowded(rows: DataFrame, keys: list[str], by: str, most: int = MOST, counted: DataFrame | None = None) -> DataFrame | None:
    """keys and borders (ascending values of by) of the keys to cut; None if there are none. counted: rows that are as many or a fixed
    share of them, and cheaper to make."""
    per = (rows if counted is None else counted).groupBy(*keys).count()
    total = per.agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (total["most"] or 0) <= most:
        return None
    limit = max(most, total["all"] // 20_000)
    hot = F.broadcast(per.where(F.col("count") > limit).select(*keys))  # at most 20,000 rows
    parts = min(STRETCHES, max(2, -(-total["most"] // limit)))
    cuts = F.percentile_approx(by, [i / parts for i in range(1, parts)], 10 * STRETCHES)
    # rows of one key are summed up on the way to it
    found = rows.join(hot, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"), cuts.alias("_c"))
    # as many as the key needs, so that all keys together have some 40,000 at most
    step = F.greatest(F.lit(1), F.floor(parts * limit / F.col("_n")).cast("int"))
    found = found.select(*keys, F.array_distinct(F.filter("_c", lambda x, i: i % step == 0)).alias("_borders"))
    return rows.sparkSession.createDataFrame(found.collect(), found.schema)


def stretches(rows: DataFrame, keys: list[str], by: str, cuts: DataFrame | None) -> DataFrame:
    """rows with _b, the stretch of the key that they lie in; equal values of by lie in one."""
    if cuts is None:
        return rows
    number = F.size(F.filter("_borders", lambda x: x < F.col(by)))
    return rows.join(F.broadcast(cuts), keys, "left").withColumn("_b", F.coalesce(F.when(F.col("_borders").isNotNull(), number), F.lit(0))).drop("_borders")


def carried(rows: DataFrame, keys: list[str], cuts: DataFrame | None, total: dict[str, Column], fill: dict) -> DataFrame:
    """rows with what earlier stretches of their key leave: total says how a stretch sums up (all are maxima or sums of earlier
    ones), fill how a row takes the sum of the stretches before its own."""
    if cuts is None:
        return rows
    sums = rows.join(F.broadcast(cuts.select(*keys)), keys, "left_semi").groupBy(*keys, "_b").agg(*(c.alias(f"_t_{n}") for n, c in total.items()))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    left = sums.select(*keys, "_b", *((F.sum if n == "_count" else F.max)(f"_t_{n}").over(before).alias(f"_s_{n}") for n in total))
    out = rows.join(F.broadcast(left), [*keys, "_b"], "left")
    return out.select(*(fill[c](F.col(c), F.col(f"_s_{c if c in total else '_count'}")).alias(c) if c in fill else c for c in rows.columns))


def numbered(versions: DataFrame, keys: list[str], order: list[str], reach: dict[str, Column], most: int = MOST) -> DataFrame:
    """versions with n (place in the history, from 0) and, for each of reach, its running maximum in that order. The first of order is a
    number."""
    cuts = crowded(versions, keys, order[0], most)
    rows = stretches(versions, keys, order[0], cuts)
    w = Window.partitionBy(*keys, *(["_b"] if cuts is not None else [])).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("n"), *(F.max(c).over(so_far).alias(k) for k, c in reach.items()))
    total = {"_count": F.count("*")} | {k: F.max(k) for k in reach}
    fill = {"n": lambda own, s: own + F.coalesce(s, F.lit(0))} | {k: lambda own, s: F.greatest(own, s) for k in reach}
    return carried(rows, keys, cuts, total, fill).drop("_b")


def answered(versions: DataFrame, events: Column, questions: DataFrame, asked: Column, keys: list[str], own: list[str], most: int = MOST) -> DataFrame:
    """own columns of the questions, each as often as asked has structs (t, which, ...), with the state at t: of each further column of
    events, an array of structs (t, o, n, state...) of a version, the last value, not null, up to it. Events with o below 0 come
    before questions of the same time, others behind; n orders events of one o; those without t don't happen. A key's values of n must not
    fall with time for one column of state; columns of state that belong together are a struct. Without crowded keys, the result is dealt
    out by keys, and to there a version or a question goes as the one row that it is: it becomes several only where its key is."""
    of = lambda df, c: df.select(c.alias("e")).schema["e"].dataType.elementType
    kinds, more = ({f.name: f.dataType for f in of(df, c)} for df, c in ((versions, events), (questions, asked)))
    state, more = [c for c in kinds if c not in ("t", "o", "n")], {c: k for c, k in more.items() if c != "t"}
    null = lambda k: F.lit(None).cast(k)
    happens = F.transform(events, lambda e: F.struct(*(e[c].alias(c) for c in ("t", "o", "n", *state)), *(null(k).alias(c) for c, k in more.items())))
    asks = F.transform(asked, lambda e: F.struct(e["t"].alias("t"), F.lit(0).alias("o"), F.lit(0).cast("bigint").alias("n"), *(null(kinds[c]).alias(c) for c in state), *(e[c].alias(c) for c in more)))
    cuts = crowded(questions.select(*keys, F.inline(asked)).where("t IS NOT NULL").select(*keys, "t"), keys, "t", most, questions)
    rows = versions.withColumn("_asks", F.lit(False)).unionByName(questions.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    rows = rows.repartition(*keys) if cuts is None else rows
    rows = rows.select(*keys, *own, "_asks", F.when(F.col("_asks"), asks).otherwise(happens).alias("_each"))
    rows = rows.select(*keys, *own, "_asks", F.inline("_each")).where("t IS NOT NULL")
    rows = stretches(rows, keys, "t", cuts)
    part = [] if cuts is None else ["_b"]
    w = Window.partitionBy(*keys, *part).orderBy("t", "o", "n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "t", *part, "_asks", *own, *more, *(F.last(c, ignorenulls=True).over(w).alias(c) for c in state))
    # the last of a stretch is its greatest in order of (t, n), which structs that begin with n, and n itself, are
    rows = carried(rows, keys, cuts, {c: F.max(c) for c in state}, {c: lambda own, s: F.coalesce(own, s) for c in state})
    return rows.where("_asks").drop("_b", "_asks")
