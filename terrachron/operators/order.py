"""Relations so that children come before parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import written


def edges(relations: DataFrame) -> DataFrame:
    """Distinct parent, child pairs over all versions."""
    m = relations.select(F.col("id").alias("parent"), F.explode("members").alias("m")).where("m.type = 'relation'")
    return m.select("parent", F.col("m.ref").alias("child")).distinct()


def child_first(ids, relations: DataFrame) -> list[int]:
    """The ids asked for and all they contain, children first, by depth-first search; a relation met on its own path ends the
    walk there, and is given later if it is reached otherwise. What the ids reach, and no more, is gathered on the driver, level
    by level, as the order is one list: for levels over everything, see levels()."""
    spark, there, kids = relations.sparkSession, set(), {}
    seen_at = relations.select("id", "version", F.posexplode_outer("members").alias("i", "m"))
    seen_at = seen_at.select("id", "version", "i", F.when(F.col("m.type") == "relation", F.col("m.ref")).alias("ref"))
    ask = list(dict.fromkeys(ids))
    while ask:
        some = spark.createDataFrame([(i,) for i in ask], "id long")
        for r in seen_at.join(F.broadcast(some), "id", "left_semi").orderBy("id", "version", "i").toLocalIterator():
            there.add(r.id)
            if r.ref is not None and r.ref not in kids.setdefault(r.id, []):
                kids[r.id].append(r.ref)
        ask = list(dict.fromkeys(k for i in ask for k in kids.get(i, ()) if k not in there))
        ask = [k for k in ask if k not in kids]
    out, done = [], set()
    for top in ids:
        stack, path = [(top, iter(kids.get(top, ())))], {top}
        if top in done or top not in there:
            continue
        while stack:
            node, it = stack[-1]
            for k in it:
                if k in path:  # a cycle: this walk of node ends without giving it
                    stack.pop()
                    path.discard(node)
                    break
                if k not in done and k in there:
                    stack.append((k, iter(kids.get(k, ()))))
                    path.add(k)
                    break
            else:
                stack.pop()
                path.discard(node)
                if node not in done:
                    done.add(node)
                    out.append(node)
    return out


def child_first_rows(ids, relations: DataFrame) -> DataFrame:
    """rank (from 0), id: what child_first() lists, without gathering it. Where no relation contains itself, depth-first search comes to each by
    the first path of all, in the order of members from the ids asked for; paths grow by a level in a round, of which there are as many as levels, and are then ranked over ranges, a
    path behind those it begins. Where a relation that is reached contains itself, the order depends on the walk so far and is child_first()'s."""
    spark = relations.sparkSession
    there = relations.select("id").distinct()
    m = relations.select(F.col("id").alias("parent"), "version", F.posexplode("members").alias("i", "m")).where("m.type = 'relation'")
    step = F.struct(F.col("version").cast("long").alias("v"), F.col("i").cast("long").alias("i"))
    e = m.groupBy("parent", F.col("m.ref").alias("child")).agg(F.min(step).alias("step"))
    e = written(e.join(there.withColumnRenamed("id", "child"), "child", "left_semi"), "edges")
    asked = spark.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(ids))], "id long, i long")
    first = F.array(F.struct(F.lit(0).cast("long").alias("v"), "i")).alias("path")
    new = written(asked.join(there, "id", "left_semi").select("id", first, F.array("id").alias("via")), "paths")
    best = new
    while new.take(1):
        n = new.join(e, F.col("id") == F.col("parent")).select("child", F.concat("path", F.array("step")).alias("path"), "via")
        n = written(n, "steps")
        if n.where(F.array_contains("via", F.col("child"))).take(1):
            return spark.createDataFrame(list(enumerate(child_first(ids, relations))), "rank bigint, id bigint")
        n = n.groupBy(F.col("child").alias("id")).agg(F.min("path").alias("path"), F.min_by("via", "path").alias("via")).withColumn("via", F.concat("via", F.array("id")))
        old = best.select("id", F.col("path").alias("_old"))
        new = written(n.join(old, "id", "left").where("_old IS NULL OR path < _old").drop("_old"), "paths")
        best = written(best.join(new.select("id"), "id", "left_anti").unionByName(new), "best")
    last = F.lit(2**63 - 1).cast("long")
    d = best.select("id", F.concat("path", F.array(F.struct(last.alias("v"), last.alias("i")))).alias("path"))
    return ranked(d, "path").select((F.col("rank") - 1).cast("long").alias("rank"), "id")


def levels(relations: DataFrame) -> DataFrame:
    """id, level: 0 for relations without member relations that are there, else one more than the highest of them; null for those in
    a cycle and above it. Relations whose members are all done are done next; what is left is written after every round, of which
    there are as many as levels."""
    ids = relations.select("id").distinct()
    left = edges(relations).join(ids.withColumnRenamed("id", "child"), "child", "left_semi")
    left, open_, done, level = written(left, "edges"), written(ids, "open"), None, 0
    while True:
        leaves = open_.join(left.select(F.col("parent").alias("id")), "id", "left_anti")
        leaves = written(leaves.withColumn("level", F.lit(level)), "level")
        if not leaves.take(1):
            rest = open_.withColumn("level", F.lit(None).cast("int"))
            return rest if done is None else done.unionByName(rest)
        done = leaves if done is None else done.unionByName(leaves)
        open_ = written(open_.join(leaves.select("id"), "id", "left_anti"), "open")
        left = written(left.join(leaves.select(F.col("id").alias("child")), "child", "left_anti"), "edges")
        level += 1


def ranked(rows: DataFrame, *key: str) -> DataFrame:
    """rows with rank (from 1) in the order of key, over ranges of it, so that no task sees all rows."""
    d = written(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    size = d.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))  # a row for each task
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*key))
    return d.join(F.broadcast(size), "_range").withColumn("rank", F.col("_before") + own).drop("_range", "_before")
