"""Change files against history: what each changed element was before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def change_to_diff(change: DataFrame, history: DataFrame, ignore_missing: bool = False) -> DataFrame:
    """action, type, id, old, new for each changed element.

    change: action (create, modify, delete), type, id, version, element. history: type, id, version, element; it may
    hold the change itself. The old state is the greatest version below the changed one. Without one a modify or delete is an
    error, or with ignore_missing counts as create. visible: what the new state is."""
    h = history.select("type", "id", "version", F.col("element").alias("_e"), F.lit(False).alias("_new"))
    both = change.withColumn("_new", F.lit(True)).unionByName(h, allowMissingColumns=True)
    below = Window.partitionBy("type", "id").orderBy("version").rangeBetween(Window.unboundedPreceding, -1)
    old = F.when(F.col("action") != "create", F.last("_e", ignorenulls=True).over(below))
    d = both.withColumn("old", old).where("_new")
    missing = (F.col("action") != "create") & F.col("old").isNull()
    if not ignore_missing:
        said = F.concat(F.lit("no previous version of "), F.col("type"), F.lit("/"), F.col("id").cast("string"))
        d = d.where(F.when(missing, F.raise_error(said).cast("boolean")).otherwise(True))
    action = F.when(missing, "create").otherwise(F.col("action"))
    return d.select(action.alias("action"), "type", "id", "version", (action != "delete").alias("visible"), "old", F.col("element").alias("new"))


def change_history(change: DataFrame) -> DataFrame:
    """Elements of a change in order create, modify, delete, with visible as the action says."""
    rank = F.when(F.col("action") == "create", 0).when(F.col("action") == "modify", 1).otherwise(2)
    return change.withColumn("visible", F.col("action") != "delete").withColumn("action_rank", rank)
