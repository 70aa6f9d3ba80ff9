"""Change feeds mirrored to a folder: numbered files in groups of three digits, each with a state file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from . import xml


def seq_of_path(path):
    """Sequence number from the path of a feed's file."""
    m = lambda i: F.regexp_extract(path, r"([0-9]{3})/([0-9]{3})/([0-9]{3})\.[a-z.]+$", i)
    return F.concat(m(1), m(2), m(3)).try_cast("bigint")


def states(spark: SparkSession, folder: str, kind: str = "minute") -> DataFrame:
    """seq, timestamp, ... of every state file below the folder."""
    d = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.state.txt")
    d = d.withColumn("_p", F.input_file_name())
    s = times.changeset_state("value", seq_of_path("_p")) if kind == "changesets" else times.interval_state("value")
    return d.select(s.alias("s")).select("s.*")


def changes(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Changed elements by kind over all of a feed's change files; compressed ones by suffix."""
    return xml.read_change(spark, f"{folder.rstrip('/')}/*/*/*.osc*")


def changesets(spark: SparkSession, folder: str) -> DataFrame:
    """Changesets over all of a changeset feed's files, with the number of the file that each came from."""
    d = xml.read(spark, f"{folder.rstrip('/')}/*/*/*.osm*", "changeset")
    return d.withColumn("seq", seq_of_path(F.input_file_name()))
