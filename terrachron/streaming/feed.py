"""Change feeds as streams: new files of a mirrored folder, their edits counted in windows, and the latest state kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE = "seq bigint, action string, type string, id bigint, version int, timestamp timestamp, changeset bigint, user string, lat double, lon double"


def edits(spark: SparkSession, folder: str, schema: str = CHANGE, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """Stream of change rows from files that appear in a folder."""
    r = spark.readStream.schema(schema).format(fmt)
    return (r.option("maxFilesPerTrigger", files) if files else r).load(folder)


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each element version once, within the time that rows may be late."""
    return stream.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["type", "id", "version"])


def counts(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Edits by window, action and type."""
    w = stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "action", "type").count()
    return w.select(F.col("window.start").alias("start"), "action", "type", F.col("count").alias("edits"))


def keep_latest(stream: DataFrame, folder: str, checkpoint: str):
    """Query that keeps, as Parquet under folder, the latest version of each element; deleted ones stay, marked by action.

    Each batch is merged into a new table beside the last one, so that a batch that is done again gives the same."""

    def merge(batch: DataFrame, number: int):
        spark = batch.sparkSession
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = f"{folder}/batch={number - 1}"
        rows = batch
        if number and there.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)):
            rows = batch.unionByName(spark.read.parquet(old))
        best = rows.groupBy("type", "id").agg(F.max_by(F.struct(*rows.columns), F.struct("version", "timestamp")).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Latest:
    """The latest version of each element as Parquet in buckets of (type, id), of which a batch writes only those that it has rows of.

    A batch n lies in batch=n/bucket=b, beside what it replaces; batch=n/_DONE says that it is whole. What counts of a bucket is its newest whole
    batch. Batch n starts from batches before n alone, so that one that is done again gives the same, after any loss. Of each bucket
    written, the version before stays, and older ones are deleted. Elements that were deleted stay, marked by their action, or, with
    `forget` (an interval such as "7 days"), until a batch that writes their bucket has changes so much later; what comes for them after
    that counts as new."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, keys: tuple[str, ...] = ("type", "id"), order: tuple[str, ...] = ("version", "timestamp"), forget: str | None = None, by: tuple[str, ...] | None = None):
        """by: of the keys those that decide the bucket."""
        self.spark, self.folder, self.buckets, self.keys, self.order, self.forget = spark, folder.rstrip("/"), buckets, list(keys), order, forget
        self.by = list(by or keys)

    def bucket(self, *values):
        """The bucket of a row, or of given values of by."""
        return F.pmod(F.xxhash64(*(values or self.by)), F.lit(self.buckets)).cast("int")

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, name: str, prefix: str) -> list[int]:
        fs, p = self._path(name)
        found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x[len(prefix) :]) for x in found if x.startswith(prefix))

    def versions(self, before: int | None = None) -> dict[int, list[int]]:
        """Whole batches of each bucket, ascending; of those before a number."""
        out: dict[int, list[int]] = {}
        for n in self._names(self.folder, "batch="):
            fs, done = self._path(f"{self.folder}/batch={n}/_DONE")
            if (before is None or n < before) and fs.exists(done):
                for b in self._names(f"{self.folder}/batch={n}", "bucket="):
                    out.setdefault(b, []).append(n)
        return out

    def _read(self, newest: dict[int, int], schema) -> DataFrame:
        paths = [f"{self.folder}/batch={n}/bucket={b}" for b, n in sorted(newest.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema=CHANGE, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """What counts, before a batch, of some buckets or of all."""
        return self._read({b: ns[-1] for b, ns in self.versions(before).items() if only is None or b in only}, schema)

    def merge(self, batch: DataFrame, number: int) -> list[int]:
        """Take a batch in; the buckets written."""
        bucket = self.bucket()
        fs, done = self._path(f"{self.folder}/batch={number}/_DONE")
        if fs.exists(done):  # done again: what it wrote doesn't count until it is whole
            fs.delete(done, False)
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # no more than there are buckets
        known = self.versions(number)
        old = self._read({b: known[b][-1] for b in touched if b in known}, batch.schema)
        both = batch.unionByName(old).withColumn("bucket", bucket)
        best = both.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*self.order)).alias("r")).select("r.*", "bucket")
        if self.forget:
            late = batch.agg((F.max("timestamp") - F.expr(f"INTERVAL {self.forget}")).alias("t")).first().t
            best = best.where(~((F.col("action") == "delete") & F.coalesce(F.col("timestamp") < F.lit(late), F.lit(False))))
        best.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={number}")
        for b in touched:  # also those of which nothing is left
            there, p = self._path(f"{self.folder}/batch={number}/bucket={b}")
            there.mkdirs(p)
        fs.create(done, True).close()
        for b in touched:
            for n in known.get(b, [])[:-1]:
                fs.delete(self._path(f"{self.folder}/batch={n}/bucket={b}")[1], True)
        return touched


def upsert(stream: DataFrame, folder: str, checkpoint: str, buckets: int = 64, forget: str | None = None):
    """Query that keeps the latest version of each element in Latest(folder): each batch writes only buckets that it touches."""
    latest = Latest(stream.sparkSession, folder, buckets, forget=forget)
    return stream.writeStream.foreachBatch(lambda batch, n: latest.merge(batch, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
