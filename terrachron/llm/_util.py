"""Shared helpers: tables cut from lineage, kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a folder of its own only where unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="terrachron-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, where it left the defaults: texts are long, and two batches lie in a worker."""
    for key, usual, now in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "8388608b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", now)


def written(df: DataFrame, name: str = "t", by: str | None = None):
    """df as a Parquet table in the shared folder, so that a lost executor costs no recomputation; with by: the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if by:
        df.write.partitionBy(by).parquet(path)
        return path
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that written() made and that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(big: DataFrame, small: DataFrame, key: str, limit_mb: int = 1, how: str = "inner") -> DataFrame:
    """Join that broadcasts the small side if its table, already written, has at most limit_mb; else by shuffle."""
    width = sum(8 if t in ("bigint", "double") else 4 if t == "int" else 0 for _, t in small.dtypes)
    of = {"binary": lambda c: F.octet_length(c), "string": lambda c: F.octet_length(c)}
    wide = [of[t](c) if t in of else F.size(c) * 32 for c, t in small.dtypes if t in of or t.startswith("array")]
    a = small.agg(F.count("*"), F.sum(sum((F.coalesce(x, F.lit(0)) for x in wide), F.lit(0)))).first()
    fits = a[0] * width + (a[1] or 0) <= limit_mb * 1_000_000
    return big.join(F.broadcast(small) if fits else small, key, how)


def semi(big: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of big with a key in keys; both are written tables. keys: the columns of on, distinct and not null, and n, how many rows
    of big have them. Keys of over one row in 20,000 are at most 20,000; they are broadcast, so that their rows don't meet in one
    task, and only the others are shuffled."""
    most = max(10_000, big.count() // 20_000)
    hot = F.broadcast(keys.where(F.col("n") > most).select(on))
    cold = big.join(hot, on, "left_anti").join(keys.where(F.col("n") <= most).select(on), on, "left_semi")
    return big.join(hot, on, "left_semi").unionByName(cold)


def drawn(rows: DataFrame, key, size, most_rows: int, most_mb: int = 64) -> DataFrame:
    """The first rows in order of the hash of key: at most so many, and no more than most_mb of size (bytes) together."""
    some = rows.withColumn("_h", F.xxhash64(key)).withColumn("_bytes", F.coalesce(size, F.lit(0))).orderBy("_h", "_bytes").limit(most_rows)
    before = F.sum("_bytes").over(Window.orderBy("_h", "_bytes").rowsBetween(Window.unboundedPreceding, 0))
    return some.withColumn("_sum", before).where(F.col("_sum") <= most_mb * 1_000_000).drop("_h", "_bytes", "_sum")


def bound(value, of):
    """of(value), with value made once: what a lambda refers to is made again for each element otherwise."""
    return F.element_at(F.transform(F.array(value), of), 1)


def sliced(batches, rows: int = 1000):
    """Batches of at most so many rows: bounds what a step holds at once where texts are long."""
    for b in batches:
        for a in range(0, len(b), rows):
            yield b.iloc[a : a + rows]
