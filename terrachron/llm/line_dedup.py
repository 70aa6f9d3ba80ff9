"""Line dedup by range-partitioned hashes, in DataFrame operations only.

A line's key is the line without white space `[\\x20\\x09-\\x0D]` at its ends, A-Z in lower case. A key of at least `least`
code points that at least `docs` documents hold loses all its lines but those of the largest doc_id that holds it.

Only hashes, document and position of such lines are dealt out: ranges of hashes, sorted inside by document (falling) and
position, so that the first rows of a hash are the lines that stay and one pass over the rows in order counts its documents.
Hashes of over one line in 20,000, and over 1,000 lines (hence at most 20,000 hashes, broadcast), don't go that way: their documents are counted by
hash and document, and combined before they are dealt. The result is a bitmap for each document that loses lines, compressed to
the positions at which it flips; `kept()` applies it.

Defined results: a null or empty text is one empty line; a document is its doc_id (null is one too, the smallest), so that rows
that repeat a doc_id count once for a key, and each row is returned with its own text's lines judged; equal rows have equal
results; an empty table gives no rows; further columns stay as they are, and may have any name but those of the result. Keys
are compared by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import bound, dropped, table, written

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _sign(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _key(line):
    bare = F.trim(line, F.lit(BLANK))
    # lower() changes A-Z alone where all is ASCII, and is far cheaper
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def entries(docs: DataFrame, least: int = 40) -> DataFrame:
    """h1, h2 (hash of the key), doc_id, sign (hash of the text) and pos of every line whose key is long enough."""
    rows = docs.select("doc_id", _sign(F.col("text")).alias("sign"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.where(F.octet_length("line") >= least).select("doc_id", "sign", "pos", _key(F.col("line")).alias("key"))
    rows = rows.where(F.char_length("key") >= least)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(13), "key").alias("h2"), "doc_id", "sign", "pos")


def _flips(gone):
    """Positions at which a bitmap with these ascending bits unset flips: kept up to the first, then gone up to the second, ..."""
    starts = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1))
    ends = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) != x + 1))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b + 1)))


def bitmaps(docs: DataFrame, least: int = 40, in_docs: int = 5, hot: int | None = None) -> DataFrame:
    """doc_id, sign and flips of every document that loses lines. hot: lines of one key that are dealt out by document."""
    e = written(entries(docs, least), "lines")
    most = max(1_000, e.count() // 20_000) if hot is None else hot
    hashes = ["h1", "h2"]
    often = F.broadcast(written(e.groupBy(*hashes).count().where(F.col("count") > most).select(hashes), "often"))
    by_key = Window.partitionBy(*hashes)
    newest = by_key.orderBy(F.col("doc_id").desc_nulls_last())
    cold = e.join(often, hashes, "left_anti").repartitionByRange(*hashes)
    cold = cold.sortWithinPartitions(*hashes, F.col("doc_id").desc_nulls_last(), "pos")
    cold = cold.withColumn("nth", F.dense_rank().over(newest)).withColumn("held", F.max("nth").over(by_key))
    gone = cold.where((F.col("held") >= in_docs) & (F.col("nth") > 1)).select("doc_id", "sign", "pos")
    many = e.join(often, hashes).groupBy(*hashes, "doc_id").agg(F.lit(1).alias("one"))
    many = many.groupBy(*hashes).agg(F.count("*").alias("held"), F.max("doc_id").alias("keeper")).where(F.col("held") >= in_docs)
    others = e.join(F.broadcast(many), hashes).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "sign", "pos")
    out = gone.unionByName(others).groupBy("doc_id", "sign").agg(F.collect_set("pos").alias("gone"))
    out = written(out.select("doc_id", "sign", bound(F.array_sort("gone"), _flips).alias("flips")), "bitmaps")
    dropped(docs.sparkSession, e)
    return out


def kept(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """docs with what stays of each text, and n_lines, n_dropped."""
    if clash := {"n_lines", "n_dropped"} & set(docs.columns):
        raise ValueError(f"results have the names {sorted(clash)}")
    m = maps.select(F.col("doc_id").alias("_doc"), F.col("sign").alias("_sign"), F.col("flips").alias("_flips"))
    d = docs.join(m, F.col("doc_id").eqNullSafe(F.col("_doc")) & (_sign(F.col("text")) == F.col("_sign")), "left")
    flips = F.col("_flips")

    def staying(lines):
        def piece(i):
            at = F.when(i == 0, 0).otherwise(F.get(flips, 2 * i - 1))
            return F.slice(lines, at + 1, F.coalesce(F.get(flips, 2 * i), F.size(lines)) - at)

        return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(flips) / 2).cast("int")), piece))

    lines = _lines(F.col("text"))
    text = F.when(flips.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(bound(lines, staying), "\n"))
    gone = F.aggregate(flips, F.lit(0), lambda n, x: x - n)  # ends less starts, as there are as many of both
    own = [F.col(f"`{c}`") if c != "text" else text.alias("text") for c in docs.columns]
    return d.select(*own, F.size(lines).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"))


def op13_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return kept(docs, bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT r, k.doc_id, pos, line, g.key IS NULL OR k.doc_id IS NOT DISTINCT FROM keeper AS keep FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT keep)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
