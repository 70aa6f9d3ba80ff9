"""A corpus pipeline of five stages, each calling one operator on all that its predecessor kept.

quality   drops the documents that the quality classifier rejects (low quality, toxic)
near      keeps one document, that with the smallest doc_id, of each group linked by 5-word shingles at 0.8
repeats   removes every string of 200 bytes that occurs elsewhere, all its copies; an emptied document stays, empty
mixing    takes words by source: a document taken more than once is repeated, what is taken in part is cut after its last
          word taken (words then joined by single spaces), what is not taken goes
packing   packs the pieces of all documents into sequences of 1024 tokens

All stages but the last return the columns of documents; n_chars follows the text. Rows without doc_id are kept by `near`
as they are. Empty tables pass through, and so do further columns of documents, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from . import mixing, ngram_join, packing, quality, suffix_dedup
from ._util import bounded, sized, table, written

#: SQL can't express the stages' models and fixpoints; tests/llm compares them with brute force.
ORACLE_SQL = None


USUAL = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage):
    """The stage with further columns of docs under names of their own, so that none clashes; they come back as they were."""

    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        bounded(spark)
        own = {c: c if c in USUAL else f"_x{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())), sf_dir)
        return out.select(*(F.col(n).alias(c) for c, n in own.items()))

    return run


@apart
def keep_quality(spark, docs, sf_dir):
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@apart
def drop_near(spark, docs, sf_dir):
    c = ngram_join.classes(docs, k=5, percent=80)
    c = c.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("_comp"), F.count("*").alias("_copies"))
    c = written(c.where("doc_id != _comp or _copies > 1"), "losers")
    d = docs.withColumn("_id", F.col("doc_id").cast("long"))
    gone = sized(d, c.withColumnRenamed("doc_id", "_id"), "_id", how="left")
    once = gone.where("_copies is null or _id is null").drop("_id", "_comp", "_copies")
    again = gone.where("_comp = _id and _copies > 1").drop("_id", "_comp", "_copies").dropDuplicates(["doc_id"])
    return once.unionByName(again)


@apart
def cut_repeats(spark, docs, sf_dir):
    return suffix_dedup.without_repeats(docs, window=200, gram=100)


@apart
def mix_sources(spark, docs, sf_dir):
    own = docs.withColumn("_dk", F.xxhash64("doc_id", "text", "source"))
    t = mixing.mix(own, keep=("_dk",)).groupBy("_dk").agg(F.max("taken").alias("_taken"), F.max("size").alias("_size"))
    d = sized(own, written(t.where("_taken > 0"), "taken"), "_dk")
    whole, part = F.floor(F.col("_taken") / F.col("_size")).cast("int"), F.col("_taken") % F.col("_size")
    d = d.select("*", F.explode(F.sequence(F.lit(0), whole)).alias("_copy")).where((F.col("_copy") < whole) | (part > 0))
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    text = F.when(F.col("_copy") < whole, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), part.cast("int")), " "))
    d = d.withColumn("text", text)
    return d.select(*(F.length("text").cast("long").alias("n_chars") if c == "n_chars" else c for c in docs.columns))


def pack_sequences(spark, docs, sf_dir):
    import public_tokenizers

    bounded(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near", drop_near),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark, sf_dir):
    """All stages over documents, each written as Parquet and reread as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
