"""The pipeline's stages on a small folder of tables."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql.functions import lit
from terrachron.llm import mixing, queries
from terrachron.llm._util import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, near and exact copies, a shared passage and junk."""
    import random

    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(800)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = make(60)
    texts = [make(150) for _ in range(60)]
    near = texts[0].split()
    near[75] = "changed"
    texts += [texts[1], " ".join(near), passage + "\n" + make(90), make(90) + "\n" + passage]
    junk = [" ".join(w + "$$$" for w in make(80).split()) for _ in range(20)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate([*texts, *junk])] + [(None, make(40), None, None, 5), (200, None, "en", "src0", 0), (201, "", "en", "src1", 0)]
    d = tmp_path_factory.mktemp("tables")
    more = {"kept": 1, "_dk": 2, "low": 3, "spans": 4, "taken": 5, "key": 6}  # names that stages use inside
    d0 = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d0.withColumns({c: lit(v) for c, v in more.items()}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 64), 0) for i in range(0, 84, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), passage


def test_stages(spark, folder):
    d, passage = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near", "repeats", "mixing", "packing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, d), name)
        out[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "_dk", "low", "spans", "taken", "key"]
            assert docs.select("kept", "_dk", "low", "spans", "taken", "key").distinct().collect() == [(1, 2, 3, 4, 5, 6)]
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in out.items()}
    assert set(range(64)) <= ids["quality"] and not ids["quality"] & set(range(64, 84)) and None in ids["quality"]
    assert ids["quality"] - ids["near"] == {60, 61}
    assert ids["repeats"] == ids["near"]
    text = {r.doc_id: r for r in out["repeats"].collect()}
    assert passage not in text[62].text + text[63].text and len(text[62].text) > 300 and text[62].n_chars == len(text[62].text)
    want = {r.doc_id: r.taken for r in mixing.mix(out["repeats"]).collect() if r.taken}
    got = Counter()
    for r in out["mixing"].collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == want
    assert ids["packing"] == ids["mixing"]


def test_run_and_registration(spark, folder):
    d, _ = folder
    assert corpus_pipeline.run(spark, d).count() > 0
    names = list(queries.queries())
    assert names[0] == "pipeline" and sorted(n.split("_")[0] for n in names[1:]) == sorted(f"op{i}" for i in range(1, 14))
