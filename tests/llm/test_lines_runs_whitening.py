"""Line dedup, periodic runs and whitening against brute force, with nulls, blanks, ties, repeated rows and empty tables."""

import hashlib
import random
from collections import defaultdict

import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.llm import line_dedup, periodic_runs, whitening


def brute_lines(rows, least, in_docs):
    blank, holds = " \t\n\x0b\f\r", defaultdict(set)
    small = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    keyed = [(i, [(x, x.strip(blank).translate(small)) for x in (t or "").split("\n")]) for i, t in rows]
    for i, lines in keyed:
        for _, k in lines:
            holds[k].add(i)
    out = []
    for i, lines in keyed:
        stay = [x for x, k in lines if len(k) < least or len(holds[k]) < in_docs or i == max(holds[k], key=lambda j: (j is not None, j or 0))]
        out.append((str(i), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.mark.parametrize("hot", [None, 3])
def test_line_dedup(spark, hot):
    r = random.Random(3)
    long = ["  Ä line of Some length ", "another LINE of it\r", "\tthird line, third line", "ünïcödé línë, ünïcödé", "short", "", " \t ", "a line of some lengtH"]
    rows = [(i, "\n".join(r.choice(long) for _ in range(r.randrange(1, 9)))) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "no such line here at all"), (5, rows[5][1]), (5, "a line of some length\nand one more of its own"), (None, "a line of some length")]
    rows += [(-1, "\n".join(["another line of it", "x" * 300, str(i)][i % 3] for i in range(9000)) + "\n" + "y" * 2_000_000)]
    schema = "doc_id long, text string, h1 string, pos int, flips int, key string, sign string, held int"
    docs = spark.createDataFrame([(i, t, "h", 1, 2, "k", "s", 3) for i, t in rows], schema).repartition(5)
    d = line_dedup.kept(docs, line_dedup.bitmaps(docs, 15, 4, hot))
    assert d.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = sorted((str(x.doc_id), x.n_lines, x.n_dropped, x.text) for x in d.collect())
    assert got == brute_lines(rows, 15, 4)
    assert sum(x[2] for x in got) > 3000
    empty = docs.limit(0)
    assert line_dedup.kept(empty, line_dedup.bitmaps(empty)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.kept(docs.withColumn("n_lines", F.lit(1)), d)


def test_line_dedup_against_its_sql(spark, tmp_path):
    same = ["The same line of at least forty code points, here", "  THE SAME LINE OF AT LEAST FORTY CODE POINTS, HERE\r", "ÀÉ" * 20]
    rows = [(i, "\n".join([same[i % 3], str(i), same[0][:39]])) for i in range(30)] + [(40, None), (41, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, line_dedup.op13_line_dedup(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(line_dedup.SQL).fetchall())
    assert sum(x[2] for x in got) == 28
    assert ("41", hashlib.sha256(b"").hexdigest()) in [(str(x[0]), x[3]) for x in got]


def test_line_dedup_stays_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = line_dedup.kept(docs, line_dedup.bitmaps(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_runs(w, least, floor):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - a
            if i > a and length >= max(floor, least * q) and not any(all(w[x] == w[x + d] for x in range(a, a + length - d)) for d in range(1, q)):
                out.add((a, length, q))
            i += i == a
    return sorted(out)


def test_runs_equal_brute_force():
    r = random.Random(2)
    for _ in range(4000):
        k, n = r.choice([1, 2, 2, 3, 4]), r.randrange(40)
        w = [str(r.randrange(k)) for _ in range(n)]
        if r.random() < 0.6 and n > 3:
            a = r.randrange(n)
            p = 1 + r.randrange(max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if r.random() < 0.5:
                w[r.randrange(n)] = r.choice("012")
        for least, floor in ((4, 6), (3, 4), (2.5, 3), (2, 2)):
            assert periodic_runs.text_runs(w, least, floor) == brute_runs(w, least, floor)
    with pytest.raises(ValueError):
        periodic_runs.runs(np.zeros(9, np.int64), 1.5)


def test_runs_take_linear_work():
    """Places read for texts of twice the length: about twice as many, whatever their shape."""

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return list.__getitem__(self, i)

    def fibonacci(n):
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]

    r = random.Random(1)
    noise = [r.randrange(2) for _ in range(40_000)]
    shapes = (lambda n: [0] * n, lambda n: [0, 1] * (n // 2), fibonacci, lambda n: noise[: n // 4] * 4, lambda n: [x for i in range(int((2 * n) ** 0.5)) for x in [0] * i + [1]][:n])
    for make in shapes:
        reads = []
        for n in (10_000, 20_000, 40_000):
            Counted.reads = 0
            w, lyndon = make(n), periodic_runs.lyndon
            source = Counted([*w, -1])
            lyndon(w, source)
            reads.append(Counted.reads / n)
        assert reads[2] < 1.35 * reads[0] and reads[2] < 40


def made(i, t):
    w = (t or "").encode().split()
    h, n = zlib.crc32(str(i).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]


def test_periodic_runs_query(spark, tmp_path):
    r = random.Random(4)
    word = lambda k: " ".join(r.choice(["a", "b", "çé", "Dog", "x" * 30]) for _ in range(k))
    rows = [(i, word(r.randrange(60))) for i in range(300)] + [(300, None), (301, ""), (302, " \t\n"), (303, "a " * 30), (7, word(40)), (7, word(40)), (304, "a\u00a0a a\u2003a " * 9), (305, "b b b b b b a a a a a a")]
    rows += [(400 + i, word(3000)) for i in range(12)] + [(500, ("y" * 500_000 + " ") * 7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = made(i, t)
        found = brute_runs(w, 4, 6) if len(w) < 1000 else periodic_runs.text_runs(w)
        gone = {x for s, n, q in found for x in range(s + q, s + n)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        text = b" ".join(x for k, x in enumerate(w) if k not in gone)
        every = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(found), *shown, hashlib.sha256(every.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(x[1] > 0 for x in want) > 20


def test_runs_keep_other_columns(spark):
    d = spark.createDataFrame([("a b " * 6, 1, "w"), (None, 2, "w")], "words string, start int, period string")
    got = periodic_runs.find(d, "words").orderBy("start").collect()
    assert [(x.start, [tuple(s) for s in x.runs], x.collapsed) for x in got] == [(1, [(0, 12, 2)], "a b"), (2, [], "")]
    assert periodic_runs.find(d.limit(0), "words").count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find(d.withColumnRenamed("start", "runs"), "words")


def exact_gram(x):
    """Gram matrix of n * x - S by Fractions, and n."""
    x = sorted(set(map(tuple, x)))
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - b for a, b in zip(v, s)] for v in x]
    return [[sum(v[i] * v[j] for v in y) for j in range(len(s))] for i in range(len(s))], n, s


@pytest.mark.parametrize("top", [1, 1e5, 1e13])
def test_digits_make_exact_products(spark, top):
    r = np.random.default_rng(3)
    x = (r.normal(size=(700, 5)) * 256 * top + 1e3 * top).astype(np.int64)
    rows = spark.createDataFrame([(list(map(int, v)),) for v in x], "_x array<long>").repartition(7).distinct()
    w = whitening.Whitening(rows, 5)
    gram, n, s = exact_gram(x.tolist())
    assert (w.gram, w.n, w.sums) == (gram, n, s)


def test_digits_carry_signs():
    y = np.array([[-1, 5], [1 << 61, -(1 << 61)], [0, -(1 << 20)]])
    assert whitening.whole(whitening.limbs(y, 4)).tolist() == y.tolist()
    assert whitening.whole(whitening.carried(whitening.limbs(y, 4) * 3)).tolist() == (3 * y.astype(object)).tolist()
    big = np.array([[1 << 70, -(1 << 90)]], object)
    assert whitening.whole(whitening.gram(big, 6, 15)).tolist() == [[1 << 140, -(1 << 160)], [-(1 << 160), 1 << 180]]


def test_whitening_query(spark, tmp_path):
    r = np.random.default_rng(5)
    base = (r.normal(size=(400, 6)) * [3, 1, 0.5, 0.2, 0.1, 0.05] + [9, 0, -7, 0, 0, 1]).round(3)
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(base)]
    rows += [(i + 500, rows[0][1], 0) for i in range(200)] + [(3, rows[4][1], 1)]  # a vector of a third of all rows, a repeated id
    bad = [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 6, 1), (903, [float("inf")] * 6, 1), (904, [], 1), (905, [1.0, 2.0], 1)]
    spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, component int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op11_whitening(spark, str(tmp_path)).collect()
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v, _ in rows]
    gram, n, s = exact_gram(x)
    v = np.array([[float(Fraction(g, n**3)) for g in row] for row in gram])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 4 * len(rows) and {y.n for y in got} == {n}
    want = defaultdict(list)
    for (i, _, _), c in zip(rows, x):
        want[i].append((sum((n * a - b) ** 2 for a, b in zip(c, s)), [(np.array(c) - np.array(s) / n) @ u[:, k] / e[k] ** 0.5 for k in range(4)]))
    sign = {}
    for y in got:
        k = y.component - 1
        near = [w for d, w in want[y.vec_id] if d == y.deviation]
        assert near and y.explained == pytest.approx(e[k] / np.trace(v), rel=1e-9) and 0 <= y.identity_error < 1e-9
        z = near[0][k]
        assert abs(y.whitened) == pytest.approx(abs(z), rel=1e-7, abs=1e-7)
        if abs(z) > 1e-3:
            assert sign.setdefault(k, np.sign(z * y.whitened)) == np.sign(z * y.whitened)


def test_whitening_of_few_vectors(spark):
    shape = "embedding array<double>, n int, explained string"
    one = spark.createDataFrame([([1.0, 2.0, 3.0], 1, "a"), ([1.0, 2.0, 3.0], 2, "a")], shape).withColumnRenamed("n", "k")
    got = whitening.whiten(one, keep=("k",)).collect()
    assert sorted((x.k, x.component, x.n, int(x.deviation), x.whitened, x.explained, x.identity_error) for x in got) == [(k, c, 1, 0, None, None, None) for k in (1, 2) for c in (1, 2, 3)]
    flat = spark.createDataFrame([([0.0, 1.0], 1, ""), ([1.0, 1.0], 2, ""), ([2.0, 1.0], 3, "")], shape).withColumnRenamed("n", "_x")
    got = whitening.whiten(flat, keep=("_x",)).orderBy("_x", "component").collect()
    assert [round(x.whitened, 12) if x.whitened is not None else None for x in got] == [-round(1.5**0.5, 12), None, 0, None, round(1.5**0.5, 12), None]
    assert [x.explained for x in got] == [1, 0] * 3 and got[0].identity_error < 1e-12
    assert whitening.whiten(one.limit(0), keep=("k",)).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(one, keep=("explained",))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([([1e300],)], "embedding array<double>"), keep=()).collect()
