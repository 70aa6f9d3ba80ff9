"""Whitening of embeddings from an exact covariance: digit-slice GEMM.

Entries become whole numbers x = floor(scale * c); the fit list has each distinct x vector once. With n vectors of sums S, the centred
y = n * x - S is a whole number too. y is split into limbs of `BITS` bits, so that the float64 matrix product of two limbs over
a block of 4,096 vectors is exact; products go into digits of the same base, which are big integers with carries. Each task
adds up its own d x d matrix and deals it out by rows; the rows are added as they stream in. Only that matrix comes to the driver: d x d
numbers for vectors of length d, whatever the table. It is divided by n^3, rounded once, and decomposed.

Defined results: vectors that are null, empty or hold null or non-finite entries are dropped, and so are those whose length isn't the most
frequent one (of several, the shortest); an entry with |scale * c| of 2^62 or more is an error; repeated rows are all returned, but count
once in the fit; with d < `components`, d components; one whose variance isn't above rounding (d * 2^-52 of the largest), such as all of
them where one vector is left, has null whitened, and explained null only where all variance is 0; identity_error covers the others (null if there
are none); deviations of 10^38 and more are null; equal eigenvalues have any basis; an empty table gives no rows; further columns named in
`keep` come along under any name but those of the result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded, dropped, table, written

BITS, BLOCK = 20, 4096
_MASK = (1 << BITS) - 1


def limbs(y: np.ndarray, k: int) -> np.ndarray:
    """k limbs of whole numbers, the lowest first; the last has the sign."""
    out = np.empty((k, *y.shape), np.int64)
    for s in range(k - 1):
        out[s], y = y & _MASK, y >> BITS
    out[k - 1] = y
    return out


def carried(digits: np.ndarray) -> np.ndarray:
    """The same numbers with all digits but the last from 0 to 2^BITS - 1."""
    for s in range(len(digits) - 1):
        digits[s + 1] += digits[s] >> BITS
        digits[s] &= _MASK
    return digits


def whole(digits: np.ndarray) -> np.ndarray:
    """Digits, the lowest first, as Python integers."""
    return sum(d.astype(object) << (BITS * s) for s, d in enumerate(digits))


def gram(y: np.ndarray, k: int, size: int) -> np.ndarray:
    """Digits of y'y by exact float64 products of limbs; y has at most BLOCK rows."""
    parts = limbs(y, k).astype(np.float64)
    out = np.zeros((size, y.shape[1], y.shape[1]), np.int64)
    for a in range(k):
        for b in range(a, k):
            p = (parts[a].T @ parts[b]).astype(np.int64)
            out[a + b] += p if a == b else p + p.T
    return carried(out)


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("_x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, n: int, s: list[int], most: int) -> np.ndarray:
    """n * x - S, in Python integers where they might not fit."""
    return n * x - np.array(s, np.int64) if most < 1 << 62 else n * x.astype(object) - np.array(s, object)


def _sums(d: int, size: int = 8):
    def run(batches):
        n, most, digits = 0, 0, np.zeros((size, d), np.int64)
        for b in batches:
            x = _matrix(b, d)
            if len(x):
                n, most = n + len(x), max(most, int(np.abs(x).max()))
                digits[:4] += limbs(x, 4).sum(1)
                carried(digits)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "most": [most], "digits": [digits.ravel()]})

    return run


def _grams(n: int, s: list[int], most: int, k: int, size: int):
    d = len(s)

    def run(batches):
        total = None
        for b in batches:
            x = _matrix(b, d)
            for a in range(0, len(x), BLOCK):
                g = gram(_centred(x[a : a + BLOCK], n, s, most), k, size)
                total = g if total is None else carried(total + g)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(d), "digits": list(total.transpose(1, 0, 2).reshape(d, -1))})

    return run


def _added(size: int):
    """Rows of the same number i added up, as they come."""

    def run(batches):
        total: dict = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = v.values.to_numpy().reshape(size, -1)
                total[i] = carried(total[i] + v) if i in total else v.copy()
        if total:
            yield pa.RecordBatch.from_pydict({"i": list(total), "digits": [v.ravel() for v in total.values()]})

    return run


def _whole_vectors(vectors: DataFrame, column: str, scale: int) -> DataFrame:
    """vectors with _x, for those that can be used."""
    c = F.col(f"`{column}`")
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(v.cast("double")))
    big = F.raise_error("an entry is too large for whole numbers of 62 bits").cast("long")
    x = F.transform(c, lambda v: F.when(F.abs(v.cast("double") * scale) < 2.0**62, F.floor(v.cast("double") * scale).cast("long")).otherwise(big))
    rows = vectors.where(fine)
    d = rows.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size(c) == (d.d if d else -1)).withColumn("_x", x)


class Whitening:
    """What a table of vectors gives: n, sums, eigenvalues and unit eigenvectors (columns), all of them, the largest first."""

    def __init__(self, fit: DataFrame, d: int):
        """fit: a written table of distinct _x, all of length d."""
        first = fit.mapInArrow(_sums(d), "n long, most long, digits array<long>")
        each = first.select("n", "most", F.posexplode("digits").alias("at", "digit")).groupBy("at").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("digit").alias("digit")).collect()
        self.n, self.d = each[0].n, d
        digits = np.zeros(8 * d, object)
        digits[[r["at"] for r in each]] = [r.digit for r in each]
        self.sums = whole(digits.reshape(8, d)).tolist()
        self.most = self.n * each[0].most + max(map(abs, self.sums))
        k = -(-(self.most.bit_length() + 1) // BITS)
        size = 2 * k + 3  # 40 bits and more for the number of vectors
        rows = fit.mapInArrow(_grams(self.n, self.sums, self.most, k, size), "i long, digits array<long>")
        rows = rows.repartition("i").mapInArrow(_added(size), "i long, digits array<long>").collect()
        self.gram = [[]] * d
        for r in rows:
            self.gram[r.i] = whole(np.array(r.digits, np.int64).reshape(size, d)).tolist()
        v = np.array([[g / self.n**3 for g in row] for row in self.gram], np.float64)
        e, u = np.linalg.eigh(v)
        self.values, self.units = np.maximum(e[::-1], 0), u[:, ::-1]
        self.units = self.units * np.where(self.units[np.abs(self.units).argmax(0), np.arange(d)] < 0, -1, 1)
        self.trace = sum(self.gram[i][i] for i in range(d)) / self.n**3

    def real(self) -> int:
        """How many components have a variance above rounding."""
        return int((self.values > self.d * 2.0**-52 * self.values[0]).sum()) if self.values[0] > 0 else 0

    def projection(self, components: int) -> np.ndarray:
        """From y / n to whitened values."""
        r = min(components, self.real())
        return self.units[:, :r] / np.sqrt(self.values[:r])


def _moments(w: Whitening, p: np.ndarray):
    n, s, most = w.n, w.sums, w.most

    def run(batches):
        total = np.zeros((p.shape[1], p.shape[1]))
        for b in batches:
            z = (_centred(_matrix(b, len(s)), n, s, most) / n).astype(np.float64) @ p
            total += z.T @ z
        yield pa.RecordBatch.from_pydict({"sums": [total.ravel()]})

    return run


def _scored(w: Whitening, p: np.ndarray, components: int, keep: list[str]):
    n, s, most, d, real = w.n, w.sums, w.most, w.d, p.shape[1]

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            y = _centred(_matrix(b, d), n, s, most)
            z = np.full((len(b), components), np.nan)
            z[:, :real] = (y / n).astype(np.float64) @ p
            if d * most * most < 1 << 62:
                dev = pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
            else:
                exact = [int(v) for v in (y.astype(object) ** 2).sum(1)]
                dev = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            row = pa.array(np.repeat(np.arange(len(b)), components))
            own = {f"k{i}": b.column(b.schema.get_field_index(c)).take(row) for i, c in enumerate(keep)}
            white = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
            yield pa.RecordBatch.from_pydict(own | {"component": pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(b))), "deviation": dev.take(row), "whitened": white})

    return run


NEW = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 4, scale: int = 256, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """A row for each usable vector and component: the columns in keep, component (from 1), n, deviation (decimal), whitened,
    explained, identity_error."""
    spark = vectors.sparkSession
    if clash := set(NEW) & set(keep):
        raise ValueError(f"results have the names {sorted(clash)}")
    bounded(spark)
    own = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = _whole_vectors(vectors.select(*own, F.col(f"`{column}`").alias("_v")), "_v", scale).drop("_v")
    shape = ", ".join(f"k{i} {t}" for i, t in enumerate(dict(vectors.dtypes)[c] for c in keep)) + ", component int, deviation decimal(38,0), whitened double"
    fit = written(rows.select("_x").distinct(), "fit")
    first = fit.select(F.size("_x").alias("d")).first()
    if first is None:
        r = spark.createDataFrame([], shape)
        return r.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", *(F.lit(None).cast("double").alias(c) for c in NEW[4:]))
    w = Whitening(fit, first.d)
    m = min(components, w.d)
    p = w.projection(m)
    error, r = None, p.shape[1]
    if r:
        moments = fit.mapInArrow(_moments(w, p), "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
        c = np.zeros(r * r)
        for x in moments.collect():
            c[x["at"]] = x.v / w.n
        error = float(np.abs(c.reshape(r, r) - np.eye(r)).max())
    dropped(spark, fit)
    explained = F.array(*(F.lit(float(e) / w.trace if w.trace else None).cast("double") for e in w.values[:m]))
    out = rows.mapInArrow(_scored(w, p, m, [f"k{i}" for i in range(len(keep))]), shape)
    return out.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("component")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op11_whitening(spark, sf_dir):
    d = whiten(table(spark, sf_dir, "embeddings"))
    return d.withColumn("deviation", F.col("deviation").try_cast("long"))
