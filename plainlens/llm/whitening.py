"""Whitening of embeddings by a randomised range finder: power passes over all centred rows, then Rayleigh-Ritz.

Entries are whole numbers (floor of `scale` times the entry), so the fit list, each distinct vector once, its sums and the
deviations are exact. A pass multiplies the centred rows by a basis and back, one small matrix for each task, which Spark
sums up entry by entry; no vector leaves its task. If the residuals of the leading pairs do not fall fast enough, as with
spectra without gaps, the basis grows to the full dimension, where Rayleigh-Ritz is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import prepare, removed, shared_path, tidy, unused

#: Vectors of the first basis beyond the components asked for, and power passes before the basis grows to the full dimension.
OVERSAMPLING, PASSES, SEED = 8, 12, 20240611
#: Residual of a pair, as a part of the largest eigenvalue, that counts as settled.
SETTLED = 1e-14
#: Rows of one block of a pass.
BLOCK = 4096
#: Whole entries are exact in products with counts below this.
_EXACT = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """A fit: rows n, exact sums by dimension, components by column, eigenvalues, trace, the covariance check, and how it went."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int
    full: bool


def whole_entries(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of each entry; null for a null or empty vector and for one with a null, NaN or infinite entry.

    Entries whose product is outside 64 bits get the nearest 64-bit number.
    """
    c = F.transform(vector, lambda v: v.cast("double"))
    fine = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(c, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Rows minus the mean, as doubles; the difference is taken in whole numbers where they are exact."""
    s = np.array(sums, dtype=object)
    most = max(int(np.abs(x.astype(np.float64)).max(initial=0)) + 1, 1)
    if most * n + max((abs(v) for v in sums), default=0) < _EXACT:
        return (x * n - s.astype(np.int64)).astype(np.float64) / n
    return ((x.astype(object) * n - s) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n * entry - sum)^2 of each row, exact; null where 64 bits cannot hold it."""
    s = np.array(sums, dtype=object)
    most = (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) * n + max((abs(v) for v in sums), default=0)
    if most * most * max(1, x.shape[1]) < _EXACT:
        return ((x * n - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
    big = ((x.astype(object) * n - s) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in big]


def _summed(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], d: int) -> np.ndarray:
    """The sum over all blocks of rows of the matrices made of them; tasks add up their own, Spark the tasks' entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                total += make(_matrix(b.column(0).slice(at, BLOCK), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    entries = rows.mapInArrow(tidy(run), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in entries:
        out[r.i] = r.v
    return out.reshape(shape)


def _sums(rows: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and the exact sums of their entries, as decimals where 64 bits may not hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for b in batches:
            x = _matrix(b.column(0), d)
            small = len(x) * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) < _EXACT
            total = [a + int(v) for a, v in zip(total, x.sum(axis=0) if small else x.astype(object).sum(axis=0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int64()), pa.array([str(n), *map(str, total)])], names=["i", "v"])

    got = {r.i: int(r.v) for r in rows.mapInArrow(run, "i long, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return got.get(-1, 0), tuple(got.get(i, 0) for i in range(d))


def _pairs(basis: np.ndarray, image: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Rayleigh-Ritz: the k largest Ritz values, their vectors, and the largest residual as a part of the first value."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    values, turn = values[order], turn[:, order]
    vectors = basis @ turn
    rest = np.linalg.norm(image @ turn - vectors * values, axis=0)
    return values, vectors, float(rest.max() / values[0]) if values[0] > 0 else 0.0


def fitted(rows: DataFrame, d: int, components: int) -> Whitening:
    """The fit of a table of one column of distinct whole vectors of d entries."""
    n, sums = _sums(rows, d)
    k = min(components, d)
    rng = np.random.default_rng(SEED)
    basis = np.linalg.qr(rng.standard_normal((d, min(d, k + OVERSAMPLING))))[0]
    before, passes, full = None, 0, basis.shape[1] == d
    while True:

        def image_of(x: np.ndarray, q=basis) -> np.ndarray:
            y = centred(x, n, sums)
            return np.vstack([y.T @ (y @ q), np.full((1, q.shape[1]), np.square(y).sum())])

        got = _summed(rows, image_of, (d + 1, basis.shape[1]), d) / n
        image, trace, passes = got[:-1], float(got[-1, 0]), passes + 1
        values, vectors, residual = _pairs(basis, image, k)
        if full or residual <= SETTLED or trace == 0:
            break
        # each pass shrinks residuals by about one factor: with that of the last pass, would the passes left be enough?
        slow = before is not None and residual * (residual / before) ** (PASSES - passes) > SETTLED
        before = residual
        if slow or passes >= PASSES:
            basis, full = np.eye(d), True
        else:
            basis = np.linalg.qr(image)[0]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    values = np.where(values > 1e-13 * max(values.max(initial=0), 0), values, 0.0)
    to = _projection(vectors, values)
    live = values > 0
    covariance = _summed(rows, lambda x: (w := centred(x, n, sums) @ to).T @ w, (k, k), d) / max(n, 1)
    error = float(np.abs(covariance - np.eye(k))[np.ix_(live, live)].max(initial=0.0))
    return Whitening(n, sums, vectors, values, trace, error, passes, full)


def _projection(vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.where(values > 0, vectors / np.sqrt(np.where(values > 0, values, 1.0)), 0.0)


def fit(df: DataFrame, vector: str, components: int = 4, scale: int = 256) -> Whitening | None:
    """The whitening of a table's vectors; None if no row has one. Vectors of different lengths are an error.

    The distinct vectors, of which copies are combined before the shuffle, are a table in the shared folder for as long as
    the passes run; a lost executor costs the tasks it had.
    """
    spark = prepare(df.sparkSession)
    x = df.select(whole_entries(F.col(f"`{vector}`"), scale).alias("x")).filter("x IS NOT NULL")
    path = shared_path(spark, "vectors")
    x.distinct().write.parquet(path)
    rows = spark.read.schema("x array<bigint>").parquet(path)
    size = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if size[0] is None:
        removed(spark, path)
        return None
    if size[0] != size[1]:
        raise ValueError(f"vectors have from {size[0]} to {size[1]} entries")
    model = fitted(rows, size[0], components)
    removed(spark, path)
    return model


def whitened(df: DataFrame, vector: str, model: Whitening, scale: int = 256) -> DataFrame:
    """The rows whose vector takes part, all columns, with whitened array<double> and deviation.

    A component without variance (eigenvalue 0) is null in every row. deviation is null where 64 bits cannot hold it. The
    model is of fixed size and sent with the function. Columns of these two names are an error.
    """
    if {"whitened", "deviation"} & {c.lower() for c in df.columns}:
        raise ValueError("the table has a column whitened or deviation")
    prepare(df.sparkSession)
    n, sums, to, d = model.n, model.sums, _projection(model.components, model.eigenvalues), len(model.sums)
    dead = [i for i, e in enumerate(model.eigenvalues) if e <= 0]
    (inner,) = unused(df, 1)
    rows = df.withColumn(inner, whole_entries(F.col(f"`{vector}`"), scale)).filter(f"{inner} IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(b.num_columns - 1), d)
            w = (centred(x, n, sums) @ to).astype(object)
            w[:, dead] = None
            made = [pa.array(w.tolist(), pa.list_(pa.float64())), pa.array(deviations(x, n, sums), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "whitened", "deviation"])

    schema = StructType([*df.schema.fields, StructField("whitened", ArrayType(DoubleType())), StructField("deviation", LongType())])
    return rows.mapInArrow(tidy(run), schema)


def whitening_report(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row for each vector that takes part and each component: key, component, n, deviation, whitened, explained, identity_error.

    Null and empty vectors and those with a null or non-finite entry are left out; an empty table, or one without other
    vectors, gives no rows. Repeated rows stay, the fit counts their vector once. With fewer dimensions than components there
    are as many components as dimensions. A component without variance has null whitened and explained 0; of vectors that
    are all equal explained is null. Vectors of different lengths are an error. The fit runs when the report is made.
    """
    lean = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{vector}`").alias("vector"))
    model = fit(lean, "vector", components)
    if model is None:
        return df.sparkSession.createDataFrame([], f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = [float(e / model.trace) if model.trace > 0 else None for e in model.eigenvalues]
    each = F.posexplode("whitened").alias("at", "value")
    rows = whitened(lean, "vector", model).select(key, "deviation", each)
    explained = F.get(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("at"))
    return rows.select(key, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
