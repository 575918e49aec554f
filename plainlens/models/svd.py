"""A text encoder learned from the texts: the leading right singular vectors of their tf-idf matrix.

The matrix stays a table of entries (row, term, weight). A randomised range finder multiplies it with a thin matrix, a vector
for each term, and back, by joins and sums; what comes together on the driver are Gram matrices of the thin side only, a few
dozen numbers square. A text's vector is the sum of its terms' vectors by weight, so encoding is one join with the terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import text as T
from ..functions.rows import exploded
from ..operators.kept import kept

#: Vectors beyond those asked for, and power passes.
OVERSAMPLING, PASSES = 8, 2


def term_counts(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, term, tf: lower-case tokens of each row's text."""
    terms = exploded(df, list(keys), T.tokens(F.lower(F.col(f"`{text}`"))), "term")
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def _weighted(counts: DataFrame, idf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, term, w: (1 + ln tf) * idf of the known terms, rows of length 1."""
    w = counts.join(idf.select("term", "idf"), "term").withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    length = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l"))
    return w.join(length, list(keys)).select(*keys, "term", (F.col("w") / F.col("_l")).alias("w"))


def _sums(k: int, vector: str = "v") -> Column:
    """The weighted sum of arrays of k numbers."""
    return F.array(*[F.sum(F.col("w") * F.get(vector, F.lit(i))) for i in range(k)])


def _gram(df: DataFrame, k: int) -> np.ndarray:
    """Sum over all rows of v v^T; a task adds up its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["i", "x"])

    out = np.zeros(k * k)
    for r in df.select("v").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out.reshape(k, k)


def _times(df: DataFrame, by: str, matrix: np.ndarray) -> DataFrame:
    """by and v @ matrix, for a small matrix that goes with the function."""
    k, m = matrix.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k) @ matrix
            made = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * m), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), made], names=[by, "v"])

    lean = df.select(by, "v")
    return lean.mapInArrow(run, StructType([lean.schema[by], StructField("v", ArrayType(DoubleType()))]))


def _orthogonal(df: DataFrame, by: str, k: int) -> DataFrame:
    """The same span with orthonormal columns; directions of no length are dropped to zero."""
    values, turn = np.linalg.eigh(_gram(df, k))
    fine = values > max(values.max(initial=0.0), 0.0) * 1e-14
    return _times(df, by, np.where(fine, turn / np.sqrt(np.where(fine, values, 1.0)), 0.0))


def _random(term: Column, i: int) -> Column:
    """A number of about normal distribution from the hash of a term: the same in every task and run."""
    uniform = lambda salt: (F.pmod(F.xxhash64(term, F.lit(salt)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.sqrt(-2 * F.log(uniform(2 * i))) * F.cos(F.lit(2 * math.pi) * uniform(2 * i + 1))


@dataclass(frozen=True)
class SvdEncoder:
    """A fit: terms (term, idf, v), the singular values, and the number of texts."""

    terms: DataFrame
    values: tuple[float, ...]
    n: int

    def encoded(self, df: DataFrame, keys: Sequence[str], text: str, name: str = "vec") -> DataFrame:
        """keys and the vector of each text; one without a known term has zeros. keys are unique, other columns are left out."""
        k = len(self.values)
        # a row's length divides the sums, so terms are joined once and rows dealt once
        entries = term_counts(df, keys, text).join(self.terms, "term").withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
        sums = entries.groupBy(*keys).agg(_sums(k).alias("_s"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l"))
        vectors = sums.select(*keys, F.transform("_s", lambda x: x / F.col("_l")).alias(name))
        zeros = F.array(*[F.lit(0.0)] * k)
        return df.select(*keys).join(vectors, list(keys), "left").withColumn(name, F.coalesce(name, zeros))


def fitted(df: DataFrame, keys: Sequence[str], text: str, k: int = 64, passes: int = PASSES, least: int = 1) -> SvdEncoder:
    """An encoder of k numbers from these texts; terms of fewer than `least` texts are left out.

    Two passes over the texts count terms; then each of the power passes is two joins of the entries, and at the end one more
    gives the values. The entries and the thin matrices are checkpointed, so a lost executor costs one step. With fewer
    than k directions the rest of a vector is zero. A term that is in most texts makes a large group of entries, which
    adaptive execution splits.
    """
    counts = kept(term_counts(df, keys, text).select(F.struct(*keys).alias("row"), "term", "tf"))
    n = counts.select("row").distinct().count()
    idf = counts.groupBy("term").agg(F.count("*").alias("_d")).filter(F.col("_d") >= least)
    idf = kept(idf.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("_d"))) + 1).alias("idf")))
    entries = kept(_weighted(counts, idf, ["row"]))
    m = k + OVERSAMPLING
    side = kept(idf.select("term", F.array(*[_random(F.col("term"), i) for i in range(m)]).alias("v")))
    for _ in range(passes):
        rows = kept(entries.join(side, "term").groupBy("row").agg(_sums(m).alias("v")))
        rows = _orthogonal(rows, "row", m)
        side = kept(entries.join(rows, "row").groupBy("term").agg(_sums(m).alias("v")))
        side = kept(_orthogonal(side, "term", m))
    values, turn = np.linalg.eigh(_gram(entries.join(side, "term").groupBy("row").agg(_sums(m).alias("v")), m))
    order = np.argsort(-values, kind="stable")[:k]
    turned = _times(side, "term", turn[:, order])
    return SvdEncoder(kept(idf.join(turned, "term")), tuple(float(x) for x in np.sqrt(np.maximum(values[order], 0.0))), n)
