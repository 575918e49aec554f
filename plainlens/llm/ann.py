"""Approximate nearest neighbours by shifted Hilbert curves.

Equal vectors are one class and are searched once. Each of CURVES curves has its own random projection to a few dimensions and
its own shift, and orders all classes by their key on the curve. A query's candidates are the `window` classes before and
after it on every curve. How wide the window must be is measured, not guessed: the true neighbours of a bounded sample of
queries are found by one scan, their distance in rows from their query is counted on every curve, and the window is the
one that finds TARGET of them on at least one curve.

A place on a curve is taken from ranks: each projection goes through the distribution function that it has in a bounded
sample of classes, so cells fill evenly whatever the lengths of the vectors, and no outlier moves the others.

The curves are cut at key quantiles into blocks, which are dealt over the cluster with vectors in 32 bits a component, as
differences from the sample's middle; queries near a border are copied to the next block. A block slides over its keys in order and returns each query's nearest;
the blocks' answers are merged, and the merged candidates are ranked by the exact distance of the original vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import MAX_PARTS, partitions, prepare

CURVES = 24
#: Dimensions and bits per dimension of a key; below them a key has TIES bits of a hash, so that no key is many rows'.
DIMS, BITS, TIES = 6, 8, 14
#: Queries in the sample, the share of their true neighbours that the windows must hold, and the margin on the window.
SAMPLE, TARGET, MARGIN = 100, 0.95, 1.1
#: Classes in the sample that the distribution functions and the middle come from, and points of a function.
FITTED, POINTS = 10_000, 1025
#: Rows of a block at least, windows of a block at least, and most blocks of a curve.
BLOCK_ROWS, BLOCK_WINDOWS, MAX_BLOCKS = 4096, 4, 8192
#: Candidates of a block beyond k that are ranked exactly.
SPARE = 6
#: Different lengths of vectors that have queries, at most.
LENGTHS = 64
#: Parts into which the rows of a class of queries are dealt.
SALTS = 16
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows x dimensions), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projections(dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Basis and shift of each curve."""
    out = []
    for curve in range(CURVES):
        g = np.random.default_rng([SEED, curve, dims])
        basis, _ = np.linalg.qr(g.standard_normal((dims, min(DIMS, dims))))
        out.append((basis, g.random(basis.shape[1])))
    return out


def curve_keys(vectors: np.ndarray, names: np.ndarray, curve: int, basis: np.ndarray, shift: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Keys on one curve; points are the quantiles of each projection, names 64-bit hashes of the vectors, which order equal places."""
    z, at = vectors @ basis, np.linspace(0.0, 1.0, points.shape[1])
    even = np.stack([np.interp(z[:, j], points[j], at) for j in range(z.shape[1])], axis=1)
    cells = np.clip((even * 0.75 + shift * 0.25) * (1 << BITS), 0, (1 << BITS) - 1)
    tie = (names ^ np.uint64(curve * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - TIES)
    return hilbert_keys(cells, BITS) << TIES | tie.astype(np.int64)


def usable(column: str) -> Column:
    """Whether a vector has components, all of them finite, and is not zero."""
    c = F.col(column)
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays([column])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) + 0.0


def _fixed(column: pa.Array, dtype: str) -> np.ndarray:
    """Equal-length binaries as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _name(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _named(k: int):
    """Rows to classes: of the rows of a batch with equal vectors, the k least ids and whether any is asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[bytes, tuple[list, list]] = {}
            for i, q, row in zip(b.column("id").to_pylist(), b.column("q").to_pylist(), _matrix(b.column("v")) if b.num_rows else (), strict=True):
                ids, asked = found.setdefault(row.astype("<f8").tobytes(), ([], []))
                ids.append(i)
                asked.append(q)
            rows = [(_name(v), v, i, any(asked)) for v, (ids, asked) in found.items() for i in sorted(set(ids))[:k]]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=["c", "v", "id", "asked"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = _matrix(b.column("v")) if b.num_rows else ()
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([_name(r.astype("<f8").tobytes()) for r in rows], pa.binary())], names=["id", "c"])


def _classes(k: int):
    """Rows sorted by class and id to one row for each class, with its k least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = ["c", "v", "ids", "asked"]
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.bool_())
        for b in batches:
            out = []
            for c, v, i, asked in zip(*(b.column(x).to_pylist() for x in ("c", "v", "id", "asked")), strict=True):
                if held is None or held[0] != c:
                    out += [held] if held else []
                    held = [c, v, [], False]
                if len(held[2]) < k and (not held[2] or held[2][-1] != i):
                    held[2].append(i)
                held[3] = held[3] or asked
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[j]], t) for j, t in enumerate(kinds)], names=names)

    return run


class Curves:
    """Everything a worker needs to place vectors: the projections' quantiles and the middle, of a sample of vectors."""

    def __init__(self, sample: np.ndarray):
        self.dims, self.middle = sample.shape[1], np.median(sample, axis=0)
        self.points = [np.quantile(sample @ basis, np.linspace(0, 1, POINTS), axis=0).T.copy() for basis, _ in projections(self.dims)]

    def keys(self, vectors: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Keys, rows x curves."""
        out = np.zeros((len(vectors), CURVES), np.int64)
        for c, (basis, shift) in enumerate(projections(self.dims)):
            out[:, c] = curve_keys(vectors, names, c, basis, shift, self.points[c])
        return out


def _hashes(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(_fixed(column, "<u8")[:, 0]) if len(column) else np.zeros(0, np.uint64)


def _keys(curves: Curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = curves.keys(_fixed(b.column("v"), "<f8"), _hashes(b.column("c")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * CURVES), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("c"), b.column("v"), b.column("asked"), flat], names=["c", "v", "asked", "keys"])

    return run


def _scan(names: list[bytes], queries: np.ndarray, k: int):
    """The k nearest classes of a partition to each of a few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in names]
        for b in batches:
            if not b.num_rows:
                continue
            v, c = _fixed(b.column("v"), "<f8"), b.column("c").to_pylist()
            keys = _fixed_lists(b.column("keys"))
            rough = (v * v).sum(1)[None] - 2 * queries @ v.T
            for s, name in enumerate(names):
                near = np.argpartition(rough[s], min(k, len(c) - 1))[: k + 1]
                best[s] = sorted(best[s] + [(float(rough[s, j]), c[j], keys[j].tolist()) for j in near if c[j] != name])[:k]
        rows = [(s, *x) for s in range(len(names)) for x in best[s]]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["s", "d", "c", "keys"])

    return run


def _fixed_lists(column: pa.Array) -> np.ndarray:
    return pa.concat_arrays([column]).flatten().to_numpy(zero_copy_only=False).reshape(len(column), CURVES)


def _counts(bounds: list[np.ndarray]):
    """How many keys of each curve lie between neighbouring bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(x) + 1, np.int64) for x in bounds]
        for b in batches:
            if b.num_rows:
                keys = _fixed_lists(b.column("keys"))
                for c, x in enumerate(bounds):
                    count[c] += np.bincount(np.searchsorted(x, keys[:, c], side="right"), minlength=len(x) + 1)
        for c, n in enumerate(count):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["curve", "at", "n"])

    return run


def measured_window(keyed: DataFrame, k: int, n: int, target: float = TARGET, sample: int = SAMPLE) -> tuple[int, float]:
    """The window that finds `target` of the true neighbours of a sample of queries, with MARGIN, and the share it finds."""
    asked = keyed.filter("asked").orderBy(F.xxhash64("c"), "c").limit(sample).select("c", "v", "keys").collect()
    queries = np.array([np.frombuffer(r.v, "<f8") for r in asked])
    found = keyed.mapInArrow(_scan([bytes(r.c) for r in asked], queries, k), "s int, d double, c binary, keys array<long>")
    order = Window.partitionBy("s").orderBy("d", "c")  # one list of k for each partition and query
    true = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("s", "keys").collect()
    if not true:
        return 1, 1.0
    own, near = np.array([r["keys"] for r in asked])[[r.s for r in true]], np.array([r["keys"] for r in true])
    bounds = [np.unique(np.concatenate([own[:, c], near[:, c]])) for c in range(CURVES)]
    counts = keyed.mapInArrow(_counts(bounds), "curve int, at int, n long").groupBy("curve", "at").agg(F.sum("n").alias("n")).collect()
    rank = [np.zeros(len(x) + 1, np.int64) for x in bounds]
    for r in counts:
        rank[r.curve][r.at] = r.n
    gap = np.full(len(true), n)
    for c, x in enumerate(bounds):
        upto = np.cumsum(rank[c])
        gap = np.minimum(gap, np.abs(upto[np.searchsorted(x, near[:, c])] - upto[np.searchsorted(x, own[:, c])]))
    window = int(np.ceil(np.quantile(gap, target, method="higher") * MARGIN)) + 1
    return window, float((gap <= window).mean())


def _deal(cuts: list[np.ndarray], low: list[np.ndarray], high: list[np.ndarray], middle: np.ndarray):
    """Every class once on every curve, and its queries: to their own block, and to the next where they are near its border."""
    kinds = [("curve", pa.int32()), ("block", pa.int32()), ("key", pa.int64()), ("query", pa.bool_()), ("c", pa.binary()), ("x", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            with np.errstate(over="ignore"):
                small = (_fixed(b.column("v"), "<f8") - middle).astype("<f4")
            x = pa.array([r.tobytes() for r in small], pa.binary())
            keys, asked = _fixed_lists(b.column("keys")), np.flatnonzero(b.column("asked").to_numpy(zero_copy_only=False))
            for c in range(CURVES):
                own = np.searchsorted(cuts[c], keys[:, c], side="left")
                mine = own[asked]
                before = asked[(mine > 0) & (keys[asked, c] < np.append(low[c], 0)[np.maximum(mine, 1) - 1])]
                after = asked[(mine < len(cuts[c])) & (keys[asked, c] > np.append(high[c], 0)[np.minimum(mine, len(cuts[c]))])]
                row = np.concatenate([np.arange(b.num_rows), asked, before, after])
                block = np.concatenate([own, mine, own[before] - 1, own[after] + 1])
                at = pa.array(row)
                columns = [np.full(len(row), c), block, keys[row, c], np.arange(len(row)) >= b.num_rows]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, (_, t) in zip(columns, kinds, strict=False)] + [b.column("c").take(at), x.take(at)], names=[n for n, _ in kinds])

    return run


def _nearest(window: int, keep: int):
    def block(key: np.ndarray, query: np.ndarray, c: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        rows, asked = np.flatnonzero(~query), np.flatnonzero(query)
        r, place = x[rows].astype(np.float64), np.searchsorted(key[rows], key[asked])
        square, out = (r * r).sum(1), ([], [], [])
        for at in range(0, len(asked) if len(rows) else 0, 64):
            part, here = asked[at : at + 64], place[at : at + 64]
            lo, hi = max(0, here[0] - window), min(len(rows), here[-1] + window + 1)
            if lo >= hi:
                continue
            a = x[part].astype(np.float64)
            d = square[None, lo:hi] - 2 * a @ r[lo:hi].T
            j = np.arange(lo, hi)[None]
            d[(j < here[:, None] - window) | (j > here[:, None] + window)] = np.inf
            m = min(keep, hi - lo)
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            score = np.take_along_axis(d, near, 1)
            i, p = np.nonzero(np.isfinite(score))
            out[0].append(c[part[i]])
            out[1].append(c[rows[lo + near[i, p]]])
            out[2].append(score[i, p] + (a * a).sum(1)[i])
        join = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
        return pa.RecordBatch.from_arrays([join(out[0], pa.binary()), join(out[1], pa.binary()), join(out[2], pa.float64())], names=["q", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            curve, at = b.column("curve").to_numpy(), b.column("block").to_numpy()
            new = np.concatenate([[0], np.flatnonzero((curve[1:] != curve[:-1]) | (at[1:] != at[:-1])) + 1, [b.num_rows]])
            fields = (b.column("key").to_numpy(), b.column("query").to_numpy(zero_copy_only=False), b.column("c").to_numpy(zero_copy_only=False), _fixed(b.column("x"), "<f4"))
            for s, e in zip(new, new[1:], strict=False):
                if held and (curve[s], at[s]) != last:
                    yield block(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                last = (curve[s], at[s])
                held.append(tuple(f[s:e] for f in fields))
        if held:
            yield block(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            score = np.sqrt(((_fixed(b.column("qv"), "<f8") - _fixed(b.column("v"), "<f8")) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("ids"), pa.array(score)], names=["q", "ids", "score"])


def neighbours(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 10, target: float = TARGET, window: int | None = None) -> DataFrame:
    """Each query's k nearest rows found, by Euclidean distance: query_id, rank (from 1), vec_id, score.

    Every usable row is a candidate but the query's own; ties go to the smaller id. Vectors that are null, empty, zero or
    hold a null or non-finite component take no part, as do null ids; those of another length than the query's are no
    candidates, and each length (LENGTHS at most, more are an error) is searched by itself. Rows that repeat
    an id with equal vectors count once; with different ones each is a row of its own, and none is a candidate of the others.
    A class of equal vectors may hold any part of the rows. Fewer candidates give fewer rows, and no query or an empty table
    none. Other columns are ignored. `target` is the recall the window is measured for; `window` sets it instead.
    """
    spark = prepare(vectors.sparkSession)
    doubles = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), doubles.alias("v"), usable(f"`{vector_col}`").alias("ok"))
    rows = rows.filter("ok AND id IS NOT NULL").select("id", "q", "v")
    lengths = [r[0] for r in rows.groupBy(F.size("v").alias("d")).agg(F.max("q").alias("q")).filter("q").orderBy("d").limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"queries have more than {LENGTHS} different lengths")
    parts = [_of_one_length(vectors, rows.filter(F.size("v") == d), k, target, window) for d in lengths]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def _of_one_length(vectors: DataFrame, rows: DataFrame, k: int, target: float, window: int | None) -> DataFrame:
    """neighbours, of usable rows (id, q, v) of one length."""
    spark = vectors.sparkSession
    width = partitions(spark, vectors)
    named = rows.mapInArrow(_named(k + 1), "c binary, v binary, id long, asked boolean")
    sorted_rows = named.repartition(width, "c").sortWithinPartitions("c", "id")
    classes = sorted_rows.mapInArrow(_classes(k + 1), "c binary, v binary, ids array<long>, asked boolean").checkpoint()
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("c"), "c").limit(FITTED).select("v").collect()
    curves = Curves(np.array([np.frombuffer(r.v, "<f8") for r in sample]))
    keyed = classes.mapInArrow(_keys(curves), "c binary, v binary, asked boolean, keys array<long>").checkpoint()
    window = window or measured_window(keyed, k, n, target)[0]
    blocks = max(1, min(MAX_BLOCKS, n // max(BLOCK_ROWS, BLOCK_WINDOWS * window)))
    accuracy = 40 * blocks + 1000
    near = 1.2 * window / n + 2 / accuracy
    share = [min(1.0, max(0.0, b / blocks + step)) for b in range(1, blocks) for step in (0, near, -near)]
    cut = {}
    if share:
        spread_out = keyed.select(F.posexplode("keys").alias("curve", "key"))
        cut = {r.curve: np.array(r.cuts).reshape(-1, 3) for r in spread_out.groupBy("curve").agg(F.percentile_approx("key", share, accuracy).alias("cuts")).collect()}
    none = np.zeros((0, 3), np.int64)
    per_curve = [cut.get(c, none) for c in range(CURVES)]
    sides = [[x[:, j] for x in per_curve] for j in range(3)]
    dealt = keyed.mapInArrow(_deal(*sides, curves.middle), "curve int, block int, key long, query boolean, c binary, x binary")
    dealt = dealt.repartition(max(width, min(MAX_PARTS, CURVES * blocks // 4)), "curve", "block").sortWithinPartitions("curve", "block", "key", "c")
    pairs = dealt.mapInArrow(_nearest(window, k + 1 + SPARE), "q binary, c binary, d double").groupBy("q", "c").agg(F.min("d").alias("d"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("d", "c"))), 1, k + 1 + SPARE)  # at most curves x 3 blocks x (k + 1 + SPARE)
    merged = pairs.groupBy("q").agg(best.alias("best")).select("q", F.explode("best.c").alias("c"))
    judged = merged.join(classes.select("c", "v", "ids"), "c").join(classes.filter("asked").select(F.col("c").alias("q"), F.col("v").alias("qv")), "q")
    scored = judged.select("q", "ids", "v", "qv").mapInArrow(_exact, "q binary, ids array<long>, score double").select("q", "score", F.explode("ids").alias("vec_id"))
    few = scored.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = rows.filter("q").select("id", "v").mapInArrow(_asked, "id long, c binary").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    joined = asked.join(salted.withColumnRenamed("q", "c"), ["c", "salt"]).filter("id <> vec_id")
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("id", "c").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
