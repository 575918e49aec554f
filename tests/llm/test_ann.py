import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainlens.llm import ann

SF = "/root/testdata/sf0.1"


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        key = ann.hilbert_keys(cells, bits)
        assert sorted(key.tolist()) == list(range(1 << (dims * bits)))
        steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1)
        assert (steps == 1).all()


def recall(x, ids, asked, got):
    """Share of each query's ten nearest by brute force that were found; every answer must be sorted and exact."""
    hits = total = 0
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:10]
        mine = got[int(ids[q])]
        assert sorted(mine) == list(range(1, 11))
        assert all(abs(d[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for v, s in mine.values())
        assert [s for _, s in (mine[i] for i in sorted(mine))] == sorted(s for _, s in mine.values())
        hits += len({int(ids[i]) for i in order} & {v for v, _ in mine.values()})
        total += 10
    return hits / total


def found(df, where, **options):
    got = {}
    for r in ann.neighbours(df, "vec_id", "embedding", where, **options).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return got


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def test_recall_with_small_windows(spark, monkeypatch):
    """Vectors around many centres: a window of a fiftieth of the rows finds the neighbours, over many blocks."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    g = np.random.default_rng(1)
    x = g.standard_normal((300, 24))[g.integers(0, 300, 10_000)] + 0.35 * g.standard_normal((10_000, 24))
    df, asked = table(spark, x), np.arange(0, 10_000, 100)
    window = 60
    assert recall(x, np.arange(len(x)), asked, found(df, F.col("vec_id") % 100 == 0, window=window)) >= 0.9
    assert 2 * window * ann.CURVES < 0.3 * len(x)


def test_measured_window_reaches_its_target(spark):
    """Uniform vectors, the worst case: the window is measured, and the recall of all queries is what the sample says."""
    x = np.random.default_rng(2).standard_normal((6000, 16))
    df, asked = table(spark, x), np.arange(0, 6000, 20)
    assert recall(x, np.arange(len(x)), asked, found(df, F.col("vec_id") % 20 == 0)) >= 0.92
    assert recall(x, np.arange(len(x)), asked, found(df, F.col("vec_id") % 20 == 0, target=0.5)) < 0.9  # windows do restrict


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables are absent")
def test_recall_of_the_tables(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    assert recall(x, ids, np.flatnonzero(ids % 100 == 0), found(df, F.col("vec_id") % 100 == 0)) >= 0.9


def test_edges(spark):
    rows = [(0, [1.0, 0.0], 9), (1, [1.0, 0.0], 9), (2, [0.0, 1.0], 9), (3, None, 9), (4, [0.0, 0.0], 9), (5, [float("nan"), 1.0], 9), (6, [None, 1.0], 9), (7, [float("inf"), 1.0], 9), (8, [], 9), (None, [1.0, 1.0], 9), (2, [0.0, 1.0], 9), (100, [1.0, 0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.neighbours(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.neighbours(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


def test_hot_vector(spark):
    """A third of the rows is one vector; queries beside it find its copies of least id, and its own queries the others."""
    g = np.random.default_rng(3)
    hot = np.array([0.9, 0.4])
    x = np.concatenate([g.uniform(-2, 2, (6000, 2)), np.repeat(hot[None], 3000, 0), hot + g.normal(0, 0.001, (60, 2))])
    df = table(spark, x)
    got = found(df, F.col("vec_id") >= 8990)
    assert all([got[q][r] for r in range(1, 11)] == [(6000 + r - 1, 0.0) for r in range(1, 11)] for q in range(8990, 9000))
    assert recall(x, np.arange(len(x)), range(9000, len(x)), got) >= 0.9


@pytest.mark.parametrize("large", [1e4, 1e6, 1e30])
def test_one_large_vector(spark, large):
    """An outlier moves neither the curves nor the precision of the others."""
    x = np.random.default_rng(5).standard_normal((3000, 16)) / 4
    x[1234] = large
    df, asked = table(spark, x), np.arange(0, 3000, 30)
    assert recall(x, np.arange(len(x)), asked, found(df, F.col("vec_id") % 30 == 0)) >= 0.9


def test_lengths_over_six_orders_and_far_from_zero(spark):
    g = np.random.default_rng(6)
    wide = g.standard_normal((3000, 12)) * 10.0 ** g.uniform(-3, 3, (3000, 1))
    far = 1e4 + g.standard_normal((3000, 12))
    for x in (wide, far):
        df, asked = table(spark, x), np.arange(0, 3000, 30)
        assert recall(x, np.arange(len(x)), asked, found(df, F.col("vec_id") % 30 == 0)) >= 0.9


def test_each_length_is_searched_by_itself(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0]), (3, [9.0, 0.0, 0.0]), (4, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, F.col("vec_id") < 2) == {0: {1: (2, 1.0)}, 1: {1: (3, 8.0)}}
