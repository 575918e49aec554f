import math

import numpy as np
from pyspark.sql import functions as F

from plainlens.operators import similarity, stats


def pairs_of(spark, n=60):
    g = np.random.default_rng(3)
    def side(seed):
        rows = []
        for k in range(n):
            key = "hot" if k % 3 else f"d{k % 5}"
            rows += [(key, 10 * k + j, float(1 + (k + j + seed) % 4), [float(x) for x in g.standard_normal(6)]) for j in range(4)]
        return rows + [("d0", 9_001, 2.0, [0.0] * 6), ("d1", 9_002, 1.0, None), (f"only{seed}", 1, 1.0, [1.0] * 6), ("zero", 5, 2.0, [0.0] * 6)]
    schema = "doc string, chunk long, weight double, vec array<double>"
    return spark.createDataFrame(side(1), schema).repartition(3), spark.createDataFrame(side(2), schema).repartition(3)


def test_alignment_by_blocks(spark):
    a, b = pairs_of(spark)
    want = {r.doc: r for r in similarity.best_alignment(similarity.chunk_pairs(a, b, "doc"), "doc").collect()}
    for block, together in ((512, 8), (20, 2), (1, 1)):
        got = similarity.aligned(a, b, "doc", block, together)
        rows = {r.doc: r for r in got.collect()}
        assert set(rows) == set(want) and "only1" not in rows
        for k, r in rows.items():
            for c in ("a_to_b", "b_to_a", "semantic_f1"):
                assert (r[c] is None and want[k][c] is None) or abs(r[c] - want[k][c]) < 1e-12, (k, c)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "a_vec" not in plan and "sim#" not in plan


def direct(x, grid, h):
    return np.exp(-0.5 * ((np.array(grid)[:, None] - x[None]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))


def test_density_within_its_bound(spark, monkeypatch):
    g = np.random.default_rng(1)
    x = np.concatenate([g.normal(0.3, 0.05, 400), g.normal(0.7, 0.01, 100), [5.0, -3.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
    for rule in ("silverman", "scott"):
        n, h = stats.bandwidth(df, "x", rule)
        q = np.quantile(x, [0.25, 0.75])
        want = x.std(ddof=1) * len(x) ** -0.2 if rule == "scott" else 0.9 * min(x.std(ddof=1), (q[1] - q[0]) / 1.349) * len(x) ** -0.2
        assert n == len(x) and abs(h - want) < 1e-12
        for fine, most in ((4096, 1 << 18), (16, 1 << 18), (4096, 300)):
            monkeypatch.setattr(stats, "FINE", fine)
            monkeypatch.setattr(stats, "MOST_BINS", most)
            rows = stats.kernel_density(df, "x", 0.0, 1.0, 1001, rule).orderBy("point").collect()
            width = max(h / fine, (1 + 18 * h) / (most - 2))
            error = np.abs(np.array([r.density for r in rows]) - direct(x, [r.x for r in rows], h)).max()
            assert error <= (width / h) ** 2 / 4 / (h * math.sqrt(2 * math.pi)) + 1e-12


def test_density_of_a_fine_grid_is_one_scan(spark):
    df = spark.range(5000).select((F.sin("id") * 3).alias("x"))
    rows = stats.kernel_density(df, "x", -4.0, 4.0, 10_000).collect()
    x = np.sin(np.arange(5000)) * 3
    assert len(rows) == 10_000
    some = rows[::500]
    assert np.allclose([r.density for r in some], direct(x, [r.x for r in some], stats.bandwidth(df, "x")[1]), atol=1e-6)
