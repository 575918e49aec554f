import math

import numpy as np
import pytest

from plainlens.llm import whitening
from plainlens.llm.whitening import whitening_report


def brute(rows, components=4):
    """{(id, component): (n, deviation, |whitened|, explained)} in plain numpy and whole numbers."""
    fine = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not fine:
        return {}
    fit = np.array(sorted({tuple(x) for _, x in fine}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = ((fit * n - s) / n).astype(float)
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    out = {}
    for i, x in fine:
        dev = int(((np.array(x, dtype=object) * n - s) ** 2).sum())
        c = ((np.array(x, dtype=object) * n - s) / n).astype(float)
        for k in range(min(components, len(e))):
            out[(i, k + 1)] = (n, dev, abs(c @ u[:, -1 - k]) / math.sqrt(e[-1 - k]), e[-1 - k] / np.trace(v))
    return out


def check(spark, rows, type_="float", tight=1e-8):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{type_}>").repartition(3)
    if type_ == "float":
        rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    got, want = whitening_report(df).collect(), brute(rows)
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        n, dev, w, share = want[(r.vec_id, r.component)]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(abs(r.whitened) - w) <= tight * max(1, w) and abs(r.explained - share) <= 1e-9 * share
        assert 0 <= r.identity_error < 1e-9
    return got


def flat(n, d, seed=0):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_flat_spectrum_needs_the_full_dimension(spark):
    x = flat(600, 24)
    check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])
    df = spark.createDataFrame([([float(c) for c in v],) for v in x], "v array<double>")
    model = whitening.fit(df, "v")
    assert model.full and model.passes < whitening.PASSES


def test_steep_spectrum_settles_in_a_small_basis(spark):
    x = np.random.default_rng(1).standard_normal((500, 60)) * 50.0 * 10.0 ** -np.arange(60.0).clip(0, 6)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    check(spark, rows, "double")
    model = whitening.fit(spark.createDataFrame([(v,) for _, v in rows], "v array<double>"), "v")
    assert not model.full and 2 <= model.passes <= whitening.PASSES
    assert np.allclose(np.abs(model.components.T @ model.components), np.eye(4), atol=1e-12)


def test_copies_count_once_and_others_take_no_part(spark):
    x = flat(80, 6, 2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(100 + i, rows[3][1]) for i in range(200)] + [(7, rows[7][1])] * 2 + [(400, None), (401, []), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("-inf")] + [0.0] * 5), (None, rows[9][1]), (405, [-0.0] * 6)]
    got = check(spark, rows)
    assert {r.n for r in got} == {81} and sum(r.vec_id == 7 for r in got) == 12


def test_fewer_dimensions_large_entries_and_no_variance(spark):
    check(spark, [(i, [float(a), float(b)]) for i, (a, b) in enumerate(flat(50, 2, 3) * 9)])
    big = [(i, [float(c) * 1e9 for c in v]) for i, v in enumerate(flat(40, 5, 4))]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got, want = whitening_report(df).collect(), brute(big)
    assert all((r.deviation if want[(r.vec_id, r.component)][1] < 2**63 else None) == r.deviation for r in got)
    assert all(abs(abs(r.whitened) - want[(r.vec_id, r.component)][2]) < 1e-6 for r in got)
    one = whitening_report(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, 0.0)] * 4
    line = whitening_report(spark.createDataFrame([(i, [float(i), 0.0, 0.0]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 12)) for r in line} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}


def test_empty_tables_lengths_and_clashing_columns(spark):
    for rows in ([], [(1, None)], [(1, [None])]):
        assert whitening_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []
    with pytest.raises(ValueError, match="from 1 to 2"):
        whitening_report(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    rows = [(i, [float(c) for c in v], "w", "d", "x") for i, v in enumerate(flat(30, 4, 5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, deviation string, x string")
    assert whitening_report(df).count() == 120
    model = whitening.fit(df, "embedding")
    out = whitening.whitened(df.drop("whitened", "deviation"), "embedding", model)
    assert out.columns == ["vec_id", "embedding", "x", "whitened", "deviation"] and all(len(r.whitened) == 4 and r.x == "x" for r in out.collect())
