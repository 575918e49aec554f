import random

import numpy as np

from plainlens.llm import mixing
from plainlens.llm.queries import op8_source_mix  # noqa: F401


def targets(sizes):
    """Sources in order with their sizes: targets by repeated resharing."""
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sizes)}
    left, out, free = 1.5 * sum(sizes.values()), {}, dict(sizes)
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            del free[s]
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def corpus(seed, n=600):
    r = random.Random(seed)
    names = ["a", "B", "é", "", "src9", "src10", None, "one"]
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 3, 3, 40, r.randint(1, 300)]))), r.choice(names[:-1])) for i in range(n)]
    rows += [(n, "only one here", "one"), (n + 1, None, "a"), (n + 2, "same", "B"), (n + 2, "same", "B"), (None, "x y", "a")]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
        got = mixing.mix_report(docs).collect()
        again = mixing.mix_report(docs.repartition(7)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len((t or "").split())
        ordered = {s: sizes[s] for s in sorted((x for x in sizes if x is not None)) + [None]}
        want = targets(ordered)
        src = {i: s for i, _, s in rows}
        taken = dict.fromkeys(sizes, 0)
        for r in got:
            s = src[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
            assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
            taken[s] += r.taken
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]), (s, taken[s], want[s])


def test_hot_size_class(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'a b c d' AS text", "'s' AS source", "1 AS copies")
    got = mixing.mixed(docs, bucket=100).collect()
    assert sum(r.taken for r in got) == 24_000 and {r.copies for r in got} == {1, 2}


def test_mixture_rows(spark):
    docs = spark.createDataFrame(corpus(3), "doc_id long, text string, source string")
    report = mixing.mix_report(docs).collect()
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns
    assert mix.count() == sum(r.copies for r in report)
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0


def brute_dual(size, count, target, prior=0.75):
    """The dual by bisection, apart from the operator's own solver."""
    x = size / ((size * count).sum() / count[size > 0].sum())
    words = lambda d: (count * size * 2 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + d * x, -700, 700)))).sum()
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < target else (low, mid)
    return (low + high) / 2


def test_newton_against_bisection(spark):
    size, count = [0, 3, 40, 300, 20_000], [5, 400, 300, 200, 2]
    total = sum(a * b for a, b in zip(size, count))
    parts = {f"s{i}": p for i, p in enumerate((0.01, 0.3, 0.74, 0.75, 0.76, 0.97, 0.9999))}
    rows = [(s, a, b, total, 2 * p * total) for s, p in parts.items() for a, b in zip(size, count)]
    rows += [("all", 5, 10, 50, 100.0), ("none", 5, 10, 50, 0.0), ("empty", 0, 9, 0, 0.0)]
    classes = spark.createDataFrame(rows, "src string, size long, count long, source_size long, target double")
    found, rounds = mixing.duals(classes)
    got = {r.src: r.dual for r in found.collect()}
    assert set(got) == set(parts) and 3 < rounds < mixing.ROUNDS
    for s, p in parts.items():
        want = brute_dual(np.array(size, float), np.array(count), 2 * p * total)
        assert abs(got[s] - want) <= 1e-6 * (1 + abs(want)) and np.sign(round(got[s], 9)) == np.sign(round(p - 0.75, 9))


def test_rates_differ_by_size(spark):
    rows = [(i, " ".join("w" * (5 if i % 2 else 200)), "ab"[i // 2 % 2]) for i in range(2000)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    mean = lambda s, n: np.mean([r.copies for r in got if "ab"[r.doc_id // 2 % 2] == s and r.size == n])
    assert mean("b", 5) - mean("b", 200) > 0.3 and mean("a", 5) == mean("a", 200) == 2


def test_clashing_columns_and_rows_that_differ_elsewhere(spark):
    rows = [(1, " ".join("w" * 30), "a", "orig", i) for i in range(5)] + [(i, " ".join("v" * i), "b", "orig", 0) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _k string, _inner0 int")
    first, again = (sorted(map(tuple, mixing.mixture(d).collect())) for d in (docs, docs.repartition(6)))
    assert first == again and {r[3] for r in first} == {"orig"} and len(first) == sum(r.copies for r in mixing.mix_report(docs).collect())
