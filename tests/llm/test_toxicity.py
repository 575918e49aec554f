import os

import numpy as np
import pytest

from plainlens.llm import toxicity as T

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables are absent")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learn, held = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    got = {r.doc_id: r for r in T.toxicity(docs, learn).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    seeds = {w for s in T.CATEGORIES.values() for w in s}
    rows = [(r.doc_id, r.toxic) for r in held.collect()]
    has = lambda i: bool(set(T._WORD.findall(text[i].lower())) & seeds)
    sure, other = [i for i, t in rows if t and has(i)], [i for i, t in rows if t and not has(i)]
    clean = [i for i, t in rows if not t]
    assert len(sure) > 30
    assert np.mean([got[i].is_toxic for i in sure]) > 0.9
    # some toxic documents without a seed word are junk text that holds no other word of the toxic ones either
    assert len(other) > 30 and np.mean([got[i].is_toxic for i in other]) > 0.75
    assert np.mean([got[i].is_toxic for i in clean]) < 0.01


def test_fit_and_edges(spark):
    rows = [(i, f"idiot v{i} u{i} w{i * i} scum" if i % 5 == 0 else f"fine v{i} u{i} words w{i % 7}", "x", 1.0) for i in range(200)]
    rows += [(900, None, "x", 1.0), (901, "", "x", 1.0), (902, "an idiot", "x", 1.0), (None, "good", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, p_toxic double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(5, 1), (None, 1), (902, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and all(got[i].is_toxic == (i % 5 == 0) for i in range(200))
    assert got[902].p_insult > 0.1 > got[None].p_toxic and not got[900].is_toxic
    none = T.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.is_toxic for r in none)
    assert T.toxicity(docs.limit(0), labels).count() == 0


def test_probabilities_by_brute_force(spark):
    """Every document's chain of probabilities by plain loops over its words, with the fitted weights."""
    import math

    rows = [(i, f"idiot v{i} u{i % 9} Trash! w{i * i}" if i % 4 == 0 else f"fine v{i} idiots? u{i} w{i % 7}" if i % 9 else f"scum, vermin {i}") for i in range(300)]
    docs = spark.createDataFrame([*rows, (301, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i % 9 == 0)) for i in range(280)], "doc_id long, toxic int")
    chain = T.fit(docs, labels)
    assert sum((w != 0).any() for w in chain.words) >= 3 and chain.constant[T.CHAIN.index("threat")] == -12.0  # no such word here
    for r in T.toxicity(docs, labels).collect():
        text = dict(rows).get(r.doc_id) or ""
        each = [b for w in set(T._WORD.findall(text.lower())) for b in set(T.buckets(w))]
        features = set(each) | {T.twice(b) for b in each if each.count(b) > 1}
        p = []
        for w, link, c in zip(chain.words, chain.links, chain.constant):
            z = c + math.fsum(w[b] for b in features) + math.fsum(a * b for a, b in zip(link, p))
            p.append(1 / (1 + math.exp(-z)))
        for name, want, least in zip(T.CHAIN, p, chain.threshold):
            assert abs(r[f"p_{name}"] - want) < 1e-9 and r[f"is_{name}"] == (want >= least)


def test_fit_is_the_minimum():
    g = np.random.default_rng(0)
    lists = [np.flatnonzero(g.random(30) < 0.3).astype(np.int64) for _ in range(400)]
    dense = g.random((400, 2))
    y = (np.array([len(set(a) & {1, 2, 3}) for a in lists]) + dense[:, 0] + g.normal(0, 0.5, 400) > 1.6).astype(float)
    x, copies = T.Rows(lists), np.arange(1200).reshape(400, 3)
    w, link, c = T.fit_logistic(x, dense, y, copies, 30, decay=1e-3)
    free = np.flatnonzero(w)
    assert {1, 2, 3} <= set(free.tolist())

    def loss(w, link, c):
        z = x.times(w) + dense @ link + c
        return (np.logaddexp(0, z) - y * z).mean() + 1e-3 / 2 * ((w * w).sum() + (link * link).sum())

    best = loss(w, link, c)
    for _ in range(200):  # no small step from there is better
        step = np.zeros(30)
        step[free] = g.normal(0, 0.05, len(free))
        assert loss(w + step, link + g.normal(0, 0.05, 2), c + g.normal(0, 0.05)) >= best - 1e-9


def test_near_copies_share_a_fold():
    g = np.random.default_rng(2)
    lists = [np.sort(g.choice(T.DIMS, 200, replace=False)) for _ in range(300)]
    fold = T.folds(lists + lists)
    assert (fold[:300] == fold[300:]).all() and np.bincount(fold, minlength=T.FOLDS).min() > 60
