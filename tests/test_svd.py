import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plainlens.models import svd
from plainlens.operators import similarity

TOPICS = ["dose remédio tomar hora água".split(), "guardar lugar seco frasco luz".split(), "efeito febre dor tontura náusea".split(), "médico exame sangue rim fígado".split()]


def corpus(n=80):
    r = random.Random(7)
    rows = []
    for i in range(n):
        words = r.choices(TOPICS[i % 4], k=r.randint(6, 14)) + r.choices([w for t in TOPICS for w in t], k=2) + ["o", f"x{i % 11}"]
        rows.append((i, i % 4, " ".join(words).capitalize()))
    return rows + [(900, 9, ""), (901, 9, None)]


def matrix(texts):
    counts = [Counter((t or "").lower().split()) for t in texts]
    n, df = sum(bool(c) for c in counts), Counter(w for c in counts for w in c)
    terms = sorted(df)
    a = np.array([[(1 + math.log(c[w])) * (math.log((1 + n) / (1 + df[w])) + 1) if c[w] else 0.0 for w in terms] for c in counts])
    length = np.linalg.norm(a, axis=1)
    return a / np.where(length > 0, length, 1)[:, None], terms


def test_subspace_against_numpy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, part int, t string").repartition(3)
    a, terms = matrix([t for _, _, t in rows])
    _, values, right = np.linalg.svd(a, full_matrices=False)
    model = svd.fitted(df, ["id", "part"], "t", k=4, passes=8)
    assert model.n == 80 and np.allclose(model.values, values[:4], rtol=1e-6)
    learned = {r.term: r.v for r in model.terms.collect()}
    assert sorted(learned) == terms
    v = np.array([learned[w] for w in terms])
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-9) and np.abs(v @ v.T - right[:4].T @ right[:4]).max() < 1e-4
    got = {(r.id, r.part): r.vec for r in model.encoded(df, ["id", "part"], "t").collect()}
    assert len(got) == 82 and got[900, 9] == got[901, 9] == [0.0] * 4
    assert np.allclose([got[i, p] for i, p, _ in rows], a @ v, atol=1e-9)
    same = np.array([got[i, p] for i, p, _ in rows[:80]])
    unit = same / np.linalg.norm(same, axis=1)[:, None]
    near = unit @ unit.T
    topic = np.arange(80) % 4
    assert near[topic[:, None] == topic].mean() > near[topic[:, None] != topic].mean() + 0.4  # texts of a topic are near


def test_more_numbers_than_directions_and_unknown_terms(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "b c")], "id long, t string")
    model = svd.fitted(df, ["id"], "t", k=5)
    assert len(model.values) == 5 and sum(x > 1e-6 for x in model.values) == 3
    other = spark.createDataFrame([(1, "z"), (2, "a z")], "id long, t string")
    got = {r.id: r.vec for r in model.encoded(other, ["id"], "t").collect()}
    assert got[1] == [0.0] * 5 and abs(np.linalg.norm(got[2]) - 1) < 1e-9
    assert svd.fitted(df.limit(0), ["id"], "t", k=2).encoded(other, ["id"], "t").count() == 2


def test_sections_by_the_learned_encoder(spark):
    heads = ["1. PARA QUE ESTE MEDICAMENTO É INDICADO?", "6. COMO DEVO USAR ESTE MEDICAMENTO?"]
    r = random.Random(3)
    body = lambda t: " ".join(r.choices(TOPICS[t], k=12))
    rows = [(i, f"{heads[0]}\n{body(2)}\n{heads[1]}\n{body(0)}", f"{heads[0]}\n{body(2)}\n{heads[1]}\n{body(0 if i % 2 else 1)}") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    texts = df.select("id", "a").union(df.select((F.col("id") + 100).alias("id"), F.col("b").alias("a")))
    model = svd.fitted(texts, ["id"], "a", k=4)
    scored = {(x.id, x.sec): x.semantic_f1 for x in similarity.section_scores(df, "id", "a", "b", model).filter("sec IN ('sec_1', 'sec_6')").collect()}
    assert min(v for (i, s), v in scored.items() if s == "sec_1" or i % 2) > max(v for (i, s), v in scored.items() if s == "sec_6" and not i % 2)
