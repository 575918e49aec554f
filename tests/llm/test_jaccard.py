import random

from plainlens.llm import jaccard


def gram_set(text, n=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, t=0.8):
    s = [gram_set(x) for _, x in rows]
    n = len(rows)
    link = [[i != j and bool(s[i]) and bool(s[j]) and len(s[i] & s[j]) >= t * len(s[i] | s[j]) - 1e-9 for j in range(n)] for i in range(n)]
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if link[i][j] and label[j] < label[i]:
                    label[i], changed = label[j], True
    return {rows[i][0]: (label[i], sum(link[i])) for i in range(n)}


def corpus(seed, n=40):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, bases = [], []
    for i in range(n):
        if bases and r.random() < 0.6:
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 2, 4, 8, 12])):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.randint(1, 250))]
            bases.append(w)
        rows.append((i, (" " if i % 3 else "\n").join(w)))
    return rows + [(n, None), (n + 1, " \t "), (n + 2, "a b"), (n + 3, "a  b"), (n + 4, "a b c")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = brute(rows)
        for block in (jaccard.BLOCK_GRAMS, 300):
            got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(docs, block_grams=block).collect()}
            assert got == want
    assert any(v[1] > 2 for v in want.values())


def test_bands_reach_recall():
    b, r = jaccard.bands_for(0.8, 0.9999, 128)
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.9999


def test_nulls_repeats_and_extra_columns(spark):
    t = " ".join(f"x{i}" for i in range(30))
    docs = spark.createDataFrame([(None, t, 1, 2), (5, t, 1, 2), (5, t, 1, 2), (7, "other words here", 1, 2), (7, t + " y", 1, 2)], "doc_id long, text string, node int, band int")
    got = sorted(((r.doc_id or -1), r.class_id or -1, r.n_links) for r in jaccard.similar_documents(docs).collect())
    assert got == [(-1, -1, 3), (5, -1, 3), (5, -1, 3), (7, -1, 3), (7, 7, 0)]
    v = t + " y z"
    both = spark.createDataFrame([(1, t), (1, t), (2, v), (2, v)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar_documents(both).collect()) == [(1, 1, 3)] * 2 + [(2, 1, 3)] * 2
    kept = jaccard.one_of_each(spark.createDataFrame([(1, t, "a"), (1, t, "a"), (2, t, "b"), (3, None, "c")], "doc_id long, text string, source string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert jaccard.similar_documents(docs.limit(0)).count() == 0
