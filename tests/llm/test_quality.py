import math
import random

import numpy as np

from plainlens.llm import quality as Q


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    rep = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(rep)


def test_counts():
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", " ", "a b a ", "\x1c"]) for _ in range(r.randint(0, 60)))
        assert Q.text_counts(t)[:5] == brute_counts(t)


def test_bound_is_exact():
    # P(X <= 2 | n = 50, p) = 0.05 at p = 0.1206...; and 1 - error ** (1 / n) without rejections
    assert abs(Q.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    p = Q.upper_bound(2, 50, 0.05)
    assert abs((1 - p) ** 50 + 50 * p * (1 - p) ** 49 + 1225 * p**2 * (1 - p) ** 48 - 0.05) < 1e-9
    assert Q.upper_bound(0, 0, 0.05) == 1.0 == Q.upper_bound(5, 5, 0.05)


def test_verdicts(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows, labels = [], []
    for i in range(6000):
        good = i % 6 != 0
        w = [word() for _ in range(60)]
        rows.append((i, " ".join(w if good else [x + "###" for x in w]), "en"))
        labels.append((i, int(good)))
    rows += [(9001, None, "en"), (9002, "a b c", None), (9003, " ".join(["x y z"] * 40), "fr"), (9003, " ".join(word() for _ in range(70)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    lab = spark.createDataFrame(labels + [(9002, None)], "doc_id long, quality int")
    got = Q.quality_report(docs, lab).collect()
    assert all(x.kept == (x.doc_id % 6 != 0) for x in got if x.doc_id < 6000)
    rest = sorted((x.doc_id, x.n_words, x.base_failed, x.kept) for x in got if x.doc_id > 9000)
    assert rest == [(9001, 0, True, False), (9002, 3, True, False), (9003, 70, False, True), (9003, 120, True, False)]
    kept = Q.good_documents(docs, lab)
    assert kept.count() == sum(x.kept for x in got) and kept.columns == docs.columns
    assert Q.quality_report(docs.limit(0), lab.limit(0)).count() == 0


def test_tail_against_the_sum():
    for x, n, p in ((0, 1, 0.5), (3, 10, 0.2), (7, 40, 0.3), (25, 2000, 0.01), (60, 2000, 0.02), (39, 40, 0.9)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))
        assert abs(Q.binomial_tail(x, n, p) - want) < 1e-10


def test_path_takes_the_best_exchange_first():
    r = np.random.default_rng(0)
    good = np.arange(4000) % 4 != 0
    bins = np.zeros((4000, len(Q.RULES)), int)
    bins[:, 0] = np.where(good, r.integers(0, 5, 4000), r.integers(15, 50, 4000))  # parts the two cleanly
    bins[:, 1] = r.integers(0, 50, 4000)  # says nothing
    path = Q.cutoff_path(bins, good)
    assert path and all(5 <= c[0] < 20 for c in path[Q.STOPS - 1 :]) and all(c[1] == Q.GRID for c in path)
    assert all(all(x >= y for x, y in zip(a, b)) for a, b in zip(path, path[1:]))
    assert Q.cutoff_path(np.zeros((0, len(Q.RULES)), int), np.zeros(0, bool)) == []


def test_guarantee_by_simulation():
    """Over many holdouts the rules reject more than the risk in some stratum with at most the error probability."""
    r, steps, true = np.random.default_rng(4), 12, np.linspace(0.004, 0.06, 12)  # shares that each step rejects in truth
    wrong = used = 0
    for _ in range(600):
        rejected = {}
        for s, n in (("a", 3000), ("b", 800), ("c", 100)):
            first = np.searchsorted(true, r.random(n))
            rejected[s] = np.bincount(first, minlength=steps + 1)
        got = Q.steps_followed({s: x[:-1] for s, x in rejected.items()}, {s: int(x.sum()) for s, x in rejected.items()})
        used += got["a"] > 0
        assert got["c"] == 0  # too small for any step
        wrong += any(k and true[k - 1] > Q.RISK for k in got.values())
    assert wrong <= 600 * Q.ERROR and used > 550


def test_strata_that_can_pass():
    assert Q.large_enough({"a": 300, "b": 200, "c": 10}, 0.02, 0.05) == {"a": 0.025, "b": 0.025}
    assert Q.large_enough({"a": 10}, 0.02, 0.05) == {}


def test_repeated_labels_and_clashing_columns(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join(word() + ("###" if i % 5 == 0 else "") for _ in range(55)), "en", "orig", "y") for i in range(3000)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, _k string, _inner0 string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(3000)] * 3 + [(None, 1)], "doc_id long, quality int")
    kept = Q.good_documents(docs, labels).collect()
    assert len(kept) == 2400 + 2 and {(x["_k"], x["_inner0"]) for x in kept} == {("orig", "y")}
    once = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(3000)], "doc_id long, quality int")
    assert Q.fitted_cutoffs(Q.measured(docs), labels) == Q.fitted_cutoffs(Q.measured(docs), once)
    # a document labelled good and bad counts as bad, so it bounds nothing
    assert Q.fitted_cutoffs(Q.measured(docs), labels.unionByName(labels.selectExpr("doc_id", "0 AS quality"))) == {}


def test_every_labelled_document_counts(spark):
    """A kind of bad document that only has hashes beyond the first thousands of the path's part still moves a cutoff."""
    from pyspark.sql import Window, functions as F

    base = spark.range(24_000).select(F.col("id").alias("doc_id"), Q.id_key("id").alias("k")).withColumn("h", F.xxhash64("k", F.lit(23)))
    rank = F.row_number().over(Window.partitionBy((F.pmod("h", F.lit(4)) == 0)).orderBy("h"))
    late = (F.pmod("h", F.lit(4)) == 0) & (F.col("r") > 4_000)
    x = base.withColumn("r", rank).withColumn("bad", late & (F.col("doc_id") % 3 == 0))
    zero = {c: F.lit(0).cast("long") for c in Q._COUNTS}
    measures = x.withColumns(zero | {"n_words": F.lit(100).cast("long"), "n_symbols": F.when(F.col("bad"), 60).otherwise(0).cast("long"), "n_lines": F.lit(1).cast("long")})
    measures = measures.withColumns({"stratum": F.lit("en"), "x": F.col("k")}).localCheckpoint()
    labels = measures.select("doc_id", F.when(F.col("bad"), 0).otherwise(1).alias("quality"))
    assert measures.filter("bad").count() > 300
    cut = Q.fitted_cutoffs(measures, labels)["en"]
    assert cut[0] < 0.6 and cut[1:] == (1.0,) * 4


def test_counted_path_is_that_of_the_rows(spark):
    r = np.random.default_rng(3)
    good = r.random(3000) < 0.7
    bins = np.minimum(r.integers(0, 12, (3000, len(Q.RULES))) + np.where(good, 0, r.integers(0, 30, 3000))[:, None], Q.GRID)
    rows = [(bool(g), *map(int, b), 1) for g, b in zip(good, bins, strict=True)]
    counts = spark.createDataFrame(rows, "good boolean, " + ", ".join(f"{c} int" for c in Q.RULES) + ", n long")
    assert Q.counted_path(counts) == Q.cutoff_path(bins, good) != []


def test_good_documents_of_every_part_shape_the_cutoffs(spark):
    """Good documents that are like a few bad ones are spared, whichever parts they are in."""
    from pyspark.sql import functions as F

    k = spark.range(24_000).select(F.col("id").alias("doc_id"), Q.id_key("id").alias("k"))
    x = k.withColumns({"bad": F.col("doc_id") % 3 == 0, "late": F.pmod(F.xxhash64("k", F.lit(23)), F.lit(4)) != 0})
    doubtful = F.when(F.col("bad"), F.col("doc_id") % 60 == 0).otherwise(F.col("late") & (F.col("doc_id") % 125 == 1))
    symbols = F.when(doubtful, 30).when(F.col("bad"), 60).otherwise(0).cast("long")
    zero = {c: F.lit(0).cast("long") for c in Q._COUNTS}
    measures = x.withColumns(zero | {"n_words": F.lit(100).cast("long"), "n_symbols": symbols, "n_lines": F.lit(1).cast("long")})
    measures = measures.withColumns({"stratum": F.lit("en"), "x": F.col("k")}).localCheckpoint()
    labels = measures.select("doc_id", F.when(F.col("bad"), 0).otherwise(1).alias("quality"))
    assert measures.filter("n_symbols = 30 AND NOT bad").count() > 60
    cut = Q.fitted_cutoffs(measures, labels)["en"]
    assert 0.3 <= cut[0] < 0.6 and cut[1:] == (1.0,) * 4


def test_paths_of_the_parts_are_those_of_their_rows(spark):
    r = np.random.default_rng(5)
    good, part = r.random(3000) < 0.7, r.integers(0, Q.PARTS, 3000)
    bins = np.minimum(r.integers(0, 12, (3000, len(Q.RULES))) + np.where(good, 3 * part, r.integers(0, 30, 3000))[:, None], Q.GRID)
    rows = [(bool(g), int(p), *map(int, b), 1) for g, p, b in zip(good, part, bins, strict=True)]
    counts = spark.createDataFrame(rows, "good boolean, part int, " + ", ".join(f"{c} int" for c in Q.RULES) + ", n long")
    want = [Q.cutoff_path(bins[~good | (part == i)], good[~good | (part == i)]) for i in range(Q.PARTS)]
    assert Q.counted_paths(counts, Q.PARTS) == want and len(set(map(tuple, want))) > 1


def test_loosest_cutoffs():
    first, second = [(40, 50, 50, 50, 50), (30, 45, 50, 50, 50)], [(35, 50, 50, 50, 50)]
    found = lambda n, *at: np.array([*at, n - sum(at)])
    # the second step of the first path rejects too many good ones
    assert Q.loosest_cutoffs([first, second], {"en": [found(1000, 0, 90), found(1000, 0)]}) == {"en": (0.8, 1.0, 1.0, 1.0, 1.0)}
    assert Q.loosest_cutoffs([first, second], {"en": [found(1000, 0, 0), found(1000, 0)]}) == {"en": (0.7, 1.0, 1.0, 1.0, 1.0)}
    # a path that is not followed at all leaves no cutoff, one whose holdout could not pass has no say
    assert Q.loosest_cutoffs([first, second], {"en": [found(1000, 0, 0), found(1000, 90)]}) == {}
    assert Q.loosest_cutoffs([first, second], {"en": [found(1000, 0, 0), found(100, 0)]}) == {"en": (0.6, 0.9, 1.0, 1.0, 1.0)}
    assert Q.loosest_cutoffs([first, second], {"en": [found(100, 0, 0), found(100, 0)]}) == {} == Q.loosest_cutoffs([first, second], {})


def test_guarantee_of_the_parts_by_simulation():
    """With good documents dealt to parts, each for a path of its own, the loosest cutoffs keep the risk."""
    r, wrong, used = np.random.default_rng(6), 0, 0
    for _ in range(200):
        good, bad = np.zeros((1600, len(Q.RULES)), int), np.zeros((400, len(Q.RULES)), int)
        good[:, 0], bad[:, 0] = np.minimum(r.geometric(0.12, 1600), Q.GRID), r.integers(10, Q.GRID, 400)
        part = np.arange(1600) % Q.PARTS
        label = lambda n: np.r_[np.ones(n, bool), np.zeros(400, bool)]
        paths = [Q.cutoff_path(np.r_[good[part == i], bad], label(int((part == i).sum()))) for i in range(Q.PARTS)]
        rejected = []
        for i, p in enumerate(paths):
            over = np.array([(good[part != i] > c).any(axis=1) for c in [*p, (-1,) * len(Q.RULES)]])
            rejected.append(np.bincount(over.argmax(axis=0), minlength=len(p) + 1))
        cut = Q.loosest_cutoffs(paths, {"en": rejected}).get("en")
        used += cut is not None
        wrong += cut is not None and 0.88 ** round(cut[0] * Q.GRID) > Q.RISK
    assert wrong <= 200 * Q.ERROR and used > 100
