import hashlib
import random

import numpy as np
import pytest

from plainlens.llm import substrings
from plainlens.llm.substrings import substring_report, without_repeats


def brute(rows, width):
    """rows: (doc_id, text), ids unique."""
    seen, out = {}, {}
    texts = sorted(((-(2**63) if i is None else i), (t or "").encode(), i) for i, t in rows)
    for _, raw, i in texts:
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            w = raw[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen[w] = 1
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    free = lambda k: " ".join(word() for _ in range(k))
    shared = [free(r.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [free(r.randint(0, 12)) if r.random() < 0.5 else r.choice(shared) for _ in range(r.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 700), (n + 3, "ab" * 300), (n + 4, rows[3][1]), (n + 5, rows[3][1]), (None, rows[5][1]), (n + 6, "x" * 100 + "y" + "x" * 100)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_report(docs).collect()}
    assert got == brute(rows, 100)
    assert sum(v[1] for v in got.values()) > 1000


def test_rows_with_equal_ids(spark):
    a, b = "0123456789" * 3 + "q" * 80, "z" * 150
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in substring_report(docs).collect())
    assert got == [(1, 110, 0), (1, 110, 0), (1, 150, 149), (2, 110, 110)]


def test_cut_keeps_columns_and_characters(spark):
    p = "é" * 60
    docs = spark.createDataFrame([(1, "a" + p, "en", 7), (2, "b" + p + "c", "fr", 8), (3, None, None, 0)], "doc_id long, text string, k string, n_chars long")
    got = {r.doc_id: r for r in without_repeats(docs).collect()}
    # "a" and 60 two-byte characters: the strings of 100 bytes from the 11th character on also start before
    assert got[1].text == "aé"
    assert got[2].text == "bc" and got[2].n_chars == 2 and got[2].k == "fr"
    assert got[3].text is None
    assert without_repeats(docs).columns == docs.columns


def test_empty(spark):
    assert substring_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_phrase_in_ever_new_surroundings(spark):
    """A phrase shorter than the threshold in every document: its first rank has many second ranks, and is spread."""
    r = random.Random(8)
    phrase = "This work is licensed under the terms of the general public license, 3."
    free = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    ends = [free(40) for _ in range(5)]
    rows = [(i, free(r.randint(0, 90)) + phrase + (r.choice(ends) if i % 3 else free(50))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substring_report(docs).collect()}
    assert got == brute(rows, 100) and sum(v[1] for v in got.values()) > 10_000


def test_spread_marks_common_first_ranks():
    n = substrings.HOT + 2
    a = np.array([5] * n + [6, 7, 7])
    b = np.arange(n + 3)
    rest = (np.arange(n + 3), np.zeros(n + 3, np.int32), np.zeros(n + 3, int), np.ones(n + 3, int), np.zeros(n + 3, bool))
    out = substrings._spread((a, b, *rest)).to_pydict()
    assert out["state"] == [2] * n + [0, 0, 0] + [3, 3] and out["a"][n:] == [6, 7, 7, 5, 5]
    assert len(set(out["a"][:n])) > 1 and (out["b"][-2], out["b"][-1]) == (0, n - 1)


def test_segments_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 64)
    data = np.frombuffer(random.Random(1).randbytes(1000), np.uint8)
    seen = []
    for at, part, bounds in substrings._segments(data, np.array([0, len(data)]), 10):
        assert (part == data[at : at + len(part)]).all()
        _, l, n, _, _ = substrings.anchor_runs(part, bounds, 10)
        seen += [at + x + j for x, m in zip(l.tolist(), n.tolist()) for j in range(m)]
    assert sorted(seen) == list(range(991))


def test_texts_of_null_ids_whose_short_hashes_collide(spark):
    """Two texts without an id that agree in a 32-bit hash stay two; their copies lose all bytes."""
    from pyspark.sql import functions as F

    many = spark.range(200_000).select(F.concat(F.lit("x" * 170), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    same = many.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).filter(F.size("t") > 1).first().t[:2]
    rows = [(None, same[0]), (None, same[1]), (7, same[0]), (8, same[1])]
    got = {r.doc_id: r for r in substring_report(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id IS NOT NULL").collect()}
    assert [got[i].n_removed for i in (7, 8)] == [234, 234]
