import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plainlens.llm import periodic


def brute_runs(w):
    """Every (start, length, smallest period), by trying all lags at all places."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def texts():
    r = random.Random(5)
    word = lambda k: r.choice("abcdefghijklmnopqrstuvwxyz"[:k])
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b a b a b a", "a b c " * 4 + "a", "x " * 7 + "y " * 8, "\x1c\x1c " * 9, "é ß é ß é ß é ß", "a b a b a b a b a " * 5, "a b " * 8]
    for k in (1, 2, 3, 6, 26):
        for n in (7, 20, 61, 150):
            out += [" ".join(word(k) for _ in range(n)) for _ in range(5)]
    for p in (1, 2, 3, 5, 8, 13, 40):  # runs beside each other, inside each other, cut by one word
        base = [word(26) for _ in range(p)]
        out.append(" ".join(["q", *base * 4, base[0], *base * 5, "z", *(base * 5)[:-1]]))
        out.append("  ".join([*(base * 3 + ["m"] * 6) * 4, *base]))
    return out


def test_runs_against_brute_force():
    column = pa.array(texts() + [" ".join(texts()[20:60])])
    for t, ids, words, stays, (s, n, q) in periodic.texts_runs(column):
        w = (column[t].as_py() or "").replace("\t", " ").replace("\n", " ").split(" ")
        want = brute_runs([x for x in w if x])
        assert list(zip(s.tolist(), n.tolist(), q.tolist(), strict=True)) == want, column[t]
        assert set(np.flatnonzero(~stays)) == {i for a, m, p in want for i in range(a + p, a + m)}


def test_report_against_brute_force(spark):
    rows = [(i, t, "no") for i, t in enumerate(texts() * 3)] + [(None, "a b " * 9, "no"), (3, "a b " * 9, "no"), (3, "a b " * 9, "no")]
    df = spark.createDataFrame(rows, "doc_id long, text string, period string").repartition(3)
    got = sorted((tuple(r) for r in periodic.run_report(df).collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t, _ in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows))) > 20
    assert periodic.run_report(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["a " * 150_000, "a b c " * 40_000, " ".join(random.Random(1).choices("ab", k=60_000)), " ".join(str(random.Random(2).randint(0, 9)) for _ in range(150_000)), " ".join(f"w{i}" for i in range(150_000))])
def test_very_long_texts(text):
    began = time.time()
    for _, ids, _, stays, runs in periodic.texts_runs(pa.array([text])):
        assert len(stays) == len(text.split())
        if text.startswith("a a"):
            assert [x.tolist() for x in runs] == [[0], [150_000], [1]] and stays.sum() == 1
        if text.startswith("a b c"):
            assert [x.tolist() for x in runs] == [[0], [120_000], [3]] and stays.sum() == 3
    assert time.time() - began < 30


def test_periods_of_long_texts():
    r = random.Random(9)
    base = [f"w{r.randint(0, 500)}" for _ in range(6_000)]
    rest = [f"v{r.randint(0, 50)}" for _ in range(3_000)]
    text = rest + base * 4 + rest[:100] + ["a", "b"] * 700 + base[:50] * 6
    [(_, _, _, _, (s, n, q))] = periodic.texts_runs(pa.array([" ".join(text)]))
    found = set(zip(s.tolist(), n.tolist(), q.tolist(), strict=True))
    assert {(3_000, 24_000, 6_000), (27_100, 1_400, 2), (28_500, 300, 50)} <= {(a, m, p) for a, m, p in found if m >= 100} | found


def test_without_loops(spark):
    df = spark.createDataFrame([(1, "say  it say it say it say it now", 5), (2, "plain  text", 6), (3, None, 7)], "id int, text string, start int")
    got = {r.id: r for r in periodic.without_loops(df).collect()}
    assert got[1].text == "say it now" and [tuple(x) for x in got[1].periodic_runs] == [(0, 8, 2)] and got[1].start == 5
    assert got[2].text == "plain  text" and got[2].periodic_runs == [] and got[3].text is None
