import hashlib
import random
import string

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from plainlens.llm import exact

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, largest=True):
    """Sorted (id, keep_id, group_size, text_sha256), and the kept ids of each group."""
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if largest else min)(known) if known else None
        out += [(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr), sorted(((t, (max if largest else min)([i for i in ids if i is not None], default=None)) for t, ids in groups.items()), key=repr)


def check(spark, rows, keep="largest"):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact.copy_groups(df, keep=keep).collect()
    want, best = brute(rows, keep == "largest")
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert sorted((r.text_sha256 for r in kept)) == sorted(hashlib.sha256(t.encode()).hexdigest() for t, _ in best)
    assert all(r.doc_id == r.keep_id for r in kept)
    stay = exact.distinct_documents(df, keep=keep).collect()
    assert sorted((((r.text or "").translate(LOWER), r.doc_id) for r in stay), key=repr) == best


ROWS = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (None, "abc"), (6, "ÄBC"), (7, "äBC"), (8, "Äbc"), (9, "İSTANBUL"), (10, "i̇stanbul"), (11, "ΣΑΣ"), (12, "K"), (13, "k"), (14, "k"), (15, "x" * 300_000), (16, "X" * 300_000), (17, "x" * 299_999), (None, "only"), (None, "ONLY"), (18, "twice"), (18, "twice"), (19, "\x00a"), (20, "\x00A")]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_brute_force(spark, keep):
    check(spark, ROWS, keep)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_many_copies_are_sorted_in_parts(spark, keep, monkeypatch):
    monkeypatch.setattr(exact, "PART_WEIGHT", 5 * exact.ROW_WEIGHT)
    r = random.Random(3)
    rows = [(i, r.choice(["Hot", "hot", "HOT"])) for i in range(400)] + [(None, "hot")] * 60 + [(None, "nulls only")] * 40
    rows += [(1000 + i, f"text {i % 90}") for i in range(200)] + [(5, "same row")] * 30 + ROWS
    check(spark, rows, keep)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    runs = exact._sorted_runs(df, "text", "doc_id", True, [])
    assert max(x["count"] for x in runs.groupBy("digest", "part").count().collect()) <= 6


def test_equal_digests_of_different_texts_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "PART_WEIGHT", 3 * exact.ROW_WEIGHT)
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.lit("00ff"))
    monkeypatch.setattr(exact.F, "substring", lambda c, a, b: F.lit(b"x"))
    rows = [(i, f"text {i % 4}") for i in range(40)]
    got = exact.copy_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(i, 36 + i % 4, 10) for i in range(40)]
    assert sorted(r.doc_id for r in got if r.kept) == [36, 37, 38, 39]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.text(alphabet="aAbBäÄ\x00İ ", max_size=3))), max_size=25))
def test_any_rows(spark, rows):
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert exact.copy_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    names = ["digest", "part", "run", "first", "best", "n", "sample", "head", "norm", "bytes", "id", "row", "lead", "keep_id"]
    rows = [(i, f"t{i % 3}", *[f"{c}{i}" for c in names]) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    assert sorted(tuple(r) for r in exact.distinct_documents(df).collect()) == rows[6:]
    assert sorted((r.doc_id, r.keep_id) for r in exact.copy_groups(df).collect()) == [(i, 6 + i % 3) for i in range(9)]


def test_one_exchange_of_the_texts_and_no_python(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = exact._sorted_runs(df, "text", "doc_id", True, [])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") - plan.count("BroadcastExchange") <= 2
    assert "Python" not in plan and "Arrow" not in plan
