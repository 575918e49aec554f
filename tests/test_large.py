"""Work that grows with the input only: in the plans, and in time on one large row."""

import time

from pyspark.sql import functions as F

from plainlens.functions import text as T
from plainlens.models import svd
from plainlens.operators import judge, pages, postings, punkt, sari, similarity


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sliding_similarity_reads_its_pairs_once(spark):
    rows = [(1, "One two. Three four.", "One two."), (2, "a b", "a b"), (3, "", "x"), (4, None, "x"), (5, "y", "z")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    got = similarity.sliding_similarity(df, "k", "a", "b", similarity.hashed_encoder(32))
    assert "Join" not in plan(got) and "posexplode" not in plan(got)
    want = similarity.sliding_similarity(df, "k", "a", "b", lambda c: similarity.hashed_encoder(32)(c))  # of unknown length
    near = lambda x: {r.k: round(r.sim, 12) for r in x.collect()}
    assert near(got) == near(want) and set(near(got)) == {1, 2, 5} and near(got)[2] == 1.0


def test_a_word_is_hashed_once(spark):
    c = similarity.hashed_encoder(300)(F.col("t"))
    assert plan(spark.createDataFrame([("a",)], "t string").select(c.alias("v"))).count("md5(") == 1
    v = spark.createDataFrame([("The the end",), ("",), (None,)], "t string").select(c.alias("v")).collect()
    assert sorted(v[0].v)[-2:] == [1.0, 2.0] and sum(v[0].v) == 3 and sum(v[1].v) == 0 and v[2].v == [None] * 300


def test_ngrams_are_not_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c", "a b d"), (2, "<skipped>", "x", "y"), (3, "", "x", "y")], "k long, s string, o string, r string")
    out = sari.d_sari(df, "k", "s", "o", "r")
    assert "Join" not in plan(out) and "Generate" not in plan(out) and "Aggregate" not in plan(out)
    got = {r.k: r.d_sari for r in out.collect()}
    assert got[1] > 0 and got[2] is not None and got[3] is None
    assert {r.k for r in sari.operation_scores(df.filter("k = 1"), "k", "s", "o", "r").collect()} == {1}


def test_many_cookies_in_a_row(spark):
    raw = "; ".join(f"k{i % 3000}=v{i}" for i in range(6000))
    start = time.monotonic()
    got = spark.createDataFrame([(raw,)], "t string").select(T.parse_cookies(F.col("t")).alias("m")).first().m
    assert len(got) == 3000 and got["k7"] == "v3007" and time.monotonic() - start < 20
    few = spark.createDataFrame([("b=1; =x; a=y=z; b = 2;b=3; q",)], "t string").select(T.parse_cookies(F.col("t")).alias("m")).first().m
    assert few == {"": "x", "a": "y=z", "b ": " 2", "b": "3"}


def test_a_marker_is_searched_once(spark):
    df = spark.createDataFrame([([5, 2, 3, -100, 1, 4, 2, 3],), ([2, 2, 3],), ([12, 3],), ([],), (None,), ([2, None, 2, 3, 7],)], "ids array<int>")
    at = judge.find_run(F.col("ids"), [2, 3])
    assert "sequence(" not in plan(df.select(at)) and "slice(" not in plan(df.select(at))
    assert [r[0] for r in df.select(at).collect()] == [1, 1, None, None, None, 2]
    assert [r[0] for r in df.select(judge.find_run(F.col("ids"), [2, 3], 2)).collect()] == [6, None, None, None, None, 2]
    out = judge.label_validity(df, "ids", [2, 3], [4], 1, 0.0)
    assert plan(out).count("instr(") == 2 and out.columns == ["ids", "total_length", "valid_labels", "label_ratio", "is_valid"]
    assert [(r.valid_labels, r.is_valid) for r in out.collect()][:4] == [(4, True), (0, False), (0, False), (0, False)]


def test_an_index_of_the_fields_asked(spark, tmp_path):
    rows = [(s, str(i), "ab"[i % 2], "NV"[s % 2]) for s in range(40) for i in range(1, 4)]
    tok = spark.createDataFrame(rows, "sent long, id string, word string, upos string")
    postings.stored(tok, ["sent"], str(tmp_path / "i"), fields=["word"])
    index = spark.read.parquet(str(tmp_path / "i"))
    assert {r.field for r in index.select("field").distinct().collect()} == {"word"} and index.agg(F.sum("n")).first()[0] == 120
    assert postings.with_all(spark, str(tmp_path / "i"), "word", ["a", "b"], ["sent"]).count() == 40


def test_no_filter_on_each_token(spark):
    df = spark.createDataFrame([(1, "Ab. The (x) end, 3.5 a-b. ")], "k long, t string")
    counts = punkt.type_counts(punkt.fragments(df, "k", "t"))
    assert not [x for x in plan(counts).splitlines() if "Filter" in x and "RLIKE(w" in x]
    assert {(r.type, r.with_dot, r.without) for r in counts.collect()} == {("ab", 1, 0), ("the", 0, 1), ("x", 0, 1), ("end", 0, 1), ("##number##", 0, 1), ("a-b", 1, 0)}


def test_fragments_stay_in_their_texts(spark):
    rows = [(1, 'One. Two!\n"Three?" Four'), (2, "a. "), (3, ""), (4, None), (5, "1. 2. 3. x"), (6, "x \u0001 y. Z")]
    df = spark.createDataFrame(rows, "k long, t string")
    out = punkt.sentences(df, "k", "t", punkt.trained(df, "k", "t"))
    assert not [x for x in plan(out).splitlines() if "Aggregate" in x and "fragment" in x]
    got = {r.k: r.sentences for r in out.collect()}
    assert set(got) == {1, 2, 5, 6} and got[1] == ["One.", "Two!", '"Three?"', "Four"] and got[2] == ["a."] and got[6] == ["x", "y. Z"]


def test_edge_lines_are_counted_where_they_meet(spark):
    rows = [(1, i, f"Head\n\nHead {i}\nline\nfoot") for i in range(4)] + [(2, 0, "Head\nfoot"), (2, 1, ""), (2, 2, None)]
    df = spark.createDataFrame(rows, "doc long, page int, text string")
    out = pages.without_margins(df, "doc", "page", "text")
    assert len([x for x in plan(out).splitlines() if "Join" in x]) == 1
    assert {(r.doc, r.page): r.text for r in out.collect()} == {**{(1, i): f"Head {i}" for i in range(4)}, (2, 0): "Head\nfoot", (2, 1): "", (2, 2): ""}


def test_terms_are_joined_once(spark):
    df = spark.createDataFrame([(1, "a b b c"), (2, "c d"), (3, "")], "k long, t string")
    coder = svd.fitted(df, ["k"], "t", k=2)
    out = coder.encoded(df, ["k"], "t")
    assert len([x for x in plan(out).splitlines() if "Join" in x]) == 2
    got = {r.k: r.vec for r in out.collect()}
    assert set(got) == {1, 2, 3} and got[3] == [0.0, 0.0] and all(sum(x * x for x in got[k]) <= 1 + 1e-9 for k in (1, 2))
