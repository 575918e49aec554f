"""What one key, one file or one entry holds is spread over tasks, with the rows that a plain computation gives."""

import random

import pytest
from pyspark.sql import functions as F

from plainlens.operators import ordering, splits, ud
from plainlens.sources import files


def conllu(n, seed=0, end="\n"):
    r = random.Random(seed)
    out = []
    for i in range(n):
        tokens = [f"{k}\tw{r.randint(0, 99)}\tl\tNOUN\t_\t_\t0\troot\t_\t_" for k in range(1, r.randint(2, 9))]
        out.append(end.join([f"# sent_id = s{i}", f"# text = é {i}", *tokens]))
    return out


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_file_is_read_in_splits(spark, tmp_path, small_splits):
    one, two = conllu(150), conllu(40, 1)
    (tmp_path / "in").mkdir()
    gaps = random.Random(2)
    (tmp_path / "in" / "a.conllu").write_text("".join(s + gaps.choice(["\n\n", "\n\n\n", "\n \t\n", "\n\n\n\n"]) for s in one))
    (tmp_path / "in" / "b.conllu").write_text("\n\n".join(two) + "\n\n")
    df = files.read_conllu(spark, str(tmp_path / "in"))
    splits_of = spark.read.option("lineSep", "\n\n").text(str(tmp_path / "in")).select("_metadata.file_block_start").distinct().count()
    assert splits_of > 10
    got = {}
    for r in df.collect():
        got.setdefault(r.entry_id.rsplit("/", 1)[1], []).append((r.sent_no, r.sent_key, r.raw, tuple(r.lines)))
    for name, want in (("a.conllu", one), ("b.conllu", two)):
        assert sorted(got[name]) == [(i, f"s{i}", s, tuple(s.split("\n")[2:])) for i, s in enumerate(want)]


def test_as_a_whole_text_and_with_other_line_ends(spark, tmp_path, small_splits):
    text = "\n\n".join(conllu(60)) + "\n\n"
    (tmp_path / "lf").write_text(text)
    (tmp_path / "crlf").write_bytes(text.replace("\n", "\r\n").encode())
    want = [tuple(r) for r in ud.parse_sentences(spark.createDataFrame([(text,)], "t string").withColumn("e", F.lit(1)), "e", "t").orderBy("sent_no").select("sent_no", "sent_key", "raw", "lines").collect()]
    for name, end in (("lf", "\n\n"), ("crlf", "\r\n\r\n"), ("crlf", "\n\n")):
        got = files.read_conllu(spark, str(tmp_path / name), end).orderBy("sent_no").select("sent_no", "sent_key", "raw", "lines").collect()
        assert [tuple(r) for r in got] == want, (name, end)


def test_sentences_of_one_entry_are_numbered_in_blocks(spark):
    rows = [("a", i) for i in range(0, 3000, 2)] + [("b", 5)] + [("c", i) for i in range(70)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "e string, n long")
    got = ud.renumbered(df, ["e", "n"], block=100)
    assert [r.new_sent_id for r in got.orderBy("e", "n").collect()] == list(range(1, len(rows) + 1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    numbered = next(x for x in plan.split("\n") if "row_number" in x)
    assert "_k#" in numbered.rsplit("], [", 2)[1]  # partitioned by entry and block


def test_ranks_inside_one_group(spark):
    rows = [(i, 7 if i % 5 else i % 3, f"k{i:05d}") for i in range(2000)] + [(5000, None, "x"), (5001, 7, None)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "i long, g long, s string")
    for key in ("i", "s"):
        got = ordering.ranked_in_groups(df, "g", key, runs=16).collect()
        at = {"i": 0, "s": 2}[key]
        want = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), (r[at] is not None, r[at] if r[at] is not None else "")))
        assert [r.i for r in sorted(got, key=lambda r: r.rank)] == [r[0] for r in want] and sorted(r.rank for r in got) == list(range(1, len(rows) + 1))
    sizes = df.withColumn("p", ordering.run_of(df, "i", 16)).groupBy("g", "p").count().agg(F.max("count")).first()[0]
    assert sizes < 200  # of 1,601 rows of one group
    with pytest.raises(TypeError):
        ordering.run_of(df.select(F.array("i").alias("a")), "a")


def test_batches_of_one_length(spark):
    df = spark.range(1000).select("id", F.lit(9).alias("n"))
    got = splits.length_batches(df, "id", "n", 4, 10)
    assert [r.bucket for r in got.orderBy("id").collect()] == [i // 40 for i in range(1000)]
    assert got.groupBy("bucket", "batch").count().filter("count <> 4").count() == 0


def test_planted_leaks_come_out(spark):
    df = spark.createDataFrame([(g, s) for g, s in (("a", "train"), ("a", "test"), ("b", "val"), ("c", "test"), ("c", "test"), (None, "train"), (None, "val"))], "g string, split string")
    assert sorted(((r.g, r.n_splits) for r in splits.leaking_groups(df, "g").collect()), key=repr) == [("a", 2), (None, 2)]
