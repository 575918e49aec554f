import random
import re

from pyspark.sql import functions as F

from plainlens.operators import postings


def corpus(spark):
    r = random.Random(4)
    rows = []
    for e in range(3):
        for s in range(60):
            n = r.randint(1, 9)
            rows += [(e, f"s{s}", str(i), r.choice(["o", "a", "casa", "é", "dose"]), r.choice(["N", "V"])) for i in range(1, n + 1)]
            rows.append((e, f"s{s}", "2-3", "casa", "V"))  # ranges have no place
    return rows, spark.createDataFrame(rows, "entry long, sent string, id string, word string, upos string").repartition(3)


def test_lookups_read_their_buckets(spark, tmp_path):
    rows, df = corpus(spark)
    at = str(tmp_path / "index")
    postings.stored(df, ["entry", "sent"], at, buckets=16, block=7)
    plain = [x for x in rows if "-" not in x[2]]
    sentences = {}
    for e, s, i, w, u in plain:
        sentences.setdefault((e, s), {})[int(i)] = (w, u)
    got = postings.lookup(spark, at, "word", ["casa", "é"], 16)
    assert sorted((r.value, r.place.entry, r.place.sent, r.place.pos) for r in got.collect()) == sorted((w, e, s, int(i)) for e, s, i, w, _ in plain if w in ("casa", "é"))
    both = {(r.entry, r.sent): r.n for r in postings.with_all(spark, at, "word", ["casa", "dose"], ["entry", "sent"], 16).collect()}
    words = {k: [w for w, _ in v.values()] for k, v in sentences.items()}
    assert both == {k: sum(x in ("casa", "dose") for x in v) for k, v in words.items() if {"casa", "dose"} <= set(v)}
    some = {(r.entry, r.sent): r.n for r in postings.with_any(spark, at, "word", ["casa", "dose"], ["entry", "sent"], 16).collect()}
    assert some == {k: n for k, v in words.items() if (n := sum(x in ("casa", "dose") for x in v))}
    want = sorted((e, s, i) for (e, s), v in sentences.items() for i in v if v[i][0] == "a" and v.get(i + 1, ("", ""))[1] == "N" and v.get(i + 2, ("", ""))[0] == "a")
    assert sorted(tuple(r) for r in postings.phrase(spark, at, [("word", "a"), ("upos", "N"), ("word", "a")], ["entry", "sent"], 16).collect()) == want and want
    assert postings.lookup(spark, at, "word", ["none"], 16).count() == 0
    plan = postings.lookup(spark, at, "word", ["casa"], 16)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+", plan), plan
    bucket = df.select(postings._bucket(F.lit("word"), F.lit("casa"), 16)).first()[0]
    files = spark.read.parquet(at).filter((F.col("bucket") == bucket)).select(F.input_file_name()).distinct().collect()
    assert files and all(f"bucket={bucket}/" in f[0] for f in files)
    assert spark.read.parquet(at).filter("field = 'upos' AND value = 'N'").agg(F.max("n")).first()[0] <= 7
