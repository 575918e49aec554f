import os
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
from plainlens.llm import quality  # noqa: E402
from plainlens.llm.queries import vocabulary  # noqa: E402
from test_jaccard import brute as links  # noqa: E402
from test_mixing import targets  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(r.randint(55, 90)))) for i in range(60)]
    shared = " ".join(word() for _ in range(40))
    rows += [(60 + i, f"{rows[i][1]} {shared} {rows[i + 1][1]}") for i in range(6)]
    rows += [(70 + i, rows[10 + i][1]) for i in range(4)] + [(80, rows[20][1] + " tail"), (81, "too short"), (82, None), (83, "la la la " * 60)]
    return [(i, t, "en", r.choice(["a", "b", "c", None]), len(t or "")) for i, t in rows]


def cut(rows):
    """Bytes of 100-byte strings seen earlier removed; ASCII texts, ids ascending."""
    seen, out = set(), []
    for i, t, *rest in sorted(rows):
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(t[s : s + 100])
        kept = "".join(c for c, g in zip(t, gone) if not g)
        out.append((i, kept, *rest[:-1], len(kept)))
    return out


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    docs, stages = spark.read.parquet(f"{at}/documents.parquet"), dict(corpus_pipeline.STAGES)
    tuples = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)

    def step(name, docs):
        stages[name](spark, docs, at).write.parquet(f"{at}/{name}")
        out = spark.read.parquet(f"{at}/{name}")
        assert name == "bpe_encoding" or out.columns == COLUMNS
        return out

    good = step("quality_rules", docs)
    want = [r for r in rows if (c := quality.text_counts(r[1] or ""))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    assert tuples(good) == sorted(want, key=repr) and len(want) < len(rows)

    one = step("ngram_jaccard_join", good)
    found = links([(r[0], r[1]) for r in want])
    want = [r for r in want if found[r[0]][0] == r[0]]
    assert tuples(one) == sorted(want, key=repr)

    bare = step("suffix_array_dedup", one)
    want = cut(want)
    assert tuples(bare) == sorted(want, key=repr)

    mix = step("source_mixing", bare)
    size, source = {}, {}
    for i, t, _, s, _ in want:
        size[i], source[i] = len(t.split()), s
    total = {}
    for i, n in size.items():
        total[source[i]] = total.get(source[i], 0) + n
    goal = targets({s: total[s] for s in sorted(x for x in total if x is not None)} | ({None: total[None]} if None in total else {}))
    got = mix.collect()
    assert {tuple(r) for r in got} <= set(want)
    for s, g in goal.items():
        taken = [size[r.doc_id] for r in got if r.source == s]
        assert abs(sum(taken) - g) <= max(size.values())
    assert all(sum(r.doc_id == i for r in got) <= 2 for i in size)

    coded = step("bpe_encoding", mix)
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    text = {r[0]: r[1] for r in want}
    assert coded.count() == len(got)
    assert all(list(r.ids) == t.encode(text[r.doc_id], add_special_tokens=False).ids and r.round_trip for r in coded.collect())
    assert corpus_pipeline.run(spark, at).count() == len(got)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test tables are absent")
def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"] and out.filter("NOT round_trip").count() == 0 < out.count()


EXTRA = {"k": "key", "x": "ex", "marks": "m", "ids": "i", "decoded": "d", "_inner0": "z", "node": "n", "size": "s", "copies": "c", "stratum": "t"}


def test_extra_columns_with_clashing_names(spark, tmp_path):
    """Columns named like the operators' own ones go through all stages but the last, and change nothing."""
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    wide = plain.select("*", *[F.concat(F.lit(v), F.col("doc_id").cast("string")).alias(c) for c, v in EXTRA.items()])
    labels = spark.createDataFrame([(i, 1, "no") for i in range(20)] + [(None, None, "no")], "doc_id long, quality int, k string")
    for name, df in (("plain", plain), ("wide", wide)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = {n: sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, f"{tmp_path}/{n}").collect()) for n in ("plain", "wide")}
    assert got["plain"] == got["wide"] and len(got["wide"]) > 50
    docs = spark.read.parquet(f"{tmp_path}/wide/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/wide")
        assert out.columns == docs.columns, name
        assert all(r[c] == f"{v}{r.doc_id}" for r in out.collect() for c, v in EXTRA.items()), name


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nulls, str(tmp_path)).count() in (0, 1, 3), name
