import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainlens.functions import text as T
from plainlens.operators import curate, judge, pages, sari, similarity, splits, stats, ud
from plainlens.operators.ordering import ranked_by_value


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_curation(spark):
    df = spark.createDataFrame([(1, "a.", 0.9), (2, None, float("nan")), (3, "Error: Could not paraphrase - x", 0.81), (4, " \xa0", None)], "k int, t string, sim double")
    assert rows(curate.similar(df), "k") == [(1,), (3,)]
    assert rows(curate.without_errors(df, "t"), "k") == [(1,), (2,), (4,)]
    assert rows(curate.all_filled(df, ["t"]), "k") == [(1,), (3,)]
    assert rows(df.filter(curate.needs_work(["t"])), "k") == [(2,), (4,)]
    assert curate.missing_columns(df, ["z", "k", "a"]) == ["a", "z"]
    with pytest.raises(KeyError):
        curate.require(df, ["z"])
    assert curate.with_columns_present(df, {"new": "double", "t": "string"}).schema["new"].dataType.simpleString() == "double"
    keys = spark.createDataFrame([(1,), (None,)], "k int")
    nul = spark.createDataFrame([(1,), (None,), (5,)], "k int")
    assert sorted(r.k or 0 for r in curate.drop_keys(nul, keys, "k").collect()) == [0, 5]
    dotted = spark.createDataFrame([("x",)], "`q3.6_s` string")
    assert curate.project(dotted, {"q3.6_s": "s"}).first().s == "x" and curate.all_filled(dotted, ["q3.6_s"]).count() == 1


def test_merge_and_update(spark):
    old = spark.createDataFrame([("a", 1, "o"), ("b", 2, "o")], "k string, row_id int, v string")
    new = spark.createDataFrame([("b", 1, "n"), ("c", 3, "n"), ("c", 2, "m")], "k string, row_id int, v string")
    assert rows(curate.merged(old, new, "k", "row_id"), "k", "v") == [("a", "o"), ("b", "o"), ("c", "m")]
    assert rows(curate.overriding(old, new.filter("row_id < 3"), "k"), "k", "v") == [("a", "o"), ("b", "n"), ("c", "m")]
    both, off = curate.aligned(old, new.withColumn("v", F.lit("o")), "row_id", ["k"])
    assert both.count() == 0 and off.count() == 3


def test_splits(spark):
    df = spark.range(500).select("id", F.concat(F.lit("g"), (F.col("id") % 37).cast("string")).alias("g"), (F.col("id") % 100 / 10).alias("m"))
    s = splits.group_split(df, "g", forced_test=["g3"])
    sizes = {r.split: r.n for r in s.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()}
    assert sizes == {"train": 28, "val": 4, "test": 5} and splits.leaking_groups(s, "g").count() == 0
    assert {r.split for r in s.filter("g = 'g3'").collect()} == {"test"}
    assert rows(s, "id", "split") == rows(splits.group_split(df.repartition(5), "g", forced_test=["g3"]), "id", "split")
    good, hard = splits.challenge_sets(df, "g", "m", 5)
    assert not {r.g for r in good.collect()} & {r.g for r in hard.collect()} and good.agg(F.min("m")).first()[0] >= 8.9
    assert splits.one_per_group(df, "g", "id").count() == 37 and splits.sample_groups(df, "g", 200).count() == 37 and splits.choose(df, "id", 7).count() == 7
    b = splits.length_batches(df.withColumn("n", F.length("g")), "id", "n", 8, 5)
    assert b.count() == 500 and b.groupBy("bucket", "batch").count().agg(F.max("count")).first()[0] == 8
    assert splits.length_batches(df.withColumn("n", F.length("g")), "id", "n", 8, 5, drop_last=True).count() == 496
    pairs = splits.blind_pairs(spark.createDataFrame([(i, "x", "y") for i in range(40)], "k int, a string, b string"), "k", "a", "b")
    assert {(r.slot, r.model) for r in pairs.collect()} == {(1, "a"), (2, "a"), (1, "b"), (2, "b")}


def test_statistics(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (1.5,), (2.0,), (None,)], "x double")
    h = stats.histogram(df, "x", 0.0, 1.5, 15).orderBy("bin").collect()
    assert [r.n for r in h][:2] == [2, 1] and h[14].n == 1 and abs(sum(r.density for r in h) * 0.1 - 1) < 1e-9 and h[3].n == 0
    k = stats.kernel_density(df.filter("x < 0.2"), "x", -1.0, 1.0, 201).collect()
    assert abs(sum(r.density for r in k) * 0.01 - 1) < 0.01
    assert {r.density for r in stats.kernel_density(df.limit(1), "x", 0.0, 1.0, 3).collect()} == {0.0}
    flat = stats.kernel_density(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", 1.0, 2.0, 2).orderBy("point").first()
    assert abs(flat.density - 1 / (0.05 * math.sqrt(2 * math.pi))) < 1e-9
    assert stats.spread(spark.createDataFrame([(3.0,)], "x double"), "x").first().std == 0.0
    assert stats.within_length(df.limit(0).withColumnRenamed("x", "n"), "n")[1].first().percent is None


def test_pages(spark):
    p = spark.createDataFrame([("d", i, f"Cabeça\nlinha {i}\nmeio\n rodapé ") for i in range(3)] + [("e", 0, "Cabeça\nx"), ("e", 1, "")], "doc string, page int, t string")
    got = {(r.doc, r.page): r.text for r in pages.without_margins(p, "doc", "page", "t").collect()}
    assert got == {("d", 0): "linha 0", ("d", 1): "linha 1", ("d", 2): "linha 2", ("e", 0): "Cabeça\nx", ("e", 1): ""}
    assert {r.doc: r.text for r in pages.full_text(p, "doc", "page", "t").collect()}["d"] == "linha 0\n\nlinha 1\n\nlinha 2"
    f = spark.createDataFrame([(["x"], ["long"]), (["y" * 200], ["z"]), (None, ["w"])], "a array<string>, b array<string>")
    assert [r.pages[0][0] for r in pages.chosen_pages(f, "a", "b").collect()] == ["l", "y", "w"]


def test_d_sari(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e", "a b c d e"), (2, "a b c d", "x y", "x y"), (3, " ", "a", "b"), (4, None, "a", "b"), (5, "a b c d e f", "a b c", "a b")], "k int, i string, o string, r string")
    got = {r.k: r for r in sari.d_sari(df, "k", "i", "o", "r").collect()}
    assert abs(got[1].d_sari_keep - 100) < 1e-9 and got[1].d_sari_add == 0 and got[1].d_sari_del == 0
    assert abs(got[2].d_sari_add - 50) < 1e-9 and abs(got[2].d_sari_del - 100) < 1e-9  # two of four lengths have n-grams to add
    assert got[3].d_sari is None and got[4].d_sari is None and len(got) == 5
    p = {r.k: r for r in sari.penalties(df, "i", "o", "r").collect()}
    assert p[5].lp1 == 1.0 and abs(p[5].lp2 - math.exp((2 - 3) / 4)) < 1e-12 and p[5].slp == 1.0


def test_similarity(spark):
    encode = similarity.hashed_encoder(64)
    text = "PARA QUE ESTE MEDICAMENTO É INDICADO? dor forte COMO ESTE MEDICAMENTO FUNCIONA? rápido"
    other = "PARA QUE ESTE MEDICAMENTO É INDICADO? dor forte"
    s = {r.sec: r for r in similarity.section_scores(spark.createDataFrame([(1, text, other)], "k int, a string, b string"), "k", "a", "b", encode).collect()}
    assert abs(s["sec_1"].semantic_f1 - 1) < 1e-9 and s["sec_2"].semantic_f1 == 0.0 and s["sec_3"].semantic_f1 is None and len(s) == 9
    scores = spark.createDataFrame([(1, k, v.orig_to_simp, v.simp_to_orig, v.semantic_f1) for k, v in s.items()], "k int, sec string, orig_to_simp double, simp_to_orig double, semantic_f1 double")
    wide = similarity.wide_section_scores(scores, "k").first()
    assert abs(wide.semantic_similarity_sections - 0.08 / 0.15) < 1e-9 and len(wide) == 29
    same = similarity.sliding_similarity(spark.createDataFrame([(1, "Oi. Tudo bem?", "Oi. Tudo bem?")], "k int, a string, b string"), "k", "a", "b", encode)
    assert abs(same.first().sim - 1) < 1e-9


CONLLU = """# sent_id = s1
# text = Ele foi visto
1\tEle\tele\tPRON\t_\tGender=Masc\t3\tnsubj\t_\t_
2-3\tfoivisto\t_\t_\t_\t_\t_\t_\t_\t_
2\tfoi\tser\tAUX\t_\t_\t3\taux\t_\t_
3\tvisto\tver\tVERB\t_\tVoice=Pass|X=1=2\t0\troot\t_\tA=b

# sent_id = s2
1\told\told\tX\t_\t_\t0\troot\t_\t_

# sent_id = s2
1\tVai\tir\tAUX\t_\t_\t0\troot\t_\t_
2\t,\t,\tPUNCT\t_\t_\t1\tpunct\t_\t_
"""


def test_dependencies(spark, tmp_path):
    s = ud.last_of_each_sentence(ud.parse_sentences(spark.createDataFrame([(1, CONLLU)], "e int, t string"), "e", "t"))
    assert rows(s, "sent_no", "sent_key") == [(0, "s1"), (1, "s2")]
    tok = ud.with_neighbours(ud.with_head(ud.tokens(s), ["entry_id", "sent_key"]), ["entry_id", "sent_key"])
    got = {(r.sent_key, r.id): r for r in tok.collect()}
    assert got["s1", "1"].head_upos == "VERB" and got["s1", "3"].head_upos == "_" and got["s1", "3"].head_id == "0"
    assert got["s1", "1"].next_word == "foi" and got["s1", "2"].previous_word == "Ele" and got["s1", "2-3"].next_word is None
    p = ud.profile(tok, 1, ["entry_id", "sent_key"]).first()
    assert (p.m01_tokens, p.m02_sentences, p.m08_clauses_per_sentence) == (5, 2, 1.0)
    assert p.m13_post_pre_subjects == 0.0 and p.m14_passive_active == 1 / 4 and p.m07_commas_per_token == 1 / 5
    assert ud.tokens(s).filter("word = 'visto'").select(ud.attributes(F.col("feats"))).first()[0] == {"voice": "Pass", "x": "1"}
    from plainlens.sources import files

    files.write_conllu(s, str(tmp_path / "out"), "corpus-1")
    back = files.read_conllu(spark, str(tmp_path / "out"))
    assert back.count() >= 1 and back.filter("metadata['corpus'] = 'corpus-1'").count() == back.count()
    assert rows(ud.sentence(s, "s2"), "sent_no") == [(1,)]
    flagged = ud.matching(s, "raw", None, ["visto"])
    assert rows(flagged, "sent_key", "built") == [("s1", True), ("s2", False)]


def test_judging(spark):
    ok = '```json\n[{"id":"1__rep1","Versao_1":{"P1":{"nota":5}},"Versao_2":{"P1":{"nota":3}},"Ranking_geral":{"ordem_melhor_para_pior":["Versao_1"]}}]\n```'
    df = spark.createDataFrame([(1, ok), (2, '{"results": []}'), (3, "no json"), (4, '{"results": [{"id": "2__rep1"}]}')], "k int, a string")
    good, bad = judge.parsed(df, "a")
    assert rows(bad, "k") == [(3,)] and rows(good, "k", "result.id") == [(1, "1__rep1"), (4, "2__rep1")]
    s = judge.scores(good.filter("k = 1")).filter("criterion = 'P1'")
    assert rows(s, "slot", "score", "best") == [(1, 5, "Versao_1"), (2, 3, "Versao_1")]
    items = judge.judge_items(spark.createDataFrame([(1, "o", "x", "y")], "k int, o string, a string, b string"), "k", "o", ("m", "n"), ("a", "b"))
    assert all((r.v1, r.Versao_1_model) in {("x", "m"), ("y", "n")} for r in items.collect()) and items.count() == 3
    ids = spark.createDataFrame([([1, 7, 8, 5, 9, 5], [1, 1, 1, 1, 1, 0]), ([1, 2], [1, 1])], "i array<int>, m array<int>")
    got = [tuple(r) for r in ids.select(judge.masked_labels(F.col("i"), [7, 8], F.col("m")), judge.complete(F.col("i"), [7, 8], [9])).collect()]
    assert got == [([-100, -100, -100, 5, 9, -100], True), ([-100, -100], False)]


def test_order_statistics_by_runs(spark, monkeypatch):
    import random

    monkeypatch.setattr(stats, "HELD", 50)
    r = random.Random(3)
    for values in ([r.gauss(0, 1) for _ in range(4000)], [5.0] * 3000 + [r.random() for _ in range(300)], [1.0] * 200 + [2.0] * 200, [0.0, None, float("nan"), 7.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        want = sorted(v for v in values if v is not None and v == v)
        ranks = [0, len(want) // 3, len(want) // 2, len(want) - 1]
        assert stats.order_statistics(df, "v", ranks) == {k: want[k] for k in ranks}
        assert abs(stats.exact_quantiles(df, "v", [0.37])[0] - float(np.quantile(want, 0.37))) < 1e-12
    assert stats.exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    assert stats.means(spark.createDataFrame([(1.0, 2.0), (3.0, None)], "a double, b double"), ["a", "b"]).first() == (2.0, 2.0)


def test_ranks_by_value(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([5, 3, None, 3, 9, 10**12, -4] * 30)], "k long, i int").repartition(4)
    got = {r.i: r["rank"] for r in ranked_by_value(df, "k", "i", runs=4).collect()}
    rows = sorted(((r.k is not None, r.k or 0, r.i) for r in df.collect()))
    assert got == {i: n for n, (_, _, i) in enumerate(rows, 1)}
    assert ranked_by_value(df.limit(0), "k", "i").count() == 0


def test_postings_in_blocks(spark):
    tok = spark.createDataFrame([(s, p, str(p), "NOUN" if p % 2 else "VERB") for s in range(50) for p in range(1, 9)], "sent_key long, pos int, id string, upos string")
    got = ud.inverted_index(tok, ["sent_key"], block=7, salts=3).filter("field = 'upos'").collect()
    assert max(r.n for r in got) <= 7 and all(r.n == len(r.places) for r in got)
    nouns = sorted((p.sent_key, p.pos) for r in got if r.value == "NOUN" for p in r.places)
    assert nouns == [(s, p) for s in range(50) for p in (1, 3, 5, 7)]


def test_order_and_preview(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert [r.k for r in curate.ordered(df, "k").collect()] == [1, 2, 3] and [r.k for r in curate.preview(df, 2, "k").collect()] == [1, 2]


def test_sentence_counts_agree_with_the_sentences(spark):
    texts = ["", "  ", None, "Oi. Tudo bem?", "Dr. Silva et al. viu (n.º 3). Sim!\n\nNão.”  Fim", "a.b. c", "...  ... x", " . ", "n. n.n. n. x. "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.sentence_count(F.coalesce("t", F.lit(""))).alias("n"), F.size(T.sentences(F.coalesce("t", F.lit("")))).alias("m")).collect():
        assert r.n == r.m, r.t


def test_judge_answers_of_any_shape(spark):
    """What is taken for the JSON of an answer, and what it gives, against Python's own reader."""
    import json
    import random

    def cut(text):
        text = text.strip()
        for fence in ("```json", "```"):
            text = text[len(fence) :].lstrip() if text.startswith(fence) else text
        text = text[:-3].rstrip() if text.endswith("```") else text
        a, b = text.find("["), text.rfind("]")
        return text[a : b + 1] if a != -1 and b > a else text

    def ids(text):
        try:
            data = json.loads(cut(text))
        except ValueError:
            return None
        found = data if isinstance(data, list) else data.get("results", []) if isinstance(data, dict) else None
        return found if found is None else [x.get("id") if isinstance(x, dict) else None for x in found] if isinstance(found, list) else []

    r = random.Random(4)
    bits = ["```json", "```", "\n", " ", " ", "[", "]", '{"id":"7"}', '{"results":', "}", '[{"id":"1"},{"id":"2"}]', "Segue:", "[]", "{}", "\x1f", "12", '"a"', "null"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 7))) for _ in range(400)] + ["x" * 50_000 + '[{"id":"9"}]' + "y" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, a string")
    assert [x[0] for x in df.orderBy("k").select(judge.json_array(F.col("a"))).collect()] == [cut(t) for t in texts]
    want = {k: ids(t) for k, t in enumerate(texts)}
    good, bad = judge.parsed(df, "a")
    assert {x.k for x in bad.select("k").collect()} == {k for k, v in want.items() if v is None}
    got = {}
    for x in good.select("k", "result.id").collect():
        got.setdefault(x.k, []).append(x.id)
    assert got == {k: v for k, v in want.items() if v} and len(got) > 20
    odd = '[{"id": 3, "Versao_1": {"P1": {"nota": "5"}, "P2": {"nota": "x"}, "P3": 4}, "Ranking_geral": {"ordem_melhor_para_pior": []}}, 8]'
    rows = judge.scores(judge.parsed(spark.createDataFrame([(odd,)], "a string"), "a")[0]).filter("slot = 1 AND id IS NOT NULL").orderBy("criterion").collect()
    assert [(x.id, x.best, x.score) for x in rows] == [("3", None, s) for s in (5, None, None, None, None)]
