import os
import random

import numpy as np
import pytest

from plainlens.llm import langid

SF = "/root/testdata/sf0.01"


def test_trigrams():
    texts = [b"abc", b"", b"x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    code, text = langid.trigram_codes(data, np.array([0, 3, 3, 4]))
    assert text.tolist() == [0, 0, 0, 2] and code.max() < langid.DIMS and len(set(code.tolist())) == 4


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables are absent")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if langid.crc32_of(i) == 0]
    assert all(got[i].held_out == (langid.crc32_of(i) == 0) for i in truth)
    assert len(held) > 100 and np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    rows = [(i, "the quick brown fox " * 5, "en", 1) for i in range(20)] + [(i, "über den wolken muß " * 5, "de", 1) for i in range(20, 40)]
    rows += [(50, None, "en", 1), (51, "123 ...", None, 1), (None, "the fox", "en", 1), (52, "", "de", 1), (53, "a", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h int")
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    assert got[50].lang_pred == got[51].lang_pred == got[52].lang_pred == "und" and got[50].score == 0
    assert got[None].lang_pred == "en" and got[None].held_out is False
    assert {got[i].lang_pred for i in range(20)} == {"en"} and {got[i].lang_pred for i in range(20, 40)} == {"de"}
    assert {r.lang_pred for r in langid.identified(docs.withColumn("lang", docs.lang.substr(1, 0)).filter("doc_id > 49")).collect()} <= {"und", ""}
    assert langid.identified(docs.limit(0)).count() == 0


def test_nearest_centroid_by_brute_force(spark):
    """Features, document frequencies and the nearest centroid of each text, by plain loops."""
    import re

    r = random.Random(4)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["ße", "ün", "tr"], "cc": ["ça", "oi", "eu"]}
    rows = [(i, " ".join("".join(r.choice(sounds[x]) for _ in range(3)) for _ in range(r.randint(1, 30))) + r.choice(["", "!", " 12"]), x) for i, x in enumerate(r.choices(list(sounds), k=150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs.filter(langid.remainder() != 0))

    def counts(text):
        raw = f" {re.sub(r'[^a-zßüçA-Z]+', ' ', text.lower())} ".encode()
        out = {}
        for i in range(len(raw) - 2):
            code = ((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 18
            out[code] = out.get(code, 0) + 1
        return out

    learned = [(counts(t), x) for i, t, x in rows if langid.crc32_of(i)]
    for dim in (next(iter(learned[0][0])), 3, 77):
        df = sum(dim in c for c, _ in learned)
        assert abs(model.idf[dim] - (np.log((1 + len(learned)) / (1 + df)) + 1)) < 1e-5
    assert model.languages == sorted(sounds) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    got = {x.doc_id: x for x in langid.identified(docs).collect()}
    for i, text, _ in rows:
        v = {d: n**0.5 * float(model.idf[d]) for d, n in counts(text).items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        near = [sum(x * float(c[d]) for d, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(near)), key=near.__getitem__)
        assert abs(got[i].score - near[best]) < 1e-4 and (got[i].lang_pred == model.languages[model.of[best]] or sorted(near)[-1] - sorted(near)[-2] < 1e-4)
