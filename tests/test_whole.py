"""Registered queries see whole inputs: brute force on small tables."""

import random

from plainlens.plans import catalog


def documents(spark, at, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return rows


def test_labels_of_whole_texts(spark, tmp_path):
    r = random.Random(5)
    text = lambda n, low=1: " ".join("w" * r.randint(low, 5) for _ in range(n))
    # markers (lengths 2, 3 and 4) before and after the 60th token, on both sides of it, and none
    texts = [text(n) for n in (0, 1, 59, 60, 61, 200, 3000)]
    texts += [text(70, 5) + " ww www " + text(90, 4), "ww www " + text(80, 5) + " wwww", text(59, 5) + " ww www " + text(30, 5) + " wwww", text(90, 5)]
    documents(spark, tmp_path, texts)
    want, labels = {}, {}
    for i, t in enumerate(texts):
        ids = [len(w) % 6 for w in t.split()]
        p = next((j for j in range(len(ids) - 1) if ids[j : j + 2] == [2, 3]), None)
        after = [] if p is None else ids[p + 2 :]
        ratio = len(after) / max(len(ids), 1)
        want[i] = (len(ids), len(after), round(ratio, 6), 4 in after and len(after) >= 20 and ratio >= 0.05)
        labels[i] = str([-100] * (len(ids) - len(after)) + after)
    got = catalog.QUERIES["label_validity"](spark, str(tmp_path)).collect()
    assert {x.row_id: (x.total_length, x.valid_labels, x.label_ratio, x.is_valid) for x in got} == want
    assert {x.row_id: x.labels for x in catalog.QUERIES["masked_labels"](spark, str(tmp_path)).collect()} == labels


def test_judge_answers_of_all_events(spark, tmp_path):
    r = random.Random(6)
    events = [(i, r.randint(1, 50)) for i in [*range(700), *range(2990, 3400), 10**6]]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    want, model = [], {}
    for e, u in events:
        for slot in (1, 2):
            for c in range(1, 6):
                score = (e * (slot + 1) + u * c) % 5 + 1
                want.append((f"{e}__rep1", "Versao_1" if u % 2 == 0 else "Versao_2", slot, f"P{c}", score))
                model.setdefault(("a" if (e % 2 == 0) == (slot == 1) else "b", f"P{c}"), []).append(score)
    got = catalog.QUERIES["judge_scores"](spark, str(tmp_path)).collect()
    assert sorted((x.id, x.best, x.slot, x.criterion, x.score) for x in got) == sorted(want)
    means = {(x.model, x.criterion): (x.n, x.mean_score) for x in catalog.QUERIES["judge_means"](spark, str(tmp_path)).collect()}
    assert means == {k: (len(v), round(sum(v) / len(v), 6)) for k, v in model.items()}


def test_backfill_of_all_documents(spark, tmp_path):
    rows = documents(spark, tmp_path, [f"text {i}" for i in range(31)])
    got = catalog.QUERIES["backfilled_columns"](spark, str(tmp_path)).collect()
    assert sorted((x.row_id, x.lang, x.source, x.n_chars) for x in got) == sorted((i, *rest) for i, _, *rest in rows)
