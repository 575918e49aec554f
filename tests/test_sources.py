import json

from pyspark.sql import functions as F

from plainlens.models import generate
from plainlens.operators import curate
from plainlens.sources import files
from plainlens.streaming import incremental


def test_tables(spark, tmp_path):
    a = spark.createDataFrame([("o1", "p1", 1)], "original_text string, paraphrase string, x int")
    b = spark.createDataFrame([("o2", "p2")], "original_text string, simple_text string")
    files.write_table(a, str(tmp_path / "a.parquet"))
    files.write_table(b, str(tmp_path / "b.parquet"))
    both = files.read_pairs(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")])
    assert sorted(map(tuple, both.collect())) == [("o1", "p1"), ("o2", "p2")]
    assert files.with_source_file(a, "f").first().source_file == "f"
    assert files.with_source_file(files.read_table(spark, str(tmp_path / "a.parquet"))).first().source_file.endswith(".parquet")
    files.write_csv(spark.createDataFrame([("a\n\"b\"", 1)], "t string, n int"), str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "t string, n int").first().t == 'a\n"b"'
    files.write_json(spark.createDataFrame([("é", None)], "t string, n int"), str(tmp_path / "j"))
    line = (tmp_path / "j").glob("part-*")
    assert any(json.loads(x) == {"t": "é", "n": None} and "é" in x for p in line for x in p.read_text().splitlines())
    assert files.read_json(spark, str(tmp_path / "none.json"), "t string").count() == 0


def test_listing_and_pdf(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    for name in ("x.pdf", "e/y.PDF", "e/z.txt"):
        (tmp_path / "d" / name).write_bytes(b"%" + name.encode())
    assert sorted(r.name for r in files.list_files(spark, str(tmp_path / "d")).collect()) == ["x.pdf", "y.PDF"]

    def broken(data, margin):
        raise ValueError("no")

    def short(data, margin):
        return ["p" * 10]

    got = files.pdf_pages(spark, str(tmp_path / "d"), [broken, short]).collect()
    assert [r.pages for r in got] == [["p" * 10]] * 2 and all(r.error is None for r in got)
    assert {r.error for r in files.pdf_pages(spark, str(tmp_path / "d"), [broken]).collect()} == {"erro: ValueError: no"}


def test_replace_and_resume(spark, tmp_path):
    at = str(tmp_path / "t")
    files.replace_table(spark.range(3), at)
    files.replace_table(files.current_version(spark, at).filter("id > 0"), at)
    assert files.current_version(spark, at).count() == 2
    done = files.Checkpoints(spark, str(tmp_path / "k"), "id long, out_1 string")
    assert done.done().count() == 0
    done.append(spark.createDataFrame([(1, "x")], "id long, out_1 string"))
    assert sorted(r.id for r in done.left(spark.range(3), "id").collect()) == [0, 2]
    done.clear()
    assert done.done().count() == 0


def test_generation(spark):
    df = spark.createDataFrame([(0, "um dois tres"), (1, " "), (2, "bum quatro"), (3, "cinco")], "k long, t string")

    def factory():
        def ask(system, user, seed):
            if "bum" in user:
                raise RuntimeError("boom")
            return f"<think>x</think>{seed}"

        return ask

    got = {r.k: r for r in generate.completions(df, "k", "t", factory, "s", "T: {text}", 3, 42, 10).collect()}
    assert (got[0].out_1, got[0].out_3, got[3].out_2) == ("42", "44", "73")
    assert got[2].out_1 is None and got[2].error == "RuntimeError: boom" and 1 not in got
    done = spark.createDataFrame([(0, "x", None), (3, "", None)], "k long, out_1 string, error string")
    again = generate.generated(df, done, "k", "t", generate.fake_client, "s", "{text}")
    assert sorted((r.k, r.out_1) for r in again.collect()) == [(0, "x"), (2, "bum"), (3, "cinco")]
    notes = generate.annotated(df, "k", "t", lambda: str.upper, spark.createDataFrame([(0, "cached")], "k long, conllu string"), wait=0)
    assert {r.k: r.conllu for r in notes.collect()}[0] == "cached" and notes.count() == 4
    pages = {("A", 1): {"content": [{"nomeProduto": "x"}], "totalPages": 2}, ("A", 2): {"content": [{"nomeProduto": "y"}], "totalPages": 2}}
    scan = files.paged_source(lambda letter, page: pages.get((letter, page), {}), ["A", "B"])
    assert sorted(r.nomeProduto for r in scan(spark).collect()) == ["x", "y"]


def test_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for i in range(2):
        spark.createDataFrame([(i, "Oi. Tudo bem?")], "id int, t string").write.mode("append").parquet(src)
        incremental.score_arrivals(spark, src, "id int, t string", "t", out, ck)
    got = spark.read.parquet(out)
    assert sorted(r.id for r in got.collect()) == [0, 1] and got.filter(F.col("flesch") > 0).count() == 2
    assert curate.distinct_sorted(got, "band").count() == 1


def test_one_indented_document(spark, tmp_path):
    import json

    at = str(tmp_path / "doc")
    files.write_json_document(spark.createDataFrame([("ação", 1, None)], "a string, b int, c string"), at)
    text = "\n".join(r.value for r in spark.read.text(at, wholetext=True).collect()).rstrip("\n")
    assert text == json.dumps({"a": "ação", "b": 1, "c": None}, indent=4, ensure_ascii=False)


def test_downloads_skip_what_is_there_and_check_the_answer(spark, tmp_path):
    folder = str(tmp_path / "pdf")
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "old.pdf").write_bytes(b"old")

    def factory():
        def get(url):
            if url == "boom":
                raise OSError("no answer")
            return {"ok": (200, "application/pdf", b"new"), "html": (200, "text/html", b"x"), "gone": (404, "application/pdf", b"")}[url]

        return get

    rows = [("old.pdf", "ok"), ("a.pdf", "ok"), ("a.pdf", "ok"), ("b.pdf", "html"), ("c.pdf", "gone"), ("d.pdf", "boom"), (None, "ok")]
    df = spark.createDataFrame(rows, "n string, u string")
    got = {r["name"]: r.outcome for r in files.downloaded(df, "n", "u", folder, factory).collect()}
    assert got == {"old.pdf": "there", "a.pdf": "written", "b.pdf": "status 200, text/html", "c.pdf": "status 404, application/pdf", "d.pdf": "OSError: no answer"}
    assert sorted(p.name for p in (tmp_path / "pdf").iterdir()) == ["a.pdf", "old.pdf"] and (tmp_path / "pdf" / "old.pdf").read_bytes() == b"old"


def test_metrics_by_name(spark):
    import pytest

    df = spark.createDataFrame([(1, "O gato dorme. Ele come.", "O gato dorme.", "O gato come.")], "k int, a string, b string, c string")
    assert {"flesch", "lexical_diversity", "d_sari", "sliding_similarity"} <= set(generate.METRICS)
    assert generate.metric_of("lexical_diversity")(df, "k", "a", "b").first() == (1, 5, 3)
    assert generate.metric_of("sliding_similarity")(df, "k", "a", "a").first().sim > 0.999
    assert 0 <= generate.metric_of("d_sari")(df, "k", "a", "b", "c").first().d_sari <= 100
    with pytest.raises(KeyError):
        generate.metric_of("absent")


def test_greedy_unless_warm():
    assert generate.decoding() == {"do_sample": False} and generate.decoding(0.7, 0.9) == {"do_sample": True, "temperature": 0.7, "top_p": 0.9}


def test_split_of_a_dataset(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("test", "train")}
    for n, p in paths.items():
        spark.createDataFrame([(n,)], "n string").write.parquet(p)
    assert files.read_split(spark, paths).first().n == "train" and files.read_split(spark, {"test": paths["test"]}).first().n == "test"
