import unicodedata

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from plainlens.functions import mapping as M, text as T


def brute(text):
    """[(normal character, start, stop)] of the original, 1-based: a letter goes with its marks, a phrase as a whole."""
    out, i = [], 0
    while i < len(text):
        j = i + 1
        if unicodedata.category(text[i]) == "Mn":
            i = j
            continue
        while j < len(text) and unicodedata.category(text[j]) == "Mn":
            j += 1
        form = "".join(x for x in unicodedata.normalize("NFKD", text[i]) if unicodedata.category(x) != "Mn").upper()
        out += [(x, i + 1, j + 1) for x in form]
        i = j
    for phrase in ("ESSE MEDICAMENTO", "ESSE PRODUTO", "ESTE PRODUTO"):
        flat = "".join(x for x, _, _ in out)
        while (at := flat.find(phrase)) >= 0:
            part = out[at : at + len(phrase)]
            out[at : at + len(phrase)] = [(x, part[0][1], part[-1][2]) for x in "ESTE MEDICAMENTO"]
            flat = "".join(x for x, _, _ in out)
    return out


def check(spark, texts):
    m = T.leaflet_form(F.col("t"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", m)
    spans = F.transform(F.sequence(F.lit(1), F.length("m.text")), lambda i: F.struct(M.original_span(F.col("m.maps"), i, i + 1), M.original_span(F.col("m.maps"), F.lit(1), i + 1)))
    for r in df.select("t", "m.text", F.when(F.length("m.text") > 0, spans).alias("s")).collect():
        want = brute(r.t)
        assert r.text == "".join(x for x, _, _ in want), repr(r.t)
        assert [tuple(a) for a, _ in r.s or []] == [(a, b) for _, a, b in want], repr(r.t)
        assert [tuple(b) for _, b in r.s or []] == [(want[0][1], b) for _, _, b in want], repr(r.t)


def test_lengths_that_change(spark):
    check(spark, ["", "abc", "Straße ﬁm ½ ŉ", "É é̂x", "́a", "ß́s", "a😀 este produto é", "Esse  produto, esse produto: ESTE PRODUTOesse medicamento", "EŚTE PRODÚTO!", "ﬀeste pro" + "duto" * 3])


def test_a_long_text(spark):
    text = "x" * 60_000 + "ß este produto " + "é" * 3_000 + "\n1. Para que este produto é indicado?\n" + "ß" * 2_000 + "texto"
    got = T.with_sections(spark.createDataFrame([(text,)], "t string"), "t", "s").collect()[0].s
    assert got["sec_1"] == "ß" * 2_000 + "texto"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet=st.sampled_from("aéEßﬁ½ŉ́̂😀 ºŒǆİıſ\n"), max_size=12).map(lambda s: s.replace("º", "este produto").replace("Œ", "ESSE PRODUTO")), min_size=1, max_size=12))
def test_any_text(spark, texts):
    check(spark, texts)


def test_section_slices_have_no_drift(spark):
    rows = ["ßßß😀ﬁ½ é\n1. PARA QUE ESTE PRODUTO É INDICADO?\nuso\n2. como esse produto funciona?\nação ß\n6. COMO DEVO USAR ESTE PRODUTO?\nfim"]
    got = T.with_sections(spark.createDataFrame([(t,) for t in rows], "t string"), "t", "s").collect()[0].s
    assert (got["sec_1"], got["sec_2"], got["sec_6"]) == ("uso", "ação ß", "fim")
    span = spark.createDataFrame([(t,) for t in rows], "t string").select("t", F.explode(T.section_spans(F.col("t"))).alias("s")).collect()
    assert [r.t[r.s.start - 1 : r.s.stop - 1] for r in span] == ["1. PARA QUE ESTE PRODUTO É INDICADO?", "2. como esse produto funciona?", "6. COMO DEVO USAR ESTE PRODUTO?"]


def test_a_span_of_part_of_a_piece_takes_it_whole(spark):
    m = M.replacing(M.upper_without_accents(M.plain(F.lit("xßy"))), ("SY",), "-")
    assert spark.range(1).select(m["text"], M.original_span(m["maps"], F.lit(2), F.lit(3)), M.original_span(m["maps"], F.lit(2), F.lit(2))).collect()[0][:] == ("XS-", (2, 3), None)
