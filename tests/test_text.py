import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from plainlens.functions import text as T


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [tuple(r)[1:] for r in sorted(df.select("i", *columns).collect())]


TEXTS = ["", "  \xa0 ", "Olá. Tudo bem? Sim!", "Art. 5 da lei. Dr. Silva veio.", "O remédio não faz mal; é ótimo\xa0mesmo", "ÀÉ ß º ﬁ x² naïve", "sem fim", "n.º 3 e al. b. Fim."]


def test_counts_follow_python(spark):
    got = values(spark, TEXTS, T.word_count(F.col("t")), T.token_count(F.col("t")), T.syllables(F.col("t")), T.letter_count(F.col("t")))
    for text, (words, tokens, vowels, letters) in zip(TEXTS, got):
        assert words == len(re.findall(r"\w+", text)) and tokens == len(text.split())
        assert vowels == len(re.findall("[aeiouáéíóúâêôãõàü]", text.lower())) and letters == len(re.sub("[^A-Za-zÀ-ÿ]", "", text))


def test_sentences(spark):
    got = [r[0] for r in values(spark, TEXTS, T.sentences(F.col("t")))]
    assert got[0] == [] and got[1] == []
    assert got[2] == ["Olá.", "Tudo bem?", "Sim!"]
    assert got[3] == ["Art. 5 da lei.", "Dr. Silva veio."]
    assert got[6] == ["sem fim"] and got[7] == ["n.º 3 e al. b.", "Fim."]


def test_flesch(spark):
    (score, band), = values(spark, ["O gato bebe. Ele dorme."], T.flesch(F.col("t")), T.flesch_band(T.flesch(F.col("t"))))
    assert score == round(248.835 - 1.015 * (5 / 2) - 84.6 * (9 / 5), 2) and band == "Muito fácil (nível fundamental)"
    bands = [r[0] for r in values(spark, ["75", "74.9", "50", "25", "24"], T.flesch_band(F.col("t").cast("double")))]
    assert bands == ["Muito fácil (nível fundamental)", "Médio (nível médio)", "Médio (nível médio)", "Difícil (nível superior)", "Muito difícil (pós-graduação / textos técnicos)"]


def test_accents(spark):
    rows = ["áéîõüçñ ÀÖ", "áè", "ø æ ß", "ºª²ﬁ½"]
    got = values(spark, rows, T.strip_accents(F.col("t")), T.strip_accents(F.col("t"), "NFKD"))
    bare = lambda t, form: "".join(c for c in unicodedata.normalize(form, t) if unicodedata.category(c) != "Mn")
    assert got == [(bare(t, "NFD"), bare(t, "NFKD")) for t in rows]


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (5, 1), (6, 2), (8, 2), (9, 3), (11, 3), (12, 4)])
def test_sentence_windows(spark, n, want):
    df = spark.range(1).select(F.slice(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda x: x.cast("string")), 1, n).alias("a"))
    got = df.select(T.windows(F.col("a"), 5, 2).alias("w")).first().w
    assert len(got) == want and (not n or got[-1][-1] == str(n))


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (120, 1), (121, 2), (210, 2), (211, 3)])
def test_word_windows(spark, n, want):
    df = spark.createDataFrame([(" ".join("w" * n),)], "t string")
    assert len(T.with_word_chunks(df, "t", "c").first().c) == want


def test_overlap_must_be_less(spark):
    with pytest.raises(ValueError):
        T.windows(F.array(), 2, 2)


def test_small_functions(spark):
    one = lambda t, c: values(spark, [t], c)[0][0]
    t = F.col("t")
    assert one("AÇÃO X __12.pdf", T.medicine_name(t)) == "ACAO X"
    assert one("a-\nb  \n\n\n\nc\xad ", T.join_lines(t)) == "ab\n\nc"
    assert one("<think>a\nb</think> x </THINK>", T.clean_llm_output(t)) == "x"
    assert one("**BULA (texto SIMPLIFICADO)** – X\n\n---\nOi", T.clean_llm_output(t, "B")) == "---\nOi"
    assert one("Bula simples de uso\nOi", T.clean_llm_output(t)) == "Oi"
    assert one(None, T.clean_llm_output(t)) is None and one(None, T.clean_llm_output(t, "B")) == ""
    assert one("<think>\n\n</think>\n oi", T.strip_empty_think(t)) == "oi"
    assert one(" a/b c!!d ", T.model_file_name(t)) == "a_b_c_d" and one("!!", T.model_file_name(t)) == "model"
    assert one('a<b>:"c', T.file_name(t)) == "a_b___c"
    assert one("a?*b \n c", T.safe_file_name(t)) == "a_b _ c" and one(None, T.safe_file_name(t)) == "sem_nome"
    assert one("abcdef", T.shorten(t, 3)) == "abc... [truncado, len=6]"
    assert one("a=1; b=2=3; a=4; x", T.parse_cookies(t)) == {"a": "4", "b": "2=3"}
    assert one("este produto e ESSE MEDICAMENTO", T.normalize_text_for_match(t)) == "ESTE MEDICAMENTO E ESTE MEDICAMENTO"
    assert one("– x-y — - z", T.letter_word_count(t)) == 2


BODY = "texto " * 120


def test_patient_section(spark):
    full = f"Capa\n1. PARA QUE ESTE MEDICAMENTO É INDICADO?\n{BODY}\nIII – DIZERES LEGAIS\nfim"
    second = f"Capa\nPara que esse produto foi indicado?\n{BODY}\nDizeres legais"
    rows = [full, full.replace("III – DIZERES LEGAIS", "Em caso de uso de grande quantidade, ligue"), full.replace("III – DIZERES LEGAIS", ""), second, "curto", None]
    got = values(spark, rows, T.patient_section(F.col("t")), T.patient_section(F.col("t"), 2))
    want = f"1. PARA QUE ESTE MEDICAMENTO É INDICADO?\n{BODY}".strip()
    assert [g[0] for g in got] == [want, want, None, None, None, None]
    assert got[3][1].startswith("Para que esse produto") and got[3][1].endswith("texto") and got[2][1] is None


def test_sections_in_any_order(spark):
    text = "6. Como devo usar este medicamento?\nuso\nPARA QUE SERVE ESTE PRODUTO?\nserve\nquando não devo utilizar esse medicamento?\nnunca"
    df = T.with_sections(spark.createDataFrame([(text,), (None,), (" ",)], "t string"), "t", "s")
    a, b, c = (r.s for r in df.collect())
    assert (a["sec_6"], a["sec_1"], a["sec_3"], a["sec_2"]) == ("uso", "serve", "nunca", "")
    assert set(b.values()) == set(c.values()) == {""} and len(b) == 9


def test_headings_found_on_the_text_as_by_a_map_of_offsets(spark):
    """Positions of headings by normalising each character and mapping back, against the search on the original text."""
    import random
    import re
    import unicodedata

    def normalised(text):
        out, back = [], []
        for i, c in enumerate(text):
            for x in unicodedata.normalize("NFKD", c):
                if unicodedata.category(x) != "Mn":
                    out.append(x.upper())
                    back.append(i)
        return "".join(out), back

    r = random.Random(12)
    heads = ["1. Para que este medicamento é indicado?", "2 - COMO ESTE  PRODUTO FUNCIONA", "3) quando não devo utilizar este medicamento?", "Como guardar este produto?", "7. O que fazer se me esquecer de usar este medicamento?", "8. QUAIS OS MALES QUE ESTE MEDICAMENTO PODE CAUSAR?"]
    texts = []
    for _ in range(40):
        parts = [p for h in r.sample(heads, r.randint(0, 6)) for p in (" ".join(r.choice(["ação", "dose", "ÉTER", "você", "\n"]) for _ in range(r.randint(0, 9))), h)]
        texts.append("\n".join([*parts, "fim."]))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.section_spans(F.col("t")).alias("s")).collect()
    for x in got:
        flat, back = normalised(x.t)
        want = []
        for sec, pattern in T.SECTION_HEADINGS.items():
            if m := re.search(pattern, flat):
                want.append((back[m.start()] + 1, back[m.end() - 1] + 2, sec))
        assert [tuple(s) for s in x.s] == sorted(want), x.t
