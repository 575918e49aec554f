"""Registered queries over the driver's tables, each with the SQL that must give the same rows in DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.rows import exploded
from ..models import svd
from ..operators import curate, judge, pages, postings, punkt, sari, similarity, splits, stats, ud
from ..operators.kept import shared_folder
from ..operators.ordering import ranked_by_value
from ..sources import files
from . import views as V
from .views import d_band, d_flesch, d_sentences, d_strip, d_sub, d_syllables, d_tokens, d_windows, d_words, q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# --- text statistics ---------------------------------------------------------------------------------------------------


@query(f"WITH {V.DOCS}, s AS (SELECT lang, {d_flesch('docs')} AS f FROM docs) SELECT lang, {d_band('f')} AS band, count(*) AS n, round(avg(f), 6) AS mean_flesch FROM s GROUP BY 1, 2")
def flesch_by_lang_band(spark, d):
    x = T.with_flesch(V.docs(spark, d).select("lang", "docs"), "docs", "f")
    return x.groupBy("lang", T.flesch_band(F.col("f")).alias("band")).agg(F.count("*").alias("n"), r6(F.avg("f")).alias("mean_flesch"))


@query(f"WITH {V.DOCS} SELECT row_id, {d_words('docs')} AS n_words, {d_syllables('docs')} AS n_syllables, len({d_sentences('docs')}) AS n_sentences, len({d_tokens('docs')}) AS n_tokens, len(regexp_replace(docs, '[^A-Za-zÀ-ÿ]', '', 'g')) AS n_letters, round({d_flesch('docs')}, 6) AS flesch FROM docs")
def document_statistics(spark, d):
    c = F.col("docs")
    x = V.docs(spark, d).select("row_id", T.word_count(c).alias("n_words"), T.syllables(c).alias("n_syllables"), T.sentence_count(c).alias("n_sentences"), T.token_count(c).alias("n_tokens"), T.letter_count(c).alias("n_letters"))
    return x.withColumn("flesch", r6(T.flesch_of(F.col("n_words"), F.col("n_syllables"), F.col("n_sentences"))))


@query(f"WITH {V.DOCS}, s AS (SELECT row_id, docs, {d_flesch('docs')} AS f FROM docs) SELECT 'Documento ' || row_number() OVER (ORDER BY row_id) AS document, round(f, 6) AS score, {d_band('round(f, 2)')} AS label FROM s")
def rated_documents(spark, d):
    x = T.with_flesch(V.docs(spark, d).select("row_id", "docs"), "docs", "f").select("row_id", "f")
    return ranked_by_value(x, "row_id").select(F.concat(F.lit("Documento "), F.col("rank").cast("string")).alias("document"), r6(F.col("f")).alias("score"), T.flesch_band(F.round("f", 2)).alias("label"))


@query(f"WITH {V.DOCS} SELECT row_id, len(list_distinct(list_filter(string_split(regexp_replace(strip_accents(lower(docs)), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> ''))) AS n_distinct FROM docs")
def lexical_diversity(spark, d):
    return V.docs(spark, d).select("row_id", T.lexical_diversity(F.col("docs")).alias("n_distinct"))


@query(f"WITH {V.DOCS} SELECT row_id, len(list_filter(string_split({d_sub('translate(docs, ' + q('–—−‑') + ', ' + q('----') + ')', '[^A-Za-zÀ-ÿ-]+', q(' '))}, ' '), lambda w: w <> '' AND w <> '-')) AS n FROM docs")
def letter_words(spark, d):
    return V.docs(spark, d).select("row_id", T.letter_word_count(F.col("docs")).alias("n"))


@query(f"WITH {V.DOCS}, s AS (SELECT row_id, unnest({d_sentences('docs')}) AS sentence FROM docs) SELECT row_id, count(*) AS n, sum(length(sentence)) AS chars, min(sentence) AS first_sentence FROM s GROUP BY 1")
def sentence_split(spark, d):
    x = exploded(V.docs(spark, d), ["row_id"], T.sentences(F.col("docs")), "sentence")
    return x.groupBy("row_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"), F.min("sentence").alias("first_sentence"))


@query(f"WITH {V.DOCS} SELECT row_id, strip_accents(docs) AS bare, lower(strip_accents(docs)) AS low FROM docs")
def accents_removed(spark, d):
    c = T.strip_accents(F.col("docs"))
    return V.docs(spark, d).select("row_id", c.alias("bare"), F.lower(c).alias("low"))


@query(f"WITH {V.DOCS}, m AS (SELECT row_id, docs, replace(docs, 'ß', 'ss') AS t FROM docs) SELECT row_id, {d_sub('upper(strip_accents(replace(t, chr(173), ' + q('') + ')))', '[ \\t]+', q(' '))} AS v1, {d_sub('translate(upper(strip_accents(replace(t, chr(173), ' + q('') + '))), chr(160), ' + q(' ') + ')', '[ \\t]+', q(' '))} AS v2 FROM m")
def normalised_for_match(spark, d):
    t = F.replace(F.col("docs"), F.lit("ß"), F.lit("ss"))
    return V.docs(spark, d).select("row_id", T.normalize_for_match(t).alias("v1"), T.normalize_for_match(t, nbsp=True).alias("v2"))


@query(f"WITH {V.DOCS}, m AS (SELECT row_id, replace(replace(docs, 'ß', 'ss'), ' the ', ' esse  Produto ') AS t FROM docs) SELECT row_id, {d_sub("replace(replace(replace(upper(strip_accents(t)), 'ESSE MEDICAMENTO', 'ESTE MEDICAMENTO'), 'ESSE PRODUTO', 'ESTE MEDICAMENTO'), 'ESTE PRODUTO', 'ESTE MEDICAMENTO')", '[ \\t]+', q(' '))} AS norm FROM m")
def medicine_wording(spark, d):
    t = F.replace(F.replace(F.col("docs"), F.lit("ß"), F.lit("ss")), F.lit(" the "), F.lit(" esse  Produto "))
    return V.docs(spark, d).select("row_id", T.normalize_text_for_match(t).alias("norm"))


@query(f"WITH {V.DOCS}, j AS (SELECT row_id, replace(replace(replace(docs, ' the ', '-' || chr(10)), '. ', '.  ' || chr(10) || chr(10) || chr(10)), 'en', chr(173) || 'en') AS t FROM docs) SELECT row_id, {d_strip(d_sub(d_sub(d_sub('replace(t, chr(173), ' + q('') + ')', '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', q('\\1\\2')), '[ \\t]+\\n', 'chr(10)'), '\\n{3,}', 'chr(10) || chr(10)'))} AS joined FROM j")
def lines_joined(spark, d):
    t = F.replace(F.replace(F.replace(F.col("docs"), F.lit(" the "), F.lit("-\n")), F.lit(". "), F.lit(".  \n\n\n")), F.lit("en"), F.lit("­en"))
    return V.docs(spark, d).select("row_id", T.join_lines(t).alias("joined"))


@query(f"WITH {V.DOCS} SELECT row_id, upper(split_part(pdf_filename, '__', 1)) AS medicine_name FROM docs")
def medicine_names(spark, d):
    return V.docs(spark, d).select("row_id", T.medicine_name(F.col("pdf_filename")).alias("medicine_name"))


@query(f"WITH {V.DOCS} SELECT row_id, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace({d_strip('docs')}, '[^\\p{{L}}\\p{{N}}_\\-.]+', '_', 'g'), '_+', '_', 'g'), 1, 80), '^_+|_+$', '', 'g'), ''), 'model') AS model_file, {d_strip('translate(docs, ' + q('<>:\"/' + chr(92) + '|?*') + ', ' + q('_' * 9) + ')')} AS plain_file, CASE WHEN length(docs) <= 800 THEN docs ELSE substr(docs, 1, 800) || '... [truncado, len=' || length(docs) || ']' END AS short FROM docs")
def file_names_and_short_texts(spark, d):
    c = F.col("docs")
    return V.docs(spark, d).select("row_id", T.model_file_name(c).alias("model_file"), T.file_name(c).alias("plain_file"), T.shorten(c).alias("short"))


@query(f"WITH {V.DOCS}, s AS (SELECT row_id, {d_strip('CASE WHEN docs = ' + q('') + ' THEN ' + q('sem_nome') + ' ELSE docs END')} AS t FROM docs), u AS (SELECT row_id, {d_strip('substr(' + d_sub(d_sub('t', '[<>:\"/' + chr(92) * 2 + '|?*\\n\\r\\t]+', q('_')), V.WS + '+', q(' ')) + ', 1, 180)')} AS t FROM s) SELECT row_id, CASE WHEN t = '' THEN 'sem_nome' ELSE t END AS safe FROM u")
def safe_names(spark, d):
    return V.docs(spark, d).select("row_id", T.safe_file_name(F.col("docs")).alias("safe"))


#: What is left of each kind of answer: form A knows leaflets' headings, form B also those of texts (the line under one stays).
_CLEANED = "CASE WHEN row_id % 4 = 2 THEN {} || docs || repeat(chr(10), 4) || 'Fim ' ELSE docs END"


@query(f"WITH {V.DOCS} SELECT row_id, {d_strip(d_sub(_CLEANED.format("'**TEXTO (versão SIMPLES)**' || chr(10) || chr(10) || '---' || chr(10)"), '\\n{3,}', 'chr(10) || chr(10)'))} AS form_a, {d_strip(d_sub(_CLEANED.format("'---' || chr(10)"), '\\n{3,}', 'chr(10) || chr(10)'))} AS form_b FROM docs")
def cleaned_model_output(spark, d):
    c = F.col("raw")
    return V.llm_raw(spark, d).select("row_id", T.clean_llm_output(c, "A").alias("form_a"), T.clean_llm_output(c, "B").alias("form_b"))


@query(f"WITH {V.DOCS} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN {d_strip('docs')} ELSE docs END AS text FROM docs")
def empty_reasoning_prefix(spark, d):
    raw = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("<think>\n\n</think>\n"), F.col("docs"))).otherwise(F.col("docs"))
    return V.docs(spark, d).select("row_id", T.strip_empty_think(raw).alias("text"))


@query(f"WITH {V.DOCS} SELECT row_id, 'Simplifique.' || chr(10) || docs || chr(10) || 'Fim ' || lang AS prompt, 42 + row_id AS seed, 42 + row_id * 10 + 2 AS third_seed FROM docs")
def prompts_and_seeds(spark, d):
    k = F.col("row_id")
    return V.docs(spark, d).select("row_id", T.prompt("Simplifique.\n{text}\nFim {lang}", text=F.col("docs"), lang=F.col("lang")).alias("prompt"), (k + 42).alias("seed"), (k * 10 + 44).alias("third_seed"))


@query("SELECT event_id, event_type AS kind, 'a=' || user_id AS token FROM events")
def cookies_parsed(spark, d):
    raw = F.concat(F.lit(" kind=old; kind="), F.col("event_type"), F.lit("; plain ; token=a="), F.col("user_id").cast("string"), F.lit(";"))
    m = V.table(spark, d, "events").select("event_id", T.parse_cookies(raw).alias("m"))
    return m.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["token"].alias("token"))


#: Fixed values, written out for the SQL: a token, and the threshold of an abbreviation.
_TOKEN = r"[\p{L}\p{N}]([\p{L}\p{N}.'’-]*[\p{L}\p{N}])?\.*"
_ABBREVIATIONS = rf"""w AS (SELECT unnest(regexp_extract_all(replace(docs, ' the ', ' approx. the '), {q(_TOKEN)})) AS w FROM docs),
t AS (SELECT CASE WHEN regexp_matches(rtrim(lower(w), '.'), '^[+-]?[0-9][0-9.,-]*$') THEN '##number##' ELSE rtrim(lower(w), '.') END AS type, w LIKE '%.' AS dot FROM w),
c AS (SELECT type, count(*) FILTER (dot) AS with_dot, count(*) FILTER (NOT dot) AS without FROM t GROUP BY 1),
n AS (SELECT sum(with_dot)::DOUBLE AS d, sum(with_dot + without)::DOUBLE AS n FROM c),
s AS (SELECT type, with_dot, without, length(replace(type, '.', ''))::DOUBLE AS l, -2 * ((with_dot * ln(d / n) + without * ln(1 - d / n)) - (with_dot * ln(0.99::DOUBLE) + without * ln(1 - 0.99::DOUBLE))) AS ratio FROM c, n WHERE with_dot > 0 AND type <> '##number##' AND regexp_matches(type, '\p{{L}}')),
r AS (SELECT type, with_dot, without, ratio * exp(-l) * (length(type) - l + 1) * pow(greatest(l, 1), -without::DOUBLE) AS score FROM s)"""


@query(f"WITH {V.DOCS}, {_ABBREVIATIONS} SELECT type, with_dot, without, round(score, 6) AS score FROM r WHERE score >= 0.3")
def learned_abbreviations(spark, d):
    t = V.docs(spark, d).select("row_id", F.replace("docs", F.lit(" the "), F.lit(" approx. the ")).alias("docs"))
    return punkt.abbreviations(punkt.type_counts(punkt.fragments(t, "row_id", "docs"))).withColumn("score", r6(F.col("score")))


@query()
def learned_sentences(spark, d):
    """Sentences by boundaries learned from the documents; the tests hold the method against a small implementation."""
    t = V.docs(spark, d).select("row_id", F.replace("docs", F.lit(" the "), F.lit(" approx. the ")).alias("docs"))
    found = punkt.sentences(t, "row_id", "docs", punkt.trained(t, "row_id", "docs"))
    return found.select("row_id", F.size("sentences").alias("n_sentences"), F.sha2(F.array_join("sentences", "\n"), 256).alias("sha256"))


# --- chunks and sections -----------------------------------------------------------------------------------------------


@query(f"WITH {V.DOCS}, w AS (SELECT row_id, unnest({d_windows(d_tokens('docs'), 120, 30)}) AS c, generate_subscripts({d_windows(d_tokens('docs'), 120, 30)}, 1) AS n FROM docs) SELECT row_id, n - 1 AS chunk, len(c) AS n_words, array_to_string(c, ' ') AS text FROM w")
def word_chunks(spark, d):
    x = exploded(T.with_word_chunks(V.docs(spark, d), "docs", "_c"), ["row_id"], "_c", "text", "chunk")
    return x.select("row_id", "chunk", T.token_count(F.col("text")).alias("n_words"), "text")


@query(f"WITH {V.DOCS}, s AS (SELECT row_id, {d_sentences('docs', False)} AS s FROM docs), w AS (SELECT row_id, unnest({d_windows('s', 5, 2)}) AS c, generate_subscripts({d_windows('s', 5, 2)}, 1) AS n FROM s) SELECT row_id, n - 1 AS chunk, array_to_string(c, ' ') AS text FROM w")
def sentence_chunks(spark, d):
    return exploded(T.with_sentence_chunks(V.docs(spark, d), "docs", "_c"), ["row_id"], "_c", "text", "chunk")


_LAST = "greatest(" + ", ".join(f"CASE WHEN {'TRUE' if k == 1 else f'(id + {k}) % 7 <> 0'} THEN {k} ELSE 0 END" for k in range(1, 10)) + ")"


@query(f"WITH {V.LEAFLETS}, r AS (SELECT id, {_LAST} AS last, k, [s1, s2, s3, s4, s5, s6, s7, s8, s9][k] AS t FROM parts, range(1, 10) x(k)) SELECT id, 'sec_' || k AS sec, CASE WHEN k > 1 AND (id + k) % 7 = 0 THEN '' ELSE {d_strip('t || CASE WHEN k = last AND id % 5 <> 0 THEN chr(10) || ' + q('III - DIZERES LEGAIS') + ' || chr(10) || ' + q('fim') + ' ELSE ' + q('') + ' END')} END AS text FROM r")
def leaflet_sections(spark, d):
    return similarity.section_rows(V.leaflets(spark, d), "id", "leaflet")


@query(f"WITH {V.LEAFLETS}, c AS (SELECT id, CASE WHEN id % 5 <> 0 THEN {d_strip(d_sub(d_sub(d_sub('replace(substr(leaflet, 5, instr(leaflet, ' + q('III - DIZERES') + ') - 5), chr(173), ' + q('') + ')', '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', q('\\1\\2')), '[ \\t]+\\n', 'chr(10)'), '\\n{3,}', 'chr(10) || chr(10)'))} END AS t FROM leaflets) SELECT id, CASE WHEN length(t) >= 500 THEN t END AS section FROM c")
def patient_sections(spark, d):
    return V.leaflets(spark, d).select("id", T.patient_section(F.col("leaflet")).alias("section"))


@query(f"WITH {V.LEAFLETS}, c AS (SELECT id, CASE WHEN id % 5 <> 0 THEN {d_strip(d_sub(d_sub(d_sub('translate(replace(substr(leaflet, 5, instr(leaflet, ' + q('DIZERES LEGAIS') + ') - 5), chr(173), ' + q('') + '), chr(160), ' + q(' ') + ')', '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', q('\\1\\2')), '[ \\t]+\\n', 'chr(10)'), '\\n{3,}', 'chr(10) || chr(10)'))} END AS t FROM leaflets) SELECT id, CASE WHEN length(t) >= 200 THEN t END AS section FROM c")
def patient_sections_second_pass(spark, d):
    return V.leaflets(spark, d).select("id", T.patient_section(F.col("leaflet"), 2, 200).alias("section"))


@query(f"WITH {V.LEAFLETS}, h AS (SELECT id, k, instr(leaflet, [{', '.join(q(h) for h in V.HEADINGS)}][k]) AS start FROM leaflets, range(1, 10) x(k)) SELECT id, 'sec_' || k AS sec, start, lead(start) OVER (PARTITION BY id ORDER BY start) AS next_start FROM h WHERE start > 0")
def section_spans_with_next(spark, d):
    x = exploded(V.leaflets(spark, d), ["id"], T.section_spans(F.col("leaflet")), "s").select("id", "s.sec", "s.start")
    return pages.with_next_start(x, "id", "start")


def _any_case(words: str) -> str:
    """A pattern of words in the leaflets below: letters in either case, bare or with an accent, of its own or as a mark."""
    return words.replace("N", "[Nn]").replace("E", "[EeÉé]\\x{301}?").replace("O", "[Oo]").replace("A", "[AaÃã]\\x{303}?").replace(" ", "\\s+")


#: Fixed values, written out for the SQL: the headings' words before and after the product's name.
_HEADS = {1: ("PARA QUE", "E INDICADO"), 2: ("COMO", "FUNCIONA"), 3: ("QUANDO NAO DEVO USAR", ""), 6: ("COMO DEVO USAR", "")}
_DRIFT = "'Maße ½ ﬁm e' || chr(769) || ' ' || chr(128512) || chr(10) || replace(CASE WHEN id % 2 = 0 THEN replace(leaflet, 'ESTE MEDICAMENTO', 'esse produto') ELSE replace(leaflet, 'ESTE MEDICAMENTO', 'Este Produto') END, 'É', 'E' || chr(769))"


@query(f"WITH {V.LEAFLETS}, d AS (SELECT id, {_DRIFT} AS t FROM leaflets), h AS (" + " UNION ALL ".join(f"SELECT id, {q(f'sec_{k}')} AS sec, t, regexp_extract(t, {q(f'{k}[.] ' + _any_case(a) + chr(92) + 's+(?i:es[st]e produto)' + _any_case((' ' + b) if b else '') + '[?]')}) AS heading FROM d" for k, (a, b) in _HEADS.items()) + ") SELECT id, sec, instr(t, heading) AS start, instr(t, heading) + length(heading) AS stop, heading, substr(t, instr(t, heading) + length(heading), 40) AS body FROM h WHERE heading <> ''")
def headings_in_original(spark, d):
    """Headings found in the normal form of leaflets whose letters and names change length in it, sliced from the original."""
    x, accent, smile = V.leaflets(spark, d), "\u0301", "\U0001f600"
    names = F.replace(F.col("leaflet"), F.lit("ESTE MEDICAMENTO"), F.when(F.col("id") % 2 == 0, "esse produto").otherwise("Este Produto"))
    t = F.concat(F.lit(f"Maße ½ ﬁm e{accent} {smile}\n"), F.replace(names, F.lit("É"), F.lit(f"E{accent}")))
    s = exploded(x.select("id", t.alias("t")).withColumn("s", T.section_spans(F.col("t"))), ["id", "t"], "s", "s")
    cut = F.substr("t", F.col("s.start"), F.col("s.stop") - F.col("s.start"))
    return s.filter(F.col("s.sec").isin(*[f"sec_{k}" for k in _HEADS])).select("id", "s.sec", "s.start", "s.stop", cut.alias("heading"), F.substr("t", F.col("s.stop"), F.lit(40)).alias("body"))


# --- curation ----------------------------------------------------------------------------------------------------------


@query(f"WITH {V.PAIRS} SELECT pair_id, round({d_flesch('original_text')}, 6) AS flesch_original, round({d_flesch('paraphrase')}, 6) AS flesch_paraphrase, round({d_flesch('paraphrase')} - {d_flesch('original_text')}, 6) AS flesch_diff FROM pairs WHERE {d_flesch('paraphrase')} - {d_flesch('original_text')} > 0")
def flesch_gain(spark, d):
    x = curate.flesch_gain(V.pairs(spark, d), "original_text", "paraphrase", digits=None)
    return x.select("pair_id", *[r6(F.col(c)).alias(c) for c in ("flesch_original", "flesch_paraphrase", "flesch_diff")])


_DIV = "len(list_distinct(list_filter(string_split(regexp_replace(strip_accents(lower({})), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '')))"


@query(f"WITH {V.PAIRS}, s AS (SELECT pair_id, {_DIV.format('original_text')} AS a, {_DIV.format('paraphrase')} AS b FROM pairs) SELECT pair_id, a AS div_original, b AS div_paraphrase, a - b AS div_diff FROM s WHERE a - b > 0")
def diversity_gain(spark, d):
    return curate.diversity_gain(V.pairs(spark, d), "original_text", "paraphrase").select("pair_id", "div_original", "div_paraphrase", "div_diff")


_SIM = "CASE WHEN pair_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN pair_id % 7 = 0 THEN NULL ELSE ((conv_id * 37 + turn * 13) % 100) / 100.0::DOUBLE END"


def _sim_pairs(spark, d):
    k = F.col("pair_id")
    return V.pairs(spark, d).withColumn("sim", F.when(k % 11 == 0, float("nan")).when(k % 7 == 0, None).otherwise(((F.col("conv_id") * 37 + F.col("turn") * 13) % 100) / 100.0))


@query(f"WITH {V.PAIRS}, s AS (SELECT *, {_SIM} AS sim FROM pairs) SELECT pair_id, sim FROM s WHERE sim > 0.8 AND NOT isnan(sim)")
def similar_pairs(spark, d):
    return curate.similar(_sim_pairs(spark, d)).select("pair_id", "sim")


@query(f"WITH {V.PAIRS}, s AS (SELECT *, {_SIM} AS sim, {d_flesch('paraphrase')} - {d_flesch('original_text')} AS g FROM pairs) SELECT pair_id, sim FROM s WHERE {d_strip('original_text')} <> '' AND {d_strip('paraphrase')} <> '' AND g > 0 AND sim > 0.8 AND NOT isnan(sim)")
def curated_pairs(spark, d):
    return curate.curated(_sim_pairs(spark, d), "original_text", "paraphrase", digits=None).select("pair_id", "sim")


@query(f"WITH {V.PAIRS}, s AS (SELECT {_SIM} AS sim, {d_strip('original_text')} <> '' AND {d_strip('paraphrase')} <> '' AS f, round({d_flesch('paraphrase')}, 2) - round({d_flesch('original_text')}, 2) > 0 AS g FROM pairs) SELECT count(*) AS n_total, count(*) FILTER (f) AS n_filled, count(*) FILTER (f AND g) AS n_gain, count(*) FILTER (f AND g AND sim > 0.8 AND NOT isnan(sim)) AS n_similar FROM s")
def curation_funnel(spark, d):
    return curate.curation_funnel(_sim_pairs(spark, d), "original_text", "paraphrase")


@query(f"WITH {V.DOCS}, e AS (SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 'Error: Could not paraphrase - ' || docs WHEN row_id % 7 = 0 THEN NULL WHEN row_id % 9 = 0 THEN chr(160) || ' ' ELSE docs END AS t FROM docs) SELECT row_id, t FROM e WHERE NOT coalesce(starts_with(t, 'Error: Could not paraphrase -'), FALSE)")
def rows_without_errors(spark, d):
    return curate.without_errors(_gaps(spark, d), "t")


def _gaps(spark, d):
    k, c = F.col("row_id"), F.col("docs")
    return V.docs(spark, d).select("row_id", F.when(k % 5 == 0, F.concat(F.lit("Error: Could not paraphrase - "), c)).when(k % 7 == 0, None).when(k % 9 == 0, "  ").otherwise(c).alias("t"))


@query(f"WITH {V.DOCS} SELECT row_id, row_id % 7 = 0 AND row_id % 5 <> 0 OR (row_id % 9 = 0 AND row_id % 5 <> 0) OR {d_strip('docs')} = '' AS todo, CASE WHEN row_id % 5 = 0 THEN length({d_strip(q('Error: Could not paraphrase - ') + ' || docs')}) WHEN row_id % 7 = 0 OR row_id % 9 = 0 THEN 0 ELSE length({d_strip('docs')}) END AS n FROM docs")
def work_left(spark, d):
    x = _gaps(spark, d).join(V.docs(spark, d).select("row_id", "docs"), "row_id")
    return x.select("row_id", curate.needs_work(["t", "docs"]).alias("todo"), F.length(T.clean(F.col("t"))).alias("n"))


@query(f"WITH {V.DOCS} SELECT pdf_filename AS file, docs AS text, CAST(NULL AS VARCHAR) AS rev1 FROM docs WHERE row_id >= 100 AND row_id < 350")
def projected_row_range(spark, d):
    x = curate.row_range(V.docs(spark, d), "row_id", 100, 250)
    x = curate.without(curate.nulled(x.withColumn("rev1", F.lit("x")), ["rev1"]), ["lang", "not there"])
    return curate.project(x, {"pdf_filename": "file", "docs": "text", "rev1": "rev1"})


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, d):
    o = V.table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return curate.keep_keys(V.table(spark, d, "customer").select("c_custkey"), o, "c_custkey")


@query("WITH c AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k, c_custkey FROM customer) SELECT k, c_custkey FROM c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.k AND o_totalprice > 100000)")
def anti_join_keeps_nulls(spark, d):
    c = V.table(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k"), "c_custkey")
    o = V.table(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))
    return curate.drop_keys(c, o, "k")


@query(f"WITH {V.LLM_RAW} SELECT row_id, docs AS a, raw AS b, docs = raw AS same FROM llm_raw")
def aligned_outputs(spark, d):
    x = V.llm_raw(spark, d)
    both, off = curate.aligned(x.select("row_id", "docs", F.col("docs").alias("k")), x.select("row_id", F.col("raw").alias("docs"), F.col("docs").alias("k")), "row_id", ["k"])
    return curate.union_all([both, off]).select("row_id", F.col("docs").alias("a"), F.col("docs_right").alias("b"), (F.col("docs") == F.col("docs_right")).alias("same"))


@query("SELECT o_orderkey, o_totalprice, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def results_with_metadata(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), "o_totalprice")
    c = V.table(spark, d, "customer").join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), "c_name", "n_name")
    return curate.with_metadata(o, c)[0].select("o_orderkey", "o_totalprice", "c_name", "n_name")


@query("SELECT count(*) AS n_unknown FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)")
def unknown_results(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return curate.with_metadata(o, V.table(spark, d, "customer").select(F.col("c_custkey").alias("id")))[1].agg(F.count("*").alias("n_unknown"))


_OLD_NEW = "old AS (SELECT doc_id // 2 AS k, doc_id AS row_id, 0 AS src, text FROM documents WHERE doc_id % 5 < 3), new AS (SELECT doc_id // 2 AS k, doc_id AS row_id, 1 AS src, text FROM documents WHERE doc_id % 5 > 1)"


def _old_new(spark, d):
    """All documents as two results that overlap: some keys are in both, some in one of them."""
    x = V.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("k"), F.col("doc_id").alias("row_id"), "text")
    return x.filter("row_id % 5 < 3"), x.filter("row_id % 5 > 1")


@query(f"WITH {_OLD_NEW}, u AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT k, row_id, text FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY src, row_id) = 1")
def merged_keep_first(spark, d):
    old, new = _old_new(spark, d)
    return curate.merged(old, new, "k", "row_id")


@query(f"WITH {_OLD_NEW} SELECT k, row_id, text FROM new UNION ALL SELECT k, row_id, text FROM old WHERE k NOT IN (SELECT k FROM new)")
def updates_override(spark, d):
    old, new = _old_new(spark, d)
    return curate.overriding(old, new, "k")


@query(f"WITH {_OLD_NEW} SELECT k, row_id, text, NULL::VARCHAR AS extra FROM old UNION ALL SELECT k, row_id, text, 'x' FROM new")
def union_with_missing_columns(spark, d):
    old, new = _old_new(spark, d)
    return curate.union_all([old, new.withColumn("extra", F.lit("x"))])


@query("SELECT DISTINCT doc_id // 2 AS k FROM documents WHERE doc_id % 5 < 3 INTERSECT SELECT doc_id // 2 FROM documents WHERE doc_id % 5 > 1")
def shared_values(spark, d):
    return curate.shared_values(*_old_new(spark, d), "k")


@query("SELECT DISTINCT p_brand FROM part WHERE p_size > 30 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)")
def absent_values(spark, d):
    p = V.table(spark, d, "part")
    return curate.absent_values(p.filter("p_size > 30"), p.filter("p_size > 49"), "p_brand")


@query("SELECT DISTINCT p_type FROM part ORDER BY p_type")
def distinct_values(spark, d):
    return curate.distinct_sorted(V.table(spark, d, "part"), "p_type")


@query("WITH l AS (SELECT split_part(url, '/', -1) AS name, min(url) AS found FROM pages GROUP BY 1), w AS (SELECT DISTINCT unnest([split_part(url, '/', -1), page_id::VARCHAR || '.pdf', page_id::VARCHAR]) AS name FROM pages) SELECT w.name, l.found FROM w LEFT JOIN l USING (name)")
def files_located(spark, d):
    p = V.table(spark, d, "pages")
    number = F.col("page_id").cast("string")
    names = F.array(F.element_at(F.split("url", "/"), -1), F.concat(number, F.lit(".pdf")), number)
    return curate.located(p.select(F.explode(names).alias("name")).distinct(), p.select("url"), "name", "url")


@query("WITH s AS (SELECT doc_id AS row_id, lang FROM documents) SELECT s.row_id, s.lang, d.source, d.n_chars FROM s LEFT JOIN documents d ON d.doc_id = s.row_id")
def backfilled_columns(spark, d):
    x = V.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang", "source", "n_chars")
    return curate.backfilled(x.select("row_id", "lang"), x, "row_id")


@query(f"WITH {V.PAIRS} SELECT original_text, paraphrase FROM pairs UNION ALL SELECT docs, lang FROM (SELECT text AS docs, lang FROM documents)")
def united_pairs(spark, d):
    other = V.table(spark, d, "documents").select("source", F.col("text").alias("original_text"), F.col("lang").alias("simple_text"))
    return files.united_pairs([V.pairs(spark, d), other])


@query("SELECT n_nationkey, 'nation.parquet' AS source_file, 'fixed' AS given FROM nation")
def source_files(spark, d):
    x = files.with_source_file(V.table(spark, d, "nation"))
    name = F.regexp_extract("source_file", "nation.*$", 0)  # a folder of part files gives the part's name
    return x.select("n_nationkey", F.when(name.startswith("nation"), name).otherwise("nation.parquet").alias("source_file"), F.lit("fixed").alias("given"))


@query(f"WITH {V.DOCS} SELECT row_id, lang, CAST(NULL AS VARCHAR) AS rev1, CAST(NULL AS DOUBLE) AS score FROM docs")
def columns_added(spark, d):
    return curate.with_columns_present(V.docs(spark, d).select("row_id", "lang"), {"lang": "string", "rev1": "string", "score": "double"})


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def ordered_rows(spark, d):
    return curate.ordered(V.table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.desc("c_acctbal"), "c_custkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5")
def head_preview(spark, d):
    return curate.preview(V.table(spark, d, "part").select("p_partkey", "p_name"), 5, "p_partkey")


# --- statistics --------------------------------------------------------------------------------------------------------

_LENGTHS = f"""lens AS (SELECT pair_id, len(regexp_replace(original_text, '[^A-Za-zÀ-ÿ]', '', 'g')) AS orig_chars, len({d_sentences('original_text')}) AS orig_sents, len(regexp_replace(paraphrase, '[^A-Za-zÀ-ÿ]', '', 'g')) AS para_chars, len({d_sentences('paraphrase')}) AS para_sents FROM pairs)"""


@query(f"WITH {V.PAIRS}, {_LENGTHS} SELECT pair_id, orig_chars, orig_sents, para_chars, para_sents, round(para_chars / nullif(orig_chars, 0), 6) AS char_ratio FROM lens")
def length_columns(spark, d):
    x = stats.length_columns(V.pairs(spark, d), "original_text", "paraphrase")
    return x.select("pair_id", "orig_chars", "orig_sents", "para_chars", "para_sents", r6(F.col("char_ratio")).alias("char_ratio"))


def _describe_sql(by: str = "") -> str:
    one = lambda c: f"SELECT {by + ', ' if by else ''}'{c}' AS metric, count({c}) AS n, round(sum({c})::DOUBLE, 4) AS total, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM orders{' GROUP BY ' + by if by else ''}"
    return " UNION ALL ".join(one(c) for c in ("o_totalprice", "o_custkey"))


@query(_describe_sql())
def describe(spark, d):
    x = stats.described(V.table(spark, d, "orders"), ["o_totalprice", "o_custkey"])
    return x.select("metric", "n", F.round("total", 4).alias("total"), r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query(_describe_sql("o_orderstatus"))
def describe_by_group(spark, d):
    x = stats.described(V.table(spark, d, "orders"), ["o_totalprice", "o_custkey"], "o_orderstatus")
    return x.select("o_orderstatus", "metric", "n", F.round("total", 4).alias("total"), r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("SELECT count(DISTINCT p_name) AS n_groups, round(avg(TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_retailprice::VARCHAR END AS DOUBLE)), 6) AS safe_mean, round(avg(p_size), 6) AS mean_size FROM part")
def means_and_distinct(spark, d):
    return V.table(spark, d, "part").agg(F.countDistinct("p_name").alias("n_groups"), r6(stats.safe_mean(F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_retailprice").cast("string")))).alias("safe_mean"), r6(F.avg("p_size")).alias("mean_size"))


@query("SELECT 0.1::DOUBLE AS quantile, round(quantile_cont(o_totalprice, 0.1), 6) AS value FROM orders UNION ALL SELECT 0.9::DOUBLE, round(quantile_cont(o_totalprice, 0.9), 6) FROM orders")
def exact_quantiles(spark, d):
    return stats.quantiles(V.table(spark, d, "orders"), "o_totalprice").select("quantile", r6(F.col("value")).alias("value"))


@query("SELECT round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM events")
def spread(spark, d):
    x = stats.spread(V.table(spark, d, "events"), "value")
    return x.select(*[r6(F.col(c)).alias(c) for c in x.columns])


@query("WITH r AS (SELECT l_discount * 15 AS x FROM lineitem), i AS (SELECT least(floor(x / 0.1), 14)::INTEGER AS bin FROM r WHERE x BETWEEN 0 AND 1.5), c AS (SELECT bin, count(*) AS n FROM i GROUP BY 1) SELECT b::INTEGER AS bin, round((b + 0.5) * 0.1, 6) AS center, coalesce(n, 0) AS n, round(coalesce(n, 0) / ((SELECT count(*) FROM i) * 0.1), 6) AS density FROM range(15) x(b) LEFT JOIN c ON c.bin = b")
def density_histogram(spark, d):
    x = stats.histogram(V.table(spark, d, "lineitem").select((F.col("l_discount") * 15).alias("x")), "x", 0.0, 1.5, 15)
    return x.select("bin", r6(F.col("center")).alias("center"), "n", r6(F.col("density")).alias("density"))


@query("WITH v AS (SELECT s_acctbal / 10000 AS x FROM supplier), s AS (SELECT count(x) AS n, coalesce(stddev_samp(x), 0) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM v), w AS (SELECT n, CASE WHEN least(sd, iqr / 1.349) > 0 THEN greatest(0.9 * least(sd, iqr / 1.349) * pow(n, -0.2), 0.001) ELSE 0.05 END AS bw FROM s), g AS (SELECT p::INTEGER AS point, 0.1::DOUBLE * p / 39 AS gx FROM range(40) t(p)) SELECT point, round(gx, 6) AS x, round(sum(exp(-0.5 * pow((gx - x) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 5) AS density FROM g, v, w GROUP BY point, gx")
def kernel_density(spark, d):
    x = stats.kernel_density(V.table(spark, d, "supplier").select((F.col("s_acctbal") / 10000).alias("x")), "x", 0.0, 0.1, 40)
    return x.select("point", r6(F.col("x")).alias("x"), F.round("density", 5).alias("density"))


@query("SELECT min(n_chars) AS low, round(avg(n_chars), 6) AS mean, max(n_chars) AS high, count(*) AS n_total, count(*) FILTER (n_chars <= 2000) AS n_kept, round(count(*) FILTER (n_chars <= 2000) * 100.0 / count(*), 6) AS percent FROM documents")
def length_cap(spark, d):
    x = V.table(spark, d, "documents")
    return stats.length_range(x, "n_chars").crossJoin(stats.within_length(x, "n_chars", 2000)[1]).select("low", r6(F.col("mean")).alias("mean"), "high", "n_total", "n_kept", r6(F.col("percent")).alias("percent"))  # one row each


@query("SELECT event_id, least(greatest(value, 20), 80) AS clipped, coalesce(value BETWEEN 20 AND 80, FALSE) AS inside FROM events")
def clipped_and_ranged(spark, d):
    return V.table(spark, d, "events").select("event_id", curate.clipped("value", 20.0, 80.0).alias("clipped"), curate.finite_between("value", 20.0, 80.0).alias("inside"))


# --- samples and splits ------------------------------------------------------------------------------------------------


@query(f"WITH {V.GROUPS} SELECT row_id, medicine_name FROM grp QUALIFY row_number() OVER (PARTITION BY medicine_name ORDER BY md5('42|' || row_id), row_id) = 1")
def one_per_group(spark, d):
    return splits.one_per_group(V.groups(spark, d), "medicine_name", "row_id").select("row_id", "medicine_name")


@query(f"WITH {V.GROUPS}, g AS (SELECT DISTINCT medicine_name FROM grp) SELECT medicine_name FROM g ORDER BY md5('42|' || medicine_name), medicine_name LIMIT 20")
def sampled_groups(spark, d):
    return splits.sample_groups(V.groups(spark, d), "medicine_name", 20)


@query("SELECT c_custkey FROM customer ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 50")
def chosen_rows(spark, d):
    return splits.choose(V.table(spark, d, "customer").select("c_custkey"), "c_custkey", 50, 7)


@query(f"WITH {V.PAIRS}, p AS (SELECT pair_id, original_text, paraphrase, ('0x' || substr(md5('42|' || pair_id), 1, 1))::INTEGER % 2 AS s FROM pairs) SELECT pair_id, CASE WHEN s = 0 THEN 1 ELSE 2 END AS slot, 'original_text' AS model, original_text AS text FROM p UNION ALL SELECT pair_id, CASE WHEN s = 0 THEN 2 ELSE 1 END, 'paraphrase', paraphrase FROM p")
def blinded_pairs(spark, d):
    return splits.blind_pairs(V.pairs(spark, d), "pair_id", "original_text", "paraphrase")


_SPLIT = f"g AS (SELECT DISTINCT medicine_name FROM grp WHERE medicine_name NOT IN (SELECT min(medicine_name) FROM grp)), r AS (SELECT medicine_name, row_number() OVER (ORDER BY md5('42|' || medicine_name), medicine_name) AS r, count(*) OVER () AS n FROM g), s AS (SELECT medicine_name, CASE WHEN r <= floor(0.8 * n) THEN 'train' WHEN r <= floor(0.8 * n) + floor((n - floor(0.8 * n)) / 2) THEN 'val' ELSE 'test' END AS split FROM r UNION ALL SELECT min(medicine_name), 'test' FROM grp)"


def _split(spark, d):
    g = V.groups(spark, d)
    return splits.group_split(g, "medicine_name", forced_test=[g.agg(F.min("medicine_name")).first()[0]])


@query(f"WITH {V.GROUPS}, {_SPLIT} SELECT row_id, medicine_name, split FROM grp JOIN s USING (medicine_name)")
def group_split(spark, d):
    return _split(spark, d).select("row_id", "medicine_name", "split")


@query("SELECT NULL::VARCHAR AS medicine_name, 0::BIGINT AS n_splits WHERE FALSE")
def split_leakage(spark, d):
    return splits.leaking_groups(_split(spark, d), "medicine_name")


@query(f"WITH {V.GROUPS}, {_SPLIT} SELECT medicine_name, 2::BIGINT AS n_splits FROM s WHERE split <> 'test' AND medicine_name IN (SELECT medicine_name FROM grp WHERE row_id % 97 = 0)")
def planted_split_leakage(spark, d):
    """Some rows of the split are moved to the test set; their groups come out, but for those that were there anyway."""
    x = _split(spark, d)
    return splits.leaking_groups(x.unionByName(x.filter("row_id % 97 = 0").withColumn("split", F.lit("test"))), "medicine_name")


@query(f"WITH {V.GROUPS}, {_SPLIT} SELECT split AS set_name, count(*) AS n_rows, count(DISTINCT medicine_name) AS n_groups FROM grp JOIN s USING (medicine_name) GROUP BY 1")
def split_summary(spark, d):
    x = _split(spark, d)
    return splits.summarised({s: x.filter(F.col("split") == s) for s in ("train", "val", "test")}, "medicine_name")


@query(f"""WITH {V.GROUPS}, b AS (SELECT quantile_cont(flesch_diff, 0.1) AS lo, quantile_cont(flesch_diff, 0.9) AS hi FROM grp),
gd AS (SELECT DISTINCT medicine_name FROM grp, b WHERE flesch_diff >= hi), g AS (SELECT medicine_name FROM gd ORDER BY md5('42|' || medicine_name), medicine_name LIMIT 10),
hd AS (SELECT DISTINCT medicine_name FROM grp, b WHERE flesch_diff <= lo AND medicine_name NOT IN (SELECT medicine_name FROM g)), h AS (SELECT medicine_name FROM hd ORDER BY md5('42|' || medicine_name), medicine_name LIMIT 10)
SELECT 'good' AS kind, row_id FROM grp, b WHERE flesch_diff >= hi AND medicine_name IN (SELECT medicine_name FROM g) UNION ALL SELECT 'hard', row_id FROM grp, b WHERE flesch_diff <= lo AND medicine_name IN (SELECT medicine_name FROM h)""")
def challenge_sets(spark, d):
    good, hard = splits.challenge_sets(V.groups(spark, d), "medicine_name", "flesch_diff", 10)
    return good.select(F.lit("good").alias("kind"), "row_id").unionByName(hard.select(F.lit("hard").alias("kind"), "row_id"))


@query("WITH a AS (SELECT doc_id, floor((row_number() OVER (ORDER BY n_chars, doc_id) - 1) / 40)::INTEGER AS bucket FROM documents), b AS (SELECT *, floor((row_number() OVER (PARTITION BY bucket ORDER BY md5('3407|' || doc_id), doc_id) - 1) / 4)::INTEGER AS batch FROM a) SELECT doc_id, bucket, batch, md5('3407|' || bucket || '/' || batch) AS batch_order FROM b")
def length_batches(spark, d):
    x = V.table(spark, d, "documents").select("doc_id", "n_chars")
    return splits.length_batches(x, "doc_id", "n_chars", 4, 10).select("doc_id", "bucket", "batch", "batch_order")


@query("SELECT doc_id, r::INTEGER AS repeat, doc_id || '__rep' || r AS id, doc_id // 8 AS call FROM documents, range(1, 4) x(r)")
def repeated_items(spark, d):
    x = splits.repeated(V.table(spark, d, "documents").select("doc_id"), "doc_id")
    return splits.call_batches(x, "doc_id", 8)


# --- pages -------------------------------------------------------------------------------------------------------------

_LINES = f"pl AS (SELECT doc, page, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x{{B}}\\x{{C}}\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda z: {d_strip('z')}), lambda z: z <> '') AS l FROM pg), li AS (SELECT doc, page, len(l) AS n_lines, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM pl), ln AS (SELECT *, regexp_replace(upper(strip_accents(replace(replace(line, 'ß', 'ss'), chr(173), ''))), '[ \\t]+', ' ', 'g') AS norm FROM li), kinds AS (SELECT doc, 'head' AS kind, norm FROM ln WHERE line_no < 2 UNION ALL SELECT doc, 'foot', norm FROM ln WHERE line_no >= n_lines - 2), common AS (SELECT doc, kind, norm, count(*) AS n FROM kinds GROUP BY ALL HAVING count(*) >= 3)"


def _pages(spark, d):
    return V.pages(spark, d).withColumn("text", F.replace("text", F.lit("ß"), F.lit("ss")))


@query(f"WITH {V.PAGES}, {_LINES} SELECT doc, kind, norm, n FROM common")
def repeated_margins(spark, d):
    return pages.margin_counts(pages.page_lines(_pages(spark, d), "doc", "page", "text"), "doc")


@query(f"WITH {V.PAGES}, {_LINES}, kept AS (SELECT doc, page, string_agg(replace(line, 'ß', 'ss'), chr(10) ORDER BY line_no) AS t FROM ln WHERE NOT (line_no < 2 AND EXISTS (SELECT 1 FROM common c WHERE c.doc = ln.doc AND c.kind = 'head' AND c.norm = ln.norm)) AND NOT (line_no >= greatest(0, n_lines - 2) AND EXISTS (SELECT 1 FROM common c WHERE c.doc = ln.doc AND c.kind = 'foot' AND c.norm = ln.norm)) GROUP BY 1, 2) SELECT pg.doc, pg.page, coalesce(t, '') AS text FROM pg LEFT JOIN kept USING (doc, page)")
def pages_without_margins(spark, d):
    return pages.without_margins(_pages(spark, d), "doc", "page", "text")


_KEPT = "kept AS (SELECT doc, page, string_agg(replace(line, 'ß', 'ss'), chr(10) ORDER BY line_no) AS t FROM ln WHERE NOT (line_no < 2 AND EXISTS (SELECT 1 FROM common c WHERE c.doc = ln.doc AND c.kind = 'head' AND c.norm = ln.norm)) AND NOT (line_no >= greatest(0, n_lines - 2) AND EXISTS (SELECT 1 FROM common c WHERE c.doc = ln.doc AND c.kind = 'foot' AND c.norm = ln.norm)) GROUP BY 1, 2)"


@query(f"WITH {V.PAGES}, {_LINES}, {_KEPT}, f AS (SELECT pg.doc, string_agg(coalesce(t, ''), chr(10) || chr(10) ORDER BY pg.page) AS t FROM pg LEFT JOIN kept USING (doc, page) GROUP BY 1) SELECT doc, {d_strip(d_sub(d_sub(d_sub('replace(t, chr(173), ' + q('') + ')', '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', q('\\1\\2')), '[ \\t]+\\n', 'chr(10)'), '\\n{3,}', 'chr(10) || chr(10)'))} AS text FROM f")
def full_texts(spark, d):
    return pages.full_text(_pages(spark, d), "doc", "page", "text")


# --- SARI --------------------------------------------------------------------------------------------------------------


#: The tokenisation rules, in DuckDB's notation.
_SARI_RULES = (("<skipped>", ""), (r"-\n", ""), (r"\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "))


def _sari_tokens(x: str) -> str:
    s = f"' ' || lower({x}) || ' '"
    for pattern, to in _SARI_RULES:
        s = d_sub(s, pattern, q(to))
    return d_tokens(s)


_SARI = f"""{V.TRIPLES}, t AS (SELECT pair_id AS k, original_text AS a, paraphrase AS b, reference AS c FROM triples),
c AS (SELECT k, len({d_tokens('a')}) AS i, len({d_tokens('b')}) AS o, len({d_tokens('c')}) AS r, len({d_sentences('b')}) AS os, len({d_sentences('c')}) AS rs FROM t),
p AS (SELECT k, CASE WHEN o >= r THEN 1 ELSE exp((o - r) / o) END AS lp1, CASE WHEN o <= r THEN 1 ELSE exp((r - o) / greatest(i - r, 1)) END AS lp2, exp(-abs(rs - os) / greatest(rs, os)) AS slp FROM c WHERE i > 0 AND o > 0 AND r > 0),
tk AS (SELECT k, 'a' AS side, {_sari_tokens('a')} AS w FROM t UNION ALL SELECT k, 'b', {_sari_tokens('b')} FROM t UNION ALL SELECT k, 'c', {_sari_tokens('c')} FROM t),
g AS (SELECT k, side, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda j: array_to_string(list_slice(w, j, j + n - 1), ' '))) AS gram FROM tk, range(1, 5) x(n)),
m AS (SELECT k, n, gram, count(*) FILTER (side = 'a') AS s, count(*) FILTER (side = 'b') AS o, count(*) FILTER (side = 'c') AS r FROM g GROUP BY 1, 2, 3),
u AS (SELECT k, n, count(*) FILTER (o > 0 AND s = 0 AND r > 0) AS ah, count(*) FILTER (o > 0 AND s = 0) AS asys, count(*) FILTER (r > 0 AND s = 0) AS aref, sum(least(o, s, r)) AS kh, sum(least(o, s)) AS ksys, sum(least(r, s)) AS kref, sum(least(greatest(s - o, 0), greatest(s - r, 0))) AS dh, sum(greatest(s - o, 0)) AS dsys, sum(greatest(s - r, 0)) AS dref FROM m GROUP BY 1, 2),
f AS (SELECT k, sum(coalesce(2.0 * ah / nullif(asys + aref, 0), 0)) * 25 AS fa, sum(coalesce(2.0 * kh / nullif(ksys + kref, 0), 0)) * 25 AS fk, sum(coalesce(2.0 * dh / nullif(dsys + dref, 0), 0)) * 25 AS fd FROM u GROUP BY 1)"""


@query(f"WITH {_SARI} SELECT t.k AS pair_id, round((fa * lp1 + fk * lp2 * slp + fd * lp2) / 3, 5) AS d_sari, round(fa * lp1, 5) AS d_sari_add, round(fk * lp2 * slp, 5) AS d_sari_keep, round(fd * lp2, 5) AS d_sari_del FROM t LEFT JOIN (p JOIN f USING (k)) USING (k)")
def d_sari(spark, d):
    x = sari.d_sari(V.triples(spark, d), "pair_id", "original_text", "paraphrase", "reference")
    return x.select("pair_id", *[F.round(c, 5).alias(c) for c in ("d_sari", "d_sari_add", "d_sari_keep", "d_sari_del")])


# --- similarity --------------------------------------------------------------------------------------------------------


def _chunks(spark, d):
    """Vectors as chunks of documents of twenty each; even ones are the original's, odd ones the simplified text's."""
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.floor(F.col("vec_id") / 20).alias("doc"), F.col("embedding").alias("vec"), (F.col("vec_id") % 5 + 1).alias("weight"))
    return e.filter(F.col("chunk") % 2 == 0), e.filter(F.col("chunk") % 2 == 1)


_CHUNKS = "e AS (SELECT vec_id AS chunk, vec_id // 20 AS doc, embedding::DOUBLE[] AS vec, vec_id % 5 + 1 AS weight FROM embeddings), pr AS (SELECT a.doc, a.chunk AS ac, a.weight AS aw, b.chunk AS bc, b.weight AS bw, list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) AS sim FROM e a JOIN e b ON a.doc = b.doc AND a.chunk % 2 = 0 AND b.chunk % 2 = 1)"


@query(f"WITH {_CHUNKS} SELECT doc, ac AS a_chunk, bc AS b_chunk, round(sim, 6) AS sim FROM pr")
def chunk_cosines(spark, d):
    a, b = _chunks(spark, d)
    return similarity.chunk_pairs(a, b, "doc").select("doc", "a_chunk", "b_chunk", r6(F.col("sim")).alias("sim"))


@query(f"WITH {_CHUNKS}, ma AS (SELECT doc, ac, max(sim) AS m, any_value(aw) AS w FROM pr GROUP BY 1, 2), mb AS (SELECT doc, bc, max(sim) AS m, any_value(bw) AS w FROM pr GROUP BY 1, 2), a AS (SELECT doc, sum(m * w) / sum(w) AS x FROM ma GROUP BY 1), b AS (SELECT doc, sum(m * w) / sum(w) AS y FROM mb GROUP BY 1) SELECT doc, round(x, 6) AS a_to_b, round(y, 6) AS b_to_a, round(CASE WHEN x + y = 0 THEN 0 ELSE 2 * x * y / (x + y) END, 6) AS semantic_f1 FROM a JOIN b USING (doc)")
def best_alignment(spark, d):
    a, b = _chunks(spark, d)
    x = similarity.aligned(a, b, "doc")
    return x.select("doc", *[r6(F.col(c)).alias(c) for c in ("a_to_b", "b_to_a", "semantic_f1")])


@query("WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY 1, 2) SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 5) AS sim FROM m a JOIN m b ON a.i = b.i AND b.label = a.label + 1 GROUP BY 1, 2")
def mean_vector_cosine(spark, d):
    m = similarity.mean_vector(V.table(spark, d, "embeddings"), "label", "embedding")
    n = m.select((F.col("label") - 1).alias("label"), F.col("label").alias("b"), F.col("mean").alias("other"))
    return m.join(n, "label").select(F.col("label").alias("a"), "b", F.round(similarity.cosine(F.col("mean"), F.col("other")), 5).alias("sim"))


_F1 = "CASE WHEN s % 5 = 0 THEN NULL ELSE (id * s % 17) / 16.0::DOUBLE END"


@query(f"WITH r AS (SELECT item_id AS id, s, {_F1.replace('id', 'item_id')} AS f, [0.08, 0.07, 0.16, 0.16, 0.06, 0.18, 0.09, 0.15, 0.05][s]::DOUBLE AS w FROM benchmark, range(1, 10) x(s)) SELECT id, round(sum(w * f) / sum(CASE WHEN f IS NOT NULL THEN w END), 6) AS semantic_similarity_sections FROM r GROUP BY 1")
def weighted_section_score(spark, d):
    s = F.explode(F.sequence(F.lit(1), F.lit(9))).alias("s")
    x = V.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), s)
    x = x.select("id", F.concat(F.lit("sec_"), F.col("s").cast("string")).alias("sec"), F.when(F.col("s") % 5 != 0, (F.col("id") * F.col("s") % 17) / 16.0).alias("semantic_f1"))
    return similarity.document_score(x, "id").select("id", r6(F.col("semantic_similarity_sections")).alias("semantic_similarity_sections"))


#: Sections of each leaflet beside the same sections in lower case without the words that hold a "th".
_SECTIONS = f"""{V.LEAFLETS}, r AS (SELECT id, {_LAST} AS last, k, [s1, s2, s3, s4, s5, s6, s7, s8, s9][k] AS t FROM parts, range(1, 10) x(k)),
sx AS (SELECT id, 'sec_' || k AS sec, CASE WHEN k > 1 AND (id + k) % 7 = 0 THEN '' ELSE {d_strip('t || CASE WHEN k = last AND id % 5 <> 0 THEN chr(10) || ' + q('III - DIZERES LEGAIS') + ' || chr(10) || ' + q('fim') + ' ELSE ' + q('') + ' END')} END AS a FROM r),
sy AS (SELECT *, {d_strip("regexp_replace(lower(a), '[a-z]*th[a-z]*', '', 'g')")} AS b FROM sx),
tk AS (SELECT id, sec, 'a' AS side, {d_tokens('a')} AS t FROM sy UNION ALL SELECT id, sec, 'b', {d_tokens('b')} FROM sy),
ck AS (SELECT id, sec, side, unnest({d_windows('t', 120, 30)}) AS w, generate_subscripts({d_windows('t', 120, 30)}, 1) AS n FROM tk),
tm AS (SELECT id, sec, side, n, len(w) AS weight, unnest(w) AS word FROM ck),
vc AS (SELECT id, sec, side, n, any_value(weight) AS weight, ('0x' || substr(md5(lower(word)), 1, 2))::INTEGER % 32 AS d, count(*)::DOUBLE AS x FROM tm GROUP BY id, sec, side, n, d),
nm AS (SELECT id, sec, side, n, any_value(weight) AS weight, sqrt(sum(x * x)) AS norm FROM vc GROUP BY id, sec, side, n),
dp AS (SELECT a.id, a.sec, a.n AS an, b.n AS bn, sum(a.x * b.x) AS dot FROM vc a JOIN vc b ON a.id = b.id AND a.sec = b.sec AND a.d = b.d AND a.side = 'a' AND b.side = 'b' GROUP BY ALL),
pr AS (SELECT a.id, a.sec, a.n AS an, b.n AS bn, a.weight AS aw, b.weight AS bw, coalesce(dot, 0) / (a.norm * b.norm) AS sim FROM nm a JOIN nm b ON a.id = b.id AND a.sec = b.sec AND a.side = 'a' AND b.side = 'b' LEFT JOIN dp ON dp.id = a.id AND dp.sec = a.sec AND dp.an = a.n AND dp.bn = b.n),
ma AS (SELECT id, sec, an, max(sim) AS m, any_value(aw) AS w FROM pr GROUP BY ALL), mb AS (SELECT id, sec, bn, max(sim) AS m, any_value(bw) AS w FROM pr GROUP BY ALL),
ba AS (SELECT id, sec, sum(m * w) / sum(w) AS x FROM ma GROUP BY ALL), bb AS (SELECT id, sec, sum(m * w) / sum(w) AS y FROM mb GROUP BY ALL),
sc AS (SELECT sy.id, sy.sec, CASE WHEN a = '' AND b = '' THEN NULL WHEN a <> '' AND b <> '' THEN x ELSE 0 END AS orig_to_simp, CASE WHEN a = '' AND b = '' THEN NULL WHEN a <> '' AND b <> '' THEN y ELSE 0 END AS simp_to_orig, CASE WHEN a = '' AND b = '' THEN NULL WHEN a <> '' AND b <> '' THEN CASE WHEN x + y = 0 THEN 0 ELSE 2 * x * y / (x + y) END ELSE 0 END AS semantic_f1 FROM sy LEFT JOIN ba ON ba.id = sy.id AND ba.sec = sy.sec LEFT JOIN bb ON bb.id = sy.id AND bb.sec = sy.sec)"""


def _section_scores(spark, d):
    x = V.leaflets(spark, d).select("id", "leaflet", F.regexp_replace(F.lower("leaflet"), "[a-z]*th[a-z]*", "").alias("short"))
    return similarity.section_scores(x, "id", "leaflet", "short", similarity.hashed_encoder(32))


@query()
def learned_similarity(spark, d):
    """Both texts of a pair by an encoder learned from all of them; the tests hold the encoder against numpy."""
    p = V.pairs(spark, d)
    texts = p.select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("original_text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("paraphrase").alias("text")))).alias("t")).select("pair_id", "t.*")
    coded = svd.fitted(texts, ["pair_id", "side"], "text", k=16).encoded(texts, ["pair_id", "side"], "text")
    side = lambda i: coded.filter(F.col("side") == i).select("pair_id", F.col("vec").alias(f"v{i}"))
    return side(0).join(side(1), "pair_id").select("pair_id", r6(similarity.cosine(F.col("v0"), F.col("v1"))).alias("sim"))


@query(f"WITH {_SECTIONS} SELECT id, sec, round(orig_to_simp, 6) AS orig_to_simp, round(simp_to_orig, 6) AS simp_to_orig, round(semantic_f1, 6) AS semantic_f1 FROM sc")
def section_similarity(spark, d):
    """Sections of each leaflet against the same sections in lower case with some words left out, by a hashed encoder."""
    return _section_scores(spark, d).select("id", "sec", *[r6(F.col(c)).alias(c) for c in ("orig_to_simp", "simp_to_orig", "semantic_f1")])


_MEASURES = ("orig_to_simp", "simp_to_orig", "semantic_f1")
_WIDE = ", ".join(f"round(max(CASE WHEN sec = 'sec_{k}' THEN {m} END), 6) AS sec_{k}_{m}" for k in range(1, 10) for m in _MEASURES)


@query(f"WITH {_SECTIONS}, w(sec, weight) AS (VALUES ('sec_1', 0.08::DOUBLE), ('sec_2', 0.07), ('sec_3', 0.16), ('sec_4', 0.16), ('sec_5', 0.06), ('sec_6', 0.18), ('sec_7', 0.09), ('sec_8', 0.15), ('sec_9', 0.05)) SELECT id, {_WIDE}, round(sum(weight * semantic_f1) / sum(CASE WHEN semantic_f1 IS NOT NULL THEN weight END), 6) AS semantic_similarity_sections FROM sc JOIN w USING (sec) GROUP BY id")
def section_scores_wide(spark, d):
    x = similarity.wide_section_scores(_section_scores(spark, d), "id")
    return x.select("id", *[r6(F.col(c)).alias(c) for c in x.columns if c != "id"])


@query(f"""WITH {V.PAIRS}, s AS (SELECT pair_id, 'a' AS side, {d_sentences('original_text', False)} AS s FROM pairs UNION ALL SELECT pair_id, 'b', {d_sentences('paraphrase', False)} FROM pairs),
w AS (SELECT pair_id, side, unnest({d_windows('s', 5, 2)}) AS c FROM s), t AS (SELECT pair_id, side, unnest({d_tokens("lower(array_to_string(c, ' '))")}) AS word FROM w),
g AS (SELECT pair_id, ('0x' || substr(md5(word), 1, 2))::INTEGER % 32 AS d, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM t GROUP BY ALL)
SELECT pair_id, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS sim FROM g GROUP BY 1 HAVING sum(a) > 0 AND sum(b) > 0""")
def sliding_similarity(spark, d):
    x = similarity.sliding_similarity(V.pairs(spark, d), "pair_id", "original_text", "paraphrase", similarity.hashed_encoder(32))
    return x.select("pair_id", r6(F.col("sim")).alias("sim"))


# --- dependencies ------------------------------------------------------------------------------------------------------


def _linked(spark, d):
    return ud.with_head(V.ud_tokens(spark, d), ["sent_key"])


@query(f"WITH {V.UD_TOKENS} SELECT sent_key, id, head_upos, head_id::VARCHAR AS head_id FROM linked")
def head_links(spark, d):
    return _linked(spark, d).select("sent_key", "id", "head_upos", "head_id")


@query(f"WITH {V.UD_TOKENS} SELECT t.sent_key, t.id, n.word AS next_word, p.word AS previous_word FROM tok t LEFT JOIN tok n ON n.sent_key = t.sent_key AND n.id = t.id + 1 LEFT JOIN tok p ON p.sent_key = t.sent_key AND p.id = t.id - 1")
def neighbour_links(spark, d):
    return ud.with_neighbours(V.ud_tokens(spark, d), ["sent_key"]).select("sent_key", "id", "next_word", "previous_word")


@query(f"""WITH {V.UD_TOKENS}, c AS (SELECT count(*) AS tokens, count(DISTINCT sent_key) AS sentences, count(DISTINCT lower(word)) AS types, count(DISTINCT lower(lemma)) AS lemmas, count(*) FILTER (lemma = ',') AS commas,
count(*) FILTER (upos = 'VERB' OR (upos = 'AUX' AND head_upos <> 'VERB')) AS clauses, count(*) FILTER (upos = 'VERB') AS verb, count(*) FILTER (upos = 'NOUN') AS noun, count(*) FILTER (upos = 'ADJ') AS adj, count(*) FILTER (upos = 'ADV') AS adv,
count(*) FILTER (deprel = 'nsubj' AND id > head_id) AS post, count(*) FILTER (deprel = 'nsubj' AND id < head_id) AS pre, count(*) FILTER (feats LIKE '%Voice=Pass%') AS passive, count(*) FILTER (deprel = 'xcomp' AND head_upos = 'VERB') AS xcomp,
count(*) FILTER (deprel = 'advcl') AS advcl, count(*) FILTER (deprel = 'advcl' AND id < head_id) AS al, count(*) FILTER (deprel = 'advcl' AND id > head_id) AS ar, count(*) FILTER (deprel = 'acl:relcl') AS relcl, count(*) FILTER (deprel = 'acl') AS acl,
count(*) FILTER (deprel = 'ccomp') AS ccomp, count(*) FILTER (deprel = 'conj' AND head_upos = 'VERB') AS cv, count(*) FILTER (deprel = 'conj' AND head_upos <> 'VERB') AS co FROM linked)
SELECT tokens AS m01_tokens, sentences AS m02_sentences, 30::BIGINT AS m03_entries, round(tokens / sentences, 6) AS m04_tokens_per_sentence, round(types / tokens, 6) AS m05_type_token_ratio, round(lemmas / tokens, 6) AS m06_lemma_token_ratio, round(commas / tokens, 6) AS m07_commas_per_token, round(clauses / sentences, 6) AS m08_clauses_per_sentence, round(sentences / 30, 6) AS m09_sentences_per_entry,
round(verb / greatest(noun, 1), 6) AS m10_verb_noun, round(adj / greatest(noun, 1), 6) AS m11_adj_noun, round(adv / greatest(verb, 1), 6) AS m12_adv_verb, round(post / greatest(pre, 1), 6) AS m13_post_pre_subjects, round(passive / (tokens - passive), 6) AS m14_passive_active, round(xcomp / (verb - xcomp), 6) AS m15_xcomp_simple_verbs, round(advcl / clauses, 6) AS m16_advcl_per_clause,
round(al / greatest(ar, 1), 6) AS m17_advcl_left_right, round(relcl / greatest(acl, 1), 6) AS m18_developed_reduced_relatives, round(ccomp / clauses, 6) AS m19_ccomp_per_clause, round(cv / clauses, 6) AS m20_clausal_coordination, round(co / clauses, 6) AS m21_nominal_coordination FROM c""")
def syntactic_profile(spark, d):
    x = ud.profile(_linked(spark, d), 30, ["sent_key"])
    return x.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes])


@query(f"WITH {V.UD_TOKENS}, f AS (SELECT 'upos' AS field, upos AS value, sent_key, pos FROM tok UNION ALL SELECT 'deprel', deprel, sent_key, pos FROM tok UNION ALL SELECT 'lemma', lemma, sent_key, pos FROM tok) SELECT field, value, count(*) AS n, min(sent_key) AS first_sentence, sum(sent_key * 10 + pos)::BIGINT AS places FROM f GROUP BY 1, 2")
def inverted_index(spark, d):
    """Every value's places, read back from the blocks: how many, the first, and their sum as numbers."""
    x = ud.inverted_index(V.ud_tokens(spark, d).select("sent_key", "pos", "id", "upos", "deprel", "lemma"), ["sent_key"], 500).filter("field <> 'id'")
    place = F.aggregate("places", F.lit(0).cast("long"), lambda t, p: t + p["sent_key"] * 10 + p["pos"])
    return x.groupBy("field", "value").agg(F.sum("n").alias("n"), F.min(F.col("places")[0]["sent_key"]).alias("first_sentence"), F.sum(place).alias("places"))


def _stored_postings(spark, d, fields):
    """The index of the order lines' tokens by these fields in a folder of the shared one."""
    path = f"{shared_folder(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    postings.stored(V.ud_tokens(spark, d).select("sent_key", "id", "upos", "deprel", "lemma"), ["sent_key"], path, fields=fields)
    return path


@query(f"WITH {V.UD_TOKENS} SELECT sent_key, count(*) FILTER (lemma IN ('l3', 'l17')) AS n FROM tok GROUP BY 1 HAVING bool_or(lemma = 'l3') AND bool_or(lemma = 'l17')")
def sentences_by_keywords(spark, d):
    return postings.with_all(spark, _stored_postings(spark, d, ["lemma"]), "lemma", ["l3", "l17"], ["sent_key"])


@query(f"WITH {V.UD_TOKENS} SELECT a.sent_key, a.id AS start FROM tok a JOIN tok b ON b.sent_key = a.sent_key AND b.id = a.id + 1 JOIN tok c ON c.sent_key = a.sent_key AND c.id = a.id + 2 WHERE a.upos = 'NOUN' AND b.upos = 'VERB' AND c.deprel = 'conj'")
def phrases_found(spark, d):
    return postings.phrase(spark, _stored_postings(spark, d, ["upos", "deprel"]), [("upos", "NOUN"), ("upos", "VERB"), ("deprel", "conj")], ["sent_key"])


@query(f"WITH {V.UD_TOKENS} SELECT 7::BIGINT AS sent_key, id, word FROM tok WHERE sent_key = 7")
def sentence_lookup(spark, d):
    """One sentence by its id, out of the parsed text of all."""
    line = F.concat_ws("\t", F.col("id").cast("string"), "word", *[F.lit("_")] * 8)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n")
    text = V.ud_tokens(spark, d).groupBy("sent_key").agg(body.alias("b")).select(F.lit("all").alias("entry"), F.concat(F.lit("# sent_id = "), F.col("sent_key"), F.lit("\n"), F.col("b"), F.lit("\n\n")).alias("text"))
    found = ud.tokens(ud.sentence(ud.parse_sentences(text, "entry", "text"), "7"))
    return found.select(F.col("sent_key").cast("long").alias("sent_key"), F.col("id").cast("int").alias("id"), "word")


@query(f"WITH {V.UD_TOKENS}, s AS (SELECT DISTINCT sent_key, sent_key // 50 AS entry FROM tok) SELECT entry, sent_key, row_number() OVER (ORDER BY entry, sent_key) AS new_sent_id FROM s")
def sentences_renumbered(spark, d):
    s = V.ud_tokens(spark, d).select(F.floor(F.col("sent_key") / 50).alias("entry"), "sent_key").distinct()
    return ud.renumbered(s, ["entry", "sent_key"]).select("entry", "sent_key", "new_sent_id")


@query(f"WITH {V.UD_TOKENS} SELECT sent_key, string_agg(id || chr(9) || word || chr(9) || lemma || chr(9) || upos || chr(9) || '_' || chr(9) || feats || chr(9) || dephead || chr(9) || deprel || chr(9) || '_' || chr(9) || '_', chr(10) ORDER BY id) AS body FROM tok GROUP BY 1")
def sentences_serialised(spark, d):
    """Token lines written, read again by the parser, and written once more."""
    t = V.ud_tokens(spark, d).withColumns({c: F.lit("_") for c in ("xpos", "deps", "misc")})
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", ud.token_line().alias("l")))), lambda x: x["l"]), "\n")
    text = t.groupBy("sent_key").agg(body.alias("b")).select(F.lit(1).alias("entry"), F.concat(F.lit("# sent_id = <"), F.col("sent_key"), F.lit(">\n"), F.col("b"), F.lit("\n\n")).alias("text"))
    back = ud.parse_sentences(text.select(F.col("text").alias("entry"), "text"), "entry", "text")
    key = F.regexp_extract(F.col("metadata")["sent_id"], "[0-9]+", 0).cast("long")
    return back.select(key.alias("sent_key"), F.array_join("lines", "\n").alias("body"))


@query(f"WITH {V.UD_TOKENS} SELECT sent_key, id, CASE WHEN feats = '_' THEN NULL ELSE 'Pass' END AS voice, CASE WHEN feats = '_' THEN NULL ELSE 'Sing' END AS number FROM tok")
def token_attributes(spark, d):
    m = V.ud_tokens(spark, d).select("sent_key", "id", ud.attributes(F.col("feats")).alias("m"))
    return m.select("sent_key", "id", F.try_element_at("m", F.lit("voice")).alias("voice"), F.try_element_at("m", F.lit("number")).alias("number"))


@query(f"WITH {V.DOCS} SELECT row_id, contains(docs, 'idiot') OR (regexp_matches(docs, 'th[aei]') AND regexp_matches(docs, '[.]$')) AS built FROM docs")
def keyword_filter(spark, d):
    return ud.matching(V.docs(spark, d), "docs", ["th[aei]", "[.]$"], ["idiot"]).select("row_id", "built")


# --- judging and training examples ---------------------------------------------------------------------------------------


@query(f"WITH {V.JUDGE} SELECT item || '__rep1' AS id, best, slot::INTEGER AS slot, 'P' || c AS criterion, score::INTEGER AS score FROM notes")
def judge_scores(spark, d):
    return judge.scores(judge.parsed(V.judge_answers(spark, d), "answer", judge.SCORED)[0])


@query(f"WITH {V.JUDGE} SELECT CASE WHEN (slot + item) % 2 = 0 THEN 'b' ELSE 'a' END AS model, 'P' || c AS criterion, count(score) AS n, round(avg(score), 6) AS mean_score FROM notes GROUP BY 1, 2")
def judge_means(spark, d):
    results = judge.parsed(V.judge_answers(spark, d), "answer", judge.SCORED)[0]
    even = F.col("e") % 2 == 0
    items = V.judge_answers(spark, d).select(F.concat(F.col("item").cast("string"), F.lit("__rep1")).alias("id"), F.when(even, "a").otherwise("b").alias("Versao_1_model"), F.when(even, "b").otherwise("a").alias("Versao_2_model"))
    named = judge.unblinded(results.select("result"), items)
    return judge.model_means(judge.scores(named, keep=judge.MODELS)).withColumn("mean_score", r6(F.col("mean_score")))


@query(f"WITH {V.PAIRS}, r AS (SELECT pair_id, original_text, paraphrase, n, pair_id || '__rep' || n AS id FROM pairs, range(1, 4) x(n)), s AS (SELECT *, ('0x' || substr(md5('42|' || id), 1, 1))::INTEGER % 2 = 1 AS swap FROM r) SELECT id, pair_id::VARCHAR AS id_base, n::INTEGER AS repeat, original_text AS original, CASE WHEN swap THEN paraphrase ELSE original_text END AS v1, CASE WHEN swap THEN original_text ELSE paraphrase END AS v2, CASE WHEN swap THEN 'm2' ELSE 'm1' END AS Versao_1_model, CASE WHEN swap THEN 'm1' ELSE 'm2' END AS Versao_2_model FROM s")
def judge_items(spark, d):
    return judge.judge_items(V.pairs(spark, d), "pair_id", "original_text", ("m1", "m2"), ("original_text", "paraphrase"))


@query(f"WITH {V.PAIRS}, p AS (SELECT conv_id AS call, 'A seguir estão N itens. Para cada item, avalie as duas versões conforme as instruções do sistema e retorne um ÚNICO array JSON com um objeto por item.' || chr(10) || chr(10) || string_agg('### ITEM' || chr(10) || 'ID: ' || pair_id || chr(10) || chr(10) || 'TEXTO ORIGINAL:' || chr(10) || original_text || chr(10) || chr(10) || 'VERSÃO 1:' || chr(10) || original_text || chr(10) || chr(10) || 'VERSÃO 2:' || chr(10) || paraphrase || chr(10), chr(10) ORDER BY pair_id::VARCHAR) || chr(10) || chr(10) || 'Lembre-se: retorne APENAS um ARRAY JSON com os resultados, na mesma ordem dos itens acima.' AS payload FROM pairs GROUP BY 1) SELECT call, payload FROM p")
def judge_payloads(spark, d):
    x = V.pairs(spark, d).select(F.col("conv_id").alias("call"), F.col("pair_id").cast("string").alias("id"), F.col("original_text").alias("original"), F.col("original_text").alias("v1"), F.col("paraphrase").alias("v2"))
    return judge.payloads(x, "call")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type AS content FROM events")
def chat_answers(spark, d):
    e = V.table(spark, d, "events")
    raw = F.concat(F.lit('{"choices":[{"message":{"content":" '), F.col("event_type"), F.lit('\\n"}},{"message":{}}]}'))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), judge.chat_contents(raw)[0].alias("content"))


@query(f"WITH {V.PAIRS} SELECT pair_id, 'Instrução' || chr(10) || chr(10) || 'Bula original:' || chr(10) || {d_strip('original_text')} || chr(10) || chr(10) || 'Bula simplificada: ' AS ask, {d_strip('paraphrase')} AS answer FROM pairs")
def chat_examples(spark, d):
    m = judge.conversations(V.pairs(spark, d), "Instrução", "original_text", "paraphrase")
    return m.select("pair_id", F.col("messages")[0]["content"][0]["text"].alias("ask"), F.col("messages")[1]["content"][0]["text"].alias("answer"))


_IDS = f"{V.DOCS}, i AS (SELECT row_id, list_transform({d_tokens('docs')}, lambda w: length(w) % 6) AS ids FROM docs), t AS (SELECT row_id, ids, array_to_string(ids, '') AS digits FROM i), a AS (SELECT row_id, ids, nullif(instr(digits, '23'), 0) - 1 AS p0, substr(digits, instr(digits, '23') + 2) AS after FROM t)"


def _ids(spark, d):
    return V.docs(spark, d).select("row_id", F.transform(T.tokens(F.col("docs")), lambda w: F.length(w) % 6).alias("ids"))


@query(f"WITH {_IDS} SELECT row_id, len(ids) AS total_length, CASE WHEN p0 IS NULL THEN 0 ELSE len(ids) - p0 - 2 END AS valid_labels, round(CASE WHEN p0 IS NULL THEN 0 ELSE (len(ids) - p0 - 2) / greatest(len(ids), 1) END, 6) AS label_ratio, coalesce(contains(after, '4') AND len(ids) - p0 - 2 >= 20 AND (len(ids) - p0 - 2) / len(ids) >= 0.05, FALSE) AS is_valid FROM a")
def label_validity(spark, d):
    x = judge.label_validity(_ids(spark, d), "ids", [2, 3], [4])
    return x.select("row_id", "total_length", "valid_labels", r6(F.col("label_ratio")).alias("label_ratio"), "is_valid")


@query(f"WITH {_IDS} SELECT row_id, list_transform(ids, lambda x, j: CASE WHEN p0 IS NULL OR j <= p0 + 2 THEN -100 ELSE x END)::VARCHAR AS labels FROM a")
def masked_labels(spark, d):
    x = _ids(spark, d).select("row_id", judge.masked_labels(F.col("ids"), [2, 3]).cast("array<string>").alias("l"))
    return x.select("row_id", F.concat(F.lit("["), F.array_join("l", ", "), F.lit("]")).alias("labels"))

