"""Views of the driver's tables that stand in for the corpus, in Spark and as DuckDB SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- DuckDB fragments of the text functions -------------------------------------------------------------------------


#: Fixed values, written out here again so that the SQL does not follow the functions it checks.
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {to}, 'g')"


def d_strip(x: str) -> str:
    return d_sub(x, f"^{WS}+|{WS}+$", "''")


def d_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda t: t <> '')"


def d_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def d_words(x: str) -> str:
    return d_count(x, r"[\p{L}\p{N}_]+")


def d_syllables(x: str) -> str:
    return d_count(f"lower({x})", "[aeiouáéíóúâêôãõàü]")


def d_sentences(x: str, abbreviations: bool = True) -> str:
    s = d_strip(x)
    if abbreviations:
        s = d_sub(s, r"(^|[^\p{L}\p{N}_])(Art|art|Dr|Dra|Inc|Par|n|nº|n\.º|al)\.", r"'\1\2' || chr(2)")
    s = d_sub(s, rf"([.!?][”’)\]\"]?){WS}+", r"'\1' || chr(1)")
    return f"list_filter(list_transform(string_split({s}, chr(1)), lambda z: {d_strip('replace(z, chr(2), ' + q('.') + ')')}), lambda z: z <> '')"


def d_flesch(x: str) -> str:
    w, y = d_words(x), d_syllables(x)
    return f"(248.835::DOUBLE - 1.015::DOUBLE * ({w} / greatest(1, len({d_sentences(x)}))) - 84.6::DOUBLE * ({y} / greatest(1, {w})))"


def d_band(x: str) -> str:
    return f"CASE WHEN {x} >= 75 THEN 'Muito fácil (nível fundamental)' WHEN {x} >= 50 THEN 'Médio (nível médio)' WHEN {x} >= 25 THEN 'Difícil (nível superior)' ELSE 'Muito difícil (pós-graduação / textos técnicos)' END"


def d_windows(items: str, size: int, overlap: int) -> str:
    step = size - overlap
    n = f"len({items})"
    count = f"(CASE WHEN {n} = 0 THEN 0 WHEN {n} <= {size} THEN 1 ELSE CAST(ceil(({n} - {size}) / {step}) AS BIGINT) + 1 END)"
    return f"list_transform(range(0, {count}), lambda i: list_slice({items}, i * {step} + 1, i * {step} + {size}))"


# --- views -------------------------------------------------------------------------------------------------------------


def docs(spark: SparkSession, d: str) -> DataFrame:
    """row_id, docs, lang, source, pdf_filename of the documents."""
    x = table(spark, d, "documents")
    return x.select(F.col("doc_id").alias("row_id"), F.col("text").alias("docs"), "lang", "source", F.concat("source", F.lit("__"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("pdf_filename"))


DOCS = "docs AS (SELECT doc_id AS row_id, text AS docs, lang, source, source || '__' || doc_id || '.pdf' AS pdf_filename FROM documents)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    """One text for each conversation, turn and role, as some repeat."""
    return table(spark, d, "conversations").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))


TURNS = "turns AS (SELECT conv_id, turn, role, min(text) AS text FROM conversations GROUP BY ALL)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """pair_id, original_text, paraphrase: a user's turn and the assistant's next."""
    t = turns(spark, d)
    a = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("original_text"))
    b = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("paraphrase"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "conv_id", "turn", "original_text", "paraphrase")


PAIRS = TURNS + ", pairs AS (SELECT a.conv_id * 1000 + a.turn AS pair_id, a.conv_id, a.turn, a.text AS original_text, b.text AS paraphrase FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')"


def triples(spark: SparkSession, d: str) -> DataFrame:
    """pairs with the user's turn after them as reference."""
    r = turns(spark, d).filter("role = 'user'").select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("reference"))
    return pairs(spark, d).join(r, ["conv_id", "turn"])


TRIPLES = PAIRS + ", triples AS (SELECT p.*, r.text AS reference FROM pairs p JOIN turns r ON r.conv_id = p.conv_id AND r.turn = p.turn + 2 AND r.role = 'user')"


def groups(spark: SparkSession, d: str) -> DataFrame:
    """row_id, medicine_name, flesch_diff, sim of the parts."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("medicine_name"), F.col("p_retailprice").alias("flesch_diff"), F.col("p_size").cast("double").alias("sim"))


GROUPS = "grp AS (SELECT p_partkey AS row_id, p_name AS medicine_name, p_retailprice AS flesch_diff, p_size::DOUBLE AS sim FROM part)"

_RAW = (("<think>x\ny</think>", ""), ("BULA SIMPLIFICADA - Y\n\n", ""), ("**TEXTO (versão SIMPLES)**\n\n---\n", "\n\n\n\nFim </think>"))


def llm_raw(spark: SparkSession, d: str) -> DataFrame:
    """row_id, raw: documents as a model might return them."""
    x, k = docs(spark, d), F.col("row_id") % 4
    raw = F.col("docs")
    for i, (a, b) in enumerate(_RAW):
        raw = F.when(k == i, F.concat(F.lit(a), F.col("docs"), F.lit(b))).otherwise(raw)
    return x.select("row_id", "docs", raw.alias("raw"))


def _e(s: str) -> str:
    return " || chr(10) || ".join(q(p) for p in s.split("\n"))


LLM_RAW = DOCS + ", llm_raw AS (SELECT row_id, docs, CASE row_id % 4 " + " ".join(f"WHEN {i} THEN {_e(a)} || docs || {_e(b)}" for i, (a, b) in enumerate(_RAW)) + " ELSE docs END AS raw FROM docs)"

#: The nine headings, numbered; 5 of 7 pages have each.
HEADINGS = (
    "1. PARA QUE ESTE MEDICAMENTO É INDICADO?", "2. COMO ESTE MEDICAMENTO FUNCIONA?", "3. QUANDO NÃO DEVO USAR ESTE MEDICAMENTO?",
    "4. O QUE DEVO SABER ANTES DE USAR ESTE MEDICAMENTO?", "5. ONDE, COMO E POR QUANTO TEMPO POSSO GUARDAR ESTE MEDICAMENTO?", "6. COMO DEVO USAR ESTE MEDICAMENTO?",
    "7. O QUE DEVO FAZER QUANDO EU ME ESQUECER DE USAR ESTE MEDICAMENTO?", "8. QUAIS OS MALES QUE ESTE MEDICAMENTO PODE ME CAUSAR?", "9. O QUE FAZER SE ALGUÉM USAR UMA QUANTIDADE MAIOR DO QUE A INDICADA DESTE MEDICAMENTO?",
)


def leaflets(spark: SparkSession, d: str) -> DataFrame:
    """id, leaflet and parts 1 to 9: headings over benchmark texts, some left out; the first is always there."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("body"))
    total = b.agg(F.count("*").alias("n"))  # one row
    dealt = b.crossJoin(F.broadcast(total)).select("id", "n", "body", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k"))
    dealt = dealt.select(F.pmod(F.col("id") - F.col("k"), F.col("n")).alias("id"), "k", "body")
    parts = dealt.groupBy("id").agg(*[F.max(F.when(F.col("k") == k, F.col("body"))).alias(f"b{k}") for k in range(1, 10)], F.count("*").alias("_n"))
    out = parts.filter("_n = 9").drop("_n").join(b.select("id"), "id", "left_semi")
    there = lambda k: F.lit(True) if k == 1 else (F.col("id") + k) % 7 != 0
    for k in range(1, 10):
        out = out.withColumn(f"s{k}", F.when(there(k), F.regexp_replace(F.col(f"b{k}"), "[0-9]", "")).otherwise(""))
    text = F.lit("BULA\n")
    for k, h in enumerate(HEADINGS, 1):
        text = F.concat(text, F.when(there(k), F.concat(F.lit(f"{h}\n"), F.col(f"s{k}"), F.lit("\n"))).otherwise(""))
    text = F.concat(text, F.when(F.col("id") % 5 != 0, F.lit("III - DIZERES LEGAIS\nfim")).otherwise(""))
    return out.select("id", text.alias("leaflet"), *[f"s{k}" for k in range(1, 10)])


def _leaflet_sql() -> str:
    there = lambda k: "TRUE" if k == 1 else f"(id + {k}) % 7 <> 0"
    joins = " ".join(f"JOIN bodies b{k} ON b{k}.id = (b.id + {k}) % (SELECT count(*) FROM bodies)" for k in range(1, 10))
    parts = ", ".join(f"CASE WHEN {there(k)} THEN regexp_replace(t{k}, '[0-9]', '', 'g') ELSE '' END AS s{k}" for k in range(1, 10))
    text = " || ".join(["'BULA' || chr(10)"] + [f"CASE WHEN {there(k)} THEN {q(h)} || chr(10) || s{k} || chr(10) ELSE '' END" for k, h in enumerate(HEADINGS, 1)] + ["CASE WHEN id % 5 <> 0 THEN 'III - DIZERES LEGAIS' || chr(10) || 'fim' ELSE '' END"])
    return f"bodies AS (SELECT item_id AS id, text AS body FROM benchmark), nine AS (SELECT b.id, {', '.join(f'b{k}.body AS t{k}' for k in range(1, 10))} FROM bodies b {joins}), parts AS (SELECT id, {parts} FROM nine), leaflets AS (SELECT *, {text} AS leaflet FROM parts)"


LEAFLETS = _leaflet_sql()


def pages(spark: SparkSession, d: str) -> DataFrame:
    """doc, page, text: documents cut into pages of ten lines, with a repeated header and footer."""
    x = docs(spark, d).select(F.col("row_id").alias("doc"), F.posexplode(F.split("docs", "\n")).alias("n", "line"))
    return x.groupBy("doc", F.floor(F.col("n") / 10).cast("int").alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda v: v["line"]), "\n").alias("t")).select("doc", "page", F.concat(F.lit("Bulário  Ágil\n"), F.col("t"), F.lit("\n  página\n")).alias("text"))


PAGES = DOCS + ", lines AS (SELECT row_id AS doc, unnest(string_split(docs, chr(10))) AS line, generate_subscripts(string_split(docs, chr(10)), 1) - 1 AS n FROM docs), pg AS (SELECT doc, (n // 10)::INTEGER AS page, 'Bulário  Ágil' || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10) || '  página' || chr(10) AS text FROM lines GROUP BY 1, 2)"

_UPOS = ("NOUN", "VERB", "AUX", "ADJ", "ADV", "PUNCT")
_DEPREL = ("nsubj", "xcomp", "advcl", "acl:relcl", "acl", "ccomp", "conj", "nsubj:pass")


def ud_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as dependency tokens: sent_key, id, word, lemma, upos, feats, dephead, deprel, pos."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (c % len(names) + 1).cast("int"))
    upos = pick(_UPOS, F.col("p"))
    return x.select(
        F.col("l_orderkey").alias("sent_key"), F.col("l_linenumber").cast("int").alias("id"), F.col("l_linenumber").cast("int").alias("pos"), F.concat(F.lit("W"), F.col("p").cast("string")).alias("word"),
        F.when(upos == "PUNCT", ",").otherwise(F.concat(F.lit("l"), (F.col("p") % 50).cast("string"))).alias("lemma"), upos.alias("upos"), F.when(F.col("p") % 9 == 0, "Voice=Pass|Number=Sing").otherwise("_").alias("feats"),
        ((F.col("l_linenumber") + F.col("s")) % 8).cast("int").alias("dephead"), pick(_DEPREL, F.col("s")).alias("deprel"),
    )


def _case(names: tuple, c: str) -> str:
    return f"[{', '.join(q(n) for n in names)}][({c} % {len(names)} + 1)::INTEGER]"


UD_TOKENS = f"""raw AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
tok AS (SELECT l_orderkey AS sent_key, l_linenumber::INTEGER AS id, l_linenumber::INTEGER AS pos, 'W' || p AS word, CASE WHEN {_case(_UPOS, 'p')} = 'PUNCT' THEN ',' ELSE 'l' || (p % 50) END AS lemma, {_case(_UPOS, 'p')} AS upos, CASE WHEN p % 9 = 0 THEN 'Voice=Pass|Number=Sing' ELSE '_' END AS feats, ((l_linenumber + s) % 8)::INTEGER AS dephead, {_case(_DEPREL, 's')} AS deprel FROM raw),
linked AS (SELECT t.*, coalesce(h.upos, '_') AS head_upos, CASE WHEN h.upos IS NULL THEN 0 ELSE t.dephead END AS head_id FROM tok t LEFT JOIN tok h ON h.sent_key = t.sent_key AND h.id = t.dephead)"""


def judge_answers(spark: SparkSession, d: str) -> DataFrame:
    """item, answer: a judge result as JSON for each event, some in code fences, some inside an object."""
    e = table(spark, d, "events").select(F.col("event_id").alias("item"), F.col("event_id").alias("e"), F.col("user_id").alias("u"))
    note = lambda v, i: F.concat(F.lit(f'"P{i}":{{"nota":'), ((F.col("e") * (v + 1) + F.col("u") * i) % 5 + 1).cast("string"), F.lit(',"justificativa":"j"}'))
    version = lambda v: F.concat(F.lit(f'"Versao_{v}":{{'), F.concat_ws(",", *[note(v, i) for i in range(1, 6)]), F.lit("}"))
    best = F.when(F.col("u") % 2 == 0, '["Versao_1","Versao_2"]').otherwise('["Versao_2","Versao_1"]')
    one = F.concat(F.lit('{"id":"'), F.col("item").cast("string"), F.lit('__rep1",'), version(1), F.lit(","), version(2), F.lit(',"Ranking_geral":{"ordem_melhor_para_pior":'), best, F.lit(',"justificativa":"r"}}'))
    array = F.concat(F.lit("["), one, F.lit("]"))
    return e.select("item", "e", "u", F.when(F.col("e") % 3 == 0, F.concat(F.lit("```json\n"), array, F.lit("\n```"))).when(F.col("e") % 3 == 1, array).otherwise(F.concat(F.lit('{"results":'), array, F.lit("}"))).alias("answer"))


JUDGE = "ev AS (SELECT event_id AS item, event_id AS e, user_id AS u FROM events), notes AS (SELECT item, e, u, v AS slot, c, (e * (v + 1) + u * c) % 5 + 1 AS score, CASE WHEN u % 2 = 0 THEN 'Versao_1' ELSE 'Versao_2' END AS best FROM ev, range(1, 3) r(v), range(1, 6) s(c))"
