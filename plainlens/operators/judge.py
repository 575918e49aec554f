"""Model-judge items and results, chat answers, and chat training examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.rows import bound, exploded
from .ordering import md5_order
from .splits import repeated

MODELS = ("Versao_1_model", "Versao_2_model")
CRITERIA = ("P1", "P2", "P3", "P4", "P5")
_NOTE = "struct<nota:int,justificativa:string>"
_VERSION = "struct<" + ",".join(f"{c}:{_NOTE}" for c in CRITERIA) + ",`Comentário_geral`:string>"
RESULT = f"struct<id:string,Versao_1:{_VERSION},Versao_2:{_VERSION},Ranking_geral:struct<ordem_melhor_para_pior:array<string>,justificativa:string>>"
#: The fields of RESULT that scores reads: what is not asked for is not taken out of an answer, nor shuffled.
_NOTES = "struct<" + ",".join(f"{c}:struct<nota:int>" for c in CRITERIA) + ">"
SCORED = f"struct<id:string,Versao_1:{_NOTES},Versao_2:{_NOTES},Ranking_geral:struct<ordem_melhor_para_pior:array<string>>>"
#: The first and last lines of a judge's message.
PAYLOAD_HEAD = "A seguir estão N itens. Para cada item, avalie as duas versões conforme as instruções do sistema e retorne um ÚNICO array JSON com um objeto por item.\n"
PAYLOAD_TAIL = "\nLembre-se: retorne APENAS um ARRAY JSON com os resultados, na mesma ordem dos itens acima."


def judge_items(df: DataFrame, key: str, original: str, models: tuple[str, str], columns: tuple[str, str], times: int = 3, seed: int = 42) -> DataFrame:
    """id, id_base, repeat, original, v1, v2, Versao_1_model, Versao_2_model; the order of versions is drawn per repeat."""
    rows = repeated(df.withColumn("id_base", F.col(key).cast("string")), key, times)
    swap = F.conv(F.substring(md5_order(seed, F.col("id")), 1, 1), 16, 10).cast("int") % 2 == 1
    a, b = (F.col(f"`{c}`") for c in columns)
    m, n = (F.lit(x) for x in models)
    pick = lambda x, y: F.when(swap, y).otherwise(x)
    return rows.select("id", "id_base", "repeat", F.col(original).alias("original"), pick(a, b).alias("v1"), pick(b, a).alias("v2"), pick(m, n).alias("Versao_1_model"), pick(n, m).alias("Versao_2_model"))


def payloads(items: DataFrame, call: str) -> DataFrame:
    """One message per call with its items in id order."""
    # fixed values: an item's lines
    block = F.concat(F.lit("### ITEM\nID: "), F.col("id"), F.lit("\n\nTEXTO ORIGINAL:\n"), F.col("original"), F.lit("\n\nVERSÃO 1:\n"), F.col("v1"), F.lit("\n\nVERSÃO 2:\n"), F.col("v2"), F.lit("\n"))
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("id", block.alias("b")))), lambda x: x["b"])
    return items.groupBy(call).agg(F.array_join(F.concat(F.array(F.lit(PAYLOAD_HEAD)), blocks, F.array(F.lit(PAYLOAD_TAIL))), "\n").alias("payload"))


def _unfenced(c: Column, fence: str) -> Column:
    """Without an opening fence and the blanks after it."""
    n = len(fence)
    return bound(c, lambda s: F.when(s.startswith(fence), T.strip_start(F.substring(s, n + 1, 2**31 - 1))).otherwise(s))


def json_array(c: Column) -> Column:
    """Code fences out, then from the first `[` to the last `]` if both are there in order. Each step looks at the ends only,
    or once along the answer."""
    c = _unfenced(_unfenced(T.strip_ws(c), "```json"), "```")
    c = bound(c, lambda s: F.when(s.endswith("```"), T.strip_end(F.left(s, F.length(s) - 3))).otherwise(s))
    first = lambda s: F.instr(s, "[")
    last = lambda s: F.length(s) - F.length(F.substring_index(s, "]", -1))
    return bound(c, lambda s: F.when((first(s) > 0) & (last(s) > first(s)), F.substring(s, first(s), last(s) - first(s) + 1)).otherwise(s))


def parsed(df: DataFrame, column: str, fields: str = RESULT) -> tuple[DataFrame, DataFrame]:
    """Judge results, one row each as a struct `result` of these fields, and the rows whose answer is no JSON array or
    object.

    An answer is an array of results, or an object that holds them as `results`. It is parsed once, to a VARIANT, and no
    filter reads it: an answer that is no JSON has no results.
    """
    # the reader ignores what follows a value; with a field after it, an answer that goes on is no JSON
    closed = F.concat(F.lit('{"answer":'), json_array(F.col(column)), F.lit(',"end":true}'))
    tried = df.withColumn("_answer", F.try_parse_json(closed))
    at = lambda path, kind: F.try_variant_get("_answer", path, kind)
    items = F.coalesce(at("$.answer", "array<variant>"), at("$.answer.results", "array<variant>"))
    fits = at("$.end", "boolean") & (at("$.answer", "array<variant>").isNotNull() | at("$.answer", "map<string,variant>").isNotNull())
    shaped = tried.withColumns({"_items": F.when(at("$.end", "boolean"), items), "_ok": fits})
    bad = shaped.filter("NOT coalesce(_ok, FALSE)").select(*df.columns)
    # what a result lacks, or has of another kind, is null
    return exploded(shaped, df.columns, "_items", "result").withColumn("result", F.try_variant_get("result", "$", fields)), bad


def unblinded(results: DataFrame, items: DataFrame, result: str = "result") -> DataFrame:
    """Results with Versao_1_model and Versao_2_model of their item; results of no item are left out. One row for each result
    is joined, before its scores become rows."""
    return results.withColumn("_id", F.col(f"{result}.id")).join(items.select(F.col("id").alias("_id"), *MODELS), "_id").drop("_id")


def scores(results: DataFrame, result: str = "result", keep: Sequence[str] = ()) -> DataFrame:
    """id, slot, criterion, score in long form, the best slot of the ranking, and columns to keep."""
    rows = [F.struct(F.lit(v).alias("slot"), F.lit(c).alias("criterion"), F.col(f"{result}.Versao_{v}.{c}.nota").alias("score")) for v in (1, 2) for c in CRITERIA]
    best = F.try_element_at(F.col(f"{result}.Ranking_geral.ordem_melhor_para_pior"), F.lit(1))
    return results.select(F.col(f"{result}.id").alias("id"), best.alias("best"), *keep, F.explode(F.array(*rows)).alias("s")).select("id", "best", *keep, "s.slot", "s.criterion", "s.score")



def model_means(scored: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Mean score by model and criterion: slots are named by the items' metadata, or by MODELS where the scores have them."""
    named = scored if items is None else scored.join(items.select("id", *MODELS), "id")
    model = F.when(F.col("slot") == 1, F.col(MODELS[0])).otherwise(F.col(MODELS[1]))
    return named.groupBy(model.alias("model"), "criterion").agg(F.count("score").alias("n"), F.avg("score").alias("mean_score"))


def chat_contents(c: Column) -> Column:
    """The stripped texts of choices[].message.content, in order; other contents than strings are left out."""
    raw = F.from_json(c, "struct<choices:array<struct<message:struct<content:string>>>>")
    return F.transform(F.filter(raw["choices"], lambda x: x["message"]["content"].isNotNull()), lambda x: T.strip_ws(x["message"]["content"]))


def listing_items(c: Column) -> Column:
    """Name and id of a listing page's entries."""
    return F.from_json(c, "struct<content:array<struct<nomeProduto:string,idBulaPacienteProtegido:string>>,totalPages:int>")


def conversations(df: DataFrame, instruction: str, original: str, simplified: str) -> DataFrame:
    """Adds messages: the user's request with the text, and the assistant's answer."""
    part = lambda role, text: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))
    ask = F.concat(F.lit(instruction + "\n\nBula original:\n"), T.strip_ws(F.col(f"`{original}`")), F.lit("\n\nBula simplificada: "))
    return df.withColumn("messages", F.array(part("user", ask), part("assistant", T.strip_ws(F.col(f"`{simplified}`")))))


def find_run(ids: Column, run: Sequence[int], start: Column | int = 0) -> Column:
    """0-based place of the first occurrence of run in ids from start on, or null; an empty run has none."""
    if not run:
        return F.lit(None).cast("int")
    begin = start if isinstance(start, Column) else F.lit(start)
    rest = ids if isinstance(start, int) and start == 0 else F.slice(ids, begin + 1, F.greatest(F.size(ids), F.lit(0)))
    # one search along the numbers written out between commas; an id's place is the number of commas before its own
    written = F.concat(F.lit(","), F.array_join(rest.cast("array<string>"), ",", "null"), F.lit(","))
    wanted = F.lit("," + ",".join(str(int(x)) for x in run) + ",")

    def place(s: Column) -> Column:
        before = lambda p: F.substring(s, F.lit(1), p - 1)
        commas = lambda b: F.length(b) - F.length(F.replace(b, F.lit(","), F.lit("")))
        return bound(F.instr(s, wanted), lambda p: F.when(p > 0, bound(before(p), commas) + begin))

    return bound(written, place)


def masked_labels(ids: Column, assistant: Sequence[int], attention: Column | None = None) -> Column:
    """ids with -100 up to and including the assistant's marker (everywhere without one) and where attention is 0."""
    mask = lambda at: F.transform(ids, lambda x, i: F.when(at.isNull() | (i < at + len(assistant)), F.lit(-100)).otherwise(x))
    # the marker is bound by a lambda of its own: it is searched once for a row, not once for each id
    out = F.get(F.transform(F.array(find_run(ids, assistant)), mask), F.lit(0))
    return out if attention is None else F.zip_with(out, attention, lambda x, a: F.when(a == 0, F.lit(-100)).otherwise(x))


def complete(ids: Column, assistant: Sequence[int], end: Sequence[int]) -> Column:
    """Whether an end marker follows the assistant's marker."""
    at = find_run(ids, assistant)
    return F.coalesce(at.isNotNull() & find_run(ids, end, F.coalesce(at, F.lit(0)) + len(assistant)).isNotNull(), F.lit(False))


def label_validity(df: DataFrame, ids: str, assistant: Sequence[int], end: Sequence[int], least_labels: int = 20, least_ratio: float = 0.05) -> DataFrame:
    """Adds total_length, valid_labels, label_ratio, is_valid."""
    c, after = F.col(ids), F.col("_at") + len(assistant)
    found = df.withColumn("_at", find_run(c, assistant))  # one search for both measures
    labels = F.slice(c, F.coalesce(after, F.lit(0)) + 1, F.when(after.isNotNull(), F.greatest(F.size(c), F.lit(0))).otherwise(0))
    out = found.withColumns({"total_length": F.size(c), "valid_labels": F.size(F.filter(labels, lambda x: x != -100))})
    out = out.withColumn("label_ratio", F.col("valid_labels") / F.greatest("total_length", F.lit(1)))
    whole = F.coalesce(after.isNotNull() & find_run(c, end, F.coalesce(after, F.lit(0))).isNotNull(), F.lit(False))
    return out.withColumn("is_valid", whole & (F.col("valid_labels") >= least_labels) & (F.col("label_ratio") >= least_ratio)).drop("_at")
