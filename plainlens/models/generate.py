"""Resumable generation with an injected client.

A client takes (system, user, seed) and returns a text; it is built on the worker by a factory, so connections need not be
sent. Errors become a column and never end the job. Concurrency is the number of partitions times the requests that each
has under way; a ledger keeps answers that were paid for.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import curate, sari, similarity
from .ledger import Ledger, answered, known_by_key

Client = Callable[[str, str, int], str]
#: Measures by name: functions of a DataFrame and its text columns.
METRICS: dict[str, Callable[..., DataFrame]] = {}


def metric(name: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        METRICS[name] = f
        return f

    return add


def metric_of(name: str) -> Callable[..., DataFrame]:
    if name not in METRICS:
        raise KeyError(f"no metric {name!r}; there are {sorted(METRICS)}")
    return METRICS[name]


@metric("flesch")
def _flesch(df: DataFrame, key: str, original: str, simplified: str) -> DataFrame:
    """key, flesch_original, flesch_simplified."""
    return df.select(key, T.flesch(F.col(f"`{original}`")).alias("flesch_original"), T.flesch(F.col(f"`{simplified}`")).alias("flesch_simplified"))


@metric("lexical_diversity")
def _diversity(df: DataFrame, key: str, original: str, simplified: str) -> DataFrame:
    """key, div_original, div_simplified."""
    return df.select(key, T.lexical_diversity(F.col(f"`{original}`")).alias("div_original"), T.lexical_diversity(F.col(f"`{simplified}`")).alias("div_simplified"))


@metric("d_sari")
def _d_sari(df: DataFrame, key: str, original: str, simplified: str, reference: str) -> DataFrame:
    return sari.d_sari(df, key, original, simplified, reference)


@metric("sliding_similarity")
def _sliding(df: DataFrame, key: str, original: str, simplified: str, encode: Callable | None = None) -> DataFrame:
    return similarity.sliding_similarity(df, key, original, simplified, encode or similarity.hashed_encoder())


def fake_client() -> Client:
    """A deterministic stand-in: the first half of the user's words."""
    def ask(system: str, user: str, seed: int) -> str:
        words = user.split()
        return f"<think>{seed}</think>" + " ".join(words[: max(1, len(words) // 2)])

    return ask


def decoding(temperature: float = 0.0, top_p: float = 1.0) -> dict:
    """Options for a local model's factory: greedy unless the temperature is above 0."""
    return {"do_sample": True, "temperature": temperature, "top_p": top_p} if temperature > 0 else {"do_sample": False}


def completions(df: DataFrame, key: str, text: str, factory: Callable[[], Client], system: str, template: str, n: int = 1, base_seed: int = 42, seeds_per_row: int = 1, concurrency: int = 8, parallel: int = 1, ledger: str | None = None) -> DataFrame:
    """key, out_1 .. out_n, error for rows with a text. Row seeds are base + key * seeds_per_row + 0, 1, ...; if one of the
    n fails all are null and error says why. key is a number, unique.

    Rows are dealt over `concurrency` tasks by key, each of which has `parallel` requests under way at most. With a ledger, a
    folder that all executors share, each answer is written down when it comes: an attempt that follows a lost one, a second
    use of the result, or another run asks only for what is not there. Requests that were under way in a task when it was
    lost, `parallel` at most, and failed ones are asked again. Two attempts of one task at once (speculation) do not see
    each other.
    """
    spark, run_id = df.sparkSession, uuid.uuid4().hex
    asked = df.filter(T.filled(F.col(text))).select(F.col(key).cast("long").alias("k"), T.prompt(template, text=F.col(text)).alias("user"))
    known = known_by_key(spark, ledger) if ledger else spark.createDataFrame([], "k long, known map<bigint,string>")
    asked = asked.join(known, "k", "left").select("k", "user", F.map_entries("known").alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        book = Ledger(ledger, run_id, TaskContext.get().partitionId()) if ledger else None
        before = book.known if book else {}
        for pdf in batches:
            out = {int(k): {} for k in pdf["k"]}
            errors: dict[int, str] = {}
            todo = []
            for k, user, old in zip(pdf["k"], pdf["user"], pdf["known"], strict=True):
                kept = {e["key"]: e["value"] for e in old} if old is not None else {}
                for seed in (base_seed + int(k) * seeds_per_row + i for i in range(n)):
                    if seed in kept or (int(k), seed) in before:
                        out[int(k)][seed] = kept.get(seed, before.get((int(k), seed)))
                    else:
                        todo.append((int(k), system, user, seed))
            for (k, _, _, seed), answer, error in answered(iter(todo), lambda k, *request: ask(*request), parallel):
                if error:
                    errors[k] = min(errors.get(k, error), error)
                else:
                    out[k][seed] = answer
                    if book:
                        book.add(k, seed, answer)
            rows = [(k, *([None] * n if k in errors else [out[k][s] for s in sorted(out[k])]), errors.get(k)) for k in out]
            yield pd.DataFrame(rows, columns=["k", *[f"out_{i + 1}" for i in range(n)], "error"])
        if book:
            book.close()

    schema = "k long, " + ", ".join(f"out_{i + 1} string" for i in range(n)) + ", error string"
    out = asked.repartition(concurrency, "k").mapInPandas(run, schema)
    return out.select(F.col("k").alias(key), *[T.clean_llm_output(F.col(f"out_{i + 1}")).alias(f"out_{i + 1}") for i in range(n)], "error")


def resumed(df: DataFrame, done: DataFrame, key: str, outputs: list[str]) -> DataFrame:
    """Rows still to do: those not done, or done with a blank output."""
    complete = done.filter(~curate.needs_work(outputs))
    return curate.drop_keys(df, complete, key)


def generated(df: DataFrame, done: DataFrame, key: str, text: str, factory: Callable[[], Client], system: str, template: str, n: int = 1, **options) -> DataFrame:
    """The done rows that are complete, and new completions for the rest."""
    outputs = [f"out_{i + 1}" for i in range(n)]
    new = completions(resumed(df, done, key, outputs), key, text, factory, system, template, n, **options)
    return curate.union_all([done.filter(~curate.needs_work(outputs)), new])


def annotated(df: DataFrame, key: str, text: str, factory: Callable[[], Callable[[str], str]], cached: DataFrame | None = None, tries: int = 3, wait: float = 5.0) -> DataFrame:
    """key, conllu: CoNLL-U text of an injected parser; cached rows are taken as they are, failed connections are tried again
    after `wait` seconds."""
    todo = curate.drop_keys(df, cached, key) if cached is not None else df
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = factory()
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                for left in range(tries - 1, -1, -1):
                    try:
                        rows.append((k, parse(t)))
                        break
                    except ConnectionError:
                        if not left:
                            raise
                        time.sleep(wait)
            yield pd.DataFrame(rows, columns=[key, "conllu"])

    new = todo.select(key, text).mapInPandas(run, f"{key} {kind}, conllu string")
    return new if cached is None else curate.union_all([cached.select(key, "conllu"), new])
