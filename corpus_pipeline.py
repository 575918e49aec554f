"""A corpus from raw documents: quality rules, near-duplicate removal, substring removal, mixing, BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; what it returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plainlens.llm import bpe, jaccard, mixing, quality, substrings
from plainlens.llm.common import prepare, removed, shared_path, table
from plainlens.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the cutoffs come from the labels of these documents."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity, the one of least doc_id."""
    return jaccard.one_of_each(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the strings of 100 bytes that start earlier too; n_chars follows. None is dropped."""
    return substrings.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' weights takes it, up to twice."""
    return mixing.mixture(docs)


#: Entries of a worker's BPE cache, fewer than in a job of its own, as the workers of earlier stages hold memory too.
BPE_CACHE = 80_000


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and whether the decoded tokens spell out the text's normalised words, one row per copy."""
    coded = bpe.bpe_round_trip(docs.select("doc_id", "source", "text"), vocabulary("word_bpe_49k.json"), BPE_CACHE, spelt="round_trip")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_substrings),
    ("source_mixing", source_mix),
    ("bpe_encoding", bpe_tokens),
]

#: Fitted cutoffs, connected components and merges are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents; stages hand over through tables in the shared folder.

    A table goes when the next one is written; that of the last stage but one stays, as the result reads it.
    """
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    folder = shared_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            removed(spark, before)
        before = out
    return STAGES[-1][1](spark, docs, sf_dir)
