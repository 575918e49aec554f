"""Exact duplicates by a content sort: documents are range-partitioned and sorted by normalised content, and neighbours compared.

The sort key is (first bytes of the normalised text, its SHA-256, the text itself): equal texts are adjacent, and the range
splitters that Spark samples stay short however long the texts are. A text with very many copies is sorted in several
parts, whose representatives are compared once more. Everything is a built-in function or a window over the range
partitioning, which no second exchange follows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import partitions, prepare

#: Bytes of content that lead the sort key.
HEAD = 16
#: What a row weighs beside its text, the least weight of one part of a copied text, and the most such parts of a table.
ROW_WEIGHT, PART_WEIGHT, MAX_PARTS = 4096, 1 << 20, 100_000


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    # of a text without other than ASCII characters lower() changes just these letters, and it is the faster one
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def _copied(keyed: DataFrame) -> DataFrame:
    """digest and number of parts of the texts whose copies weigh more than one part may: MAX_PARTS rows at most."""
    weight = F.lit(ROW_WEIGHT) + F.col("bytes")
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    bound = max(PART_WEIGHT, total // MAX_PARTS)
    sizes = keyed.groupBy("digest").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).filter((F.col("n") > 1) & (F.col("w") > bound))
    return sizes.select("digest", F.least(F.col("n"), F.ceil(F.col("w") / bound)).alias("parts"))


def _sorted_runs(docs: DataFrame, text: str, key: str, largest: bool, carry: list[Column]) -> DataFrame:
    """Rows with their run of equal texts in one part of the sort: id, digest, part, run, best, n, first (whether the row is
    the run's best), sample (the run's text, of first rows whose text has several parts) and the carried columns."""
    norm = normalised(F.col(f"`{text}`"))
    keyed = docs.select(F.col(f"`{key}`").alias("id"), norm.alias("norm"), *carry)
    keyed = keyed.withColumns({"digest": F.unhex(F.sha2("norm", 256)), "head": F.substring(F.col("norm").cast("binary"), 1, HEAD), "bytes": F.octet_length("norm").cast("long")})
    tagged = keyed.join(F.broadcast(_copied(keyed.select("digest", "bytes"))), "digest", "left")
    tagged = tagged.withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("parts"))).cast("int"))
    places = ["head", "digest", "part"]
    dealt = tagged.repartitionByRange(partitions(docs.sparkSession, keyed), *places)
    order = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    beside = Window.partitionBy(*places).orderBy("norm", order)
    runs = dealt.withColumn("first", ~F.lag("norm").over(beside).eqNullSafe(F.col("norm")))
    runs = runs.withColumn("run", F.sum(F.col("first").cast("int")).over(beside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sample = F.when(F.col("first") & F.col("parts").isNotNull(), F.col("norm")).alias("sample")
    runs = runs.select("id", *places, "run", "first", sample, *[c for c in keyed.columns if c not in ("id", "norm", "bytes", *places)])
    same = Window.partitionBy(*places, "run")
    return runs.withColumns({"best": (F.max if largest else F.min)("id").over(same), "n": F.count("*").over(same)})


def _joined_parts(runs: DataFrame, largest: bool) -> DataFrame:
    """digest, part, run, and of the whole text's copies: their best id, number, and the part and run that hold it.

    The samples are grouped by the full text, combined before the shuffle; there are at most 2 * MAX_PARTS of them.
    """
    leader = (F.max if largest else F.min)(F.struct(F.col("best").isNotNull() if largest else F.col("best").isNull(), "best", "part", "run"))
    whole = runs.filter("sample IS NOT NULL").groupBy("digest", "sample").agg(leader.alias("lead"), F.sum("n").alias("all_n"), F.collect_list(F.struct("part", "run")).alias("members"))
    return whole.select("digest", "lead", "all_n", F.explode("members").alias("m")).select("digest", "m.part", "m.run", "lead", "all_n")


def _resolved(runs: DataFrame, largest: bool) -> DataFrame:
    """Runs with keep_id, group_size and kept."""
    done = runs.join(F.broadcast(_joined_parts(runs, largest)), ["digest", "part", "run"], "left")
    alone = F.col("lead").isNull()
    leads = alone | ((F.col("lead.part") == F.col("part")) & (F.col("lead.run") == F.col("run")))
    return done.withColumns({"keep_id": F.when(alone, F.col("best")).otherwise(F.col("lead.best")), "group_size": F.coalesce("all_n", "n").cast("long"), "kept": F.col("first") & leads})


def copy_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "largest") -> DataFrame:
    """Every document with its group of equal texts: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is empty. Of a group the row with the `largest` (or
    `smallest`) key stays, a null key only if there is no other; of rows that share text and key one stays, so each group
    has exactly one kept row. text_sha256 is of the normalised text in UTF-8. Texts are never cut, and compared whole. An
    empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    largest = _largest(keep)
    runs = _sorted_runs(docs, text, key, largest, []).select("id", "digest", "part", "run", "first", "best", "n", "sample").checkpoint()
    done = _resolved(runs, largest)
    return done.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "largest") -> DataFrame:
    """The documents that stay, all columns as they were; rules as in copy_groups."""
    prepare(docs.sparkSession)
    largest = _largest(keep)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    runs = _sorted_runs(docs, text, key, largest, [whole]).filter("first").select("id", "digest", "part", "run", "first", "best", "n", "sample", "row").checkpoint()
    return _resolved(runs, largest).filter("kept").select("row.*")


def _largest(keep: str) -> bool:
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is `largest` or `smallest`")
    return keep == "largest"
