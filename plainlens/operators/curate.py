"""Projection, filtering, joining and set operations of corpus curation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

ERROR_PREFIX = "Error: Could not paraphrase -"


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Selected columns, old name to new, in this order; names may hold dots."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


def without(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without these columns; absent ones are no error."""
    return df.drop(*columns)


def nulled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("string") for c in columns})


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require(df: DataFrame, required: Sequence[str]) -> DataFrame:
    if missing := missing_columns(df, required):
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def with_columns_present(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that are absent are added as nulls of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def all_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all neither null nor blank."""
    return df.filter(reduce(lambda a, b: a & b, [T.filled(F.col(f"`{c}`")) for c in columns]))


def needs_work(columns: Sequence[str]) -> Column:
    """True where any of these outputs is null or blank."""
    return reduce(lambda a, b: a | b, [T.blank(F.col(f"`{c}`")) for c in columns])


def without_errors(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is no error message; nulls stay."""
    return df.filter(~F.coalesce(F.col(column).startswith(ERROR_PREFIX), F.lit(False)))


def null_for_nan(column: str) -> Column:
    return F.when(~F.isnan(column), F.col(column))


def flesch_columns(df: DataFrame, original: str, paraphrase: str, digits: int | None = 2) -> DataFrame:
    out = df.withColumns({"flesch_original": T.flesch(F.col(original), digits), "flesch_paraphrase": T.flesch(F.col(paraphrase), digits)})
    return out.withColumn("flesch_diff", F.col("flesch_paraphrase") - F.col("flesch_original"))


def flesch_gain(df: DataFrame, original: str, paraphrase: str, least: float = 0.0, digits: int | None = 2) -> DataFrame:
    """Pairs whose paraphrase is easier by more than `least`."""
    return flesch_columns(df, original, paraphrase, digits).filter(F.col("flesch_diff") > least)


def similar(df: DataFrame, column: str = "sim", least: float = 0.8) -> DataFrame:
    return df.filter(null_for_nan(column) > least)


def diversity_gain(df: DataFrame, original: str, paraphrase: str, least: int = 0) -> DataFrame:
    """Pairs whose paraphrase has fewer different words, by more than `least`."""
    out = df.withColumns({"div_original": T.lexical_diversity(F.col(original)), "div_paraphrase": T.lexical_diversity(F.col(paraphrase))})
    return out.withColumn("div_diff", F.col("div_original") - F.col("div_paraphrase")).filter(F.col("div_diff") > least)


def curated(df: DataFrame, original: str, paraphrase: str, sim: str = "sim", digits: int | None = 2) -> DataFrame:
    """Filled pairs with a readability gain and enough similarity, cheap filters first."""
    return similar(flesch_gain(all_filled(df, [original, paraphrase]), original, paraphrase, digits=digits), sim)


def curation_funnel(df: DataFrame, original: str, paraphrase: str, sim: str = "sim") -> DataFrame:
    """Rows left after each stage, in one pass: total, filled, gain, similar."""
    full = T.filled(F.col(original)) & T.filled(F.col(paraphrase))
    gain = full & F.coalesce(T.flesch(F.col(paraphrase)) - T.flesch(F.col(original)) > 0, F.lit(False))
    close = gain & F.coalesce(null_for_nan(sim) > 0.8, F.lit(False))
    return df.agg(F.count("*").alias("n_total"), F.count_if(full).alias("n_filled"), F.count_if(gain).alias("n_gain"), F.count_if(close).alias("n_similar"))


def finite_between(column: str, low: float, high: float) -> Column:
    return F.coalesce(~F.isnan(column) & F.col(column).between(low, high), F.lit(False))


def clipped(column: str, low: float, high: float) -> Column:
    return F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high))


def row_range(df: DataFrame, row_id: str, start: int = 0, count: int | None = None) -> DataFrame:
    """Rows start, ..., start + count - 1 by an explicit row id."""
    out = df.filter(F.col(row_id) >= start)
    return out if count is None else out.filter(F.col(row_id) < start + count)


def keep_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not there; null keys stay. Also the resume filter: what is done leaves."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def aligned(left: DataFrame, right: DataFrame, row_id: str, same: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of two outputs joined by row id, and those whose shared columns differ or that one side lacks."""
    renamed = right.select(F.col(row_id).alias("_r"), *[F.col(c).alias(f"{c}_right") for c in right.columns if c != row_id])
    both = left.join(renamed, left[row_id] == F.col("_r"), "full_outer")
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_right")) for c in same], F.col(row_id).isNotNull() & F.col("_r").isNotNull())
    return both.filter(equal).drop("_r"), both.filter(~equal).drop("_r")


def with_metadata(results: DataFrame, metadata: DataFrame, on: str = "id") -> tuple[DataFrame, DataFrame]:
    """Results with their metadata, and the results of unknown id (which must be none)."""
    return results.join(metadata, on), results.join(metadata, on, "left_anti")


def backfilled(saved: DataFrame, source: DataFrame, row_id: str) -> DataFrame:
    """Saved output with the columns it lacks taken from the source rows of equal id."""
    extra = [c for c in source.columns if c not in saved.columns]
    return saved.join(source.select(row_id, *extra), row_id, "left")


def first_of_each(df: DataFrame, key: Sequence[str] | str, order: Sequence) -> DataFrame:
    """The first row of each key in an explicit order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def merged(old: DataFrame, new: DataFrame, key: str, row_id: str) -> DataFrame:
    """Union of two results; of equal keys the old row stays, then the first by row id."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return first_of_each(both, key, ["_src", row_id]).drop("_src")


def overriding(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of base, replaced by updates of equal key, and the updates of new keys."""
    return updates.unionByName(base.join(updates.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def absent_values(required: DataFrame, there: DataFrame, column: str) -> DataFrame:
    return required.select(column).distinct().join(there.select(column), column, "left_anti")


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def located(wanted: DataFrame, listing: DataFrame, name: str, path: str) -> DataFrame:
    """Each wanted file name with the first path that has it, or null."""
    first = listing.groupBy(F.element_at(F.split(path, "/"), -1).alias(name)).agg(F.min(path).alias("found"))
    return wanted.join(first, name, "left")


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def preview(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows by these keys."""
    return df.orderBy(*keys).limit(n)
