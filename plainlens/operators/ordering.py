"""Repeatable pseudo-random order by md5, and exact global ranks that no single task computes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType, StringType


def md5_order(seed: str | int, key: Column) -> Column:
    """The order of a key under a seed; SQL engines agree on it."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def global_rank(df: DataFrame, md5_col: str, *ties: str, name: str = "rank") -> DataFrame:
    """1-based rank by an md5 column, then ties: rows are ranked inside the 65,536 four-digit prefixes, and the prefixes'
    counts, a bounded table, are summed up and broadcast."""
    keyed = df.withColumn("_p", F.substring(md5_col, 1, 4))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_p").orderBy(md5_col, *ties)
    ranked = keyed.withColumn(name, F.row_number().over(inside)).join(F.broadcast(counts), "_p")
    return ranked.withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")


def run_of(df: DataFrame, key: str, runs: int = 256) -> Column:
    """A column that cuts the values of a key into ordered runs: all keys of a run are before those of the next.

    Numbers are cut at approximate quantiles, which a Spark job finds when the column is made, into runs of about equal size;
    strings by their first four characters. Nulls come first; equal keys are in one run.
    """
    kind = df.schema[key].dataType
    if isinstance(kind, StringType):
        return F.left(F.coalesce(F.col(key), F.lit("")), F.lit(4))
    if not isinstance(kind, NumericType):
        raise TypeError(f"{key} is neither a number nor a string")
    cuts = df.agg(F.percentile_approx(key, [i / runs for i in range(1, runs)], 20 * runs)).first()[0]
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]) if cuts else F.array().cast("array<double>")
    return F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c < F.col(key))))


def ranked_by_value(df: DataFrame, key: str, *ties: str, name: str = "rank", runs: int = 256) -> DataFrame:
    """1-based rank by a numeric key, then ties: rows are ranked inside runs (see run_of), and the counts of the runs, a bounded
    table, are summed up and broadcast. Rows of one key are in one run, so ties are only ranked there. The runs' borders are
    found by a Spark job when this is called."""
    keyed = df.withColumn("_p", run_of(df, key, runs))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_p").orderBy(key, *ties)
    ranked = keyed.withColumn(name, F.row_number().over(inside)).join(F.broadcast(counts), "_p")
    return ranked.withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")


def ranked_in_groups(df: DataFrame, group: str, key: str, name: str = "rank", runs: int = 256) -> DataFrame:
    """1-based rank by a group's value, then by key, over the whole table.

    Rows are numbered inside a run of keys of a group, the runs' counts are added up inside the group and the groups' over
    all; a task never has more than a run, however many rows a group has. The last sum has one row for each group.
    """
    keyed = df.withColumn("_p", run_of(df, key, runs))
    so_far = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = keyed.groupBy(group, "_p").count()
    whole = counts.groupBy(group).agg(F.sum("count").alias("count")).select(F.col(group).alias("_g"), so_far(Window.orderBy(group)).alias("_all"))
    starts = counts.select(F.col(group).alias("_of"), F.col("_p").alias("_q"), so_far(Window.partitionBy(group).orderBy("_p")).alias("_in"))
    starts = starts.join(whole, F.col("_of").eqNullSafe(F.col("_g"))).select("_of", "_q", (F.col("_in") + F.col("_all")).alias("_before"))
    ranked = keyed.withColumn(name, F.row_number().over(Window.partitionBy(group, "_p").orderBy(key)))
    joined = ranked.join(starts, ranked[group].eqNullSafe(F.col("_of")) & (ranked["_p"] == F.col("_q")))
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_of", "_q", "_before")
