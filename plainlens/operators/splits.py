"""Samples, splits, challenge sets, blinding and batching; all repeatable under a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .ordering import global_rank, md5_order, ranked_in_groups
from .stats import exact_quantiles

#: Groups that always belong to the test set.
REVISED_MEDICINES = (
    "ATENOLOL", "BESILATO DE ANLODIPINO", "CLORIDRATO DE PROPRANOLOL", "CAPTOPRIL", "ESPIRONOLACTONA", "FUROSEMIDA",
    "HIDROCLOROTIAZIDA", "LOSARTANA POTASSICA", "MALEATO DE ENALAPRIL", "SUCCINATO DE METOPROLOL",
)


def one_per_group(df: DataFrame, group: str, key: str, seed: str | int = 42) -> DataFrame:
    """One row of each group; only ids are sorted inside a group."""
    pick = df.groupBy(group).agg(F.min_by(key, F.struct(md5_order(seed, F.col(key)), F.col(key))).alias(key))
    return df.join(pick, [group, key], "left_semi")


def sample_groups(df: DataFrame, group: str, most: int = 200, seed: str | int = 42) -> DataFrame:
    """At most `most` different non-null groups."""
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    return groups.withColumn("_o", md5_order(seed, F.col(group))).orderBy("_o", group).limit(most).drop("_o")


def choose(df: DataFrame, key: str, n: int, seed: str | int = 42) -> DataFrame:
    """n rows without replacement (all if fewer)."""
    return df.withColumn("_o", md5_order(seed, F.col(key))).orderBy("_o", key).limit(n).drop("_o")


def blind_pairs(df: DataFrame, key: str, first: str, second: str, seed: str | int = 42) -> DataFrame:
    """Per pair two rows (pair_id, slot, model, text) whose order hides the model."""
    swap = F.conv(F.substring(md5_order(seed, F.col(key)), 1, 1), 16, 10).cast("int") % 2
    pair = F.array(F.struct(F.lit(first).alias("model"), F.col(f"`{first}`").alias("text")), F.struct(F.lit(second).alias("model"), F.col(f"`{second}`").alias("text")))
    rows = df.select(F.col(key).alias("pair_id"), swap.alias("_s"), F.posexplode(pair).alias("_p", "_v"))
    return rows.select("pair_id", (F.when(F.col("_s") == 0, F.col("_p")).otherwise(1 - F.col("_p")) + 1).alias("slot"), "_v.model", "_v.text")


def group_split(df: DataFrame, group: str, seed: str | int = 42, train: float = 0.8, forced_test: Sequence[str] = ()) -> DataFrame:
    """Adds `split`: train, val or test by group. floor(train * G) of the G groups train, half of the rest (rounded down)
    validates; forced groups are test and count for neither."""
    groups = df.select(group).filter(F.col(group).isNotNull() & ~F.col(group).isin(*forced_test)).distinct()
    ranked = global_rank(groups.withColumn("_o", md5_order(seed, F.col(group))), "_o", group, name="_r").drop("_o")
    total = groups.agg(F.count("*").alias("_g"))
    n_train = F.floor(F.lit(train) * F.col("_g"))
    n_val = F.floor((F.col("_g") - n_train) / 2)
    split = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_val, "val").otherwise("test")
    named = ranked.crossJoin(F.broadcast(total)).select(group, split.alias("split"))  # total is one row
    out = df.join(named, group, "left")
    return out.withColumn("split", F.when(F.col(group).isin(*forced_test), "test").otherwise(F.col("split"))) if forced_test else out


def challenge_sets(df: DataFrame, group: str, metric: str, most: int = 200, seed: str | int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows of good groups (metric at the 90th percentile or above) and hard ones (10th or below, none of the good). The
    percentiles are found by Spark jobs when this is called."""
    least, most_of_all = (F.lit(q) for q in exact_quantiles(df, metric, (0.1, 0.9)))
    high, low = df.filter(F.col(metric) >= most_of_all), df.filter(F.col(metric) <= least)
    good = sample_groups(high, group, most, seed)
    hard = sample_groups(low.join(F.broadcast(good), group, "left_anti"), group, most, seed)
    return high.join(F.broadcast(good), group, "left_semi"), low.join(F.broadcast(hard), group, "left_semi")


def leaking_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups in more than one split; a sound split gives no rows."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def length_batches(df: DataFrame, key: str, length: str, batch: int, multiplier: int = 50, seed: str | int = 3407, drop_last: bool = False) -> DataFrame:
    """Adds bucket and batch: rows sorted by length are cut into buckets of batch * multiplier, shuffled inside and cut into
    batches; batch_order shuffles the batches.

    The position by length is a global rank, numbered inside runs of keys of a length: a table of one length is spread too.
    """
    size = batch * multiplier
    at = ranked_in_groups(df, length, key, name="_n").withColumn("bucket", F.floor((F.col("_n") - 1) / size).cast("int"))
    shuffled = Window.partitionBy("bucket").orderBy(md5_order(seed, F.col(key)), key)
    at = at.withColumn("_i", F.row_number().over(shuffled) - 1)
    at = at.withColumn("batch", F.floor(F.col("_i") / batch).cast("int"))
    if drop_last:
        at = at.withColumn("_c", F.count("*").over(Window.partitionBy("bucket", "batch"))).filter(F.col("_c") == batch).drop("_c")
    order = md5_order(seed, F.concat_ws("/", "bucket", "batch"))
    return at.withColumn("batch_order", order).drop("_n", "_i")


def repeated(df: DataFrame, key: str, times: int = 3) -> DataFrame:
    """Each row `times` times with repeat = 1, 2, ... and id `{key}__rep{repeat}`."""
    out = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return out.withColumn("id", F.concat(F.col(key).cast("string"), F.lit("__rep"), F.col("repeat")))


def call_batches(df: DataFrame, row_id: str, size: int) -> DataFrame:
    return df.withColumn("call", F.floor(F.col(row_id) / size).cast("long"))


def summarised(frames: dict[str, DataFrame], group: str) -> DataFrame:
    """Rows and different groups of each named set."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups")).select(F.lit(name).alias("set_name"), "n_rows", "n_groups")
        out = one if out is None else out.unionByName(one)
    return out
