"""A stored index of annotated tokens: a value's places in buckets of files, for lookups, keywords and phrases.

Blocks of places (see ud.inverted_index) are written in folders by a hash of field and value, sorted by value inside. A
question names its values, so its buckets are constants of the plan: only their folders are listed and read, and in them the
row groups whose range of values fits. Places are intersected by aggregation, never as pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.rows import exploded
from . import ud

BUCKETS = 64


def _bucket(field: Column, value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(field, value), F.lit(buckets)).cast("int")


def stored(tok: DataFrame, keys: Sequence[str], path: str, buckets: int = BUCKETS, block: int = 10_000, fields: Sequence[str] = ud.FIELDS) -> None:
    """Write the index of tokens (keys, id and fields): field, value, block, n, places of keys and pos, the token's number.

    Every token is in it, under each of the fields that questions will name (all, unless told otherwise).

    A value's blocks are spread by their name, so no file and no task has all places of a frequent value.
    """
    numbered = tok.filter(F.col("id").cast("string").rlike("^[0-9]+$")).withColumn("pos", F.col("id").cast("int"))
    index = ud.inverted_index(numbered, list(keys), block, fields=fields).filter("value IS NOT NULL")
    dealt = index.withColumn("bucket", _bucket(F.col("field"), F.col("value"), buckets)).withColumn("_s", F.pmod(F.xxhash64("block"), F.lit(4)))
    dealt.repartition("bucket", "_s").sortWithinPartitions("bucket", "field", "value", "block").drop("_s").write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, field: str, values: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """value and place of each place of these values of a field; reads the values' buckets only."""
    index = spark.read.parquet(path)
    asked = reduce(lambda a, b: a | b, [(F.col("bucket") == _bucket(F.lit(field), F.lit(v), buckets)) & (F.col("value") == v) for v in dict.fromkeys(values)])
    found = index.filter((F.col("field") == field) & asked)
    return exploded(found, ["value"], "places", "place")


def with_all(spark: SparkSession, path: str, field: str, values: Sequence[str], keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """keys and n, the number of places, of the sentences that have every one of the values."""
    n = len(set(values))
    places = lookup(spark, path, field, values, buckets).select("value", *[F.col("place")[k].alias(k) for k in keys])
    each = places.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.count("*").alias("_v"), F.sum("n").alias("n")).filter(F.col("_v") == n).drop("_v")


def with_any(spark: SparkSession, path: str, field: str, values: Sequence[str], keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """keys and n, the number of places, of the sentences that have one of the values or more."""
    places = lookup(spark, path, field, values, buckets).select(*[F.col("place")[k].alias(k) for k in keys])
    return places.groupBy(*keys).agg(F.count("*").alias("n"))


def phrase(spark: SparkSession, path: str, parts: Sequence[tuple[str, str]], keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """keys and start of each run of neighbouring tokens with these (field, value) in order.

    Each part's places give the start that they fit to; a start that all parts fit to is a match.
    """
    def fits(i: int, field: str, value: str) -> DataFrame:
        place = F.col("place")
        return lookup(spark, path, field, [value], buckets).select(*[place[k].alias(k) for k in keys], (place["pos"] - i).alias("start"), F.lit(i).alias("part"))

    every = reduce(DataFrame.unionByName, [fits(i, f, v) for i, (f, v) in enumerate(parts)])
    counted = every.groupBy(*keys, "start").agg(F.countDistinct("part").alias("_n"))
    return counted.filter(F.col("_n") == len(parts)).drop("_n")
