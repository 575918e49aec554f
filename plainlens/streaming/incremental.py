"""New leaflets as a stream, an extension: files that arrive are scored with the batch functions and appended once.

Only per-row functions are used, so there is no state to bound and no late data; availableNow makes it a resumable batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def scored(df: DataFrame, text: str) -> DataFrame:
    score = T.flesch(F.col(text), None)
    return df.withColumns({"n_words": T.word_count(F.col(text)), "flesch": score}).withColumn("band", T.flesch_band(F.col("flesch")))


def score_arrivals(spark: SparkSession, folder: str, schema: str, text: str, out: str, checkpoint: str) -> None:
    """Score what has arrived since the last call; the stream's checkpoint makes each file count once."""
    query = scored(arriving(spark, folder, schema), text).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
