"""Table access, shared folders and Arrow helpers used by every operator here."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows in one Arrow batch sent to Python; bounds a worker's memory for long texts.
BATCH_ROWS = 1000
#: Estimated input of one task of a shuffle, and the most tasks that follow from it.
PART_BYTES, MAX_PARTS = 256 << 20, 100_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and name a checkpoint folder where the cluster has none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_dir(spark)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that it need not be installed there."""
    context = spark.sparkContext
    if getattr(context, "_plainlens_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="plainlens-")
    target = os.path.join(folder, "plainlens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(at, name)
                    z.write(whole, os.path.relpath(whole, os.path.dirname(top)))
    context.addPyFile(target)
    context._plainlens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may go without; it gets a new one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plainlens-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession, *inputs: DataFrame) -> int:
    """Tasks of a shuffle of these tables: spark.sql.shuffle.partitions, or more where a task would get over PART_BYTES of
    what the plans of the inputs are estimated at. Plans without an estimate count for nothing."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in inputs:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if size < 1 << 60:
            n = max(n, min(MAX_PARTS, -(-size // PART_BYTES)))
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(column: str) -> Column:
    """An id as a join key that is never null: a null id counts as one id before all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches that gives a task's free memory back to the system when it ends: workers outlive tasks,
    and the next stage's workers share the executor with them."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def unused(df: DataFrame, n: int) -> list[str]:
    """Names that no column of a table has."""
    taken, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"_inner{i}" not in taken:
            out.append(f"_inner{i}")
        i += 1
    return out


def batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans made and run in here drop their shuffle files when they end; what they leave must be a checkpoint or a table."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)
