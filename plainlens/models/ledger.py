"""Answers that were paid for, written down as they come: a request is made once, whatever happens to the task that made it.

A ledger is a folder that all executors share. Each attempt of a task adds a line for each answer to a file of its own, named
after the run and the partition; the next attempt of the same partition reads the lines before it asks anything. What
earlier runs wrote is joined by Spark. A line that a lost executor cut short is no answer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _lines(files: fs.FileSystem, path: str) -> Iterator[dict]:
    with files.open_input_stream(path) as f:
        for line in f.read().decode("utf-8", "replace").split("\n"):
            try:
                entry = json.loads(line)
            except ValueError:
                continue
            if isinstance(entry, dict) and {"k", "seed", "answer"} <= set(entry):
                yield entry


class Ledger:
    """One task's part: answers known from earlier attempts of its partition, and the file that new ones go to."""

    def __init__(self, path: str, run: str, partition: int):
        self.files, base = opened(path)
        self.files.create_dir(base, recursive=True)
        mine = f"{run}-{partition:06d}-"
        self.known = {}
        for f in self.files.get_file_info(fs.FileSelector(base)):
            if f.base_name.startswith(mine) and f.size:
                self.known |= {(e["k"], e["seed"]): e["answer"] for e in _lines(self.files, f.path)}
        self.path, self.out = f"{base}/{mine}{uuid.uuid4().hex}.jsonl", None

    def add(self, k: int, seed: int, answer: str) -> None:
        if self.out is None:
            self.out = self.files.open_append_stream(self.path) if isinstance(self.files, fs.LocalFileSystem) else self.files.open_output_stream(self.path)
        self.out.write(json.dumps({"k": k, "seed": seed, "answer": answer}, ensure_ascii=False).encode() + b"\n")
        self.out.flush()
        self.known[k, seed] = answer

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """k, seed, answer of all runs, one for each request."""
    files, base = opened(path)
    there = files.get_file_info(base).type == fs.FileType.Directory and any(f.base_name.endswith(".jsonl") for f in files.get_file_info(fs.FileSelector(base)))
    if not there:
        return spark.createDataFrame([], "k long, seed long, answer string")
    lines = spark.read.schema("k long, seed long, answer string").option("mode", "DROPMALFORMED").json(path)
    return lines.filter("k IS NOT NULL AND seed IS NOT NULL AND answer IS NOT NULL").groupBy("k", "seed").agg(F.min("answer").alias("answer"))


def known_by_key(spark: SparkSession, path: str) -> DataFrame:
    """k and known, a map of seeds to answers."""
    return recorded(spark, path).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("seed", "answer"))).alias("known"))


def answered(requests: Iterator[tuple], ask: Callable[..., str], parallel: int) -> Iterator[tuple]:
    """(request, answer, error) of each request (ask's arguments), in the order they end, `parallel` at most under way; no more
    are taken from the iterator than are asked."""
    with ThreadPoolExecutor(parallel) as pool:
        running: dict = {}
        while True:
            while len(running) < parallel and (request := next(requests, None)) is not None:
                running[pool.submit(ask, *request)] = request
            if not running:
                return
            for done in wait(running, return_when=FIRST_COMPLETED).done:
                request, error = running.pop(done), done.exception()
                yield (request, None, f"{type(error).__name__}: {error}") if error else (request, done.result(), None)
