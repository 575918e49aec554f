"""Tables that are replaced or grown in one step: numbered versions, each a list of files, of which readers see the last.

Data files go to a folder of their own first. A version exists once its list does, and a list is made only if no one else
made that number: of two writers that started from the same version the second one fails, or, if it only adds rows, tries
again on top of the first. What fails leaves no files. Versions are ordered by number, not by a clock.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task of the writer holds before it writes them.
ROWS = 100_000
_LISTS = "_versions"


class Conflict(RuntimeError):
    """Another writer made the version that this one was to be."""


def _name(version: int) -> str:
    return f"{version:012d}.json"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def versions(path: str) -> list[int]:
    """Numbers of the versions there are, in order."""
    files, base = _open(path)
    found = files.get_file_info(fs.FileSelector(f"{base}/{_LISTS}", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())


def content(path: str, version: int | None = None) -> dict:
    """files, schema and version of a version, by default the last; version 0 is the empty table before the first."""
    there = versions(path)
    at = version if version is not None else there[-1] if there else 0
    if at == 0:
        return {"version": 0, "files": [], "schema": None}
    if at not in there:
        raise FileNotFoundError(f"{path} has no version {at}")
    files, base = _open(path)
    with files.open_input_stream(f"{base}/{_LISTS}/{_name(at)}") as f:
        return json.loads(f.read())


def publish(path: str, base_version: int, names: list[str], schema: str, grow: bool, tries: int = 20) -> int:
    """Make the version after base_version of these files, and those of before if it is to grow; returns its number.

    The list is written aside and linked to its number, which fails if that is taken. For growth the next number is tried.
    """
    files, base = _open(path)
    if not isinstance(files, fs.LocalFileSystem):
        raise ValueError("versions are made in local or mounted folders")
    os.makedirs(f"{base}/{_LISTS}", exist_ok=True)
    for _ in range(tries if grow else 1):
        before = content(path, base_version)["files"] if grow else []
        aside = f"{base}/{_LISTS}/.{uuid.uuid4().hex}"
        with open(aside, "w", encoding="utf-8") as f:
            json.dump({"version": base_version + 1, "files": [*before, *names], "schema": schema}, f)
        try:
            os.link(aside, f"{base}/{_LISTS}/{_name(base_version + 1)}")
            return base_version + 1
        except FileExistsError:
            base_version = versions(path)[-1]
        finally:
            os.unlink(aside)
    raise Conflict(f"{path}: another writer made a version since; nothing of this write is kept")


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.json, self.overwrite = path, schema.json(), overwrite
        there = versions(path)
        self.base, self.folder = there[-1] if there else 0, f"data-{uuid.uuid4().hex}"
        old = content(path)["schema"]
        if not overwrite and old is not None and StructType.fromJson(json.loads(old)).simpleString() != schema.simpleString():
            raise ValueError("rows to add have another schema than the table")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, base = _open(self.path)
        files.create_dir(f"{base}/{self.folder}", recursive=True)
        target, names, held, n = to_arrow_schema(StructType.fromJson(json.loads(self.json))), [], [], 0

        def flush() -> None:
            names.append(f"{self.folder}/part-{uuid.uuid4().hex}.parquet")
            pq.write_table(pa.Table.from_batches(held).cast(target), f"{base}/{names[-1]}", filesystem=files)

        for batch in iterator:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                flush()
                held, n = [], 0
        if n:
            flush()
        return _Written(names)

    def commit(self, messages: list) -> None:
        publish(self.path, self.base, [n for m in messages if m is not None for n in m.names], self.json, not self.overwrite)

    def abort(self, messages: list) -> None:
        files, base = _open(self.path)
        if files.get_file_info(f"{base}/{self.folder}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{self.folder}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, version: int | None, schema: StructType):
        self.path, self.files, self.names = path, content(path, version)["files"], schema.names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            files, base = _open(self.path)
            with files.open_input_file(f"{base}/{partition.value}") as f:
                yield from pq.ParquetFile(f).iter_batches(columns=self.names)


class SnapshotSource(DataSource):
    """format("snapshot"): option path; reading takes a version, and a schema of fewer columns; writing is all or nothing.

    mode("overwrite") makes a version of the new rows and fails if another writer was faster; mode("append") one of the old
    and the new. Register it by spark.dataSource.register(SnapshotSource). Folders must be ones that driver and executors
    share as local or mounted paths; replace_table does the same through Spark's own writer.
    """

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> StructType:
        kept = content(self.options["path"], self._version())["schema"]
        if kept is None:
            raise FileNotFoundError(f"{self.options['path']} has no version yet")
        return StructType.fromJson(json.loads(kept))

    def _version(self) -> int | None:
        return int(self.options["version"]) if "version" in self.options else None

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self._version(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)


def replace_table(df: DataFrame, path: str, grow: bool = False) -> int:
    """Write the rows by Spark's own writer and make them the table's next version; returns its number.

    A table may be replaced by what was read from it. If another writer made a version meanwhile this is a Conflict, unless
    the table only grows; then nothing of this write is left.
    """
    there = versions(path)
    start, folder = there[-1] if there else 0, f"data-{uuid.uuid4().hex}"
    files, base = _open(path)
    try:
        df.write.parquet(f"{path}/{folder}")
        names = [f"{folder}/{f.base_name}" for f in files.get_file_info(fs.FileSelector(f"{base}/{folder}")) if f.base_name.endswith(".parquet")]
        return publish(path, start, sorted(names), df.schema.json(), grow)
    except BaseException:
        if files.get_file_info(f"{base}/{folder}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{folder}")
        raise


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, by default the last, by Spark's own reader: filters and columns reach the files."""
    found = content(path, version)
    if found["schema"] is None:
        raise FileNotFoundError(f"{path} has no version yet")
    schema = StructType.fromJson(json.loads(found["schema"]))
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in found["files"]]) if found["files"] else spark.createDataFrame([], schema)


def expired(path: str, keep: int = 1) -> list[str]:
    """Remove all versions but the last few, and the data folders that none of these names; returns the folders' names.

    Not to be run while a write is under way, whose folder no version names yet.
    """
    files, base = _open(path)
    there = versions(path)
    live = {f.split("/")[0] for v in there[-keep:] for f in content(path, v)["files"]}
    for v in there[:-keep]:
        files.delete_file(f"{base}/{_LISTS}/{_name(v)}")
    gone = [f.base_name for f in files.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("data-") and f.base_name not in live]
    for name in gone:
        files.delete_dir(f"{base}/{name}")
    return sorted(gone)
