"""Files in and out: tables, text formats, listings, PDF pages, CoNLL-U, atomic and resumable output."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import curate, ud
from . import listing, snapshots


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_pairs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """original_text and paraphrase of several files, one after another."""
    return united_pairs([spark.read.parquet(p) for p in paths])


def united_pairs(frames: Sequence[DataFrame]) -> DataFrame:
    """original_text and paraphrase of several tables; simple_text counts as paraphrase."""
    named = [x.withColumnRenamed("simple_text", "paraphrase") if "simple_text" in x.columns else x for x in frames]
    return curate.union_all([x.select("original_text", "paraphrase") for x in named])


def with_source_file(df: DataFrame, name: str | None = None) -> DataFrame:
    """Adds source_file: the base name of each row's file, or a given name."""
    found = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.withColumn("source_file", F.lit(name) if name is not None else found)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array or object over many lines; with a schema, a path that is not there gives no rows."""
    reader = spark.read.option("multiLine", True)
    if schema is None:
        return reader.json(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return reader.schema(schema).json(path)


def read_text(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    return spark.read.text(path, wholetext=whole)


def read_split(spark: SparkSession, splits: dict[str, str]) -> DataFrame:
    """The split named train, else the first of a dataset's splits (name to path)."""
    return spark.read.parquet(splits["train"] if "train" in splits else next(iter(splits.values())))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """path and name of the files below a folder, contents unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def read_conllu(spark: SparkSession, path: str, separator: str = "\n\n") -> DataFrame:
    """Sentences of CoNLL-U files; each file is an entry, its sentences numbered from 0 in sent_no.

    Records end at the separator, so a large file is read in splits by many tasks, a sentence or a few in each row. Files
    with other line ends need theirs (`\\r\\n\\r\\n`); without it each is one record, and the result the same. Sentences are
    numbered inside their split of the file, and the splits, of which a file has few, are added up in order.
    """
    split = F.col("_metadata.file_block_start").alias("_split")
    records = spark.read.option("lineSep", separator).text(path).select(F.input_file_name().alias("_file"), split, F.monotonically_increasing_id().alias("_record"), "value")
    found = ud.parse_sentences(records, F.struct("_file", "_split", "_record"), "value")
    flat = found.select("entry_id.*", *[c for c in found.columns if c != "entry_id"])
    inside = Window.partitionBy("_file", "_split").orderBy("_record", "sent_no")
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    counts = flat.groupBy("_file", "_split").count().select("_file", "_split", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    numbered = flat.withColumn("sent_no", F.row_number().over(inside) - 1).join(counts, ["_file", "_split"])
    return numbered.select(F.col("_file").alias("entry_id"), (F.col("sent_no") + F.col("_before")).cast("long").alias("sent_no"), "raw", "metadata", "lines", "sent_key")


def _plumber(data: bytes, margin: float) -> list[str]:
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return [p.crop((0, p.height * margin, p.width, p.height * (1 - margin))).extract_text() or "" for p in pdf.pages]


def _mupdf(data: bytes, margin: float) -> list[str]:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        return [p.get_text("text") or "" for p in pdf]


def pdf_pages(spark: SparkSession, folder: str, readers: Sequence[Callable[[bytes, float], list[str]]] = (_plumber, _mupdf), margin: float = 0.08, least: int = 200) -> DataFrame:
    """path, pages array<string>, error: the first reader that works and finds enough text, else the last one's.

    The readers need libraries that are not part of this package; give others, or have them installed on the executors.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                pages, error = None, None
                for i, reader in enumerate(readers):
                    try:
                        got = reader(bytes(data), margin)
                    except Exception as e:  # a file that a library cannot read is a row of the error table
                        error = f"erro: {type(e).__name__}: {e}"
                        continue
                    pages, error = got, None
                    if sum(len(p.strip()) for p in got) >= least or i == len(readers) - 1:
                        break
                rows.append((path, pages, error))
            yield pd.DataFrame(rows, columns=["path", "pages", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select("path", "content").mapInPandas(read, "path string, pages array<string>, error string")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object in each line; letters outside ASCII stay as they are, nulls are written."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


#: A JSON document is put together on the driver, so it has no more rows.
DOCUMENT_ROWS = 100_000


def write_json_document(df: DataFrame, path: str) -> None:
    """One document, indented by four, with letters outside ASCII as they are: an object for one row, else an array."""
    rows = [r.asDict(recursive=True) for r in df.limit(DOCUMENT_ROWS + 1).collect()]
    if len(rows) > DOCUMENT_ROWS:
        raise ValueError(f"more than {DOCUMENT_ROWS} rows; write_json has a line for each")
    text = json.dumps(rows[0] if len(rows) == 1 else rows, indent=4, ensure_ascii=False, default=str)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_conllu(sentences: DataFrame, path: str, corpus: str) -> None:
    """Sentences renumbered from 1 over all entries, in order."""
    out = ud.serialised(ud.renumbered(sentences, ["entry_id", "sent_no"]), corpus)
    out.orderBy("new_sent_id").select("value").write.mode("overwrite").text(path)


def replace_table(df: DataFrame, path: str) -> int:
    """Make these rows the table's next version in one step, see snapshots."""
    return snapshots.replace_table(df, path)


def current_version(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.read_version(spark, path)


class Checkpoints:
    """Rows done so far, appended part by part; what is done is left out of the next run, and dropped at the end."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def done(self) -> DataFrame:
        return rows_or_none(self.spark, self.path, self.schema)

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def left(self, df: DataFrame, key: str) -> DataFrame:
        return curate.drop_keys(df, self.done(), key)

    def clear(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def rows_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet rows at a path, none if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def paged_source(fetch: Callable[[str, int], dict], letters: Sequence[str]):
    """Listing pages as a table of letter, nomeProduto, idBulaPacienteProtegido; see listing, which is a data source too.

    A letter of which a page cannot be had has the pages before it. fetch is the caller's, as no network is part of this
    package.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(x, e.get("nomeProduto"), e.get("idBulaPacienteProtegido")) for x in pdf["letter"] for _, entries, _ in listing.pages(fetch, x) for e in entries]
            yield pd.DataFrame(rows, columns=["letter", "nomeProduto", "idBulaPacienteProtegido"])

    def scan(spark: SparkSession) -> DataFrame:
        asked = spark.createDataFrame([(x,) for x in letters], "letter string").repartition(max(1, len(letters)))
        return asked.mapInPandas(read, "letter string, nomeProduto string, idBulaPacienteProtegido string")

    return scan


def downloaded(df: DataFrame, name: str, url: str, folder: str, factory: Callable[[], Callable[[str], tuple[int, str, bytes]]], kind: str = "pdf") -> DataFrame:
    """Files fetched into a folder that the executors share: name, outcome (`written`, `there` or why not).

    Names that the folder has are not fetched again. Only an answer of status 200 whose content type holds `kind` is written,
    under another name first, so a task that is lost leaves no half file. The client is built on the worker and takes a
    URL to (status, content type, content), as no network is part of this package.
    """
    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        get = factory()
        for pdf in batches:
            rows = []
            for n, u in zip(pdf["name"], pdf["url"], strict=True):
                at = f"{base}/{n}"
                if files.get_file_info(at).type != fs.FileType.NotFound:
                    rows.append((n, "there"))
                    continue
                try:
                    status, content_type, content = get(u)
                except Exception as e:  # a file that cannot be had is a row, and the others go on
                    rows.append((n, f"{type(e).__name__}: {e}"))
                    continue
                if status != 200 or kind not in content_type.lower():
                    rows.append((n, f"status {status}, {content_type}"))
                    continue
                part = f"{base}/.{n}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(content)
                files.move(part, at)
                rows.append((n, "written"))
            yield pd.DataFrame(rows, columns=["name", "outcome"])

    wanted = df.select(F.col(f"`{name}`").alias("name"), F.col(f"`{url}`").alias("url")).filter("name IS NOT NULL AND url IS NOT NULL").dropDuplicates(["name"])
    return wanted.mapInPandas(fetch, "name string, outcome string")
