"""Token ids in Arrow files of equal-length sequences, and reading them back without copies.

Each range of doc_ids is one part: `part-N-<attempt>.arrow` holds record batches of two fixed-size-list columns, `ids` (the
ids of the part's documents end to end, cut every LENGTH) and `mask` (false only in the padding of the part's last
sequence); `part-N-<attempt>.index.arrow` holds doc_id, start in the part and n_tokens. The files are Arrow's random-access
file form of its stream format, not compressed: sequence i is a view into batch i // ROWS of the memory map. A task that
runs again writes files of a new name, and the manifest names those of the task that ended.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bytesops as B
from .common import MAX_PARTS, id_key, partitions, prepare, tidy

LENGTH = 1024
#: Sequences in one record batch.
ROWS = 512
#: Entries of a worker's cache of encoded pieces; it is emptied beyond it. Results do not depend on it.
CACHE = 1_000_000
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 1 << 20
#: Unknown pieces that stand in one text for the library.
JOINED = 128
_MANIFEST = "part int, path string, index_path string, n_docs long, n_tokens long"


def _filesystem(uri: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


#: Bytes after which a space or line break may open a piece: printable ASCII, and the second byte of Latin letters (after
#: C3); letters of both kinds, after which punctuation may.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,!?;:"]] = True
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 32]] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces that can be encoded alone: texts are cut before white space and before a letter's punctuation.

    The byte-level pattern always ends a token between a character that is no white space and white space, and between a
    letter and one of these marks. Places that are not sure to be such borders are not cut.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        latin = np.zeros(len(data) - 1, bool)
        latin[1:] = (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        cut[1:-1] = (_GAP[data[1:]] & (_SOLID[data[:-1]] | latin)) | (_MARK[data[1:]] & (_LETTER[data[:-1]] | latin))
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut[: len(data)])


class Pieces:
    """Texts to ids with a bounded cache: the ids of all known pieces stand end to end in one array."""

    def __init__(self, path: str, dtype: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.cache = Tokenizer.from_file(path), np.dtype(dtype), cache
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.special = [t.content.encode() for t in added]
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        known_form = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True) and not spec["normalizer"]
        alone = all(not (t.lstrip or t.rstrip or t.single_word) and len(piece_starts(d := np.frombuffer(b"x" + t.content.encode() + b"x", np.uint8), np.array([0, len(d)]))) == 1 for t in added)
        #: Only with this form of tokenizer may texts be cut; in its vocabulary a token has a character for each byte.
        self.cuts = known_form and alone
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.count, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, self.dtype)
        self.used = 0

    def _store(self, pieces: Sequence[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        at, n = len(self.known), len(pieces)
        while at + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.count[at : at + n] = count
        self.first[at : at + n] = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.known.update(zip(pieces, range(at, at + n), strict=True))

    def _several(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: np.ndarray) -> None:
        """Encode an array of pieces (bytes). Those that open with a gap and end solid may stand end to end, JOINED in one
        text, and are told apart by the bytes of their tokens; all others are texts of their own."""
        joins = np.fromiter((p[0] in (10, 32) and bool(_SOLID[p[-1]]) for p in pieces), bool, len(pieces)) if self.cuts else np.zeros(len(pieces), bool)
        alone, order = list(pieces[~joins]), pieces[joins]
        groups = [order[at : at + JOINED] for at in range(0, len(order), JOINED)]
        for at in range(0, len(groups), 16):
            texts = [b"".join(g) for g in groups[at : at + 16]]
            for group, text, ids in zip(groups[at : at + 16], texts, self._several([t.decode() for t in texts]), strict=True):
                have, want = np.cumsum(self.bytes_of[ids]), np.cumsum([len(p) for p in group])
                ends = np.minimum(np.searchsorted(have, want), len(have) - 1)
                if any(s in text for s in self.special) or not len(ids) or have[-1] != want[-1] or (have[ends] != want).any():
                    alone += list(group)
                else:
                    self._store(group, ids, np.diff(ends + 1, prepend=0))
        for at in range(0, len(alone), 1000):
            got = self._several([p.decode() for p in alone[at : at + 1000]])
            self._store(alone[at : at + 1000], np.concatenate(got), np.array([len(g) for g in got], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and how many each has; a null text is empty."""
        parts = [(np.zeros(0, self.dtype), np.zeros(0, np.int64))]
        for _, _, data, offsets in B.text_chunks(texts, CHUNK_BYTES):
            starts = piece_starts(data, offsets) if self.cuts else np.unique(offsets[:-1][np.diff(offsets) > 0])
            if len(self.known) > self.cache:
                self.forget()
            bounds = np.append(starts, len(data))
            pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            coded = pieces.dictionary_encode()
            different = coded.dictionary.to_numpy(zero_copy_only=False)
            slots = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
            new = np.flatnonzero(slots < 0)
            if len(new):
                self.learn(different[new])
                slots[new] = np.fromiter(map(self.known.__getitem__, different[new]), np.int64, len(new))
            slots = slots[coded.indices.to_numpy()]
            size = self.count[slots]
            last = np.cumsum(size)
            at = np.arange(last[-1] if len(last) else 0) + np.repeat(self.first[slots] - last + size, size)
            upto = np.concatenate([[0], last])[np.searchsorted(starts, offsets)]
            parts.append((self.ids[at], np.diff(upto)))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@lru_cache(maxsize=2)
def pieces_of(path: str, dtype: str) -> Pieces:
    """One encoder for each worker process, so that its cache outlives a task."""
    return Pieces(path, dtype)


def _schema(dtype: str, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(dtype)), length)), ("mask", pa.list_(pa.bool_(), length))])


def _sequences(raw: bytes, dtype: str, length: int, used: int) -> pa.RecordBatch:
    ids = pa.array(np.frombuffer(raw, dtype))
    mask = pa.array(np.arange(len(ids)) < used)
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, length) for x in (ids, mask)], schema=_schema(dtype, length))


def _write(uri: str, path: str, dtype: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces = pieces_of(path, dtype)
        part = TaskContext.get().partitionId()
        fs, base = _filesystem(uri)
        fs.create_dir(base, recursive=True)
        stem = f"{base}/part-{part:06d}-{uuid.uuid4().hex}"
        width = np.dtype(dtype).itemsize
        full, total, held, count = ROWS * length * width, 0, bytearray(), 0
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        with fs.open_output_stream(f"{stem}.arrow") as out, fs.open_output_stream(f"{stem}.index.arrow") as out_index:
            with pa.ipc.new_file(out, _schema(dtype, length)) as file, pa.ipc.new_file(out_index, index) as file_index:
                for b in batches:
                    ids, size = pieces.encode(b.column("text"))
                    ids, size = np.insert(ids, np.cumsum(size), end_id), size + 1
                    start = total + np.cumsum(size) - size
                    file_index.write_batch(pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(start), pa.array(size)], schema=index))
                    total, count = total + int(size.sum()), count + len(size)
                    held += ids.tobytes()
                    at = 0
                    while len(held) - at >= full:
                        file.write_batch(_sequences(bytes(held[at : at + full]), dtype, length, ROWS * length))
                        at += full
                    del held[:at]
                if held:
                    used = len(held) // width
                    held += bytes(-len(held) % (length * width))
                    file.write_batch(_sequences(bytes(held), dtype, length, used))
        scheme = uri.split("://")[0] + "://" if "://" in uri else ""
        host = uri.split("://")[1].split("/")[0] if scheme and scheme != "file://" else ""
        whole = f"{scheme}{host}{stem}"
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{whole}.arrow"]), pa.array([f"{whole}.index.arrow"]), pa.array([count], pa.int64()), pa.array([total], pa.int64())], names=["part", "path", "index_path", "n_docs", "n_tokens"])

    return run


def open_part(path: str) -> pa.ipc.RecordBatchFileReader:
    """A part's file, memory-mapped where it is local."""
    fs, at = _filesystem(path)
    return pa.ipc.open_file(pa.memory_map(at) if fs.type_name == "local" else fs.open_input_file(at))


def sequence(file: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of a part: a view of its ids, and its mask."""
    b = file.get_batch(i // ROWS)
    ids, mask = b.column("ids"), b.column("mask")
    length, at = ids.type.list_size, i % ROWS
    return ids.values.to_numpy()[at * length : (at + 1) * length], mask.values.slice(at * length, length).to_numpy(zero_copy_only=False)


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0, length: int = LENGTH, parts: int | None = None) -> DataFrame:
    """Encode and write the documents in ascending doc_id order; returns the manifest.

    Manifest: part, path, index_path, n_docs, n_tokens, first (ids in all parts before). It is checkpointed, so reading it
    again writes nothing. Null texts are empty; null doc_ids come first; rows with equal doc_id are ordered by a hash of
    their text. Ids take 16 bits where the vocabulary allows, else 32. An empty table gives an empty manifest; other
    columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = prepare(docs.sparkSession)
    dtype = "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    lean = docs.select(id_key("doc_id").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lean = lean.withColumn("x", F.xxhash64("text"))
    ranged = lean.repartitionByRange(parts or partitions(spark, docs), "k", "x").sortWithinPartitions("k", "x").select("doc_id", "text")
    manifest = ranged.mapInArrow(tidy(_write(folder, path, dtype, end_id, length)), _MANIFEST).checkpoint()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one small row for each file
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            file, index = open_part(row["path"]), open_part(row["index_path"])
            at, number, view = 0, -1, np.zeros(0, np.uint16)
            for j in range(index.num_record_batches):
                docs = index.get_batch(j)
                crcs = []
                for n in docs.column("n_tokens").to_pylist():
                    crc = 0
                    while n:
                        if at == len(view):
                            number, at = number + 1, 0
                            got = file.get_batch(number)
                            view = got.column("ids").values.to_numpy()
                        take = min(n, len(view) - at)
                        crc = zlib.crc32(view[at : at + take].astype("<u4").tobytes(), crc)
                        at, n = at + take, n - take
                    crcs.append(crc)
                start = pa.array(docs.column("start").to_numpy() + row["first"])
                yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of 32-bit ids)."""
    spread = manifest.repartition(max(partitions(manifest.sparkSession), min(MAX_PARTS, manifest.count())), "part")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
