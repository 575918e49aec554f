"""Language identification by the nearest of several centroids per language.

Texts are lower-cased, cut to their letters and counted as byte trigrams in DIMS hashed dimensions, damped, weighted with inverse document
frequencies and normalised. Document frequencies come from all learned documents. Centroids come from spherical k-means on
a bounded sample of each language: the documents with the least hashes, about SAMPLE of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import bytesops as B
from .common import prepare

DIMS = 1 << 14
#: Learned documents per language that shape the centroids (expected number), and centroids per language.
SAMPLE, CENTROIDS = 600, 4
#: A text is rejected if its similarity is below this quantile of its language's sample.
REJECT_QUANTILE = 0.005
#: More languages than this are an error, as their centroids are broadcast.
MAX_LANGUAGES = 500
#: Texts whose vectors are held at once.
_BLOCK = 256


def remainder(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % 5


def trigram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams and the texts they are in; a text is padded with a space on either side."""
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size + 2)
    padded = np.full(len(data) + 2 * len(size), 32, np.uint32)
    padded[np.arange(len(data)) + 2 * np.repeat(np.arange(len(size)), size) + 1] = data
    code = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:] if len(padded) > 2 else padded[:0]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMS.bit_length() + 1)
    inside = text[2:] == text[:-2] if len(padded) > 2 else np.zeros(0, bool)
    return code[inside].astype(np.int64), text[2:][inside] if len(padded) > 2 else text[:0]


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, trigram counts) for consecutive texts, whatever is no letter being one space."""
    lowered = pc.replace_substring_regex(pc.utf8_lower(column.fill_null("")), r"\PL+", " ")
    for at in range(0, len(lowered), _BLOCK):
        for lo, hi, data, offsets in B.text_chunks(lowered.slice(at, _BLOCK)):
            code, text = trigram_codes(data, offsets)
            yield at + lo, np.bincount(text * DIMS + code, minlength=(hi - lo) * DIMS).reshape(hi - lo, DIMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts, dtype=np.float32) * idf
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for _, counts in blocks(b.column("text")):
            total += (counts > 0).sum(0)
            docs += len(counts)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], docs))], names=["dim", "n"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, counts in blocks(b.column("text")):
            rows = [np.flatnonzero(c) for c in counts]
            sparse = [np.stack([r, np.minimum(c[r], 65535)]).astype("<u2").tobytes() for r, c in zip(rows, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("lang").slice(at, len(sparse)), b.column("h").slice(at, len(sparse)), pa.array(sparse)], names=["lang", "h", "counts"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts from the sample's mean direction and the rows furthest from those chosen."""
    c = [x.mean(0)]
    while len(c) < min(k, len(x)):
        c.append(x[np.argmin((x @ np.array(c).T).max(1))])
    c = np.array(c)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _centroids(idf: np.ndarray):
    """The sampled documents of one language to its centroids and least accepted similarity."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = sorted(zip(pdf["h"], map(bytes, pdf["counts"]), strict=True))
        x = np.zeros((len(own), DIMS), np.float32)
        for i, (_, raw) in enumerate(own):
            at, count = np.frombuffer(raw, "<u2").reshape(2, -1)
            x[i, at] = count
        x = weighted(x, idf)
        c = spherical_kmeans(x, CENTROIDS).astype("<f4")
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "centroids": [c.tobytes()], "floor": [float(np.quantile((x @ c.T).max(1), REJECT_QUANTILE))]})

    return run


class Model:
    """idf, and unit centroids with the language and the least accepted similarity of each."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, floor: np.ndarray):
        self.languages, self.idf, self.centroids, self.of, self.floor = languages, idf, centroids, of, floor

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        lang, score, far = [], np.zeros(len(column)), np.zeros(len(column), bool)
        for at, counts in blocks(column):
            near = weighted(counts, self.idf) @ self.centroids.T
            best = near.argmax(1)
            lang += [self.languages[i] for i in self.of[best]]
            top = near[np.arange(len(best)), best]
            score[at : at + len(best)] = np.clip(top, 0, 1)
            far[at : at + len(best)] = top < self.floor[self.of[best]]
        return lang, score, far


def fit(learn: DataFrame) -> Model | None:
    """A model from learn (text, lang, doc_id), or None if it has no rows with a language and a text."""
    learn = learn.filter("lang IS NOT NULL AND text IS NOT NULL")
    per = learn.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not per:
        return None
    spread = 1 << 30
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(spread))
    bound = F.create_map(*[F.lit(v) for r in per for v in (r.lang, int(min(spread, spread * SAMPLE / r["count"])))])
    df = learn.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    n = {r.dim: r.n for r in df}
    idf = np.log((1 + n.pop(-1)) / (1 + np.array([n.get(i, 0) for i in range(DIMS)]))).astype(np.float32) + 1
    sampled = learn.withColumn("h", h).filter(F.col("h") < F.try_element_at(bound, F.col("lang")))
    counted = sampled.select("text", "lang", "h").mapInArrow(_counts, "lang string, h long, counts binary")
    # one group is about SAMPLE documents, and the driver only gets the centroids
    rows = sorted(counted.groupBy("lang").applyInPandas(_centroids(idf), "lang string, centroids binary, floor double").collect(), key=lambda r: r.lang)
    if not rows:
        return None
    per_language = [np.frombuffer(r.centroids, "<f4").reshape(-1, DIMS) for r in rows]
    of = np.repeat(np.arange(len(rows)), [len(c) for c in per_language])
    return Model([r.lang for r in rows], idf, np.concatenate(per_language), of, np.array([r.floor for r in rows]))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None:
                lang, score, far = ["und"] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            else:
                lang, score, far = model.value.predict(b.column("text"))
            letters = b.column("letters").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x if y else "und" for x, y in zip(lang, letters, strict=True)], pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, far, True))], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identified(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected.

    Learned from text and non-null lang of documents whose crc32(doc_id as text) modulo 5 is not 0; the others are held
    out, and only text decides a prediction. score is the cosine to the nearest centroid, rejected says that it is unusually
    far for its language. lang_pred is `und` (score 0, rejected) if text is null or has no letter, or nothing was learned. A
    null doc_id is neither held out nor learned. Repeated rows get equal results; other columns are ignored. More than 500
    languages to learn are an error.
    """
    spark = prepare(docs.sparkSession)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(lean.filter(remainder() != 0))
    shared = spark.sparkContext.broadcast(model) if model else None
    out = lean.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    return out.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def crc32_of(doc_id: int) -> int:
    """The same remainder in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
