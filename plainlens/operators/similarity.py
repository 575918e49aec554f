"""Similarity of documents and sections from chunk vectors; the encoder is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.rows import bound, exploded


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), norm(a)))


def _means(vector: Column, dims: int) -> Column:
    """The means of each place of vectors of a known length, as an aggregate."""
    return F.array(*[F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dims)])


def mean_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean of each key's vectors: key, mean."""
    dims = df.select(key, F.posexplode(vector).alias("_d", "_v")).groupBy(key, "_d").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return dims.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", "_m"))), lambda x: x["_m"]).alias("mean"))


def term_vectors(chunks: DataFrame, key: str, chunk: str, text: str) -> DataFrame:
    """Term frequencies as sparse rows: key, chunk, term, tf. The encoder used where none is given."""
    terms = exploded(chunks, [key, chunk], T.tokens(F.lower(text)), "term")
    return terms.groupBy(key, chunk, "term").agg(F.count("*").alias("tf"))


def chunk_pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Cosine of each chunk of a with each of b of the same key: a and b are (key, chunk, weight, vec)."""
    left = a.select(key, F.col("chunk").alias("a_chunk"), F.col("weight").alias("a_weight"), F.col("vec").alias("a_vec"))
    right = b.select(key, F.col("chunk").alias("b_chunk"), F.col("weight").alias("b_weight"), F.col("vec").alias("b_vec"))
    return left.join(right, key).select(key, "a_chunk", "a_weight", "b_chunk", "b_weight", cosine(F.col("a_vec"), F.col("b_vec")).alias("sim"))


def best_alignment(pairs: DataFrame, key: str) -> DataFrame:
    """key, a_to_b, b_to_a, semantic_f1: the weighted means of each chunk's best match in either direction, and their F1."""
    def way(side: str) -> DataFrame:
        best = pairs.groupBy(key, f"{side}_chunk").agg(F.max("sim").alias("_m"), F.first(f"{side}_weight").alias("_w"))
        return best.groupBy(key).agg(F.try_divide(F.sum(F.col("_m") * F.col("_w")), F.sum("_w")).alias(f"{side}_best"))

    both = way("a").join(way("b"), key)
    a, b = F.col("a_best"), F.col("b_best")
    return both.select(key, a.alias("a_to_b"), b.alias("b_to_a"), F.when(a + b == 0, 0.0).otherwise(F.try_divide(2 * a * b, a + b)).alias("semantic_f1"))


def _spread_blocks(x: DataFrame, key: str, size: int) -> DataFrame:
    """key, block, rows: a key's chunks in blocks of so many chunk numbers."""
    row = F.struct(F.col("chunk").cast("long").alias("chunk"), F.col("weight").cast("double").alias("weight"), F.col("vec").cast("array<double>").alias("vec"))
    return x.groupBy(key, F.floor(F.col("chunk") / size).alias("block")).agg(F.collect_list(row).alias("rows"))


def _vectors(rows: pa.StructArray) -> np.ndarray:
    """Unit vectors by row; NaN for a null or zero vector and for one of another length than the longest."""
    vec = rows.field("vec")
    lengths = np.asarray(vec.value_lengths().fill_null(0))
    d = int(lengths.max(initial=0))
    out = np.full((len(rows), d), np.nan)
    fits = lengths == d
    if d and fits.any():
        out[fits] = vec.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.linalg.norm(out, axis=1)[:, None]


def _block_maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best cosine of each chunk of either side within a pair of blocks: one row for a chunk, none for a pair of chunks."""
    for batch in batches:
        at, side, chunk, weight, best = [], [], [], [], []
        for i in range(batch.num_rows):
            a, b = (batch.column(n)[i].values for n in ("a_rows", "b_rows"))
            x, y = _vectors(a), _vectors(b)
            sim = x @ y.T if x.shape[1] == y.shape[1] else np.full((len(a), len(b)), np.nan)
            low = np.where(np.isnan(sim), -np.inf, sim)
            for name, rows, axis in (("a", a, 1), ("b", b, 0)):
                top = low.max(axis=axis)
                at.append(np.full(len(rows), i))
                side += [name] * len(rows)
                chunk.append(rows.field("chunk").to_numpy(zero_copy_only=False))
                weight.append(rows.field("weight").to_numpy(zero_copy_only=False))
                best.append(top)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
        top = join(best)
        key = batch.column("key").take(pa.array(join(at).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([key, pa.array(side, pa.string()), pa.array(join(chunk).astype(np.int64)), pa.array(join(weight)), pa.array(top, mask=np.isinf(top))], names=["key", "side", "chunk", "weight", "best"])


def aligned(a: DataFrame, b: DataFrame, key: str, block: int = 512, blocks_together: int = 8) -> DataFrame:
    """best_alignment of two chunk tables (key, chunk, weight, vec), by matrix products of blocks of chunks.

    Row and column maxima are taken inside a pair of blocks, so no row for a pair of chunks is made or shuffled. The blocks of
    a key are dealt in groups, each with all blocks of the other side, so a key with very many chunks is spread. chunk is a
    whole number, unique within a key.
    """
    left = _spread_blocks(a, key, block).withColumn("part", F.floor(F.col("block") / blocks_together)).select(F.col(key).alias("key"), "part", F.col("rows").alias("a_rows"))
    parts = left.select("key", "part").distinct()
    right = _spread_blocks(b, key, block).select(F.col(key).alias("key"), F.col("rows").alias("b_rows")).join(parts, "key")
    kind = a.schema[key].dataType
    schema = StructType([StructField("key", kind), StructField("side", StringType()), StructField("chunk", LongType()), StructField("weight", DoubleType()), StructField("best", DoubleType())])
    folded = left.join(right, ["key", "part"]).select("key", "a_rows", "b_rows").mapInArrow(_block_maxima, schema)
    each = folded.groupBy("key", "side", "chunk").agg(F.max("best").alias("m"), F.first("weight").alias("w"))
    mean = lambda side: F.try_divide(F.sum(F.when(F.col("side") == side, F.col("m") * F.col("w"))), F.sum(F.when(F.col("side") == side, F.col("w"))))
    both = each.groupBy("key").agg(mean("a").alias("a_to_b"), mean("b").alias("b_to_a"))
    x, y = F.col("a_to_b"), F.col("b_to_a")
    return both.select(F.col("key").alias(key), "a_to_b", "b_to_a", F.when(x + y == 0, 0.0).otherwise(F.try_divide(2 * x * y, x + y)).alias("semantic_f1"))


def section_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return T.with_sections(df, text, "_m").select(key, F.explode_outer("_m").alias("sec", "text")).filter("sec IS NOT NULL")


def section_chunks(df: DataFrame, key: str, text: str, encode: Callable[[Column], Column], size: int = 120, overlap: int = 30) -> DataFrame:
    """key, sec, chunk, weight (words), vec of every chunk of every section.

    encode makes a vector column of a text column, or, as models.svd.SvdEncoder does, encodes a table: encoded(df, keys, text).
    """
    parts = exploded(T.with_word_chunks(section_rows(df, key, text), "text", "_c", size, overlap), [key, "sec"], "_c", "text", "chunk")
    if hasattr(encode, "encoded"):
        weights = parts.select(key, "sec", "chunk", T.token_count(F.col("text")).alias("weight"))
        return weights.join(encode.encoded(parts, [key, "sec", "chunk"], "text", "vec"), [key, "sec", "chunk"])
    return parts.select(key, "sec", "chunk", T.token_count(F.col("text")).alias("weight"), encode(F.col("text")).alias("vec"))


def section_scores(df: DataFrame, key: str, original: str, simplified: str, encode: Callable[[Column], Column], size: int = 120, overlap: int = 30) -> DataFrame:
    """key, sec, orig_to_simp, simp_to_orig, semantic_f1 for all nine sections: null if both texts lack it, 0 if one does."""
    a, b = (section_chunks(df, key, c, encode, size, overlap).withColumn("_k", F.struct(key, "sec")) for c in (original, simplified))
    got = aligned(a, b, "_k").select(F.col(f"_k.{key}").alias(key), "_k.sec", "a_to_b", "b_to_a", "semantic_f1")
    texts = T.with_sections(T.with_sections(df, original, "_o"), simplified, "_s")
    there = texts.select(key, F.explode_outer("_o").alias("sec", "_ot"), "_s").filter("sec IS NOT NULL").select(key, "sec", (F.col("_ot") != "").alias("_a"), (F.element_at("_s", F.col("sec")) != "").alias("_b"))
    value = lambda c: F.when(~F.col("_a") & ~F.col("_b"), None).when(F.col("_a") & F.col("_b"), F.col(c)).otherwise(0.0)
    return there.join(got, [key, "sec"], "left").select(key, "sec", value("a_to_b").alias("orig_to_simp"), value("b_to_a").alias("simp_to_orig"), value("semantic_f1").alias("semantic_f1"))


def document_score(scores: DataFrame, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """key, semantic_similarity_sections: weighted mean over the sections that have a score, null without any."""
    w = F.create_map(*[x for s, v in (weights or T.SECTION_WEIGHTS).items() for x in (F.lit(s), F.lit(v))])
    valued = scores.withColumn("_w", F.when(F.col("semantic_f1").isNotNull(), F.element_at(w, F.col("sec"))))
    return valued.groupBy(key).agg(F.try_divide(F.sum(F.col("_w") * F.col("semantic_f1")), F.sum("_w")).alias("semantic_similarity_sections"))


def wide_section_scores(scores: DataFrame, key: str) -> DataFrame:
    """27 columns sec_i_<measure> and the document score."""
    names = ("orig_to_simp", "simp_to_orig", "semantic_f1")
    wide = scores.groupBy(key).pivot("sec", list(T.SECTION_HEADINGS)).agg(*[F.first(n).alias(n) for n in names])
    return wide.join(document_score(scores, key), key)


def sliding_similarity(df: DataFrame, key: str, a: str, b: str, encode: Callable[[Column], Column], size: int = 5, overlap: int = 2) -> DataFrame:
    """key, sim: cosine of the mean vectors of both texts' sentence chunks.

    Both texts are cut and encoded in one pass. With an encoder that tells its length (dims) one aggregation gives both means,
    so no place of a vector becomes a row.
    """
    texts = F.array(*[F.struct(F.lit(s).alias("_side"), F.col(f"`{c}`").alias("_t")) for s, c in (("a", a), ("b", b))])
    rows = df.select(key, F.explode(texts).alias("_s")).select(key, "_s._side", "_s._t")
    chunks = exploded(T.with_sentence_chunks(rows, "_t", "_c", size, overlap), [key, "_side"], "_c", "_t").select(key, "_side", encode(F.col("_t")).alias("_v"))
    of = lambda s: F.when(F.col("_side") == s, F.col("_v"))
    if hasattr(encode, "dims"):
        means = chunks.groupBy(key).agg(_means(of("a"), encode.dims).alias("_a"), _means(of("b"), encode.dims).alias("_b"), F.count(of("a")).alias("_na"), F.count(of("b")).alias("_nb"))
        both = means.filter((F.col("_na") > 0) & (F.col("_nb") > 0))
    else:
        side = lambda s: mean_vector(chunks.filter(F.col("_side") == s), key, "_v").withColumnRenamed("mean", f"_{s}")
        both = side("a").join(side("b"), key)
    return both.select(key, cosine(F.col("_a"), F.col("_b")).alias("sim"))


def hashed_encoder(dims: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in encoder: counts of lower-case words by the first byte of their md5, without any model."""
    def encode(c: Column) -> Column:
        # each word is hashed once, to a character; a place's count is how many characters its own takes away
        marks = F.array_join(F.transform(T.tokens(F.lower(c)), lambda w: F.chr(F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int") % dims)), "")
        count = lambda m, d: F.length(m) - F.length(F.replace(m, F.lit(chr(d)), F.lit(""))) if d < 256 else F.length(m) * 0
        return bound(marks, lambda m: F.array(*[count(m, d).cast("double") for d in range(dims)]))

    encode.dims = dims
    return encode
