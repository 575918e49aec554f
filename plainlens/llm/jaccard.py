"""N-gram Jaccard self-join: MinHash bands find candidates, full sets of word n-grams decide.

Texts with equal words are one class and are compared once. Classes that share a band hash are joined to the least class
of that bucket (a star, not all pairs); the connected stars are the candidate components. Each component is compared
exactly: its sets are dealt to blocks of bounded weight, each pair of blocks is one group, and in a group a prefix filter
on the rarest n-grams splits the sets before their overlaps are counted by matrix products. Links are counted where they
are found, never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytesops as B
from .common import batch, id_key, partitions, prepare, tidy, unused
from .graph import components, joined_per_key

N_WORDS = 5
THRESHOLD = 0.8
#: A pair at the threshold shares a band with this probability at least.
RECALL = 0.9999
#: Most hash functions to spend on it.
HASHES = 128
#: N-grams of one block of a component.
BLOCK_GRAMS = 1 << 20
#: Documents of one block, and rows of a block pair's overlap matrix that are held at once.
BLOCK_DOCS, STRIPE = 2048, 512
_SIG = "k long, x long, node binary, grams long, bands array<long>"
_SIG_ARROW = pa.schema([("k", pa.int64()), ("x", pa.int64()), ("node", pa.binary()), ("grams", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SET_ARROW = pa.schema([("node", pa.binary()), ("copies", pa.int64()), ("comp", pa.binary()), ("blocks", pa.int32()), ("grams", pa.binary())])
_LINK_ARROW = pa.schema([("node", pa.binary()), ("hub", pa.binary()), ("links", pa.int64()), ("blocks", pa.int32())])


def bands_for(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """Bands and rows: most rows (fewest false candidates) whose bands reach the recall within this many hashes."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band and row counts reach this recall")
    return best


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word names and their texts, then n-gram names and their texts; a text of fewer words is one shorter n-gram."""
    start, end, text = B.words(data, offsets)
    name = B.Fingerprints(data, 0).range(start, end)
    count = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    padded = np.concatenate([name, np.zeros(n, np.uint64)])
    at = np.arange(len(name))
    left = (first + count)[text] - at if len(name) else at
    keep = np.flatnonzero((left >= n) | (at == first[text])) if len(name) else at
    out = np.zeros(len(keep), np.uint64)
    for j in range(n):
        out = np.where(j < left[keep], B.mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[keep + j] + np.uint64(j + 1)), out)
    return name, text, out, text[keep]


def _signatures(n: int, bands: int, rows: int):
    g = np.random.default_rng(B.SEED)
    flip = g.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    times = g.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, x = b.column("k").to_numpy(), b.column("x").to_numpy()
            for lo, hi, data, offsets in B.text_chunks(b.column("text")):
                name, text, gram, owner = grams(data, offsets, n)
                m = hi - lo
                bound = np.searchsorted(text, np.arange(m + 1))
                node = [hashlib.blake2b(name[bound[i] : bound[i + 1]].tobytes(), digest_size=16).digest() for i in range(m)]
                count = np.bincount(owner, minlength=m)
                has = np.flatnonzero(count)
                hashed = np.zeros((m, bands), np.uint64)
                if len(has):
                    first = np.concatenate([[0], np.cumsum(count[has])[:-1]])
                    low = (gram >> np.uint64(32)).astype(np.uint32)
                    for band in range(bands):
                        h = np.full(len(has), band + 1, np.uint64)
                        for j in range(band * rows, band * rows + rows):
                            h = B.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((low ^ flip[j]) * times[j], first))
                        hashed[has, band] = h
                flat = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * bands), pa.array(hashed.view(np.int64).ravel()))
                yield batch([k[lo:hi], x[lo:hi], node, count, flat], _SIG_ARROW)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in B.text_chunks(b.column("text")):
                name, text, gram, owner = grams(data, offsets, n)
                bound, cut = np.searchsorted(text, np.arange(hi - lo + 1)), np.searchsorted(owner, np.arange(hi - lo + 1))
                rest = {c: b.column(c).slice(lo, hi - lo).to_pylist() for c in ("node", "copies", "comp", "blocks")}
                keep, sets = [], []
                for i in range(hi - lo):
                    if hashlib.blake2b(name[bound[i] : bound[i + 1]].tobytes(), digest_size=16).digest() == rest["node"][i]:
                        keep.append(i)
                        sets.append(np.unique(gram[cut[i] : cut[i + 1]]).tobytes())
                yield batch([[rest[c][i] for i in keep] for c in ("node", "copies", "comp", "blocks")] + [sets], _SET_ARROW)

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of 0..n-1's components under links a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def linked(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per set the copies it links to, and the least set it is connected to; if cross, only links between the two sides."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    links, root = np.zeros(n, np.int64), np.arange(n)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, gram, df = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((gram, df[gram], owner))
    place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    prefix = place < np.repeat(size - np.ceil(threshold * size - 1e-9).astype(int) + 1, size)
    g, o = gram[order][prefix], owner[order][prefix]
    lead = np.full(len(df), n)
    np.minimum.at(lead, g, o)
    part = _roots(n, o, lead[g])
    shared = df[gram] > 1
    flat_g, flat_o = gram[shared], owner[shared]
    by = np.argsort(part, kind="stable")
    for members in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
        if len(members) < 2 or cross and len(set(side[members].tolist())) < 2:
            continue
        local = np.full(n, -1)
        local[members] = np.arange(len(members))
        mine = local[flat_o] >= 0 if len(members) < n else slice(None)
        r, (_, c) = local[flat_o[mine]], np.unique(flat_g[mine], return_inverse=True)
        by_c = np.argsort(c, kind="stable")
        r, c = r[by_c], c[by_c]
        n_c, step = int(c[-1]) + 1 if len(c) else 0, max(256, (1 << 22) // len(members))
        own, their, sides = size[members], copies[members], side[members]
        every = np.arange(len(members))
        joined = every
        for top in range(0, len(members), STRIPE):
            rows = slice(top, min(top + STRIPE, len(members)))
            both = np.zeros((rows.stop - top, len(members)), np.float32)
            for at in range(0, n_c, step):
                lo, hi = np.searchsorted(c, [at, at + step])
                m = np.zeros((len(members), min(step, n_c - at)), np.float32)
                m[r[lo:hi], c[lo:hi] - at] = 1
                both += m[rows] @ m.T
            hit = both >= threshold * (own[rows, None] + own[None, :] - both) - 1e-6
            hit[np.arange(rows.stop - top), np.arange(top, rows.stop)] = False
            if cross:
                hit &= sides[rows, None] != sides[None, :]
            links[members[rows]] = hit @ their
            i, j = np.nonzero(hit)
            joined = _roots(len(members), np.concatenate([every, i + top]), np.concatenate([joined, j]))
        root[members] = members[joined]
    return links, root


def _compare(threshold: float):
    def group(rows: list[tuple]) -> pa.RecordBatch:
        node = [r[0] for r in rows]
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        p, q = rows[0][4], rows[0][5]
        links, root = linked(sets, np.array([r[1] for r in rows]), np.array([r[6] for r in rows]), p != q, threshold)
        return batch([node, [node[i] for i in root], links, [r[7] for r in rows]], _LINK_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("node", "copies", "grams", "comp", "p", "q", "side", "blocks")), strict=True):
                if row[3:6] != key and held:
                    yield group(held)
                    held = []
                key = row[3:6]
                if not held or held[-1][0] != row[0]:  # rows equal in id and text
                    held.append(row)
        if held:
            yield group(held)

    return run


def _verdicts(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Per document its id key and text hash (k, x), the least of these in its class and among its copies, and its links."""
    spark = prepare(docs.sparkSession)
    bands, rows = bands_for(threshold, recall, hashes)
    lean = docs.select(id_key("doc_id").alias("k"), F.xxhash64(F.col("text").cast("string")).alias("x"), F.col("text").cast("string").alias("text"))
    sig = lean.mapInArrow(tidy(_signatures(n, bands, rows)), _SIG).checkpoint()
    full = sig.filter("grams > 0")
    classes = full.groupBy("node").agg(F.min(F.struct("k", "x")).alias("rep"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")).checkpoint()
    keyed = classes.select("node", F.explode("bands").alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top").select("band", "hub")
    stars = keyed.join(hubs, "band").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    comp = components(stars)
    sized = comp.join(classes.select("node", "rep", "copies", "grams"), "node")
    blocks = sized.groupBy("root").agg(F.greatest(F.ceil(F.sum("grams") / F.lit(block_grams)), F.ceil(F.count("*") / F.lit(BLOCK_DOCS))).cast("int").alias("blocks"), F.count("*").alias("n"))
    cand = joined_per_key(sized, blocks, "root", comp.count()).select("node", F.col("rep.k").alias("k"), "copies", F.col("root").alias("comp"), "blocks")
    sets = lean.join(cand, "k").select("node", "copies", "comp", "blocks", "text").mapInArrow(tidy(_sets(n)), "node binary, copies long, comp binary, blocks int, grams binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.select("*", own.alias("side"), other.alias("other")).select("*", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q")).drop("other")
    dealt = dealt.repartition(partitions(spark, docs), "comp", "p", "q").sortWithinPartitions("comp", "p", "q", "node")
    found = dealt.mapInArrow(tidy(_compare(threshold)), "node binary, hub binary, links long, blocks int").checkpoint()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    single = found.filter("blocks = 1").select("node", F.col("hub").alias("root"))
    many = components(found.filter("blocks > 1").select(F.col("node").alias("u"), F.col("hub").alias("v")))
    rooted = classes.select("node", "rep", "copies").join(single.unionByName(many), "node", "left").join(links, "node", "left")
    rooted = rooted.select("node", "rep", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("class"), F.count("*").alias("n"))
    verdict = joined_per_key(rooted, least, "root", classes.count()).select("node", "rep", "class", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    grouped = joined_per_key(full.select("k", "x", "node"), verdict.withColumn("n", F.col("copies")), "node", sig.count()).select("k", "x", "class", "rep", "n_links")
    own = F.struct("k", "x")
    alone = sig.filter("grams = 0").select("k", "x", own.alias("class"), own.alias("rep"), F.lit(0).cast("long").alias("n_links"))
    return grouped.unionByName(alone)


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copy_id.

    Words are runs of other bytes than the six ASCII white-space bytes. Two documents are linked if the Jaccard
    similarity of their sets of word n-grams is `threshold` or more; a text of 1 to n - 1 words is one shorter n-gram.
    n_links counts the other documents (rows) linked to this one, copies included; class_id is the least doc_id among
    all documents connected with it by links, copy_id the least among those with equal words. A text that is null or has
    no word has no n-grams: no links, its own class. A null doc_id counts as one id before all others and gives null.
    Rows that share a doc_id are documents of their own. An empty table gives an empty result; other columns are ignored.
    Components that do not settle in 60 rounds (the rounds grow with the logarithm of a component's length) are an error.
    """
    back = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return _verdicts(docs, **options).select(back("k").alias("doc_id"), back("class.k").alias("class_id"), "n_links", back("rep.k").alias("copy_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one of least doc_id (then text hash), all columns; of rows equal in both, one.

    Documents without a word are classes of their own and stay, but of rows equal in doc_id and text one. Errors as in
    similar_documents.
    """
    k, x = own = unused(docs, 2)
    least = _verdicts(docs, **options).filter(F.struct("k", "x") == F.col("class")).select(F.col("k").alias(k), F.col("x").alias(x))
    keyed = docs.withColumns({k: id_key("doc_id"), x: F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(least, own, "left_semi").dropDuplicates(own).select(*[F.col(f"`{c}`") for c in docs.columns])
