"""Toxicity categories by a chain of linear classifiers.

The chain predicts one category after another from the words of a text, and each model also sees the probabilities of the
categories before it. While it is fitted those are out-of-fold: they come from models that did not see the document, as
they will not have seen the documents that are scored. The first categories are weakly labelled (a labelled toxic document
with a word of the category's list); the last is the label itself. Models are logistic, over hashed words and beginnings of words
(present or not, and shared by two words of the text or not).
They are fitted on the driver on a bounded sample; every document is scored in Arrow batches with broadcast weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import id_key, prepare

#: Labelled documents in the sample: those with the least hashes of doc_id.
SAMPLE = 8_000
DIMS, FOLDS = 1 << 18, 5
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (5, 6, 7)
#: Words that a worker remembers.
CACHE = 300_000
#: Words seen in fewer sampled documents have no weight.
LEAST_DOCUMENTS = 3
#: Words whose chi-square statistic against a category is less have no weight in its model.
LEAST_CHI_SQUARE = 25.0
#: Words need so many positive documents, near copies counted once; else the copies of one document make its words evidence.
LEAST_SUPPORT = 6
#: No document of a lower probability is in a category.
LEAST_PROBABILITY = 0.3
#: Seed words of the categories, in the order of the chain.
CATEGORIES = {
    "insult": ("bastard", "clown", "coward", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "stupid"),
    "contempt": ("disgusting", "filth", "filthy", "garbage", "pathetic", "scum", "trash", "vermin", "worthless"),
    "obscenity": ("asshole", "bitch", "crap", "damn", "fuck", "fucking", "shit"),
    "threat": ("kill", "murder", "strangle"),
}
CHAIN = (*CATEGORIES, "toxic")
_WORD = re.compile(r"\w+")


def buckets(word: str) -> list[int]:
    """The hashed features of a word: the word, and its beginnings, which inflected forms share."""
    return [xxhash.xxh32_intdigest(word) % DIMS] + [xxhash.xxh32_intdigest(f"^{word[:n]}") % DIMS for n in BEGINNINGS if len(word) > n]


def twice(bucket: int) -> int:
    """The feature that two or more different words of a text share a feature: inflected forms of one word."""
    return (bucket * 0x9E3779B1 + 0x7F4A7C15) % 0xFFFFFFFB % DIMS


class Features:
    """Hashed distinct features of texts, optionally only some of them, with a bounded cache of words."""

    def __init__(self, used: set[int] | None = None):
        self.used, self.known = used, {}

    def __call__(self, text: str) -> list[int]:
        words = set(_WORD.findall(text.lower()))
        if len(self.known) > CACHE:
            self.known = {}
        known, used = self.known, self.used
        for w in words.difference(known):
            known[w] = tuple(b for b in buckets(w) if used is None or b in used or twice(b) in used)
        once, more = set(), set()
        for w in words:
            for b in known[w]:
                (more if b in once else once).add(b)
        found = once | {twice(b) for b in more}
        return sorted(found if used is None else found & used)


def copy_keys(lists: list[np.ndarray], times: int = 3) -> np.ndarray:
    """MinHash values of each row's words, rows x times; near copies mostly have equal ones."""
    g = np.random.default_rng(11)
    out = np.zeros((len(lists), times), np.int64)
    for j in range(times if lists else 0):
        order = g.permutation(DIMS)
        out[:, j] = [order[np.asarray(a, np.int64)].min() if len(a) else -1 for a in lists]
    return out


def support(x: Rows, y: np.ndarray, copies: np.ndarray, dims: int) -> np.ndarray:
    """Positive rows of each column, near copies counted once: the least number of different keys."""
    inside = y[x.row] > 0
    column, row = x.column[inside], x.row[inside]
    column = column.astype(np.int64)
    counts = [np.bincount(np.unique(column * (DIMS + 1) + copies[row, j] + 1) // (DIMS + 1), minlength=dims) for j in range(copies.shape[1])]
    return np.min(counts, axis=0) if len(column) else np.zeros(dims, np.int64)


class Rows:
    """Sparse rows of ones, and dense columns beside them."""

    def __init__(self, lists: list[np.ndarray]):
        self.size = np.array([len(x) for x in lists], np.int64)
        self.column = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(lists), dtype=np.int32), self.size)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], minlength=len(self.size))

    def back(self, r: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.column, r[self.row], minlength=dims)

    def columns(self, keep: np.ndarray, dims: int) -> Rows:
        out, at = Rows([]), np.full(dims, -1, np.int32)
        at[keep] = np.arange(len(keep))
        inside = at[self.column] >= 0
        out.column, out.row = at[self.column[inside]], self.row[inside]
        out.size = np.bincount(out.row, minlength=len(self.size))
        return out

    def take(self, keep: np.ndarray) -> Rows:
        out, at = Rows([]), np.full(len(self.size), -1)
        at[keep] = np.arange(len(keep))
        at = at.astype(np.int32)
        inside = at[self.row] >= 0
        out.size, out.column, out.row = self.size[keep], self.column[inside], at[self.row[inside]]
        return out


def fit_logistic(x: Rows, dense: np.ndarray, y: np.ndarray, copies: np.ndarray, dims: int, rounds: int = 40, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of words, of dense columns, and a constant, by Newton steps; their systems are solved by conjugate gradients,
    so no matrix of weights is built.

    Only words that go with the category (chi-square and support, on these rows alone) get a weight. Without a positive row
    there are no weights, and the constant says almost never.
    """
    n = max(1, len(y))
    w = np.zeros(dims)
    if not y.any():
        return w, np.zeros(dense.shape[1]), -12.0
    with_word, positive = x.back(np.ones(n), dims), x.back(y, dims)
    gap = positive - with_word * y.mean()
    chi = gap**2 / np.maximum(with_word * (1 - with_word / n) * y.mean() * (1 - y.mean()), 1e-9)
    free = np.flatnonzero((chi >= LEAST_CHI_SQUARE) & (support(x, y, copies, dims) >= LEAST_SUPPORT))
    x, f = x.columns(free, dims), len(free)
    rate = (y.sum() + 0.5) / (n + 1)
    b = np.append(np.zeros(f + dense.shape[1]), np.log(rate / (1 - rate)))
    keep = np.append(np.full(len(b) - 1, decay), 0.0)
    score = lambda v: x.times(v[:f]) + dense @ v[f:-1] + v[-1]
    back = lambda r: np.concatenate([x.back(r, f), dense.T @ r, [r.sum()]])
    loss = lambda z, v: float((np.logaddexp(0, z) - y * z).mean() + (keep * v * v).sum() / 2)
    z = score(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g = back((p - y) / n) + keep * b
        if np.abs(g).max() < 1e-8:
            break
        curve, step, rest = p * (1 - p) / n + 1e-12, np.zeros_like(b), -g
        way, size = rest.copy(), float(rest @ rest)
        for _ in range(60):
            bent = back(curve * score(way)) + keep * way
            part = size / max(float(way @ bent), 1e-300)
            step, rest = step + part * way, rest - part * bent
            new = float(rest @ rest)
            if new <= 1e-4 * float(g @ g):
                break
            way, size = rest + new / size * way, new
        length, now = 1.0, loss(z, b)
        while length > 1e-6 and loss(score(b + length * step), b + length * step) > now + 1e-4 * length * float(g @ step):
            length /= 2
        b = b + length * step
        z = score(b)
    w[free] = b[:f]
    return w, b[f:-1], float(b[-1])


class Chain:
    """Per category: word weights (by hashed word), weights of earlier probabilities, a constant and a threshold."""

    def __init__(self):
        self.words, self.links, self.constant, self.threshold = [], [], [], []

    def used(self) -> set[int]:
        """Features that any of the models gives a weight."""
        return {int(i) for w in self.words for i in np.flatnonzero(w)}

    def score(self, lists: list[list[int]]) -> np.ndarray:
        """Probabilities, rows x categories."""
        x = Rows([np.array(a, np.int64) for a in lists])
        out = np.zeros((len(lists), len(self.words)))
        for j, (w, link, c) in enumerate(zip(self.words, self.links, self.constant, strict=True)):
            out[:, j] = 1 / (1 + np.exp(-(x.times(w) + out[:, :j] @ link + c)))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray, beta: float = 1.0) -> float:
    """The cutoff of the best F-score, from out-of-fold probabilities; at least LEAST_PROBABILITY."""
    order = np.argsort(-p)
    hit = np.cumsum(y[order])
    if not len(p) or not hit[-1]:
        return 0.5
    precision, recall = hit / np.arange(1, len(p) + 1), hit / hit[-1]
    f = (1 + beta**2) * precision * recall / np.maximum(beta**2 * precision + recall, 1e-12)
    i = int(f.argmax())
    return float(max(LEAST_PROBABILITY, (p[order][i] + (p[order][i + 1] if i + 1 < len(p) else 0)) / 2))


def fit_chain(lists: list[list[int]], categories: np.ndarray, fold: np.ndarray) -> Chain:
    """categories: rows x CHAIN of 0 and 1; fold: a number per row. Near copies must be in one fold.

    A category with fewer than LEAST_SUPPORT different positive documents cannot be learned: it is no link of the chain (its
    probability is a constant near 0, and no later model sees it).
    """
    seen = np.bincount(np.concatenate([np.array(a, np.int64) for a in lists] or [np.zeros(0, np.int64)]), minlength=DIMS)
    used = np.flatnonzero(seen >= LEAST_DOCUMENTS)
    local = np.full(DIMS, -1)
    local[used] = np.arange(len(used))
    x = Rows([(c := local[np.array(a, np.int64)])[c >= 0] for a in lists])
    copies = copy_keys(lists)
    chain, earlier = Chain(), np.zeros((len(lists), 0))
    for j in range(categories.shape[1]):
        y, held = categories[:, j].astype(float), np.zeros(len(lists))
        if len(np.unique(copies[y > 0, 0])) < LEAST_SUPPORT:
            chain.words.append(np.zeros(DIMS))
            chain.links.append(np.zeros(j))
            chain.constant.append(-12.0)
            chain.threshold.append(0.5)
            earlier = np.column_stack([earlier, held])
            continue
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w, link, c = fit_logistic(x.take(train), earlier[train], y[train], copies[train], len(used))
            held[test] = 1 / (1 + np.exp(-(x.take(test).times(w) + earlier[test] @ link + c)))
        w, link, c = fit_logistic(x, earlier, y, copies, len(used))
        whole = np.zeros(DIMS)
        whole[used] = w
        chain.words.append(whole)
        chain.links.append(link)
        chain.constant.append(c)
        chain.threshold.append(best_threshold(held, y))
        earlier = np.column_stack([earlier, held])
    return chain


def folds(lists: list[np.ndarray]) -> np.ndarray:
    """A fold for each row by two MinHash values, so that near copies are mostly in one fold."""
    _, at = np.unique(copy_keys(lists, 2), axis=0, return_inverse=True)
    return at.ravel() % FOLDS if lists else np.zeros(0, np.int64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, features = b.column("text").fill_null("").to_pylist(), Features()
        words = [set(_WORD.findall(t.lower())) for t in text]
        hits = [[int(bool(w & set(seeds))) for seeds in CATEGORIES.values()] for w in words]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("toxic"), pa.array([np.array(features(t), "<i4").tobytes() for t in text], pa.binary()), pa.array(hits, pa.list_(pa.int32()))], names=["h", "toxic", "features", "hits"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """A chain from at most `sample` labelled documents, or None if none is labelled."""
    lean = docs.select(id_key("doc_id").alias("k"), F.col("text").cast("string").alias("text"))
    chosen = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(id_key("doc_id").alias("k")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(sample)
    rows = lean.join(F.broadcast(chosen), "k").select("h", "toxic", "text").mapInArrow(_sampled, "h long, toxic int, features binary, hits array<int>").orderBy("h").limit(sample).collect()
    if not rows:
        return None
    toxic = np.array([[r.toxic] for r in rows])
    categories = np.hstack([np.array([r.hits for r in rows]) * toxic, toxic])
    lists = [np.frombuffer(r.features, "<i4") for r in rows]
    return fit_chain(lists, categories, folds(lists))


def _score(chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(chain.value.used()) if chain is not None else None
        for b in batches:
            text = b.column("text").fill_null("").to_pylist()
            if chain is None:
                p, over = np.zeros((len(text), len(CHAIN))), np.zeros((len(text), len(CHAIN)), bool)
            else:
                p = chain.value.score([features(t) for t in text])
                over = p >= np.array(chain.value.threshold)
            names = [c for j in CHAIN for c in (f"p_{j}", f"is_{j}")]
            columns = [x for j in range(len(CHAIN)) for x in (pa.array(p[:, j]), pa.array(over[:, j]))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", *names])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, and for each category of CHAIN its probability p_<category> and verdict is_<category>.

    A null text has no words and scores the constants. Of several labels of a doc_id the largest counts; null labels and
    null doc_ids in them count for nothing; without any label all probabilities are 0. Rows with equal doc_id are scored
    each by its own text. An empty table gives an empty result; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    chain = fit(docs, labels, sample)
    shared = spark.sparkContext.broadcast(chain) if chain else None
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(_score(shared), "doc_id long, " + ", ".join(f"p_{j} double, is_{j} boolean" for j in CHAIN))
