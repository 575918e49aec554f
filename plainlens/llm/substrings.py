"""Removal of repeated substrings by sparse, distributed prefix doubling.

A position's rank is a name of the bytes that follow it, the same in every task (a 64-bit fingerprint in place of a
running number, so that naming needs no sort of its own). Names are made and sorted at growing lengths, and a position
leaves once its name is unique:

1. Of the names at length HALF the least one of each window of THRESHOLD bytes is its anchor. Equal windows have equal
   anchors at equal places, so only anchors (about 4 % of all positions) are sorted: rank pairs (name of the anchor's
   HALF bytes, name of all bytes of the windows that share the anchor). An anchor whose first rank is unique leaves, and
   of those with equal pairs all but the first are repeats as a whole.
2. What is left has equal first but different second ranks. Their windows get names at length THRESHOLD and are sorted
   once more; all but the first of equal names are repeats.

No list of a group's members is ever built: both steps are sorts with the group's first row carried along, and equal
rows of one Arrow batch are merged before the shuffle, so a passage in a third of all documents sends a row per batch. A first
rank with many different second ranks (a common phrase in ever new surroundings) shows in every batch as such: its rows are
then known to be left for step 2 and are spread by their second ranks, and two marker rows tell the others of that rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bytesops as B
from .common import batch, id_key, partitions, prepare, shuffles_dropped, tidy

THRESHOLD = 100
#: Bits of a position inside a segment, in the low end of a name, so that the first of equal names is the anchor.
_AT = 28
#: Bytes of a text that are handled at once; a longer text is handled in segments, and memory is bounded by them.
SEGMENT = 8 << 20
#: Rows of a batch with one first rank and different second ranks from which on they are spread, and over how many keys.
HOT, SALTS = 8, 256
_DUP, _ASK, _MARKER = 1, 2, 3
_ROW = "a long, b long, k long, x long, l int, n int, state tinyint"
_ROW_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64()), ("x", pa.int64()), ("l", pa.int32()), ("n", pa.int32()), ("state", pa.int8())])


def _first_of_each(a, b, k, x, l, n) -> tuple:
    """Mark rows whose pair (a, b) an earlier row of another place has; join neighbouring marked rows of a text.

    Rows come in text order. Marked rows get a key of their own, so they spread evenly in the shuffle.
    """
    order = np.lexsort((l, x, k, b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    head = np.concatenate([[True], ~same])
    first = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
    lead = order[first]
    dup = np.zeros(len(a), bool)
    dup[order] = (k[lead] != k[order]) | (x[lead] != x[order]) | (l[lead] != l[order])
    text = (k[1:] == k[:-1]) & (x[1:] == x[:-1]) & (l[1:] == l[:-1] + n[:-1])
    start = np.flatnonzero(np.concatenate([[True], ~(dup[1:] & dup[:-1] & text)])) if len(a) else np.zeros(0, np.int64)
    if len(start):
        n = np.add.reduceat(n, start)
    a, b, k, x, l, dup = a[start], b[start], k[start], x[start], l[start], dup[start]
    a = np.where(dup, B.mix(k.view(np.uint64) ^ B.mix(x.view(np.uint64) ^ B.mix(l.astype(np.uint64)))).view(np.int64), a)
    return a, np.where(dup, 0, b), k, x, l, n, dup


def _emit(rows: tuple) -> pa.RecordBatch:
    a, b, k, x, l, n, dup = rows
    return batch([a, b, k, x, l.astype(np.int32), n.astype(np.int32), np.where(dup, _DUP, 0)], _ROW_ARROW)


def _spread(rows: tuple) -> pa.RecordBatch:
    """As _emit; rows of a first rank that is common here with different second ranks get keys by second rank."""
    a, b, k, x, l, n, dup = rows
    state = np.where(dup, _DUP, 0)
    own = np.flatnonzero(~dup)
    order = own[np.lexsort((b[own], a[own]))]
    start = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(order))
    hot = np.flatnonzero((end - start >= HOT) & (b[order[start]] != b[order[end - 1]])) if len(order) else start
    if len(hot):
        size = end[hot] - start[hot]
        at = order[np.repeat(start[hot] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        edge = np.concatenate([order[start[hot]], order[end[hot] - 1]])
        extra = (a[edge], b[edge], np.full(len(edge), np.iinfo(np.int64).max), x[edge], l[edge], n[edge])
        salt = B.mix((b[at].view(np.uint64) % np.uint64(SALTS)) + np.uint64(1))
        a, state = a.copy(), state.copy()
        a[at], state[at] = B.mix(a[at].view(np.uint64) ^ salt).view(np.int64), _ASK
        a, b, k, x, l, n = (np.concatenate(z) for z in zip((a, b, k, x, l, n), extra, strict=True))
        state = np.concatenate([state, np.full(len(edge), _MARKER)])
    return batch([a, b, k, x, l.astype(np.int32), n.astype(np.int32), state], _ROW_ARROW)


def _sorted_texts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Keys and texts in the order of keys, each (id, content) once, with the rows they came from."""
    k, x = b.column("k").to_numpy(), b.column("x").to_numpy()
    order = np.lexsort((x, k))
    if len(order):
        order = order[np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (x[order][1:] != x[order][:-1])])]
    return k[order], x[order], b.column("text").take(pa.array(order)), order


def anchor_runs(data: np.ndarray, offsets: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (text number, start in the text, windows, first rank, second rank)."""
    half = threshold // 2
    if len(data) < threshold:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    names = B.Fingerprints(data, 0).windows(half)
    at = np.arange(len(names), dtype=np.uint64)
    low = np.uint64((1 << _AT) - 1)
    anchor = (B.sliding_min((names & ~low) | at, threshold - half + 1) & low).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    fits = np.arange(len(anchor)) + threshold <= offsets[text + 1]
    cut = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    cut |= np.concatenate([[True], fits[1:] != fits[:-1]])
    start = np.flatnonzero(cut)
    count = np.diff(np.append(start, len(anchor)))
    keep = fits[start]
    start, count = start[keep], count[keep]
    second = B.Fingerprints(data, 1).range(start, start + count - 1 + threshold)
    return text[start], start - offsets[text[start]], count, names[anchor[start]].view(np.int64), second.view(np.int64)


def _segments(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, bytes, offsets) of parts of a chunk; parts of a long text overlap, so each window is in one of them."""
    if len(data) <= SEGMENT:
        yield 0, data, offsets
        return
    for at in range(0, len(data), SEGMENT):  # a chunk of this size is one text
        part = data[at : at + SEGMENT + width - 1]
        yield at, part, np.array([0, len(part)], offsets.dtype)


def _anchors(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, x, texts, _ = _sorted_texts(b)
            for lo, _, data, offsets in B.text_chunks(texts):
                for at, part, bounds in _segments(data, offsets, threshold):
                    t, l, n, first, second = anchor_runs(part, bounds, threshold)
                    yield _spread(_first_of_each(first, second, k[lo + t], x[lo + t], l + at, n))

    return run


def _marks(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets and fields of a list of marks."""
    flat = column.flatten()
    lengths = np.array(column.value_lengths().fill_null(0))
    return (np.concatenate([[0], np.cumsum(lengths)]), *(flat.field(f).to_numpy(zero_copy_only=False) for f in ("x", "l", "n", "kind")))


def _windows(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, x, texts, rows = _sorted_texts(b)
            offset, mx, ml, mn, kind = _marks(b.column("marks"))
            for lo, hi, data, offsets in B.text_chunks(texts):
                starts, owner = [], []
                for t in range(lo, hi):
                    m = slice(offset[rows[t]], offset[rows[t] + 1])
                    ask = (kind[m] == _ASK) & (mx[m] == x[t])
                    if ask.any():
                        l, n = ml[m][ask].astype(np.int64), mn[m][ask].astype(np.int64)
                        at = np.unique(np.repeat(l - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()))
                        starts.append(at + offsets[t - lo])
                        owner.append(np.full(len(at), t))
                if not starts:
                    continue
                starts, owner = np.concatenate(starts), np.concatenate(owner)
                for at, part, _ in _segments(data, offsets, threshold):
                    inside = slice(None) if len(data) <= SEGMENT else (starts >= at) & (starts < at + SEGMENT)
                    start, own = starts[inside], owner[inside]
                    name = [B.Fingerprints(part, w).range(start - at, start - at + threshold).view(np.int64) for w in (0, 1)]
                    yield _emit(_first_of_each(*name, k[own], x[own], start - offsets[own - lo], np.ones(len(start), np.int64)))

    return run


def _resolve(rows: DataFrame, docs: DataFrame, ask: bool) -> DataFrame:
    """Sort rank pairs; keep the rows that repeat an earlier place and, if asked, first rows of second ranks that differ."""
    place = F.struct("k", "x", "l")
    pair = Window.partitionBy("a", "b").orderBy("k", "x", "l")
    rows = rows.repartition(partitions(rows.sparkSession, docs), "a") if ask else rows
    rows = rows.withColumn("repeat", (F.col("state") == _DUP) | (F.first(place).over(pair) != place))
    kind = F.when(F.col("repeat"), _DUP)
    if ask:
        whole = Window.partitionBy("a")
        rows = rows.withColumns({"low": F.min("b").over(whole), "high": F.max("b").over(whole)})
        kind = kind.when((F.col("state") == _ASK) | (F.col("low") != F.col("high")), _ASK)
        rows = rows.filter(F.col("state") != _MARKER)
    return rows.select("k", "x", "l", "n", kind.cast("tinyint").alias("kind")).filter("kind IS NOT NULL")


def _by_text(marks: DataFrame) -> DataFrame:
    return marks.groupBy("k", "x").agg(F.collect_list(F.struct("x", "l", "n", "kind")).alias("marks"))


def repeated_marks(docs: DataFrame, threshold: int, carry: list[tuple[str, str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Keyed texts (k, x, the carried columns, text) and lists of repeated windows by k.

    The texts asked for windows carry the same columns as the ones cut later, so both joins read one shuffle of them.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(id_key("doc_id").alias("k"), F.xxhash64(text).alias("x"), *[c.alias(n) for n, _, c in carry], text.alias("text"))
    lean = keyed.select("k", "x", "text")
    with shuffles_dropped(spark):
        marks = _by_text(_resolve(lean.mapInArrow(tidy(_anchors(threshold)), _ROW), docs, True)).checkpoint()
    own = ["k", "x"]
    asked = keyed.join(marks.filter(F.exists("marks", lambda m: m["kind"] == _ASK)), own)
    late = _resolve(asked.mapInArrow(tidy(_windows(threshold)), _ROW), docs, False)
    early = marks.select("k", F.explode(F.filter("marks", lambda m: m["kind"] == _DUP)).alias("m")).select("k", "m.*")
    return keyed, _by_text(early.unionByName(late))


def removed_spans(offset: np.ndarray, mx, ml, mn, row: int, x: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte runs of one text."""
    m = slice(offset[row], offset[row + 1])
    own = mx[m] == x
    s = ml[m][own].astype(np.int64)
    if not len(s):
        return s, s
    e = s + mn[m][own] - 1 + threshold
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


def _cut(threshold: int, schema: pa.Schema, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offset, mx, ml, mn, _ = _marks(b.column("marks"))
            x, texts = b.column("x").to_numpy(), b.column("text").fill_null("").cast(pa.large_binary())
            found = [make(t.as_py(), *removed_spans(offset, mx, ml, mn, i, x[i], threshold)) for i, t in enumerate(texts)]
            made = [pa.array([f[j] for f in found], type=f_.type) for j, f_ in enumerate(schema)]
            keep = [c for c in b.schema.names if c not in ("text", "marks")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + made, names=keep + schema.names)

    return run


def _digest(raw: bytes, s: np.ndarray, e: np.ndarray) -> tuple:
    import hashlib

    h, at = hashlib.sha256(), 0
    for a, z in zip(s.tolist(), e.tolist(), strict=True):
        h.update(raw[at:a])
        at = z
    h.update(raw[at:])
    return len(raw), int((e - s).sum()), len(s), h.hexdigest()


def _whole_characters(raw: bytes, s: np.ndarray, e: np.ndarray) -> tuple:
    """The text without the characters all of whose bytes are removed."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    parts, at = [], 0
    for a, z in zip(s.tolist(), e.tolist(), strict=True):
        while inside(a):
            a += 1
        if inside(z):
            while raw[z] & 0xC0 == 0x80:
                z -= 1
        if a < z:
            parts.append(raw[at:a])
            at = z
    parts.append(raw[at:])
    return (b"".join(parts).decode("utf-8", "replace"),)


def _apply(docs: DataFrame, threshold: int, schema: str, arrow: pa.Schema, make, carry: list[tuple[str, str, Column]]) -> DataFrame:
    own, marks = repeated_marks(docs, threshold, carry)
    kept = ", ".join(f"`{n}` {t}" for n, t, _ in carry)
    return own.join(marks, ["k", "x"], "left").mapInArrow(tidy(_cut(threshold, arrow, make)), f"k long, x long, {kept}, {schema}").drop("k", "x")


def substring_report(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document what the removal of repeated substrings leaves: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `threshold` bytes that covers it also starts earlier: at a smaller doc_id, or earlier in
    the same document. Strings are judged on the input and never cross documents. A null text is empty; a null doc_id
    is one id before all others. Rows that share a doc_id are ordered by a hash of their text; rows with equal doc_id and
    text are one document and get equal results. Texts shorter than `threshold` lose nothing. An empty table gives an
    empty result. Other columns are ignored.
    """
    arrow = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    carry = [("doc_id", docs.schema["doc_id"].dataType.simpleString(), F.col("doc_id"))]
    return _apply(docs, threshold, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", arrow, _digest, carry)


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents, all columns, with repeated substrings cut out of `text` and `n_chars` (where there is one) renewed.

    Rules as in substring_report; a character goes only if all its bytes do. Null texts stay null.
    """
    others = [(f"c{i}", f.dataType.simpleString(), F.col(f"`{f.name}`")) for i, f in enumerate(docs.schema) if f.name != "text"]
    flag = [("had", "boolean", F.col("text").isNotNull())]
    cut = _apply(docs, threshold, "cut string", pa.schema([("cut", pa.string())]), _whole_characters, others + flag)
    back = {f"c{i}": f.name for i, f in enumerate(docs.schema) if f.name != "text"}
    text = F.when(F.col("had"), F.col("cut"))
    out = {v: F.col(k) for k, v in back.items()} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[out[c].alias(c) for c in docs.columns])
