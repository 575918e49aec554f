"""Runs of repeated words: stretches of a text that say the same words over and over, found by lags on bit planes.

The words of many texts get numbers; bit b of all numbers, one bit for each word, is a plane, held in one big integer. For a
lag q each plane is XORed with itself shifted by q: a set bit of the OR of them all is a word that differs from the word q
places on. What is left are stretches of zeros; a doubling chain of shifts and ANDs of the complement leaves a bit for each
start of a stretch that is long enough. A text is read whole, by one task, and nothing is shuffled.

Only lags that a run could have are looked at: a run of length 4 * q holds four words in a row at multiples of q, which must
be equal. That test costs n / q, so all lags of a text cost n * log n, and no lag with a run fails it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import bytesops as B
from .common import prepare, tidy

#: A run has at least this many words, and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Planes that are looked at before a lag without long stretches is given up.
FIRST_PLANES = 4
#: Lags up to this one skip the test at multiples, which costs as much as the planes there.
SHORT_LAGS = 8


def planes_of(ids: np.ndarray) -> list[int]:
    """Bit planes of word numbers as big integers: bit i of plane b is bit b of ids[i]."""
    out, width = [], int(ids.max()).bit_length() if len(ids) else 0
    for b in range(width):
        bits = np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little")
        out.append(int.from_bytes(bits.tobytes(), "little"))
    return out


def _and_run(z: int, length: int) -> int:
    """Bit i is set where `length` set bits of z start at i."""
    have = 1
    while have * 2 <= length and z:
        z &= z >> have
        have *= 2
    return z & (z >> (length - have)) if z and length > have else z


def _bits(x: int, n: int) -> np.ndarray:
    """Places of the set bits of x, which has at most n bits."""
    raw = np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8)
    at = np.flatnonzero(raw)  # few bytes of many have a bit
    return (at[:, None] * 8 + np.arange(8))[np.unpackbits(raw[at, None], axis=1, bitorder="little").astype(bool)]


def zero_stretches(planes: list[int], n: int, lag: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches [start, end) of at least `length` places i < n - lag with word i equal to word i + lag."""
    everywhere = (1 << (n - lag)) - 1
    differs = 0
    for k, plane in enumerate(planes):
        differs |= plane ^ (plane >> lag)
        if k + 1 == FIRST_PLANES and not _and_run(everywhere & ~differs, length):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    long = _and_run(everywhere & ~differs, length)
    if not long:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _bits(long & ~(long << 1), n), _bits(long & ~(long >> 1), n) + length


def _may_repeat(ids: np.ndarray, lag: int, reach: np.ndarray | None) -> bool:
    """Whether four words at multiples of a lag are equal, the words between the first three too, outside of runs known.

    A stretch of more than 3 * lag words inside one run of a smaller period can only be that run.
    """
    here = ids[::lag]
    same = here[1:] == here[:-1]
    at = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * lag if len(same) > 2 else np.zeros(0, np.int64)
    for more in {lag // 4, lag // 2, 3 * lag // 4}:
        if not len(at):
            return False
        at = at[(ids[at + more] == ids[at + more + lag]) & (ids[at + more] == ids[at + more + 2 * lag])]
    return bool(len(at)) if reach is None else bool((reach[at] <= at + 3 * lag).any())


def runs_of(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs, from word numbers of texts one after another.

    `lengths` are the numbers of words of the texts, falling; each text is followed by one place with a number of its own.
    A text with fewer than four lags of words has no run of that lag, so a lag looks only at the longer texts before it.
    """
    ends = np.cumsum(lengths + 1)
    planes, n = planes_of(ids), len(ids)
    found, seen, reach, lag = [], set(), None, 1
    longest = int(lengths[0]) if len(lengths) else 0
    while max(LEAST_WORDS, LEAST_PERIODS * lag) <= longest:
        need = max(LEAST_WORDS, LEAST_PERIODS * lag)
        texts = int(np.searchsorted(-lengths, -need, side="right"))
        upto = int(ends[texts - 1])
        if upto < n // 2:  # shorter texts are done with
            planes, n = [p & ((1 << upto) - 1) for p in planes], upto
        if lag <= SHORT_LAGS or _may_repeat(ids[:upto], lag, None if reach is None else reach):
            start, end = zero_stretches(planes, n, lag, need - lag)
            new = [(s, e) for s, e in zip(start.tolist(), (end + lag).tolist(), strict=True) if (s, e) not in seen]
            if new:  # the same stretch of a smaller period is that period's run
                seen.update(new)
                found += [(s, e - s, lag) for s, e in new]
                reach = np.zeros(len(ids), np.int64) if reach is None else reach
                s, e = np.array(new).T
                np.maximum.at(reach, s, e)
                reach = np.maximum.accumulate(reach)
        lag += 1
    rows = np.array(sorted(found), np.int64).reshape(-1, 3)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers of all texts, the words they stand for, and the number of words of each text."""
    starts, ends, rows = B.words(data, offsets)
    flat = pa.py_buffer(B.without_space(data))
    places = pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64))
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, places, flat]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.bincount(rows, minlength=len(offsets) - 1).astype(np.int64)


#: From a row and its number of words to the places whose words it is to have, or None.
Repeat = Callable[[int, int], np.ndarray | None]


def texts_runs(column: pa.Array, repeat: Repeat | None = None) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each text in order: row, its word numbers, the words they stand for, which words stay, and its runs.

    `repeat` may give other places of the words of a row (row, number of words); null keeps them.
    """
    for lo, hi, data, offsets in B.text_chunks(column):
        ids, words, lengths = _numbers(data, offsets)
        first = np.concatenate([[0], np.cumsum(lengths)])
        if repeat is not None:
            for t in range(lo, hi):
                at = repeat(t, int(lengths[t - lo]))
                if at is not None:
                    ids[first[t - lo] : first[t - lo + 1]] = ids[first[t - lo] + at]
        order = np.argsort(-lengths, kind="stable")
        places = np.concatenate([[0], np.cumsum(lengths[order] + 1)])
        joined = np.zeros(int(places[-1]), np.int64)
        joined[places[1:] - 1] = len(words) + np.arange(len(order))
        take = np.concatenate([np.arange(first[t], first[t + 1]) for t in order]) if len(ids) else np.zeros(0, np.int64)
        inside = np.ones(len(joined), bool)
        inside[places[1:] - 1] = False
        joined[inside] = ids[take]
        start, length, period = runs_of(joined, lengths[order])
        step = np.zeros(len(joined) + 1, np.int64)
        np.add.at(step, start + period, 1)
        np.add.at(step, start + length, -1)
        stays = np.cumsum(step)[:-1] == 0
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        cuts = np.searchsorted(start, places)
        for t in range(lo, hi):
            r = rank[t - lo]
            own, a = slice(cuts[r], cuts[r + 1]), places[r]
            yield t, joined[a : places[r + 1] - 1], words, stays[a : places[r + 1] - 1], (start[own] - a, length[own], period[own])


def _spaced(words: pa.Array, ids: np.ndarray) -> bytes:
    """Words joined by one space."""
    return b" ".join(words.take(pa.array(ids)).to_pylist())


def best_run(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int | None:
    """The run of greatest length / period, compared as fractions; then of smallest start, then period."""
    best = None
    for i in range(len(start)):
        if best is None or int(length[i]) * int(period[best]) > int(length[best]) * int(period[i]):
            best = i
    return best


def looped(key: int | None, n: int) -> np.ndarray | None:
    """Places of a text whose tail is made to repeat, as the report asks: of a tenth of the texts, by the CRC-32 of the decimal id."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = b.column("k").to_pylist()
        out = []
        for t, ids, words, stays, (start, length, period) in texts_runs(b.column("text"), lambda t, n: looped(keys[t], n)):
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
            i = best_run(start, length, period)
            best = (None,) * 4 if i is None else (int(start[i]), int(length[i]), int(period[i]), 1000 * int(length[i]) // int(period[i]))
            out.append((keys[t], len(start), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_spaced(words, ids[stays])).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], type=f.type) for j, f in enumerate(_REPORT)], schema=_REPORT)


def run_report(docs: DataFrame) -> DataFrame:
    """Per document its periodic runs: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    A run is a stretch of words of smallest period q, at least 6 words and 4 periods long, that neither neighbour extends.
    The four fields are those of the run of most periods; of ties the first, then the one of smallest period; null without
    runs. Before that the tail of a tenth of the texts is made to repeat, see looped; a text without doc_id stays as it is.
    A null or blank text has no words and no runs. Rows that repeat get equal results; an empty table gives no rows; other
    columns are ignored. A text is never cut; its task needs some 100 bytes for each of its words.
    """
    prepare(docs.sparkSession)
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS k", "CAST(text AS STRING) AS text")
    return rows.mapInArrow(tidy(_report), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapse(column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, runs, text = [], [], b.column(column)
            for t, ids, words, stays, (start, length, period) in texts_runs(text):
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)])
                texts.append(text[t].as_py() if stays.all() else _spaced(words, ids[stays]).decode())
            arrays = [pa.array(texts, type=b.schema.field(i).type) if i == column else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(runs, type=_RUNS)], names=[*b.schema.names, RUNS])

    return run


#: The column that without_loops adds.
RUNS = "periodic_runs"


def without_loops(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, and periodic_runs, an array of (start, length, period) in words; of each run only the first period's words
    stay in the text. A text without runs stays as it is, one with runs has its words joined by single spaces. Null stays null,
    with no runs. A table that has a column periodic_runs is an error.
    """
    prepare(docs.sparkSession)
    if RUNS in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {RUNS}")
    run = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    schema = StructType([*docs.schema.fields, StructField(RUNS, ArrayType(run))])
    return docs.mapInArrow(tidy(_collapse(docs.columns.index(text))), schema)
