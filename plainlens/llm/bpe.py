"""BPE encoding and decoding: speculate and verify.

Per Arrow batch the distinct words that are not known yet are handled together. Each is first cut greedily into the
longest vocabulary tokens. A token sequence is what the merges produce if and only if each adjacent pair is what the
merges produce from the two alone, so all pairs of the batch are tested at once against a sorted table of tested pairs
(new pairs are merged exactly, once). Words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import bytesops as B
from .common import prepare, tidy

#: Entries of a worker's caches (some 400 bytes each in all); they are emptied beyond it. Results do not depend on it.
CACHE = 700_000
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 1 << 20
#: Characters that say how long a token that begins with them can be.
REACH = 4
#: A vocabulary file beyond this is not sent to the executors.
VOCABULARY_BYTES = 64 << 20


#: Pieces of printable ASCII and Latin letters need no normaliser but lower case, and this form of the split pattern.
_LATIN = re.compile("[\\x21-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_LATIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from the JSON of the tokenizers library."""

    def __init__(self, raw: bytes, cache: int = CACHE):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = sorted(((t["content"], t["id"]) for t in spec["added_tokens"]), key=lambda t: -len(t[0]))
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merged.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        #: Tokens inside a word, and tokens that end one (without the mark of the end); longest inner token by its first REACH characters.
        self.inner = {t: i for t, i in self.vocab.items() if not (self.end and t.endswith(self.end))}
        self.last = {t[: len(t) - len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end) and t != self.end}
        self.longest: dict[str, int] = {}
        for token in self.inner:
            if len(token) > REACH:
                self.longest[token[:REACH]] = max(self.longest.get(token[:REACH], 0), len(token))
        self.shown = byte_characters()
        self.pieces = {}
        for token, i in self.vocab.items():
            ends = bool(self.end) and token.endswith(self.end) and token != self.end
            body = token[: -len(self.end)] if ends else token
            self.pieces[i] = [self.vocab.get(c) for c in body[:-1]] + [self.vocab.get(body[-1] + self.end if ends else body[-1])]
        library = Tokenizer.from_str(raw.decode())
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.words: dict[str, bytes] = {}
        self.cache = cache
        self.tested, self.valid = np.zeros(0, np.int64), np.zeros(0, bool)

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: always the pair of least rank, the leftmost of equals."""
        n, merged = len(ids), self.merged.get
        ids = list(ids)
        if n <= 48:  # a short list is scanned faster than a heap is kept
            none = (1 << 60, -1)
            pairs = [merged(p, none) for p in zip(ids, ids[1:], strict=False)]
            while pairs:
                best = min(pairs)
                if best is none or best[1] < 0:
                    break
                i = pairs.index(best)
                ids[i : i + 2] = [best[1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = merged((ids[i - 1], best[1]), none)
                if i < len(pairs):
                    pairs[i] = merged((best[1], ids[i + 1]), none)
            return ids
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merged.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = to, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if m := self.merged.get((to, ids[nxt[i]])):
                    heapq.heappush(heap, (m[0], i, to, ids[nxt[i]], m[1]))
            if (p := prv[i]) >= 0 and (m := self.merged.get((ids[p], to))):
                heapq.heappush(heap, (m[0], p, ids[p], to, m[1]))
        return [i for i in ids if i >= 0]

    def symbols(self, word: str) -> list[int]:
        """The ids a word starts from; a character that the vocabulary lacks is left out."""
        found = [self.vocab.get(c) for c in word[:-1]] + [self.vocab.get(word[-1] + self.end)]
        return [i for i in found if i is not None]

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None if no token fits somewhere."""
        out, at, n, inner, ends, longest = [], 0, len(word), self.inner.get, self.last.get, self.longest.get
        while (token := ends(word[at:])) is None:
            for to in range(min(n - 1, at + longest(word[at : at + REACH], REACH)), at, -1):
                if (token := inner(word[at:to])) is not None:
                    out.append(token)
                    at = to
                    break
            else:
                return None
        out.append(token)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode these words into the cache."""
        guess = {w: p for w in words if (p := self.propose(w)) is not None}
        flat = np.fromiter((i for p in guess.values() for i in p), np.int64)
        size = np.fromiter(map(len, guess.values()), np.int64, len(guess))
        last = np.cumsum(size) - 1
        pair = (flat[:-1] << 32) | flat[1:]
        inner = np.ones(len(flat), bool)
        inner[last] = False
        need = np.unique(pair[inner[:-1]])
        new = need[~np.isin(need, self.tested, assume_unique=True)]
        if len(new):
            good = np.array([self.merge(self.pieces[a] + self.pieces[b]) == [a, b] for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist(), strict=True)])
            if len(self.tested) > 10 * self.cache:
                self.tested, self.valid = np.zeros(0, np.int64), np.zeros(0, bool)
                need, new = need[:0], new
            tested, valid = np.concatenate([self.tested, new]), np.concatenate([self.valid, good])
            order = np.argsort(tested)
            self.tested, self.valid = tested[order], valid[order]
        at = np.searchsorted(self.tested, pair)
        at[at == len(self.tested)] = 0
        sound = np.ones(len(flat), bool)
        if len(self.tested) and len(pair):
            sound[:-1] = ~inner[:-1] | (self.valid[at] & (self.tested[at] == pair))
        whole = np.logical_and.reduceat(sound, last - size + 1) if len(guess) else []
        for (w, p), fine in zip(guess.items(), whole, strict=True):
            if fine:
                self.words[w] = np.array(p, "<u4").tobytes()
        for w in words:
            if w not in self.words:
                self.words[w] = np.array(self.merge(self.symbols(w)), "<u4").tobytes()

    def spells(self, decoded: str, parts: list[str | int]) -> bool:
        """Whether decoded tokens, joined by spaces, are the words and special tokens of a piece of text."""
        names = [t.removesuffix(self.end) if self.end and t != self.end else t for t in decoded.split(" ")]
        return "".join(names) == "".join([self.names[w] if isinstance(w, int) else w for w in parts])

    def parts(self, text: str) -> list[str | int]:
        """Words in order, special tokens as ids. The text holds no ASCII white space."""
        special = any(content in text for content, _ in self.special)
        if not special and _LATIN.fullmatch(text):
            if text.isascii():
                return [text.lower()] if text.isalpha() else _LATIN_SPLIT.findall(text.lower())
            return ["".join([self.shown[b] for b in w.encode()]) for w in _LATIN_SPLIT.findall(text.lower())]
        cut: list = [text]
        if special:
            for content, i in self.special:
                cut = [y for x in cut for y in ([x] if isinstance(x, int) else [z for k, piece in enumerate(x.split(content)) for z in ([i] if k else []) + [piece]])]
        return [y for x in cut if x != "" for y in ([x] if isinstance(x, int) else [w for w, _ in self.split(self.normalize(x))])]


class Encoder:
    """Texts to ids and decoded texts, with a bounded cache of white-space-separated pieces.

    The ids of all known pieces stand end to end in one array. The pieces of a batch are found, told apart and put together
    by array operations; only pieces that are not known yet are worked on one by one.
    """

    def __init__(self, raw: bytes, cache: int = CACHE, check: bool = False):
        self.bpe, self.cache, self.check = WordBpe(raw, cache), cache, check
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text: list[str] = []
        self.first, self.count, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.used = 0
        #: Pieces whose decoded tokens do not spell out their words.
        self.lost = np.zeros(1 << 12, bool)

    def learn(self, pieces: list[bytes]) -> None:
        parts = [self.bpe.parts(p.decode()) for p in pieces]
        self.bpe.learn(list({w for ws in parts for w in ws if isinstance(w, str) and w not in self.bpe.words}))
        words, names = self.bpe.words, self.bpe.names
        raw = [words[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else b"".join([w.to_bytes(4, "little") if isinstance(w, int) else words[w] for w in ws]) for ws in parts]
        ids, at = np.frombuffer(b"".join(raw), "<u4"), len(self.known)
        count = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        while at + len(pieces) > len(self.first):
            self.first, self.count, self.lost = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.lost))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        end = np.cumsum(count)
        self.count[at : at + len(pieces)], self.first[at : at + len(pieces)] = count, self.used + end - count
        self.used += len(ids)
        self.known.update(zip(pieces, range(at, at + len(pieces)), strict=True))
        each = [names[i] for i in ids.tolist()]
        self.text += [each[e - 1] if n == 1 else " ".join(each[e - n : e]) for e, n in zip(end.tolist(), count.tolist(), strict=True)]
        if self.check:
            self.lost[at : at + len(pieces)] = [not self.bpe.spells(t, ws) for t, ws in zip(self.text[at:], parts, strict=True)]

    def encode(self, column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Lists of ids, tokens joined by one space (this vocabulary's file names no decoder), and whether these spell out the
        words (if that is checked)."""
        made: list[tuple] = [(pa.array([], pa.list_(pa.int32())), pa.array([], pa.string()), pa.array([], pa.bool_()))]
        for lo, hi, data, offsets in B.text_chunks(column, CHUNK_BYTES):
            if len(self.known) > self.cache:
                self.forget()
            if len(self.bpe.words) > self.cache:
                self.bpe.words = {}
            start, end, row = B.words(data, offsets)
            bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(B.without_space(data))])
            coded = pieces.dictionary_encode()
            different = coded.dictionary.to_numpy(zero_copy_only=False)
            slots = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
            new = np.flatnonzero(slots < 0)
            if len(new):
                self.learn(different[new].tolist())
                slots[new] = np.fromiter(map(self.known.__getitem__, different[new]), np.int64, len(new))
            index = coded.indices.to_numpy()
            every = slots[index]
            size = self.count[every]
            last = np.cumsum(size)
            at = np.arange(last[-1] if len(last) else 0) + np.repeat(self.first[every] - last + size, size)
            upto = np.searchsorted(row, np.arange(hi - lo + 1))  # the first piece of each text
            ends = np.concatenate([[0], last])[upto].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.ids[at].view(np.int32)))
            text = pa.array([self.text[i] for i in slots.tolist()], pa.string()).take(coded.indices)
            full = size > 0
            if not full.all():
                text, upto = text.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[upto]
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), text), " ")
            spelt = np.ones(hi - lo, bool)
            spelt[row[self.lost[every]]] = False
            made.append((ids, decoded, pa.array(spelt)))
        return tuple(pa.concat_arrays(x) for x in zip(*made, strict=True))


_encoders: dict[tuple, Encoder] = {}


def encoder_of(vocabulary, cache: int, check: bool) -> Encoder:
    """One encoder for each worker process and broadcast vocabulary, so that its caches outlive a task."""
    key = (zlib.crc32(vocabulary.value), cache, check)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary.value, cache, check)
    return _encoders[key]


def _run(vocabulary, cache: int, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, cache, check)
        for b in batches:
            rest = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + list(encoder.encode(b.column("text"))), names=[*rest, "ids", "decoded", "spelt"])

    return run


def bpe_round_trip(docs: DataFrame, path: str, cache: int = CACHE, spelt: str | None = None) -> DataFrame:
    """The documents' other columns with ids array<int> and decoded string, as the tokenizers library makes them.

    path: the vocabulary's JSON, read on the driver and broadcast (it must not pass VOCABULARY_BYTES). Special tokens are
    not added, but their strings in a text are special tokens. A null text is empty and gives no ids and an empty text.
    Rows are independent: repeated rows get equal results, any table may be empty, and other columns (renamed inside, so
    that none clashes) pass through; columns named ids or decoded are replaced. A name in spelt adds a column: whether the decoded
    tokens, without their marks of word ends, are the normalised words of the text.
    """
    spark = prepare(docs.sparkSession)
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    rest = [f for f in docs.schema if f.name not in ("text", "ids", "decoded")]
    inner = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(rest)], F.col("text").cast("string").alias("text"))
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rest)] + ["ids array<int>", "decoded string", "spelt boolean"])
    out = inner.mapInArrow(tidy(_run(spark.sparkContext.broadcast(raw), cache, spelt is not None)), schema)
    return out.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(rest)], "ids", "decoded", *([F.col("spelt").alias(spelt)] if spelt else []))
