import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plainlens.llm import bpe, tokenfiles
from plainlens.llm.queries import op5_token_files, op7_bpe, vocabulary

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  a  b\n\n c\t\td ", "don't I'LL we've x'S", "<|endoftext|> a<|endoftext|>b  <|startoftext|>", "a  b   c", " x 　　y", "a\x1cb!\x1c ?", "ÉÀ éê İI ΣΑΣ ßẞ", "éä x", "𝒳 😀😀 👩‍👩‍👧", "123456 7.5e-3", "$$$ *** ###\n", "﻿x​y", "日本語のテキスト。", "\r\n\r\n x \n y\n", "a" * 500 + " " * 300 + "b", "x\u0085y  z",
]


def texts():
    r = random.Random(5)
    out = list(ODD)
    for _ in range(300):
        out.append("".join(r.choice(["th", "e", " ", "  ", "\n", "\t", "é", "ß", "A", "1", "'", "s", "#", " ", "İ", "ing", "tion", "\x1d", "　", "😀"]) for _ in range(r.randint(0, 60))))
    return out


def docs_of(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(5), rows


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_as_the_library(spark):
    docs, rows = docs_of(spark)
    t = library("word_bpe_49k.json")
    got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.bpe_round_trip(docs, vocabulary("word_bpe_49k.json")).collect()}
    for i, text, _ in rows:
        want = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (want, t.decode(want, skip_special_tokens=False)), (i, text)
    assert bpe.bpe_round_trip(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables are absent")
def test_bpe_query(spark):
    t = library("word_bpe_49k.json")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op7_bpe(spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        ids = t.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_most_words_pass_the_check():
    with open(vocabulary("word_bpe_49k.json"), "rb") as f:
        b = bpe.WordBpe(f.read())
    words = ["hello", "extraordinarily", "thhesion", "wherever", "unaffordable", "x", "antidisestablishmentarianism"]
    b.learn(words)
    assert all(np.frombuffer(b.words[w], "<u4").tolist() == b.merge(b.symbols(w)) for w in words)
    assert bpe.byte_characters() == [k for _, k in sorted((v, k) for k, v in ((c, i) for i, c in enumerate(bpe.byte_characters())))]


def test_token_files(spark, tmp_path):
    docs, rows = docs_of(spark)
    t = library("byte_bpe_50k.json")
    manifest = tokenfiles.write_token_files(docs, vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/t", parts=3, length=64)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_token_files(manifest).collect()}
    at, flat = 0, []
    for i, text, _ in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), (i, text)
        at += len(ids)
        flat += ids
    read, padding = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        file = tokenfiles.open_part(row.path)
        n = sum(file.get_batch(i).num_rows for i in range(file.num_record_batches))
        pieces = [tokenfiles.sequence(file, i) for i in range(n)]
        assert all(len(x) == len(m) == 64 for x, m in pieces)
        read += [x for p, m in pieces for x in p[m].tolist()]
    assert read == flat
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(docs.limit(0), vocabulary("byte_bpe_50k.json"), str(tmp_path / "e"))).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables are absent")
def test_token_query(spark):
    t = library("byte_bpe_50k.json")
    got, at = {r.doc_id: r for r in op5_token_files(spark, SF).collect()}, 0
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_decoded_tokens_spell_the_words():
    with open(vocabulary("word_bpe_49k.json"), "rb") as f:
        encoder = bpe.Encoder(f.read(), check=True)
    texts = ["The quick-brown fox's 42 tests, naïve ÉCOLE ß 你好 🙂", "", "<|endoftext|> tail"]
    assert encoder.encode(pa.array(texts))[2].to_pylist() == [True] * 3
    # as many tokens as before, but a wrong one: the number of tokens does not tell
    encoder.forget()
    encoder.bpe.words["fox"] = encoder.bpe.words["quick"]
    assert encoder.encode(pa.array(["the fox", "the quick"]))[2].to_pylist() == [False, True]


def test_bpe_with_a_small_cache():
    t = library("word_bpe_49k.json")
    with open(vocabulary("word_bpe_49k.json"), "rb") as f:
        encoder = bpe.Encoder(f.read(), cache=40)
    made = texts()
    for at in range(0, len(made), 25):
        ids, decoded, _ = encoder.encode(pa.array(made[at : at + 25]))
        want = [t.encode(x or "", add_special_tokens=False).ids for x in made[at : at + 25]]
        assert ids.to_pylist() == want and decoded.to_pylist() == [t.decode(w, skip_special_tokens=False) for w in want]


def test_pieces_as_the_library_with_a_small_cache():
    t = library("byte_bpe_50k.json")
    p = tokenfiles.Pieces(vocabulary("byte_bpe_50k.json"), "<u2", cache=50)
    made = texts() + ["é. à! ×. ÷ b", "naïve,  word", "x <|endoftext|> y.<|endoftext|>\nz", "\n" * 70, " \n" * 40 + "a", "don't. 's 's", "x" * 3000 + " " + "y. " * 2000]
    for at in range(0, len(made), 40):
        ids, size = p.encode(pa.array(made[at : at + 40]))
        want = [t.encode(x or "", add_special_tokens=False).ids for x in made[at : at + 40]]
        assert size.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert p.cuts and len(p.known) < 3000
