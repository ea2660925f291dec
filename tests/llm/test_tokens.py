"""Encoding, decoding and counting against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from edge import ROWS, edge_docs, no_docs
from tokenizers import Tokenizer

from textloom.llm.pieces import coder, encode_pieces
from textloom.llm.token_counts import counter, token_counts
from textloom.session import table

SP = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"
PARTS = [
    "a", "b", " ", "  ", "   ", "\t", "\n", "é", "ü", "中", "梦", "😀", "▁", "<s>", "</s>", "<0x41>", "the", "tion", "'s", "'ll", "1", "23", "½",
    "٣", "一", " ", "\u0085", "\x1c", "\x00", "​", "　", "ñ", "<|endoftext|>", "<|endof", "!!", "%%%", "-", "Ⅷ", "ʰ", "﻿", ".", ", ",
]


def expected(sp, text):
    ids = sp.encode(text or "", add_bos=True, add_eos=True)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode())


def test_random_texts_encode_decode_and_count_as_the_libraries_do():
    rng = random.Random(5)
    sp, c = sentencepiece.SentencePieceProcessor(model_file=SP), coder(SP)
    library, k = Tokenizer.from_file(BPE), counter(BPE)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(3000)]
    for t in [*texts, "a" * 3000, " " * 900, "中文" * 700, "ab" * 900 + ".x", "x" * 70 + " y"]:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert c.encode(t) == ids, t
        assert c.decode(ids) == sp.decode(ids), t
        raw, decoded = c.coded(t)
        assert raw == np.array(ids, "<u4").tobytes() and decoded == sp.decode(ids), t
        assert k.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_any_ids_decode_as_the_library_does():
    rng = random.Random(6)
    sp, c = sentencepiece.SentencePieceProcessor(model_file=SP), coder(SP)
    for _ in range(2000):
        ids = rng.choices([0, 1, 2, 259, 300, 29871, 31000, *range(3, 259, 3)], k=rng.randint(0, 7))
        assert c.decode(ids) == sp.decode(ids), ids


def test_whole_tokens_are_proved():
    library, k = Tokenizer.from_file(BPE), counter(BPE)
    for t in random.Random(7).sample(sorted(k.whole), 2000):
        if len(k.whole) and k.count(t) == 1:
            assert len(library.encode(t, add_special_tokens=False).ids) == 1, t
    assert len(k.whole) > 45_000


def test_tables_against_the_libraries(spark):
    docs = table(spark, SF, "documents").limit(300).cache()
    sp, library = sentencepiece.SentencePieceProcessor(model_file=SP), Tokenizer.from_file(BPE)
    for d in (docs, edge_docs(spark)):
        key = lambda r: tuple(map(str, r))
        texts = [(r["doc_id"], r["text"]) for r in d.collect()]
        got = sorted((tuple(r) for r in encode_pieces(d).collect()), key=key)
        assert got == sorted(((i, *expected(sp, t)) for i, t in texts), key=key)
        got = sorted((tuple(r) for r in token_counts(d).collect()), key=key)
        count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
        assert got == sorted(((i, len((t or "").encode()), count(t), count(t) > 1024) for i, t in texts), key=key)


def test_empty_tables(spark):
    assert encode_pieces(no_docs(spark)).count() == 0 and token_counts(no_docs(spark)).count() == 0
    assert encode_pieces(edge_docs(spark), keep_ids=True).count() == len(ROWS)
