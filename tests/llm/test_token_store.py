"""Files of token ids: the encoder against the library, the format by random access, round trips with Spark."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from edge import edge_docs, no_docs
from test_tokens import PARTS
from tokenizers import Tokenizer

from textloom.llm.jobs import LLM_QUERIES
from textloom.llm.token_store import TokenFile, encoder, file_bytes, level_widths, opened, read_documents, tokens_at, write_tokens

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def in_order(docs):
    return sorted(docs, key=lambda d: (d[0] is not None, d[0]))


def test_random_texts_encode_as_the_library_does(library):
    rng, e = random.Random(11), encoder(BPE)
    more = [*PARTS, "<|endoftext|>", "word", "Größe", "été", " .", "it's", "\x1f", "\x85", " "]
    texts = ["".join(rng.choices(more, k=rng.randint(0, 30))) for _ in range(6000)]
    texts += [" ".join(rng.choices(["word,", "Über", "a.b", "x" * 90, "中文", "don't", "(see)", "12,5", ""], k=rng.randint(0, 20))) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_memos_that_start_anew_change_nothing(library, monkeypatch):
    from textloom.llm import token_store

    monkeypatch.setattr(token_store, "WORDS_KEPT", 3)
    monkeypatch.setattr(token_store, "CHUNKS_KEPT", 2)
    e = token_store.TextEncoder(BPE)
    t = "one two three, four (five) six one two seven " * 5
    assert np.frombuffer(e.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(e.words) <= 3 and len(e.chunks) <= 2


@pytest.mark.parametrize("top", [0, 1, 15, 16, 300, 50_256, 1 << 20, (1 << 32) - 1])
def test_any_id_and_any_stretch_without_the_rest(top):
    rng, draw = random.Random(top), np.random.default_rng(top)
    for n in (0, 1, 2, 511, 512, 513, 1024, 4097):
        ids = (draw.integers(0, top, n, dtype=np.uint64, endpoint=True) >> draw.integers(0, 20, n).astype(np.uint64)).astype(np.uint32)
        raw = file_bytes([7, None], [0, n // 3, n], ids)
        read = []
        f = TokenFile(lambda size, offset: (read.append(size), raw[offset : offset + size])[1])
        assert f.ids().tolist() == ids.tolist()
        assert f.documents()[0] == [7, None] and f.documents()[1].tolist() == [0, n // 3, n]
        for _ in range(20):
            a = rng.randint(0, n)
            b = rng.randint(a, min(n, a + rng.choice([1, 5, 700])))
            assert f.ids(a, b).tolist() == ids[a:b].tolist()
        for a in rng.sample(range(n), min(n, 10)):
            read.clear()
            assert f.ids(a, a + 1).tolist() == [ids[a]]
            assert sum(read) <= len(f.widths) * (4 + 4 + 1 + 512 // 8)  # a pair of chunks, a rank and its bits
        with pytest.raises(IndexError):
            f.ids(0, n + 1)


def test_widths_take_the_least_room():
    import itertools

    ids = np.random.default_rng(1).zipf(1.3, 20_000).clip(0, 50_000).astype(np.uint32)
    size = lambda widths: sum(
        int((ids >> sum(widths[:k]) > 0).sum() if k else len(ids)) * (w + (k < len(widths) - 1)) for k, w in enumerate(widths)
    )
    every = [w for r in range(1, 5) for w in itertools.product((4, 8, 12, 16), repeat=r) if sum(w) == 16]
    assert size(level_widths(ids)) == min(map(size, every))


def expected(library, docs):
    out, at = [], 0
    for doc_id, text in docs:
        ids = ids_of(library, text)
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out, at


def test_edge_rows_in_small_files(spark, library, tmp_path):
    docs = edge_docs(spark)
    files = write_tokens(docs, str(tmp_path / "ids"), file_tokens=100)
    got = sorted((tuple(r) for r in read_documents(files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [d[0] for d in in_order(r[:2] for r in docs.collect())]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    want = [(r["doc_id"], len(ids := ids_of(library, r["text"])), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in docs.collect()]
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(want, key=repr)
    rows = files.orderBy("start").collect()
    assert len(rows) > 4 and all(r["docs"] == 1 or r["n"] >= 1 for r in rows)
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n"] for r in rows)])[:-1].tolist()


def test_empty_table(spark, tmp_path):
    files = write_tokens(no_docs(spark), str(tmp_path / "ids"))
    assert files.count() == 0 and read_documents(files).count() == 0


def test_one_id_with_a_third_of_the_rows_is_divided(spark, tmp_path):
    rows = [(5 if k % 3 == 0 else k, f"text {k} " * 20) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    files = write_tokens(docs, str(tmp_path / "ids"))
    got = sorted((tuple(r) for r in read_documents(files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(r[0] for r in rows)
    assert files.count() > 4 and files.agg({"docs": "max"}).first()[0] < 300


def test_query_and_single_places_over_the_table(spark, library, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = in_order(tuple(r) for r in docs.collect())
    want, total = expected(library, rows)
    assert sorted(tuple(r) for r in LLM_QUERIES["op11_token_store"](spark, SF).collect()) == want
    files = write_tokens(docs, str(tmp_path / "ids"), file_tokens=5_000)
    every = [i for _, text in rows for i in ids_of(library, text)]
    rng = random.Random(2)
    asked = [*rng.choices(range(total), k=400), 0, total - 1, total, -1, None, 3, 3]
    places = spark.createDataFrame([(p,) for p in asked], "place bigint")
    got = sorted(tuple(r) for r in tokens_at(files, places, bucket=4_096).collect())
    assert got == sorted((p, every[p]) for p in asked if p is not None and 0 <= p < total)
    first = files.where("start = 0").first()
    assert opened(first["path"]).ids(0, 50).tolist() == every[:50]


def test_ascii_parts_are_the_librarys_and_need_no_whole_encoding():
    import random

    from textloom.llm.common import tokenizer_path
    from textloom.llm.token_store import VOCABULARY, TextEncoder

    e = TextEncoder(tokenizer_path(VOCABULARY))
    whole, asked = e.library, []

    class Counted:
        def encode(self, text, **kw):
            asked.append(text)
            return whole.encode(text, **kw)

    e.chunks.library = Counted()
    rng = random.Random(5)
    bits = ["don't", "'s", "'S", "''ll", "x_1", "a1b2", "3.14", "--", "'", "'re've", "we'd!", "(f(x))", " ", "\n", "  ", "\t", "\x1c", "\x7f", "é", "naïve's", "٣", "e'", '"q"', "http://a.b/c?d=1"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(5000)] + [" ".join(rng.choices(bits, k=20)) for _ in range(500)]
    assert [np.frombuffer(e.encode(t), "<u4").tolist() for t in texts] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert not any(t.isascii() and t.isprintable() and t.strip() == t for t in asked)
