"""Fill-in-middle against the tokens' pattern and plain slicing."""

import hashlib
import random
import re

import numpy as np
import pytest
from edge import edge_docs, no_docs
from pyspark.sql import functions as F

from textloom.llm.fill_middle import RankIndex, fill_in_middle, fill_middle_digest, token_ends
from textloom.llm.jobs import LLM_QUERIES

SF = "/root/testdata/sf0.01"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = ["a", "b", " ", "\n", "\t", "é", "中", "😀", "\x1c", "xyz", "\xa0", " ", "<P", "<S", ">", "<", "M>"]


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    spm = h4 % 100 < 80
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), sha(out), sha(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("epsilon", [0, 3, 100])
def test_every_rank_is_exact_and_lines_keep_their_bound(epsilon):
    rng = random.Random(epsilon)
    for _ in range(400):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 60))) * (300 if rng.random() < 0.02 else 1)
        want = np.cumsum([0, *(len(t.encode()) for t in TOKEN.findall(text))]).tolist()
        ends = token_ends(np.frombuffer(text.encode(), np.uint8))
        index = RankIndex(ends, epsilon)
        assert ends.tolist() == want
        assert [index.offset(k) for k in range(len(want))] == want
        assert np.abs(index.residuals.astype(int)).max() <= epsilon + 1


def test_pieces_are_few_and_end_where_lines_bend():
    slow, fast = np.arange(1000) * 3, 3000 + np.arange(1000) * 50
    index = RankIndex(np.concatenate([slow, fast]), 10)
    assert len(index.firsts) <= 3 and index.residuals.dtype == np.int8
    assert len(RankIndex(np.arange(100_000) * 7, 10).firsts) == 1
    jumps = np.cumsum(np.where(np.arange(500) % 7 == 0, 100_000, 1))
    assert [RankIndex(jumps).offset(k) for k in range(500)] == jumps.tolist()


def test_edge_rows(spark):
    docs = edge_docs(spark)
    want = sorted((plain(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert rows(fill_middle_digest(docs)) == want
    assert fill_middle_digest(no_docs(spark)).count() == 0


def test_random_texts_and_marks(spark):
    rng = random.Random(3)
    texts = [(k, "".join(rng.choices(PARTS, k=rng.randint(0, 40)))) for k in range(1500)]
    texts += [(2000 + k, f"some {m} words and more") for k in range(5) for m in ("<P>", "<S>", "<M>")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = rows(fill_middle_digest(docs))
    assert got == sorted((plain(*t) for t in texts), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_shares_and_seed_are_parameters(spark):
    docs = spark.createDataFrame([(k, "one two three four five") for k in range(300)], "doc_id bigint, text string")
    forms = lambda **kw: {r["form"]: r["n"] for r in fill_in_middle(docs, **kw).groupBy("form").agg(F.count("*").alias("n")).collect()}
    assert set(forms(percent=100, spm_percent=0)) == {"psm"} and set(forms(percent=0)) == {"plain"}
    a, b = (fill_in_middle(docs, seed=s).agg(F.sum("prefix_chars")).first()[0] for s in (42, 43))
    assert a != b


def test_query_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows(LLM_QUERIES["op12_fill_middle"](spark, SF)) == sorted((plain(*d) for d in docs), key=repr)
