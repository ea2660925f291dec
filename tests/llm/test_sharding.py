"""Shards: whole tables, near-equal bytes, slots without gaps."""

import zlib

import pytest
from edge import ROWS, edge_docs, no_docs

from textloom.llm import sharding
from textloom.llm.sharding import shard_documents
from textloom.session import table

SF = "/root/testdata/sf0.01"


def check(docs, n=16):
    rows = shard_documents(docs, n).collect()
    want = sorted(((r["doc_id"] or 0, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()))
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == want
    total, largest = sum(w[1] for w in want), max((w[1] for w in want), default=0)
    for s in range(n):
        mine = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / n) <= largest, s
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n for r in rows)
    return rows


@pytest.mark.parametrize("ranges", [256, 7])
def test_shards_of_the_table(spark, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    check(table(spark, SF, "documents"))


def test_a_third_of_all_rows_alike(spark):
    rows = [(k, f"text {k} " * (k % 50)) for k in range(600)] + [(7, "the same " * 9)] * 300 + [(k, "equal texts") for k in range(1000, 1300)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))


def test_edges(spark):
    assert len(check(edge_docs(spark))) == len(ROWS)
    assert shard_documents(no_docs(spark)).count() == 0
    check(edge_docs(spark).where("doc_id = 7"), 3)
