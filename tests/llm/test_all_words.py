"""Language models over every word, against plain counts."""

from collections import Counter
from math import log

import pytest
from edge import ROWS, edge_docs, no_docs

from textloom.llm import lm_scores
from textloom.llm.jobs import LLM_QUERIES
from textloom.llm.lm_scores import WEIGHT, score_all_words, words_of
from textloom.session import table

SF = "/root/testdata/sf0.01"


def plain(texts, target):
    """Losses of each text under both models, from counts of every word."""
    size = len({w for t in [*texts, *target] for w in words_of(t)})

    def model(of):
        pairs, after, single = Counter(), Counter(), Counter()
        for t in of:
            ws = [None, *words_of(t)]
            pairs.update(zip(ws, ws[1:]))
            after.update(ws[:-1])
            single.update(ws[1:])
        total = sum(single.values()) + size
        return lambda a, b: -log((pairs[a, b] + WEIGHT * (single[b] + 1) / total) / (after[a] + WEIGHT))

    models, out = (model(target), model(texts)), []
    for t in texts:
        ws = [None, *words_of(t)]
        n = len(ws) - 1
        out.append((n, *(sum(m(a, b) for a, b in zip(ws, ws[1:])) / n if n else None for m in models)))
    return out


def agrees(got, want):
    assert got["n_tokens"] == want[0]
    if want[0]:
        assert (got["target_loss"], got["background_loss"], got["score"]) == pytest.approx((*want[1:], want[1] - want[2]), abs=1e-9)
    else:
        assert got["target_loss"] is got["background_loss"] is got["score"] is None


def test_query_tells_all_words_apart(spark, tmp_path):
    docs, target = table(spark, SF, "documents").limit(300), table(spark, SF, "conversations").limit(100)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    target.write.parquet(str(tmp_path / "conversations.parquet"))
    docs, target = table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "conversations")
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = plain([t for _, t in texts], [r["text"] or "" for r in target.collect()])
    got = {r["doc_id"]: r for r in LLM_QUERIES["op2_lm_scores"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for (i, _), w in zip(texts, want):
        agrees(got[i], w)


def test_chunks_and_divided_texts(spark, monkeypatch):
    rows = [(1, "a b c a b a c d"), (2, "a b c a b a c d"), (3, "x" * 9 + " b"), (4, ""), (None, "a b"), (5, "a a a a a a a a a a")]
    target = [("b c a",), (None,), ("only there",), ("a b c d e f g",)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    other = spark.createDataFrame(target, "text string")
    want = dict(zip([i for i, _ in rows], plain([t for _, t in rows], [t or "" for (t,) in target])))
    for size in (3, 4, 1000):
        monkeypatch.setattr(lm_scores, "CHUNK_TOKENS", size)
        got = score_all_words(docs, other).collect()
        assert len(got) == len(rows)
        for r in got:
            agrees(r, want[r["doc_id"]])
        same = {r["doc_id"]: r["score"] for r in got}
        assert same[1] == same[2]


def test_all_words_edges(spark):
    rows = score_all_words(edge_docs(spark), edge_docs(spark)).collect()
    assert len(rows) == len(ROWS) and all(r["score"] is None or abs(r["score"]) < 1e-9 for r in rows)
    assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in rows)
    assert score_all_words(no_docs(spark), edge_docs(spark)).count() == 0
    assert score_all_words(edge_docs(spark), no_docs(spark)).count() == len(ROWS)
