"""Classifier on held-out rows, neighbours against brute force, licenses."""

import numpy as np
import pytest
from edge import ROWS, edge_docs, no_docs

from textloom.llm import multi_index
from textloom.llm.common import give_back
from textloom.llm.licenses import TEMPLATES, Scanner, align, longest_run, scan_licenses
from textloom.llm.multi_index import nearest
from textloom.llm.quality_cnn import CHUNK, DEPTH, FILTERS, HOP, LAGS, STRIDE, WIDTH, ByteNetwork, chunks_of, keep_good, score_quality, train_network
from textloom.session import table

SF = "/root/testdata/sf0.01"


def test_chunks_cover_all_bytes():
    for n in (0, 1, CHUNK - 1, CHUNK, CHUNK + 1, HOP * 5 + CHUNK, 10_000):
        raw = bytes(k % 251 + 1 for k in range(n))
        c = chunks_of(raw)
        assert b"".join(bytes(x[:HOP]) for x in c[:-1]) + (bytes(c[-1]) if n else b"")[: n - HOP * (len(c) - 1)] == raw


def test_gradients_are_the_slopes_of_the_loss():
    net = ByteNetwork(1)
    texts = [b"abc def ghi " * 50, b"%%% $$$ " * 90, b"x"]
    parts = [chunks_of(t) for t in texts]
    chunks, counts = np.concatenate(parts), np.array([len(p) for p in parts])
    echo, y, w = np.zeros((len(chunks), 1), np.float32), np.array([1.0, 0.0, 1.0], np.float32), np.ones(3)

    def loss():
        a, _, _ = net.answers(chunks)
        z = net.joined(np.hstack([a, echo]).astype(np.float64), counts).astype(np.float64) @ net.p["out"] + net.p["shift"]
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = net.gradients(chunks, echo, counts, y, w)
    for name, at in (("out", 3), ("shift", 0), ("filters", (5, 2)), ("embed", (ord("e"), 1)), ("bias", 4)):
        old = net.p[name][at]
        net.p[name][at] = old + 5e-3
        up = loss()
        net.p[name][at] = old - 5e-3
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 1e-2 == pytest.approx(float(g[name][at]), rel=0.1, abs=1e-3), name


def plain_score(net, raw):
    """The network's score by loops over chunks, filters and places."""
    p, rows, start = net.p, [], 0
    while raw and (start == 0 or start + CHUNK - HOP < len(raw)):
        chunk = raw[start : start + CHUNK].ljust(CHUNK, b"\0")
        answers = []
        for f in range(FILTERS):
            weights = [[float(p["filters"][k * DEPTH + d, f]) for d in range(DEPTH)] for k in range(WIDTH)]
            best = max(
                sum(float(p["embed"][chunk[at + k], d]) * weights[k][d] for k in range(WIDTH) for d in range(DEPTH))
                for at in range(0, CHUNK - WIDTH + 1, STRIDE)
            )
            answers.append(max(best + float(p["bias"][f]), 0.0))
        real = max(sum(c != 0 for c in chunk), 1)
        answers.append(max(sum(chunk[k] == chunk[k - lag] != 0 for k in range(lag, CHUNK)) / real for lag in LAGS))
        rows.append(answers)
        start += HOP
    n = FILTERS + 1
    x = [max(r[k] for r in rows) for k in range(n)] + [sum(r[k] for r in rows) / len(rows) for k in range(n)] if rows else [0.0] * 2 * n
    z = sum(v * float(w) for v, w in zip(x, p["out"])) + float(p["shift"][0])
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_plain_loops():
    net = ByteNetwork(3)
    net.p["bias"][:] = np.linspace(-1, 1, FILTERS)
    net.p["shift"][:] = 0.3
    texts = ["", "x", "abc def ghi " * 70, "Grüße, \u4e2d\u6587 " + "word %$ " * 57, "".join(chr(33 + k * k % 90) for k in range(HOP + CHUNK + 1))]
    assert net.scores(texts) == pytest.approx([plain_score(net, t.encode()) for t in texts], abs=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    net = train_network(docs, labels)
    rows = score_quality(docs, net).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.98
    assert np.mean([(r["predicted"] == r["quality"]) for r in rows]) > 0.96


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (6, None, 0), (None, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    net = train_network(edge_docs(spark), labels)
    rows = score_quality(edge_docs(spark), net).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert score_quality(no_docs(spark), train_network(no_docs(spark), labels.limit(0))).count() == 0
    kept = keep_good(edge_docs(spark), net)
    assert kept.columns == edge_docs(spark).columns and kept.count() == sum(r["predicted"] for r in rows)


def brute_nearest(rows, queries, k=10):
    out = {}
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q)[:k]
        out[q] = near
    return out


def test_neighbours_of_the_table(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = brute_nearest(rows, [x for x in rows if x[0] % 100 == 0])
    got: dict = {}
    for r in nearest(vectors, vectors.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys()
    found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert found >= 0.9 * 10 * len(want)
    true = {i: np.array(v) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near)
        for score, i in near:
            assert score == pytest.approx(float(np.sqrt(((true[i] - true[q]) ** 2).sum())), abs=1e-12)


def test_equal_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "GROUP_ROWS", 40)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).round(2).tolist()) for k in range(200)] + [(k, [1.0] * 6) for k in range(1000, 1100)]
    bad = [(300, None), (400, [0.0] * 6), (500, [1.0, None, 0, 0, 0, 0]), (600, [float("nan")] * 6), (700, [float("inf"), 0, 0, 0, 0, 0]), (None, [1.0] * 6), (800, [1.0])]
    bad = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in bad]
    table_ = spark.createDataFrame(rows + rows[:5] + bad, "vec_id bigint, embedding array<float>").repartition(4)
    got = nearest(table_, table_.where("vec_id % 100 = 0")).collect()
    assert {r["query_id"] for r in got} == {0, 100, 1000}
    hot = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 1000)
    assert hot == [(k, 1000 + k, 0.0) for k in range(1, 11)]
    few = nearest(table_.where("vec_id < 4"), table_.where("vec_id < 1")).collect()
    assert len(few) == 3
    assert nearest(table_.limit(0), table_).count() == 0 and nearest(table_, table_.limit(0)).count() == 0
    assert nearest(table_.where("vec_id in (300, 400)"), table_).count() == 0


def test_alignment():
    assert longest_run([(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    a, b = "the cat sat on the mat today".split(), "so the cat then sat on a mat today ok".split()
    pairs = align(a, b)
    assert [a[i] for i, _ in pairs] == ["the", "cat", "sat", "on", "mat", "today"] and pairs == sorted(pairs)
    assert all(a[i] == b[j] for i, j in pairs) and [j for _, j in pairs] == sorted({j for _, j in pairs})


def test_licenses_whole_changed_and_repeated():
    scan = Scanner()
    noise = "the work of this and that is in the public view "
    for name, t in TEMPLATES.items():
        found = scan.found(noise * 30 + t + " " + noise * 30)
        assert any(f[0] == name and f[1] == 1.0 for f in found), name
    assert scan.found(noise * 100) == []
    assert [f[0] for f in scan.found("Released under the MIT License. " * 40)].count("mit-line") == 40
    changed = TEMPLATES["mit"].replace("hereby ", "").replace("merge", "join").replace("furnished to do so", "furnished so")
    assert any(f[0] == "mit" and 0.8 <= f[1] < 1 for f in scan.found(noise * 5 + changed))
    assert not any(f[0] == "mit" for f in scan.found(" ".join(TEMPLATES["mit"].split()[:30])))


def test_licenses_of_the_table_and_edges(spark):
    docs = table(spark, SF, "documents")
    lines = {"mit-line": "Released under the MIT License.", "all-rights-reserved": "All rights reserved.", "gpl-line": "GNU General Public License, version 3."}
    got = {(r["doc_id"], r["license"]) for r in scan_licenses(docs).collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, line in lines.items():
        assert {d for d, t in texts if line in t} <= {d for d, n in got if n == name}, name
    assert scan_licenses(no_docs(spark)).count() == 0 and scan_licenses(edge_docs(spark)).count() == 0
    two = spark.createDataFrame([(1, "All rights reserved. All rights reserved.")] * 2, "doc_id bigint, text string")
    assert scan_licenses(two).count() == 4


def test_freed_arrays_leave_the_process():
    """Small arrays below one that stays are kept by the allocator until they are given back."""
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    arrays = [np.ones(12_000) for _ in range(2000)]
    full, last = held(), arrays[-1]
    arrays.clear()
    give_back()
    assert last[0] == 1 and full - held() > 150 << 20
