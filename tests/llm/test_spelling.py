"""Spelling variants against signatures of deleted letters, on random words and whole tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from edge import edge_docs, no_docs

from textloom.llm import spelling
from textloom.llm.jobs import LLM_QUERIES
from textloom.llm.spelling import Boxes, WordTree, near_pairs, spelling_groups, vectors, word_counts

SF = "/root/testdata/sf0.01"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += 1
    return out


def near_by_signature(words):
    by, near = defaultdict(list), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by[w[:k], w[k + 1 :]].append(w)
    for (a, b), same in by.items():
        for w in same:
            near[w].update(x for x in same if x != w)
            if a + b in words:
                near[w].add(a + b)
                near[a + b].add(w)
    return near


def plain(docs, least=6, least_n=5, times=5):
    n = {w: c for w, c in counted(docs).items() if len(w) >= least and c >= least_n}
    near = near_by_signature(n)

    def form(w):
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        return best if best is not None and n[best] >= times * n[w] else None

    out = []
    for w in n:
        root = w
        while form(root):
            root = form(root)
        out.append((w, form(w), root, n[w], len(near[w]), n.get(form(w))))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_words(rng, count, letters="abcñé", low=6, high=9):
    return sorted({"".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(count)})


def test_pairs_of_random_words_with_small_boxes(spark, monkeypatch):
    words = random_words(random.Random(1), 1500, "abé", 6, 8)
    table = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n bigint").repartition(3)
    n = {w: k + 1 for k, w in enumerate(words)}
    want = sorted((w, x, n[x]) for w, near in near_by_signature(set(words)).items() for x in near)
    assert len(want) > 2000
    assert rows(near_pairs(table)) == want  # a box for each length
    monkeypatch.setattr(spelling, "BOX_WORDS", 40)
    monkeypatch.setattr(spelling, "LEAF", 4)
    assert rows(near_pairs(table)) == want  # many boxes
    monkeypatch.setattr(spelling, "SAMPLE", 200)
    monkeypatch.setattr(spelling, "BOX_CHARS", 150)
    assert rows(near_pairs(table)) == want  # boxes by a sample, fuller ones divided by a hash


def test_words_of_equal_letters_are_divided(spark, monkeypatch):
    """Anagrams share one vector, which no tree can divide."""
    monkeypatch.setattr(spelling, "BOX_CHARS", 100)
    rng = random.Random(4)
    words = sorted({"".join(rng.sample("aabbccdd", 8)) for _ in range(300)} | {"".join(rng.sample("aabbccddd", 9)) for _ in range(300)})
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    want = sorted((w, x, 1) for w, near in near_by_signature(set(words)).items() for x in near)
    assert want and rows(near_pairs(table)) == want


def test_boxes_hold_each_vector_once_and_reach_every_edit():
    rng = random.Random(2)
    words = [w.encode("latin-1") for w in random_words(rng, 400, "abcdeé", 7, 7)]
    space = Boxes(vectors(words), 20, first=10)
    points = vectors(words)
    home = {k: box for box, at in space.reached(points, 0, 0) for k in at}
    assert len(home) == len(words) and len(set(home.values())) == space.count > 10
    met = {(k, box) for box, at in space.reached(points, 1, 1) for k in at}
    for k in range(len(words)):
        for j in range(len(words)):
            gap = points[j] - points[k]
            if np.maximum(gap, 0).sum() <= 1 and np.maximum(-gap, 0).sum() <= 1:
                assert (k, home[j]) in met


def test_a_tree_finds_replaced_and_inserted_letters():
    tree = WordTree([b"colour", b"colous", b"honour", b"oclour"])
    found = lambda asked: sorted((asked[q], tree.words[e]) for a, b in tree.near(asked) for q, e in zip(a, b))
    assert found([b"colour", b"zonour"]) == [(b"colour", b"colous"), (b"zonour", b"honour")]
    assert found([b"color", b"olour", b"honou", b"zzzzz"]) == [(b"color", b"colour"), (b"honou", b"honour"), (b"olour", b"colour"), (b"olour", b"oclour")]


def test_forms_chains_and_ties(spark):
    text = " ".join(["abcdefgh"] * 2000 + ["abcdefgx"] * 300 + ["abcdefyx"] * 40 + ["abcdzyx"] * 5 + ["abcdefyxx"] * 5 + ["Abcdefgh"] + ["qwerty"] * 30 + ["qwertz"] * 30 + ["qwerta"] * 6)
    docs = [(1, text), (2, "qwertyu " * 4), (3, None)]
    got = rows(spelling_groups(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert got == plain(docs)
    by = {r[0]: r for r in got}
    assert by["abcdefyx"][1:3] == ("abcdefgx", "abcdefgh") and by["abcdefyxx"][2] == "abcdefgh"
    assert by["qwerta"][1] == "qwerty" and by["qwerty"][1] is None and by["qwerty"][4] == 2


def test_edge_rows(spark):
    docs = edge_docs(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(spelling_groups(docs)) == plain(pairs)
    assert rows(spelling_groups(docs, least=3, least_n=1, times=2)) == plain(pairs, 3, 1, 2)
    assert rows(spelling_groups(no_docs(spark))) == []


def test_counts_with_a_small_memory(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    want = counted([tuple(r) for r in docs.collect()])
    assert dict(rows(word_counts(docs))) == {w: n for w, n in want.items() if len(w) >= 6}


def test_query_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows(LLM_QUERIES["op13_spelling"](spark, SF)) == plain([tuple(d) for d in docs])
