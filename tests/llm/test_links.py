"""Links and their numbers against a comparison of all pairs."""

import random

from edge import edge_docs, no_docs
from test_ngram_join import brute

from textloom.llm import ngram_join
from textloom.llm.ngram_join import join_documents, keep_one


def plain_links(rows):
    """For each row how many other rows have a set of four-word shingles 85 % alike."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if w else set())
    out = [0] * len(rows)
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            both = len(s & t)
            if s and t and 100 * both >= 85 * (len(s) + len(t) - both):
                out[i] += 1
                out[j] += 1
    return out


def test_numbers_of_links_inside_components(spark, monkeypatch):
    """Near copies of which some are alike and some are not, exact copies, and texts of their own."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    rng, rows = random.Random(5), []
    word = lambda: "w" + str(rng.randint(0, 3000))
    for _ in range(4):
        base = [word() for _ in range(150)]
        for _ in range(30):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(150)] = word()
            rows.append((len(rows), " ".join(text)))
        rows += [(len(rows) + k, " ".join(base)) for k in range(5)]
    rows += [(1000 + k, " ".join(word() for _ in range(80))) for k in range(20)] + [(2000, None), (2001, " "), (2002, "one two"), (2003, "one two")]
    want = dict(zip([i for i, _ in rows], plain_links(rows)))
    inside = [want[i] for i in range(140)]
    assert len(set(inside)) > 5 and min(inside) < 34  # not every pair of a component links
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in join_documents(docs, links=True).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == want
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute(rows)


def test_edges(spark):
    found = join_documents(edge_docs(spark), links=True)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted((r["doc_id"], r["n_links"]) for r in found.where("n_links > 0").collect()) == [(4, 2), (4, 2), (5, 2)]
    assert join_documents(no_docs(spark), links=True).count() == 0
    assert join_documents(edge_docs(spark)).columns == ["doc_id", "n_shingles", "component_id"]


def test_number_of_words_of_a_shingle(spark):
    """One word of 48 changed: of 44 shingles of five words 39 stay, 39 / 49 is under 80 %; of 50, 41 / 51 is over."""
    word = [f"w{k}" for k in range(50)]
    change = lambda n: " ".join([*word[: n // 2], "other", *word[n // 2 + 1 : n]])
    rows = [(1, " ".join(word)), (2, change(50)), (11, "x " + " ".join(w + "y" for w in word[:47])), (12, "x " + change(48).replace(" ", "y ") + "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(keep_one(docs)) == [1, 2, 11, 12]
    assert ids(keep_one(docs, percent=80, words=5)) == [1, 11, 12]
    assert [r["n_shingles"] for r in join_documents(docs.where("doc_id = 1"), words=5).collect()] == [46]
