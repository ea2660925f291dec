"""Decontamination: the walk against scoring every item, and leaks against plain search."""

import random
import re
from collections import Counter

from edge import edge_docs, no_docs

from textloom.llm.decontam import THRESHOLD, BandCounts, BenchmarkIndex, ItemIndex, drop_leaks, find_leaks, question_and_answer, words_of
from textloom.session import table

SF = "/root/testdata/sf0.01"


def test_the_walk_retrieves_what_scoring_all_items_does():
    rng = random.Random(2)
    words = [f"w{int(rng.expovariate(0.02))}" for _ in range(4000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(5, 40)))) for k in range(300)]
    index = ItemIndex(items, 0.3)
    for _ in range(300):
        passage = set(rng.choices(words, k=rng.randint(1, 60)) + rng.choice(items)[1].split()[: rng.randint(0, 20)])
        scores: dict[int, float] = {}
        for w in passage & set(index.lists):
            for i, x in zip(index.lists[w].items, index.lists[w].weights):
                scores[i] = scores.get(i, 0.0) + x
        want = {i: round(s, 9) for i, s in scores.items() if s >= 0.3 - 1e-9}
        assert {i: round(s, 9) for i, s in index.retrieve(passage)} == want
        assert not want or passage & index.essential


def test_parts_of_an_item():
    assert question_and_answer("What is it? Answer: a thing") == (["what", "is", "it"], ["answer", "a", "thing"])
    assert question_and_answer("First part. Last part.") == (["first", "part"], ["last", "part"])
    assert question_and_answer("one two three") == (["one", "two"], ["three"])


def test_leaks_need_both_parts_and_survive_case_and_signs():
    item = "Which river crosses the old mill town near the border? The winding Eltra river."
    index = BenchmarkIndex([(7, item), (8, "Unrelated question about copper mining. Never in the hills.")])
    noise = " ".join(f"filler{k}" for k in range(500))
    assert [x[0] for x in index.leaks(f"{noise} {item.upper().replace(' ', '  ')} {noise}")] == [7]
    assert index.leaks(f"{noise} {item.split('?')[0]} {noise}") == []
    assert index.leaks(f"{noise} The winding Eltra river. {noise}") == []


def test_table_against_plain_search(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    norm = lambda t: f" {' '.join(words_of(t))} "
    bench = [(r["item_id"], norm(r["text"])) for r in items.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in bench if t in norm(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()}
    assert want and want <= got and len(got - want) <= 0.02 * len(want)
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_edges(spark):
    items = spark.createDataFrame(
        [(1, "Is the long word977 question here? Maybe an answer follows."), (2, None), (None, "x y"), (3, ""), (4, "!!"), (4, "!!")], "item_id bigint, text string"
    )
    assert find_leaks(edge_docs(spark), items).count() == 0
    assert find_leaks(no_docs(spark), items).count() == 0 and find_leaks(edge_docs(spark), items.limit(0)).count() == 0
    assert drop_leaks(edge_docs(spark), items).count() == edge_docs(spark).count()
    twice = spark.createDataFrame([(1, "a b. c d"), (1, "a b. c d")], "item_id bigint, text string")
    docs = spark.createDataFrame([(5, "so a b c d it is"), (5, "so a b c d it is"), (None, "a b c d")], "doc_id bigint, text string")
    assert sorted(map(str, (r["doc_id"] for r in find_leaks(docs, twice).collect()))) == ["5", "5", "None"]
    assert re.match(r"0\.\d", str(THRESHOLD))


def test_blocks_change_nothing(spark, monkeypatch):
    """Partly changed items near the threshold, found with their scores by one index as by many."""
    from textloom.llm import decontam

    rng = random.Random(12)
    items = table(spark, SF, "benchmark")
    pool = [r["text"] for r in items.orderBy("item_id").collect()]
    docs = []
    for k in range(400):
        words = rng.choice(pool).split()
        changed = [w if rng.random() < 0.75 else rng.choice(rng.choice(pool).split()) for w in words]
        docs.append((k, " ".join(["start", "of", "it"] * 5 + changed + ["and", "more"] * 9)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["first_word"]) for r in find_leaks(df, items).collect())
    whole = rows()
    total = sum(len(t.encode()) for t in pool)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", total // 6)
    assert 20 < len(whole) < 400 and rows() == whole


def test_band_counts_are_those_of_one_index():
    items = [(k, " ".join(f"w{(k * j) % 23}" for j in range(1, 9))) for k in range(12)]
    whole = ItemIndex(items, 0.3)
    band = BandCounts.of([Counter(words_of(t)) for _, t in items])
    halves = [ItemIndex(items[:5], 0.3, band), ItemIndex(items[5:], 0.3, band)]
    for _, text in items:
        asked = set(words_of(text)[:5])
        ids = lambda x: {x.ids[i]: round(s, 9) for i, s in x.retrieve(asked)}
        assert ids(whole) == ids(halves[0]) | ids(halves[1])
