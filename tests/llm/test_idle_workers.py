"""What tasks leave in the Python processes that Spark keeps for later tasks."""

import pandas as pd

from textloom.llm import common, pieces


def test_pieces_leave_no_memos(spark):
    docs = spark.createDataFrame([(i, f"some words, number{i} of them") for i in range(300)], "doc_id long, text string")
    assert pieces.encode_pieces(docs).count() == 300
    assert pieces.encode_pieces(docs, keep_ids=True).where("size(ids) = n_tokens").count() == 300

    def held(batches):
        for _ in batches:
            c = pieces.coder(common.tokenizer_path(pieces.MODEL))
            yield pd.DataFrame({"n": [len(c.pairs) + len(c.chunks) + len(c.older)]})

    found = spark.range(0, 32, 1, 32).mapInPandas(held, "n long").collect()
    assert len(found) == 32 and not any(r["n"] for r in found)


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append("back"))
    run = common.tidied(lambda xs: (2 * x for x in xs), lambda: calls.append("end"))
    assert list(run(iter([1, 2, 3]))) == [2, 4, 6] and calls == ["end", "back"]
    stopped = run(iter([1, 2]))
    assert next(stopped) == 2 and len(calls) == 2
    stopped.close()  # a limit was reached
    assert calls == ["end", "back"] * 2
