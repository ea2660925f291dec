"""The pipeline's stages, each on what its predecessor kept, against the operators' own rules in plain Python."""

import re
import sys

import sentencepiece
from edge import edge_docs, no_docs

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline  # noqa: E402
from test_ngram_join import brute  # noqa: E402

from textloom.llm.common import tokenizer_path  # noqa: E402
from textloom.llm.decontam import words_of  # noqa: E402
from textloom.llm.quality_cnn import score_quality, train_network  # noqa: E402
from textloom.session import cut_lineage, table  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_one_after_another(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "test_items", "personal_data", "pieces"]
    kept = {}
    at = docs
    for name, stage in stages.items():
        at = cut_lineage(stage(spark, at, SF))
        kept[name] = at
        if name != "pieces":
            assert at.columns == docs.columns

    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    good = score_quality(docs, train_network(docs, table(spark, SF, "labels"))).where("predicted = 1")
    assert ids(kept["quality"]) == ids(good)
    groups = brute([(r["doc_id"], r["text"]) for r in kept["quality"].collect()])
    assert ids(kept["near_duplicates"]) == {i for i, (n, c) in groups.items() if c == i or n == 0}
    norm = lambda t: f" {' '.join(words_of(t))} "
    items = [norm(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = {r["doc_id"] for r in kept["near_duplicates"].collect() if not any(t in norm(r["text"]) for t in items)}
    assert ids(kept["test_items"]) == clean
    before = {r["doc_id"]: r["text"] for r in kept["test_items"].collect()}
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept["personal_data"].collect()}
    assert after.keys() == before.keys()
    assert any(re.search(email, t) for t in before.values())
    for i, (t, n) in after.items():
        assert not re.search(email, t) and n == len(t)
        assert t.count("[EMAIL]") == len(list(re.finditer(email, before[i])))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in kept["pieces"].collect():
        assert r["ids"] == sp.encode(after[r["doc_id"]][0], add_bos=True, add_eos=True) and r["n_tokens"] == len(r["ids"])
    assert kept["pieces"].count() == len(after)


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < rows.count() <= 200


def test_edge_tables_pass_all_stages(spark):
    for docs in (edge_docs(spark), no_docs(spark)):
        at, n = docs, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            at = cut_lineage(stage(spark, at, SF))
            assert at.count() <= n
            n = at.count()
