"""Long texts in the classifier's training sample."""

from pyspark.sql import functions as F

from textloom.llm import quality_cnn
from textloom.llm.quality_cnn import SHARES, STRETCHES, ByteNetwork, held_out, train_network


def test_a_long_text_leaves_no_class_empty(spark, monkeypatch):
    monkeypatch.setattr(quality_cnn, "SAMPLE_BYTES", 1 << 16)
    ids = [r["id"] for r in spark.range(60).where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").collect()][:20]
    long = "".join(f"{k:08d}" for k in range(10_000))  # more than all bytes of a class; its id comes first
    rows = [(i, long if k == 0 else f"good text number {i} " * 20, 1) for k, i in enumerate(ids[:10])]
    rows += [(i, f"%% $$ {i} ## " * 20, 0) for i in ids[10:]]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    taught = []
    monkeypatch.setattr(ByteNetwork, "train", lambda self, batches, y: taught.extend(zip(batches, y.tolist())))
    train_network(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    assert [y for _, y in taught] == [0] * 10 + [1] * 10
    whole = {t.encode() for _, t, _ in rows if t != long}
    assert {b for b, _ in taught if b in whole} == whole
    (part,) = [b for b, _ in taught if b not in whole]
    stretch = (1 << 16) // (SHARES * STRETCHES)
    parts = [part[k : k + stretch] for k in range(0, len(part), stretch)]
    places = [long.encode().index(x) for x in parts]
    assert len(parts) == STRETCHES and places == sorted(places) and places[0] == 0 and places[-1] == len(long) - stretch
