"""Streams in several micro-batches, out of order and restarted, against batch operators and plain rules."""

import os
import random

from pyspark.sql import functions as F
from sf_tables import SF

from textloom.operators.ordered import budget_cutoff
from textloom.plans.web_jobs import scraped
from textloom.streaming.streams import SNAPSHOT_EVERY, budget_batch, run_available, stream_budget, stream_chunks, stream_pages

PAGES = "host string, url string, token_size long, char_size long"


def _pages(rnd, b, n):
    hosts = ["hot"] * 5 + ["a", "b", "c", None, f"new{b}"]
    return [(rnd.choice(hosts), f"u{b:02d}-{k:04d}", rnd.choice([0, 1, 5, 30]), rnd.randint(0, 9)) for k in range(n)]


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def _land(spark, folder, b, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _key(df):
    return sorted((r.host or "", r.url) for r in df.select("host", "url").collect())


def test_budget_over_batches_and_a_restart(spark, tmp_path):
    """Three batches, of which a host holds half; the stream ends after the first and goes on with the others."""
    rnd = random.Random(3)
    folder, base = str(tmp_path / "pages"), str(tmp_path / "budget")
    batches = [_pages(rnd, b, 60) for b in range(3)]
    got = []
    for b, rows in enumerate(batches):
        _land(spark, folder, b, rows, PAGES)
        got.append(_key(stream_budget(_stream(spark, folder, PAGES), 300, 400, base)))
    every = spark.createDataFrame([(b, *r) for b, rows in enumerate(batches) for r in rows], "b int, " + PAGES)
    want = lambda n: _key(budget_cutoff(every.where(F.col("b") < n), ["host"], ["b", "url"], limit_token=300, limit_char=400))
    assert got == [want(1), want(2), want(3)]
    assert got[0] and len(got[2]) > len(got[0]) and len(got[2]) < 180


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rnd, base = random.Random(4), str(tmp_path / "b")
    batches = [spark.createDataFrame(_pages(rnd, b, 12), PAGES) for b in range(3)]
    out = lambda: _key(spark.read.schema(PAGES).option("recursiveFileLookup", True).parquet(base + "/out"))
    for k, rows in enumerate(batches):
        budget_batch(rows, k, base, 60, None)
        first = out()
        budget_batch(rows, k, base, 60, None)
        assert out() == first


def test_totals_pass_a_snapshot(spark, tmp_path, monkeypatch):
    from textloom.streaming import streams

    monkeypatch.setattr(streams, "SNAPSHOT_EVERY", 2)
    base, rows = str(tmp_path / "b"), [("h", "u", 10, 1)]
    for k in range(5):
        budget_batch(spark.createDataFrame([(f"h{k}", "u", 1, 1)] + ([("h", "u", 10, 1)] if k in (0, 4) else []), PAGES), k, base, 15, None)
    got = spark.read.schema(PAGES).option("recursiveFileLookup", True).parquet(base + "/out")
    assert _key(got) == [("h", "u"), *((f"h{k}", "u") for k in range(5))] and rows and SNAPSHOT_EVERY > 2


def test_stream_budget_equals_batch(spark):
    batch = budget_cutoff(scraped(spark, SF), ["host"], ["url"], limit_token=1500)
    stream = stream_budget(stream_pages(spark, os.path.join(SF, "pages.parquet")), 1500)
    assert _key(batch) == _key(stream)


CHUNKS = "answer_id bigint, seq bigint, text string, finish_reason string"


def _parts(chunks):
    out, by = [], {}
    for a, s, t, f in chunks:
        by.setdefault(a, {})[s] = (t, f)
    for a, seqs in by.items():
        part, text = 0, ""
        for s in sorted(seqs):
            t, f = seqs[s]
            text += t or ""
            if f is not None:
                out.append((a, part, text, f))
                part, text = part + 1, ""
    return sorted(out)


def test_chunks_out_of_order_over_batches(spark, tmp_path):
    """Numbered chunks of each answer in any order over five batches, one number twice."""
    rnd = random.Random(5)
    chunks = [
        (a, s, None if rnd.random() < 0.1 else f"<{a}.{s}>", rnd.choice(["stop", "length"]) if s % rnd.choice([4, 5]) == 3 or s == 29 else None)
        for a in range(6) for s in range(30)
    ]
    mixed = rnd.sample(chunks, len(chunks)) + [chunks[7]]
    folder = str(tmp_path / "chunks")
    for k in range(5):
        _land(spark, folder, k, mixed[k::5], CHUNKS)
    got = run_available(stream_chunks(_stream(spark, folder, CHUNKS), timeout_ms=None, gapless=True), "t_chunks")
    rows = sorted(tuple(r) for r in got.where("part is not null").collect())
    assert rows == _parts(chunks)
    assert got.where("part is null and finish_reason <> 'late'").count() == 0


def test_chunks_with_gaps_in_their_numbers(spark, tmp_path):
    """Without a grace a part ends with the batch that brings its finish reason; what comes later is late."""
    folder = str(tmp_path / "chunks")
    batches = [
        [(1, 20, "b", None), (1, 10, "a", None), (2, 5, "x", "stop"), (2, 3, "w", None), (2, 9, "y", None)],
        [(1, 30, "c", "stop"), (1, 40, "d", None), (2, 12, "z", "length")],
        [(1, 25, "!", None), (1, 50, "e", "stop")],
    ]
    got = []
    base = str(tmp_path / "s")
    for k, rows in enumerate(batches):
        _land(spark, folder, k, rows, CHUNKS)
        q = stream_chunks(_stream(spark, folder, CHUNKS), timeout_ms=None).writeStream.option("checkpointLocation", base + "/c")
        q.outputMode("append").format("parquet").option("path", base + "/out").trigger(availableNow=True).start().awaitTermination()
        got.append(sorted((tuple(r) for r in spark.read.parquet(base + "/out").collect()), key=repr))
    assert got[0] == [(2, 0, "wx", "stop")]
    assert got[1] == [(1, 0, "abc", "stop"), (2, 0, "wx", "stop"), (2, 1, "yz", "length")]
    assert set(got[2]) - set(got[1]) == {(1, 1, "de", "stop"), (1, None, "!", "late")}


def test_chunks_wait_for_a_grace_and_idle_answers_go(spark, tmp_path):
    """A late chunk takes its place while the grace lasts; then the part is given out, and later the rest."""
    import time

    folder, base = str(tmp_path / "chunks"), str(tmp_path / "s")
    _land(spark, folder, 0, [(1, 10, "a", None), (1, 30, "c", "stop"), (1, 40, "rest", None)], CHUNKS)
    s = stream_chunks(_stream(spark, folder, CHUNKS), timeout_ms=24_000, grace_ms=16_000)
    q = s.writeStream.option("checkpointLocation", base + "/c").outputMode("append").format("parquet").option("path", base + "/out").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while not q.lastProgress or q.lastProgress["batchId"] < 0 or not any(p["numInputRows"] for p in q.recentProgress):
            assert time.time() < end
            time.sleep(0.2)
        _land(spark, folder, 1, [(1, 20, "b", None)], CHUNKS)
        want = [(1, 0, "abc", "stop"), (1, 1, "rest", None)]
        end = time.time() + 90
        while time.time() < end:
            time.sleep(1)
            got = sorted(tuple(r) for r in spark.read.schema("answer_id bigint, part bigint, text string, finish_reason string").parquet(base + "/out").collect())
            if len(got) == 2:
                break
        assert got == want
    finally:
        q.stop()
