"""Structured Streaming variants: incremental page ingest, per-key budgets, chunk assembly,
frontier growth.

Every query writes to a sink under the shared checkpoint folder with its own checkpoint
location, so a restarted or retried query resumes exactly once. ``run_available`` drains
what is available (``availableNow``) and returns the sink as a batch DataFrame.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.functions.html import html_text
from textloom.functions.text import char_count, count_tokens
from textloom.functions.urls import normalize_url, url_netloc
from textloom.operators.ordered import running_totals
from textloom.session import cut_lineage, ensure_checkpoint_dir


def _scratch(spark: SparkSession, name: str) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream over a parquet table. A file path is read as its folder filtered to that file
    name (the file source watches folders)."""
    import os

    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
    if path.endswith(".parquet") and not os.path.isdir(path):
        folder, name = os.path.split(path)
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)


def page_stream(spark: SparkSession, pages_path: str) -> DataFrame:
    return table_stream(spark, pages_path)


def run_available(df: DataFrame, name: str, mode: str = "append", foreach_batch=None) -> DataFrame:
    """Drain the stream into a parquet sink and return the sink as a batch DataFrame."""
    spark = df.sparkSession
    base = _scratch(spark, name)
    w = df.writeStream.option("checkpointLocation", base + "/_ckpt").trigger(availableNow=True).outputMode(mode)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format("parquet").option("path", base + "/out").start()
    q.awaitTermination()
    if foreach_batch is not None:
        return None
    return spark.read.parquet(base + "/out")


def stream_pages(spark: SparkSession, pages_path: str, watermark_col: str | None = None, delay: str | None = None) -> DataFrame:
    """K1: each normalized URL processed once, ever (state keeps the URLs seen). With an
    event-time column and a ``delay``, ``dropDuplicatesWithinWatermark`` bounds the state. The page of a
    URL that comes first is the one processed."""
    if (watermark_col is None) != (delay is None):
        raise ValueError("a watermark needs both a column and a delay")
    extra = [watermark_col] if watermark_col else []
    s = page_stream(spark, pages_path).select("page_id", normalize_url("url").alias("url"), "html", *extra)
    if watermark_col:
        s = s.withWatermark(watermark_col, delay).dropDuplicatesWithinWatermark(["url"])
    else:
        s = s.dropDuplicates(["url"])
    out = s.select("page_id", "url", url_netloc("url").alias("host"), html_text("html").alias("content"))
    return out.withColumn("token_size", count_tokens("content")).withColumn("char_size", char_count("content"))


SNAPSHOT_EVERY = 16  # batches after which the totals of all hosts are written, not just of those that changed


def _totals_before(spark: SparkSession, base: str, batch_id: int) -> DataFrame | None:
    """The last totals of each host before a batch: what batches since the last whole snapshot wrote."""
    first = max((batch_id // SNAPSHOT_EVERY) * SNAPSHOT_EVERY - 1, 0)
    if first >= batch_id:
        return None
    written = [
        spark.read.parquet(f"{base}/totals/batch={k}").withColumn("batch", F.lit(k)) for k in range(first, batch_id)
    ]
    every = reduce(DataFrame.unionByName, written)
    latest = every.groupBy("host").agg(F.max_by(F.struct("tokens", "chars", "closed"), "batch").alias("t"))
    return latest.select("host", "t.tokens", "t.chars", "t.closed")


def budget_batch(rows: DataFrame, batch_id: int, base: str, limit_token: int | None, limit_char: int | None) -> None:
    """One micro-batch of the budget: hosts that are closed are left out, running totals of the others' rows (a host
    with most rows spreads over all tasks) start at what the host has used, and rows up to the first that
    exceeds a limit are written below ``base``. A batch that runs again writes the same once more."""
    spark = rows.sparkSession
    narrow = rows.select("host", "url", F.col("token_size").cast("long"), F.col("char_size").cast("long"))
    before = _totals_before(spark, base, batch_id)
    if before is None:
        before = spark.createDataFrame([], "host string, tokens long, chars long, closed boolean")
    before = cut_lineage(before)
    done = before.where("closed").select(F.col("host").alias("done"))
    left = narrow.join(done, narrow["host"].eqNullSafe(done["done"]), "left_anti")
    sized = running_totals(left, ["host"], ["url"], {"t": F.col("token_size"), "c": F.col("char_size")})
    used = before.select(F.col("host").alias("known"), "tokens", "chars")
    at = lambda total, used: F.col(total) + F.coalesce(used, F.lit(0).cast("long"))
    placed = sized.join(used, sized["host"].eqNullSafe(used["known"]), "left").withColumns({"t": at("t", "tokens"), "c": at("c", "chars")})
    fits = F.lit(True)
    for total, limit in (("t", limit_token), ("c", limit_char)):
        fits = fits if limit is None else fits & (F.col(total) <= limit)
    placed = cut_lineage(placed.select("host", "url", "token_size", "char_size", "t", "c", "tokens", "chars", fits.alias("fits")))
    placed.where("fits").select("host", "url", "token_size", "char_size").write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
    spent = lambda total, used: F.coalesce(F.max(F.when(F.col("fits"), F.col(total))), F.max(used), F.lit(0)).cast("long")
    totals = placed.groupBy("host").agg(spent("t", "tokens").alias("tokens"), spent("c", "chars").alias("chars"), (~F.min("fits")).alias("closed"))
    if (batch_id + 1) % SNAPSHOT_EVERY == 0:
        changed = totals.select(F.col("host").alias("changed"))
        totals = totals.unionByName(before.join(changed, before["host"].eqNullSafe(changed["changed"]), "left_anti"))
    totals.write.mode("overwrite").parquet(f"{base}/totals/batch={batch_id}")


def stream_budget(pages: DataFrame, limit_token: int | None, limit_char: int | None = None, base: str | None = None) -> DataFrame:
    """K2: per host, accept pages until the first one that would exceed a budget; then the host is closed for
    good. Takes what is available and returns all rows accepted so far; a later call with the same ``base``
    goes on where the last one ended.

    Rows of a micro-batch are taken in URL order. Sizes are not null or negative; a null host is a host; a
    limit of None does not limit. What is kept between batches is one row of totals a host. Batches are cut by
    :func:`budget_batch` instead of a keyed stateful operator, as that would bring all rows of a host to
    one task."""
    spark = pages.sparkSession
    base = base or _scratch(spark, "budget")
    wanted = pages.select("host", "url", "token_size", "char_size")
    w = wanted.writeStream.option("checkpointLocation", base + "/_ckpt").trigger(availableNow=True)
    w.foreachBatch(lambda rows, k: budget_batch(rows, k, base, limit_token, limit_char)).start().awaitTermination()
    schema = "host string, url string, token_size long, char_size long"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(base + "/out")


CHUNK_OUT = "answer_id bigint, part bigint, text string, finish_reason string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChunkAssembler(StatefulProcessor):
    """Chunks of an answer wait in a map by ``seq`` until their part is whole; each is written once.

    With ``gapless`` chunks are numbered from ``first`` without gaps, and a part is whole when every chunk up
    to its finish reason is there. Otherwise it is whole ``grace_ms`` after its finish reason arrived, or at
    once without a grace."""

    def __init__(self, gapless: bool, first: int, grace_ms: int | None, timeout_ms: int | None):
        self.gapless, self.first, self.grace_ms, self.timeout_ms = gapless, first, grace_ms, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq bigint", "text string, finish_reason string")
        # part: number of the part at hand; next: all before it were given out; held: chunks in the map
        self.place = handle.getValueState("place", "part bigint, next bigint, held bigint, idle bigint")
        self.due = handle.getMapState("due", "seq bigint", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        part, after, held, idle = self.place.get() if self.place.exists() else (0, self.first if self.gapless else None, 0, None)
        new = {}
        for pdf in rows:
            for seq, text, reason in zip(pdf["seq"], pdf["text"], pdf["finish_reason"]):
                new[int(seq)] = (None if pd.isna(text) else text, None if pd.isna(reason) else reason)
        late = sorted(s for s in new if after is not None and s < after)
        out = [(int(key[0]), None, "".join(new.pop(s)[0] or "" for s in late), "late")] if late else []
        made, after, kept, held = (self._gapless if self.gapless else self._by_finish)(new, after, held, timerValues)
        for text, reason in made:
            out.append((int(key[0]), part, text, reason))
            part += 1
        for seq, value in kept.items():
            self.waiting.updateValue((seq,), value)
        if self.timeout_ms is not None:
            if idle is not None:
                self.handle.deleteTimer(idle)
            idle = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(idle)
        self.place.update((part, after, held + len(kept), idle))
        yield self._frame(out)

    def _gapless(self, new, after, held, timer_values):
        """Parts that are whole now, and the new chunks that wait: those behind a gap or after the last finish."""
        made, pieces, at, taken = [], [], after, []
        while at in new or held and self.waiting.containsKey((at,)):
            if at in new:
                text, reason = new[at]
            else:
                text, reason = self.waiting.getValue((at,))
                taken.append(at)
            pieces.append(text or "")
            at += 1
            if reason is not None:
                made.append(("".join(pieces), reason))
                for s in taken:
                    self.waiting.removeKey((s,))
                held -= len(taken)
                after, pieces, taken = at, [], []
        return made, after, {s: v for s, v in new.items() if s >= after}, held

    def _by_finish(self, new, after, held, timer_values):
        ends = sorted(s for s, (_, reason) in new.items() if reason is not None)
        if not ends:
            return [], after, new, held
        if self.grace_ms is not None:
            at = timer_values.getCurrentProcessingTimeInMs() + self.grace_ms
            self.handle.registerTimer(at)
            for s in ends:
                self.due.updateValue((s,), (at,))
            return [], after, new, held
        return self._cut(new, ends[-1], held)

    def _cut(self, new, upto, held):
        """Parts of all chunks up to ``upto``, the new ones and those that wait."""
        chunks = dict(new)
        if held:
            old = {k[0]: tuple(v) for k, v in self.waiting.iterator() if k[0] <= upto}
            for s in old:
                self.waiting.removeKey((s,))
            held -= len(old)
            chunks = old | chunks
        made, pieces = [], []
        for s in sorted(s for s in chunks if s <= upto):
            text, reason = chunks[s]
            pieces.append(text or "")
            if reason is not None:
                made.append(("".join(pieces), reason))
                pieces = []
        return made, upto + 1, {s: v for s, v in new.items() if s > upto}, held

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out, now = [], expiredTimerInfo.getExpiryTimeInMs()
        if self.place.exists():
            part, after, held, idle = self.place.get()
            ends = sorted(k[0] for k, v in self.due.iterator() if v[0] <= now) if self.grace_ms is not None else []
            if ends:
                for s in ends:
                    self.due.removeKey((s,))
                made, after, _, held = self._cut({}, ends[-1], held)
                for text, reason in made:
                    out.append((int(key[0]), part, text, reason))
                    part += 1
                self.place.update((part, after, held, idle))
            if idle is not None and idle <= now:
                rest = sorted((k[0], v[0] or "") for k, v in self.waiting.iterator())
                if rest:
                    out.append((int(key[0]), part, "".join(t for _, t in rest), None))
                self.waiting.clear()
                self.due.clear()
                self.place.clear()
        yield self._frame(out)

    def _frame(self, out):
        return pd.DataFrame(out, columns=["answer_id", "part", "text", "finish_reason"]).astype({"answer_id": "int64", "part": "Int64"})

    def close(self) -> None:
        pass


def stream_chunks(
    chunks: DataFrame, timeout_ms: int | None = 3_600_000, gapless: bool = False, first: int = 0, grace_ms: int | None = None
) -> DataFrame:
    """K3: chunk texts of an answer in the order of ``seq``, one row for each finish reason:
    ``answer_id, part, text, finish_reason``.

    Chunks may come in any order over any number of batches: see :class:`ChunkAssembler` for when a part is
    whole. A chunk that comes after its part was given out is a row of its own, ``late`` with a null part. A
    ``seq`` that comes twice counts once, null texts count as nothing. After ``timeout_ms`` without a chunk
    what waits is given out with a null finish reason and the answer's state goes."""
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = timeout_ms is not None or grace_ms is not None
    return chunks.select("answer_id", "seq", "text", "finish_reason").groupBy("answer_id").transformWithStateInPandas(
        ChunkAssembler(gapless, first, grace_ms, timeout_ms), CHUNK_OUT, "append", "processingTime" if timed else "none"
    )


def stream_frontier(spark: SparkSession, pages_path: str, link_scope: str = "all") -> DataFrame:
    """K4: landed pages contribute their link targets, each target once; the state keeps the targets
    seen, so a batch costs what it brings, not what was found before."""
    from textloom.plans.web_jobs import page_links

    pages = page_stream(spark, pages_path).select("page_id", normalize_url("url").alias("url"), "html")
    links = page_links(pages, link_scope).select(F.col("link").alias("url"))
    return run_available(links.dropDuplicates(["url"]), "frontier")
