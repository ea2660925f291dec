"""Registered streaming queries: each drains the stream over the given table and returns
the sink contents."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from textloom import sqltext as Q
from textloom.plans.web_jobs import _SQL_LINKS, _SQL_PAGES
from textloom.registry import register
from textloom.sources.views import SQL_CHUNKS
from textloom.streaming.streams import table_stream, run_available, stream_budget, stream_chunks, stream_frontier, stream_pages


@register("stream_pages", f"WITH {_SQL_PAGES} SELECT page_id, url, host, token_size, char_size FROM sized")
def q_stream_pages(spark, sf_dir):
    out = run_available(stream_pages(spark, os.path.join(sf_dir, "pages.parquet")), "pages")
    return out.select("page_id", "url", "host", "token_size", "char_size")


@register("stream_budget", f"""WITH {_SQL_PAGES},
run AS (SELECT *, sum(token_size) OVER (PARTITION BY host ORDER BY url ROWS UNBOUNDED PRECEDING) AS ct FROM sized)
SELECT host, url, token_size, char_size FROM run WHERE ct <= 2000""")
def q_stream_budget(spark, sf_dir):
    pages = stream_pages(spark, os.path.join(sf_dir, "pages.parquet"))
    return stream_budget(pages, 2000)


@register("stream_chunks", f"""WITH {SQL_CHUNKS},
g AS (SELECT *, coalesce(sum(CASE WHEN finish_reason IS NOT NULL THEN 1 ELSE 0 END)
        OVER (PARTITION BY answer_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM chunks)
SELECT answer_id, CAST(part AS BIGINT) AS part, string_agg(text, '' ORDER BY seq) AS text, arg_max(finish_reason, seq) AS finish_reason
FROM g GROUP BY answer_id, part HAVING count(finish_reason) > 0""")
def q_stream_chunks(spark, sf_dir):
    ev = os.path.join(sf_dir, "events.parquet")
    s = table_stream(spark, ev)
    ch = s.select(
        F.col("user_id").alias("answer_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"),
        F.when(F.col("event_type") == "error", F.lit("length")).when(F.col("event_id") % 10 == 0, F.lit("stop")).alias("finish_reason"),
    )
    return run_available(stream_chunks(ch, timeout_ms=None), "chunks")


@register("stream_frontier", f"WITH {_SQL_PAGES}, {_SQL_LINKS} SELECT DISTINCT link AS url FROM links")
def q_stream_frontier(spark, sf_dir):
    return stream_frontier(spark, os.path.join(sf_dir, "pages.parquet"))
