"""Document jobs: text scalars, ordered concatenation, packing of documents per source,
segment numbering and result summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import sqltext as Q
from textloom.functions.text import (
    CODE_BLOCK_PATTERN,
    char_count,
    count_tokens,
    extract_code,
    fmt_number,
    format_content,
    line_count,
    strip_nul,
    truncate_text,
)
from textloom.operators.ordered import pack_segments
from textloom.registry import register
from textloom.session import ensure_checkpoint_dir, table
from textloom.sources.sinks import segment_sink
from textloom.sources.views import SQL_ANSWERS, answers

DOC_MAX_TOKEN = 20_000  # the "chatgpt" preset budget


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as code blocks named ``source/lang/doc_id.txt``, one group per source."""
    d = table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    items = d.select("source", "doc_id", format_content(name, "text", "code").alias("content"))
    return items.withColumn("token", count_tokens("content")).withColumn("chars", char_count("content"))


def doc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_segments(doc_items(spark, sf_dir), ["source"], ["doc_id"], max_token=DOC_MAX_TOKEN, max_char=None)


_SQL_DOC_ITEMS = f"""items AS (
  SELECT source AS grp, doc_id AS ord,
         {Q.format_content("source || '/' || lang || '/' || doc_id || '.txt'", 'text', 'code')} AS content FROM documents),
sized AS (SELECT grp, ord, content, {Q.tokens('content')} AS tok, CAST(length(content) AS BIGINT) AS chr FROM items)"""


def _doc_pack_sql(final: str) -> str:
    return f"""WITH RECURSIVE {_SQL_DOC_ITEMS},
{Q.greedy_pack('sized', DOC_MAX_TOKEN, 999_999_999)},
segs AS (SELECT i.grp AS source, s.seg, string_agg(i.content, '' ORDER BY i.ord) AS content,
            CAST(sum(i.tok) AS BIGINT) AS token, CAST(sum(i.chr) AS BIGINT) AS chars, count(*) AS n_items
         FROM sized i JOIN packed_seg s ON s.grp = i.grp AND s.ord = i.ord GROUP BY 1, 2)
{final}"""


@register("count_tokens", f"SELECT doc_id, {Q.tokens('text')} AS tokens FROM documents")
def q_count_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", count_tokens("text").alias("tokens"))


@register("fmt_number", "SELECT doc_id, format('{:,}', n_chars) AS n_chars_fmt FROM documents")
def q_fmt_number(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fmt_number("n_chars").alias("n_chars_fmt"))


@register("truncate_text", """SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS short
FROM documents""")
def q_truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", truncate_text("text", 40).alias("short"))


@register("strip_nul", "SELECT doc_id, CAST(length(replace(text, chr(0), '')) AS BIGINT) AS chars FROM documents")
def q_strip_nul(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", char_count(strip_nul("text")).alias("chars"))


@register("extract_code", f"""WITH {SQL_ANSWERS}
SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '{CODE_BLOCK_PATTERN}', 1)) > 0
  THEN array_to_string(list_transform(regexp_extract_all(text, '{CODE_BLOCK_PATTERN}', 1), lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g')), chr(10) || chr(10) || chr(10))
  ELSE text END AS code FROM answers""")
def q_extract_code(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", extract_code("text").alias("code"))


@register("distinct_keys", """SELECT lang, count(DISTINCT source) AS n_sources, count(*) AS n_docs FROM documents GROUP BY lang""")
def q_distinct_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.countDistinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n_docs"))


@register("ordered_concat", """SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS joined_md5,
  CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS joined_chars FROM conversations GROUP BY conv_id""")
def q_ordered_concat(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.md5(F.expr("listagg(text, '\n\n') WITHIN GROUP (ORDER BY turn)")).alias("joined_md5"),
        (F.sum(F.length("text")) + 2 * (F.count(F.lit(1)) - 1)).cast("long").alias("joined_chars"),
    )


@register("latest_n", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def q_latest_n(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # ts orders the rows; it is not returned, so results do not depend on the session time zone
    return e.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(10).select("event_id", "event_type")


@register("prepend_header", """SELECT source, -1 AS ord, md5('### ' || source) AS content_md5 FROM (SELECT DISTINCT source FROM documents)
UNION ALL SELECT source, doc_id AS ord, md5(text) AS content_md5 FROM documents""")
def q_prepend_header(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    header = d.select("source").distinct().select("source", F.lit(-1).cast("long").alias("ord"),
                                                 F.concat(F.lit("### "), "source").alias("content"))
    body = d.select("source", F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    return header.unionByName(body).select("source", "ord", F.md5("content").alias("content_md5"))


@register("pack_segments", _doc_pack_sql("SELECT source, seg, md5(content) AS content_md5, token, chars, n_items FROM segs"))
def q_pack_segments(spark, sf_dir):
    p = doc_segments(spark, sf_dir)
    return p.select("source", "seg", F.md5("content").alias("content_md5"), "token", "chars", "n_items")


@register("segment_sink", _doc_pack_sql(f"""SELECT source, seg + 1 AS k, count(*) OVER (PARTITION BY source) AS n,
  'Chunk ' || (seg + 1) || ' of ' || count(*) OVER (PARTITION BY source) AS label,
  CAST(length(content) AS BIGINT) AS seg_chars, {Q.tokens('content')} AS seg_tokens FROM segs"""))
def q_segment_sink(spark, sf_dir):
    s = segment_sink(doc_segments(spark, sf_dir), ["source"])
    return s.select("source", "k", "n", "label", "seg_chars", "seg_tokens")


@register("text_sink", _doc_pack_sql("SELECT source, seg, md5(content) AS content_md5 FROM segs"))
def q_text_sink(spark, sf_dir):
    """Round trip: write packed segments partitioned by source, read them back."""
    import uuid

    from textloom.sources.sinks import text_sink

    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/sink-{uuid.uuid4().hex}"
    text_sink(doc_segments(spark, sf_dir), base, ["source"])
    back = spark.read.parquet(base)
    return back.select("source", "seg", F.md5("content").alias("content_md5"))


@register("result_summary", _doc_pack_sql(f"""SELECT source, CAST(length(string_agg(content, '' ORDER BY seg)) AS BIGINT) AS total_chars,
  CAST(len(string_split(string_agg(content, '' ORDER BY seg), chr(10))) AS BIGINT) AS total_lines,
  {Q.tokens("string_agg(content, '' ORDER BY seg)")} AS total_tokens, count(*) AS n_segments FROM segs GROUP BY source"""))
def q_result_summary(spark, sf_dir):
    """Totals over the joined segment text, computed per segment and combined: characters
    add; lines add minus one per join; tokens add because every segment starts and ends with
    a newline (no token spans a join)."""
    s = doc_segments(spark, sf_dir)
    per = s.select("source", char_count("content").alias("c"), line_count("content").alias("l"),
                   count_tokens("content").alias("t"))
    return per.groupBy("source").agg(
        F.sum("c").cast("long").alias("total_chars"),
        (F.sum("l") - F.count(F.lit(1)) + 1).cast("long").alias("total_lines"),
        F.sum("t").cast("long").alias("total_tokens"),
        F.count(F.lit(1)).alias("n_segments"),
    )
