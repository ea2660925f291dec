"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.decontam import find_leaks
from textloom.llm.fill_middle import fill_middle_digest
from textloom.llm.licenses import scan_licenses
from textloom.llm.lm_scores import score_all_words
from textloom.llm.multi_index import nearest
from textloom.llm.ngram_join import join_documents
from textloom.llm.pieces import encode_pieces
from textloom.llm.pii import pii_digest
from textloom.llm.quality_cnn import score_quality, train_network
from textloom.llm.sharding import shard_documents
from textloom.llm.spelling import spelling_groups
from textloom.llm.token_counts import token_counts
from textloom.llm.token_store import stored_tokens
from textloom.session import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        LLM_QUERIES[key] = fn
        if sql is not None:
            LLM_ORACLES[key] = sql
        return fn

    return deco


@register("op1_decontam")
def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_lm_scores")
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_all_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))


@register("op3_pieces")
def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))


_LINKS_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+3], ' '))) END) AS s FROM w),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, link.y FROM reach JOIN link ON link.x = reach.r),
comp AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(size.n, 0) AS n_shingles, comp.component_id FROM w LEFT JOIN size ON size.doc_id = w.doc_id LEFT JOIN comp ON comp.d = w.doc_id"""


@register("op4_ngram_join", _LINKS_SQL)
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


@register("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@register("op6_quality_cnn")
def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_network(docs, table(spark, sf_dir, "labels")))


@register("op7_licenses")
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


@register("op9_multi_index")
def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@register("op11_token_store")
def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tokens(spark, table(spark, sf_dir, "documents"))


@register("op12_fill_middle")
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle_digest(table(spark, sf_dir, "documents"))


@register("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))
