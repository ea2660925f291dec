"""Chat-message shaping: provider formats, system instructions, chunk assembly, typed answers.

A conversation is ``(conv_id, turn, role, text)``; a request is an ordered
``array<struct<role, content>>``. Each aggregate is per conversation / per answer, i.e.
bounded by one dialogue; Catalyst runs them with partial + final aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import _c

# Roles and the one provider-specific rename.
ROLES = ("system", "user", "assistant")
MODEL_ROLE = "model"


def provider_messages(conv: DataFrame, provider: str = "openai") -> DataFrame:
    """Per-provider message rows. ``gemini``: system rows dropped, assistant → ``model``;
    ``openai``/``instructor``: pass-through."""
    if provider == "gemini":
        return conv.where(F.col("role") != "system").withColumn(
            "role", F.when(F.col("role") == "assistant", F.lit(MODEL_ROLE)).otherwise(F.col("role"))
        )
    return conv


def build_request(conv: DataFrame, provider: str = "openai", keys=("conv_id",), order: str = "turn") -> DataFrame:
    """Ordered ``messages array<struct<role, content>>`` per conversation."""
    m = provider_messages(conv, provider)
    arr = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("role").alias("role"), F.col("text").alias("content"))))
    return m.groupBy(*keys).agg(arr.alias("__m")).select(
        *keys, F.transform("__m", lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content"))).alias("messages")
    )


def system_instruction(conv: DataFrame, keys=("conv_id",), order: str = "turn") -> DataFrame:
    """All system messages joined by a blank line; ``null`` when there is none."""
    sys_text = F.when(F.col("role") == "system", F.col("text"))
    return conv.groupBy(*keys).agg(
        F.expr(f"listagg(CASE WHEN role = 'system' THEN text END, '\n\n') WITHIN GROUP (ORDER BY {order})").alias("__i"),
        F.count(sys_text).alias("__n"),
    ).select(*keys, F.when(F.col("__n") > 0, F.col("__i")).alias("instruction"))


def assemble_chunks(chunks: DataFrame, key: str = "answer_id", seq: str = "seq") -> DataFrame:
    """Non-null chunk texts concatenated in order; finish reason of the last chunk."""
    return chunks.groupBy(key).agg(
        F.expr(f"listagg(text, '') WITHIN GROUP (ORDER BY {seq})").alias("text"),
        F.max_by("finish_reason", seq).alias("finish_reason"),
        F.count(F.lit(1)).alias("n_chunks"),
    )


ANSWER_SCHEMA = T.StructType([T.StructField("code", T.StringType()), T.StructField("score", T.DoubleType())])


def to_struct(text, schema: T.StructType | str) -> Column:
    """Text → typed record; malformed input gives null fields (PERMISSIVE)."""
    return F.from_json(_c(text), schema, {"mode": "PERMISSIVE"})


def valid_answer(code, score) -> Column:
    """Typed-answer constraints: code has at least one character, 0 < score < 100."""
    return F.coalesce((F.length(_c(code)) >= 1) & (_c(score) > 0) & (_c(score) < 100), F.lit(False))
