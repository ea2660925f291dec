"""Batch generation with a caller-supplied function (no network client is shipped).

``generate(messages: list[dict], attempt=n, **opts) -> (text, finish_reason)`` is called inside
``mapInPandas``: one client per partition, rows flow in Arrow batches, failures are retried
with backoff and end as ``status='error'`` rows instead of failing the job.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import cut_lineage

# Retry policies (tries, waits in seconds).
LONG_RETRY = (30, (1, 2, 4, 8) + (10,) * 25)
SHORT_RETRY = (3, (1, 2))
CONTINUE_PROMPT = "Please continue from where you left off."

GEN_SCHEMA = T.StructType(
    [
        T.StructField("answer", T.StringType()),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("tries", T.IntegerType()),
        T.StructField("rounds", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


def _call_with_retry(fn, messages, opts, policy, sleep):
    tries, waits = policy
    last = None
    for k in range(tries):
        try:
            return fn(messages, attempt=k + 1, **opts), k + 1, None
        except Exception as e:  # noqa: BLE001 - any client error is retried
            last = e
            if k < tries - 1:
                sleep(waits[min(k, len(waits) - 1)])
    return None, tries, f"{type(last).__name__}: {last}"


def batch_generate(
    requests: DataFrame,
    generate: Callable,
    keys: list[str],
    messages_col: str = "messages",
    options: dict | None = None,
    retry: tuple = SHORT_RETRY,
    max_rounds: int | None = 1,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Run ``generate`` over every request row (J1), with retries (J2) and, when
    ``max_rounds > 1`` or None (no bound), continuation of answers cut at the length limit (J3): the partial
    answer and a continue turn are appended and the call repeats; texts are concatenated."""
    opts = dict(options or {})
    in_cols = [*keys, messages_col]
    out_schema = T.StructType([f for f in requests.select(*in_cols).schema.fields if f.name in keys] + GEN_SCHEMA.fields)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                raw = rec[messages_col]
                msgs = [] if raw is None else [dict(role=m["role"], content=m["content"]) for m in raw]
                text, reason, tries_total, err, rounds = "", None, 0, None, 0
                while max_rounds is None or rounds < max_rounds:
                    res, tries, err = _call_with_retry(generate, msgs, opts, retry, sleep)
                    tries_total += tries
                    rounds += 1
                    if err is not None:
                        break
                    part, reason = res
                    text += part or ""
                    if reason != "length":
                        break
                    msgs = msgs + [dict(role="assistant", content=part or ""), dict(role="user", content=CONTINUE_PROMPT)]
                rows.append({**{k: rec[k] for k in keys}, "answer": text if err is None else None,
                             "finish_reason": reason, "status": "ok" if err is None else "error",
                             "tries": tries_total, "rounds": rounds, "error": err})
            yield pd.DataFrame(rows, columns=out_schema.fieldNames())

    return requests.select(*in_cols).mapInPandas(run, out_schema)


def typed_generate(requests: DataFrame, generate: Callable, keys: list[str], schema: T.StructType, **kw) -> DataFrame:
    """J4: answers parsed into ``schema``; a mismatch leaves ``parsed`` null and is flagged."""
    out = batch_generate(requests, generate, keys, **kw)
    # PERMISSIVE parsing keeps malformed text in a corrupt-record field instead of failing
    with_corrupt = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("answer", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = F.col("__p").isNull() | F.col("__p._corrupt_record").isNotNull()
    return (
        out.withColumn("__p", parsed)
        .withColumn("status", F.when((F.col("status") == "ok") & bad, F.lit("invalid")).otherwise(F.col("status")))
        .withColumn("parsed", F.when(~bad, F.struct(*[F.col(f"__p.{f.name}").alias(f.name) for f in schema.fields])))
        .drop("__p")
    )


def prompt_stages(df: DataFrame, generate: Callable, stages: list[tuple[str, str]], **kw) -> DataFrame:
    """J5: a chain of (template, output column) stages; each template may reference input
    and earlier output columns as ``{name}``; each stage is one generation pass, whose answers
    are written once, so that later stages and readers see the same ones. Rows are told apart by
    a number of their own, so keys may be null or repeat."""
    import re

    cur = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
    for template, out_col in stages:
        names = re.findall(r"\{(\w+)\}", template)
        pieces = re.split(r"\{\w+\}", template)
        parts = []
        for i, p in enumerate(pieces):
            parts.append(F.lit(p))
            if i < len(names):
                parts.append(F.coalesce(F.col(names[i]).cast("string"), F.lit("")))
        prompt = F.concat(*parts)
        req = cur.select("__row", F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"))
        ans = batch_generate(req, generate, ["__row"], **kw).select("__row", F.col("answer").alias(out_col))
        cur = cur.join(cut_lineage(ans), "__row", "left")
    return cur.drop("__row")
