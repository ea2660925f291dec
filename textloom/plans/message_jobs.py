"""Message and generation jobs over ``conversations``, ``events`` and derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import extract_code
from textloom.operators.generate import batch_generate, prompt_stages, typed_generate
from textloom.operators.messages import (
    ANSWER_SCHEMA,
    assemble_chunks,
    build_request,
    provider_messages,
    system_instruction,
    to_struct,
    valid_answer,
)
from textloom.operators.predicates import needs_continuation, route_work
from textloom.registry import register
from textloom.session import table
from textloom.sources.views import SQL_CHUNKS, SQL_WORK, chunks, work


# Deterministic stand-ins for a caller's client (module-level so executors can unpickle them).
def echo_client(messages, attempt=1, **opts):
    """Answer = last user message upper-cased, cut to ``max_tokens`` characters when given."""
    last = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "") or ""
    limit = opts.get("max_tokens")
    if limit and len(last) > limit:
        return last[:limit].upper(), "length"
    return last.upper(), "stop"


def continuing_client(messages, attempt=1, **opts):
    """Returns the first user message in slices of ``max_tokens`` characters, one per call."""
    from textloom.operators.generate import CONTINUE_PROMPT

    first = next((m["content"] for m in messages if m["role"] == "user"), "") or ""
    # text already produced = assistant parts that were followed by the continue prompt
    done = sum(len(a["content"]) for a, b in zip(messages, messages[1:])
               if a["role"] == "assistant" and b["role"] == "user" and b["content"] == CONTINUE_PROMPT)
    limit = opts.get("max_tokens") or len(first)
    part = first[done:done + limit]
    return part, ("length" if done + limit < len(first) else "stop")


class FlakyError(RuntimeError):
    pass


def flaky_client(messages, attempt=1, **opts):
    """Fails on the first attempt for every request whose last user text has odd length."""
    last = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "") or ""
    if len(last) % 2 == 1 and attempt == 1:
        raise FlakyError("transient")
    return str(len(last)), "stop"


def json_client(messages, attempt=1, **opts):
    last = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "") or ""
    n = len(last)
    if n % 5 == 0:
        return "not json", "stop"
    return '{"code": "x = %d", "score": %d}' % (n, n % 120), "stop"


def _no_sleep(_s):
    return None


@register("drop_system", """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'model' ELSE role END AS role
FROM conversations WHERE role <> 'system'""")
def q_drop_system(spark, sf_dir):
    return provider_messages(table(spark, sf_dir, "conversations"), "gemini").select("conv_id", "turn", "role")


@register("system_instruction", """SELECT c.conv_id, s.instruction FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS instruction FROM conversations
           WHERE role = 'system' GROUP BY conv_id) s USING (conv_id)""")
def q_system_instruction(spark, sf_dir):
    return system_instruction(table(spark, sf_dir, "conversations"))


@register("build_request", """SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles,
  md5(string_agg(text, chr(1) ORDER BY turn)) AS contents_md5 FROM conversations GROUP BY conv_id""")
def q_build_request(spark, sf_dir):
    r = build_request(table(spark, sf_dir, "conversations"), "openai")
    return r.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "\u0001")).alias("contents_md5"),
    )


@register("assemble_chunks", f"""WITH {SQL_CHUNKS}
SELECT answer_id, string_agg(text, '' ORDER BY seq) AS text, arg_max_null(finish_reason, seq) AS finish_reason,
  count(*) AS n_chunks FROM chunks GROUP BY answer_id""")
def q_assemble_chunks(spark, sf_dir):
    return assemble_chunks(chunks(spark, sf_dir))


@register("needs_continuation", f"""WITH {SQL_CHUNKS}
SELECT answer_id, coalesce(arg_max_null(finish_reason, seq) = 'length', false) AS needs FROM chunks GROUP BY answer_id""")
def q_needs_continuation(spark, sf_dir):
    a = assemble_chunks(chunks(spark, sf_dir))
    return a.select("answer_id", needs_continuation("finish_reason").alias("needs"))


@register("to_struct_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q_to_struct_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", to_struct("props", "k int")["k"].alias("k"))


@register("valid_answers", """SELECT event_id, (length(event_type) >= 1 AND CAST(json_extract(props, '$.k') AS DOUBLE) > 0
  AND CAST(json_extract(props, '$.k') AS DOUBLE) < 100) AS valid FROM events""")
def q_valid_answers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rec = F.struct(F.col("event_type").alias("code"), to_struct("props", "k double")["k"].alias("score"))
    return e.select("event_id", valid_answer(rec["code"], rec["score"]).alias("valid"))


@register("route_work", f"""WITH {SQL_WORK}
SELECT doc_id, CASE WHEN has_diff AND coalesce(length(test_code) >= 20, false) AND round = 1 THEN 'from_diff'
  WHEN coalesce(length(test_code) >= 20, false) AND exit_code <> 0 THEN 'repair'
  WHEN coalesce(length(test_code) >= 20, false) THEN 'update' ELSE 'generate' END AS route FROM work""")
def q_route_work(spark, sf_dir):
    w = work(spark, sf_dir)
    return w.select("doc_id", route_work("has_diff", "test_code", "exit_code", "round").alias("route"))


@register("prompt_render", f"""WITH {SQL_WORK}
SELECT doc_id, md5('Target #' || doc_id || chr(10) || 'Current test:' || chr(10) || test_code) AS prompt_md5 FROM work""")
def q_prompt_render(spark, sf_dir):
    w = work(spark, sf_dir)
    p = F.format_string("Target #%d\nCurrent test:\n%s", F.col("doc_id"), F.col("test_code"))
    return w.select("doc_id", F.md5(p).alias("prompt_md5"))


def _requests(spark, sf_dir):
    return build_request(table(spark, sf_dir, "conversations"), "openai")


# the stub clients answer by the last user text; capital sharp s is written SS
_UPPER = lambda x: f"replace(replace(upper({x}), 'ß', 'SS'), 'ẞ', 'SS')"
_LAST = """WITH last AS (SELECT c.conv_id, coalesce(u.t, '') AS t FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1) u USING (conv_id))"""


@register("batch_generate", f"{_LAST} SELECT conv_id, md5({_UPPER('t')}) AS answer_md5, 'stop' AS finish_reason, 'ok' AS status FROM last")
def q_batch_generate(spark, sf_dir):
    out = batch_generate(_requests(spark, sf_dir), echo_client, ["conv_id"], sleep=_no_sleep)
    return out.select("conv_id", F.md5("answer").alias("answer_md5"), "finish_reason", "status")


@register("retrying", f"""{_LAST} SELECT conv_id, 'ok' AS status, CAST(1 + length(t) % 2 AS INTEGER) AS tries,
  CAST(length(t) AS VARCHAR) AS answer FROM last""")
def q_retrying(spark, sf_dir):
    out = batch_generate(_requests(spark, sf_dir), flaky_client, ["conv_id"], sleep=_no_sleep)
    return out.select("conv_id", "status", "tries", "answer")


@register("continue_answers", """WITH f AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT c.conv_id, CAST(greatest(1, ceil(length(coalesce(t, '')) / 64.0)) AS INTEGER) AS rounds, 'stop' AS finish_reason,
  CAST(length(coalesce(t, '')) AS INTEGER) AS answer_chars FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id)""")
def q_continue_answers(spark, sf_dir):
    out = batch_generate(_requests(spark, sf_dir), continuing_client, ["conv_id"], options={"max_tokens": 64},
                         max_rounds=None, sleep=_no_sleep)
    return out.select("conv_id", "rounds", "finish_reason", F.length("answer").alias("answer_chars"))


@register("typed_generate", f"""{_LAST} SELECT conv_id, CASE WHEN length(t) % 5 = 0 THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN length(t) % 5 > 0 THEN 'x = ' || length(t) END AS code, CASE WHEN length(t) % 5 > 0 THEN CAST(length(t) % 120 AS DOUBLE) END AS score,
  length(t) % 5 > 0 AND length(t) % 120 > 0 AND length(t) % 120 < 100 AS valid FROM last""")
def q_typed_generate(spark, sf_dir):
    out = typed_generate(_requests(spark, sf_dir), json_client, ["conv_id"], ANSWER_SCHEMA, sleep=_no_sleep)
    return out.select("conv_id", "status", F.col("parsed.code").alias("code"), F.col("parsed.score").alias("score"),
                      valid_answer(F.col("parsed.code"), F.col("parsed.score")).alias("valid"))


@register("prompt_stages", f"""WITH {SQL_WORK}, p AS (SELECT doc_id, {_UPPER("'Plan tests for target ' || doc_id || ': ' || test_code")} AS plan FROM work)
SELECT doc_id, md5(plan) AS plan_md5, md5({_UPPER("'Write code for plan: ' || plan")}) AS code_md5 FROM p""")
def q_prompt_stages(spark, sf_dir):
    w = work(spark, sf_dir)
    stages = [("Plan tests for target {doc_id}: {test_code}", "plan"),
              ("Write code for plan: {plan}", "draft")]
    out = prompt_stages(w, echo_client, stages, sleep=_no_sleep)
    return out.select("doc_id", F.md5("plan").alias("plan_md5"), F.md5(extract_code("draft")).alias("code_md5"))
