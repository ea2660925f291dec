import math

from pyspark.sql import functions as F

from sf_tables import SF


def _last_user(spark):
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    last = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("t"))
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("f"))
    return {r.conv_id: r.t for r in last.collect()}, {r.conv_id: r.f for r in first.collect()}


def test_generation_jobs(spark):
    from textloom.registry import QUERIES, load_all

    load_all()
    last, first = _last_user(spark)
    r = {x.conv_id: x for x in QUERIES["retrying"](spark, SF).collect()}
    for cid, t in last.items():
        # the stub fails once for odd lengths; the retry succeeds on the second attempt
        assert r[cid].status == "ok" and r[cid].tries == (2 if len(t) % 2 else 1) and r[cid].answer == str(len(t))
    c = {x.conv_id: x for x in QUERIES["continue_answers"](spark, SF).collect()}
    for cid, t in first.items():
        assert c[cid].answer_chars == len(t)
        assert c[cid].rounds == max(1, math.ceil(len(t) / 64)) and c[cid].finish_reason == "stop"
    ty = {x.conv_id: x for x in QUERIES["typed_generate"](spark, SF).collect()}
    for cid, t in last.items():
        n = len(t)
        if n % 5 == 0:
            assert ty[cid].status == "invalid" and ty[cid].valid is False
        else:
            assert ty[cid].code == f"x = {n}" and ty[cid].valid == (0 < n % 120 < 100)


def test_batch_generate_and_prompt_stages(spark):
    import hashlib

    from textloom.registry import QUERIES, load_all

    load_all()
    last, _ = _last_user(spark)
    b = {x.conv_id: x for x in QUERIES["batch_generate"](spark, SF).collect()}
    for cid, t in last.items():
        assert b[cid].status == "ok" and b[cid].answer_md5 == hashlib.md5(t.upper().encode()).hexdigest()
    from textloom.sources.views import work

    w = work(spark, SF).selectExpr("doc_id", "test_code AS t")
    tc = {r.doc_id: r.t for r in w.collect()}
    st = {x.doc_id: x for x in QUERIES["prompt_stages"](spark, SF).collect()}
    for did, t in list(tc.items())[:50]:
        plan = f"Plan tests for target {did}: {t}".upper()
        assert st[did].plan_md5 == hashlib.md5(plan.encode()).hexdigest()
        code = f"Write code for plan: {plan}".upper()  # no fences: text unchanged
        assert st[did].code_md5 == hashlib.md5(code.encode()).hexdigest()


def test_stages_call_the_client_once_a_row_and_stage(spark, tmp_path):
    """A client that leaves a mark for each call: k stages make k calls a row, whatever is read afterwards."""
    import uuid

    from textloom.operators.generate import prompt_stages

    def client(messages, attempt=1, **_):
        (tmp_path / uuid.uuid4().hex).write_text("x")
        return messages[-1]["content"] + "!", "stop"

    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "k long, t string")
    out = prompt_stages(df, client, [("{t}", "s1"), ("{s1}", "s2"), ("{s2}{s1}", "s3"), ("{s3}", "s4")])
    assert sorted(r.s4 for r in out.collect()) == ["a!!a!!!", "b!!b!!!", "b!!b!!!"] and out.count() == 3
    assert len(list(tmp_path.iterdir())) == 4 * 3
