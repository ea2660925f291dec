import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import packing
from textloom.operators.ordered import assign_segments, budget_cutoff, effective_limits, pack_segments, segment_labels


def greedy(sizes, mt, mc):
    """Plain re-statement of the packing rule: add, and if a limit (0 = none) is exceeded,
    close the current segment and start a new one with this item."""
    out, s, tt, tc = [], 0, 0, 0
    for t, c in sizes:
        tt += t
        tc += c
        if (mt != 0 and mt < tt) or (mc != 0 and mc < tc):
            s += 1
            tt, tc = t, c
        out.append(s)
    first_over = bool(sizes) and ((mt != 0 and mt < sizes[0][0]) or (mc != 0 and mc < sizes[0][1]))
    return out, first_over


def _cases():
    rnd = random.Random(7)
    cases = []
    for g in range(12):
        n = rnd.randint(1, 40)
        sizes = [(rnd.choice([0, 1, 3, 5, 8, 13, 40]), rnd.choice([0, 2, 7, 30])) for _ in range(n)]
        cases.append((f"g{g}", sizes))
    cases.append(("first_over", [(50, 1), (1, 1), (2, 1)]))
    cases.append(("exact", [(5, 1), (5, 1), (10, 1), (1, 1)]))
    cases.append(("zeros", [(0, 0)] * 5))
    return cases


def _items(spark, cases):
    rows = [(g, i, t, c, f"<{g}:{i}>") for g, sizes in cases for i, (t, c) in enumerate(sizes)]
    return spark.createDataFrame(rows, "grp string, ord long, token long, chars long, content string")


def _check(spark, mt, mc, with_prompt, keep_empty):
    cases = _cases()
    df = _items(spark, cases)
    got = assign_segments(df, ["grp"], ["ord"], mt, mc, with_prompt, keep_empty)
    got = {(r.grp, r.ord): r.seg for r in got.collect()}
    emt, emc = effective_limits(mt, mc, with_prompt)
    for g, sizes in cases:
        exp, first_over = greedy(sizes, emt, emc)
        shift = 0 if (first_over and keep_empty) else (1 if first_over else 0)
        exp = [e - shift for e in exp]
        assert [got[(g, i)] for i in range(len(sizes))] == exp, (g, mt, mc)


def test_segments_follow_the_greedy_rule(spark):
    _check(spark, 10, 20, False, False)
    _check(spark, 10, 0, False, True)
    _check(spark, 0, 9, False, False)


def test_negative_effective_limit(spark):
    # with wrapping, 40 - 50 < 0: every item is over budget, each alone
    _check(spark, 40, 0, True, False)


def test_null_groups_null_sizes_and_equal_order(spark):
    rows = [(None, 1, None, 1, "a"), (None, 2, 9, 1, "b"), (None, 3, 9, 1, "c"), ("g", 1, 6, 1, "x"), ("g", 1, 6, 1, "y"), ("g", 2, 1, 1, None)]
    df = spark.createDataFrame(rows, "grp string, ord long, token long, chars long, content string")
    got = sorted((r.grp or "", r.seg, r.content, r.token, r.n_items) for r in pack_segments(df, ["grp"], ["ord"], max_token=10, max_char=0).collect())
    assert got[:2] == [("", 0, "ab", 9, 2), ("", 1, "c", 9, 1)]
    assert {g[2] for g in got[2:]} == {"x", "y"} and [g[3:] for g in got[2:]] == [(6, 1), (7, 2)]
    labels = segment_labels(pack_segments(df, ["grp"], ["ord"], max_token=10, max_char=0), ["grp"]).collect()
    assert sorted((r.grp or "", r.k, r.n, r.role) for r in labels) == [("", 1, 2, "first"), ("", 2, 2, "last"), ("g", 1, 2, "first"), ("g", 2, 2, "last")]


def test_pack_contents_and_empty_first(spark):
    df = _items(spark, [("a", [(50, 1), (1, 1), (2, 1)])])
    p = pack_segments(df, ["grp"], ["ord"], max_token=10, max_char=0, keep_empty=True)
    rows = sorted((r.seg, r.content, r.n_items) for r in p.collect())
    assert rows == [(0, "", 0), (1, "<a:0>", 1), (2, "<a:1><a:2>", 2)]
    p = pack_segments(df, ["grp"], ["ord"], max_token=10, max_char=0, keep_empty=False)
    assert sorted((r.seg, r.content) for r in p.collect()) == [(0, "<a:0>"), (1, "<a:1><a:2>")]


def test_budget_cutoff(spark):
    rows = [("h", "u%02d" % i, t, 1) for i, t in enumerate([3, 4, 3, 0, 1, 9, 0])]
    df = spark.createDataFrame(rows, "host string, url string, token_size long, char_size long")
    kept = budget_cutoff(df, ["host"], ["url"], limit_token=10)
    # running sums 3,7,10,10,11...: exactly meeting the limit is accepted, then stop for good
    assert sorted(r.url for r in kept.collect()) == ["u00", "u01", "u02", "u03"]
    none = budget_cutoff(df, ["host"], ["url"], limit_token=2)
    assert none.count() == 0


def test_running_totals_of_a_hot_key_with_a_wide_column(spark, tmp_path):
    """Blocks of 240,000 rows, written out with a wide column before they are checked, against a window."""
    from pyspark.sql import Window

    from textloom.operators.ordered import row_index, running_totals

    df = spark.range(240_000).select(
        F.when(F.col("id") % 6 < 4, "hot").when(F.col("id") % 6 == 4, F.concat(F.lit("cold"), F.col("id") % 50)).alias("k"),
        F.xxhash64("id").alias("o"), F.when(F.col("id") % 11 > 0, F.col("id") % 5).alias("v"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"),
    )
    running_totals(df, ["k"], ["o"], {"cum": F.col("v")}, n_blocks=16).write.parquet(str(tmp_path / "out"))
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("k", "o", "wide", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("cum"))
    got = spark.read.parquet(str(tmp_path / "out")).select("k", "o", "wide", "cum")
    assert got.count() == 240_000 and got.exceptAll(want).isEmpty()
    places = row_index(df, ["k"], ["o"], n_blocks=16).where("k = 'hot'").agg(F.count("*"), F.min("idx"), F.max("idx"), F.count_distinct("idx")).first()
    assert tuple(places) == (160_000, 1, 160_000, 160_000)
    kept = budget_cutoff(df.withColumn("one", F.lit(1)), ["k"], ["o"], "one", "one", limit_token=70_000)
    assert kept.where("k = 'hot'").count() == 70_000
    assert budget_cutoff(df.withColumn("one", F.lit(1)), ["k"], ["o"], "one", "one").count() == 240_000


@pytest.mark.parametrize("limits", [(10, 20), (10, 0), (0, 9), (0, 0), (40, 7), (-1, 50), (200, 100)])
def test_runs_composed_in_any_order_leave_what_the_plain_rule_leaves(limits):
    rnd, bounds = random.Random(sum(limits)), tuple(map(packing._bound, limits))
    for _ in range(60):
        sizes = [(rnd.choice([0, 0, 1, 3, 8, 13, 40]), rnd.choice([0, 2, 7, 30])) for _ in range(rnd.randint(1, 60))]
        cuts = sorted({0, len(sizes), *(rnd.randrange(len(sizes)) for _ in range(4))})
        parts = [np.array(sizes[a:b]).T for a, b in zip(cuts, cuts[1:])]
        steps = [packing.Steps.of(packing.Run.of(p, bounds)) for p in parts]
        whole = steps[0]
        for s in steps[1:]:
            whole = s.after(whole, bounds)
        pairs = steps[:]
        while len(pairs) > 1:
            pairs = [pairs[k + 1].after(pairs[k], bounds) if k + 1 < len(pairs) else pairs[k] for k in range(0, len(pairs), 2)]
        for found in [(0, 0), (3, 2), (9, 9), (41, 0), (7, 33)]:
            t, c = found
            for a, b in sizes:
                t, c = t + a, c + b
                if t > bounds[0] or c > bounds[1]:
                    t, c = a, b
            one = np.array(found)[:, None]
            assert whole(one, bounds)[:, 0].tolist() == pairs[0](one, bounds)[:, 0].tolist() == [t, c]


@pytest.mark.parametrize("limits", [(10, 20, False), (0, 0, False), (300, 100, True), (40, 0, True)])
def test_hot_groups_in_short_runs(spark, monkeypatch, limits):
    """Groups of several runs over several partitions, with every size of segment, against the plain rule."""
    monkeypatch.setattr(packing, "RUN_ITEMS", 7)
    rnd = random.Random(11)
    sizes = lambda n: [(rnd.choice([0, 1, 3, 5, 8, 13, 40]), rnd.choice([0, 2, 7, 30])) for _ in range(n)]
    cases = [("hot", sizes(500)), ("warm", sizes(90)), *((f"c{k}", sizes(rnd.randint(1, 16))) for k in range(25)), ("big", [(900, 1)] * 20), ("zero", [(0, 0)] * 40)]
    df = _items(spark, cases).repartition(5)
    mt, mc, wrap = limits
    keep = mt != 10
    got = {(r.grp, r.ord): (r.seg, r.empty_first) for r in assign_segments(df, ["grp"], ["ord"], mt, mc, wrap, keep).collect()}
    for g, sizes_of in cases:
        exp, first_over = greedy(sizes_of, *effective_limits(mt, mc, wrap))
        shift = 1 if first_over and not keep else 0
        assert [got[(g, i)] for i in range(len(sizes_of))] == [(e - shift, keep and first_over) for e in exp], (g, limits, keep)


def test_two_keys_with_nulls_in_short_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN_ITEMS", 3)
    rows = [(a, b, i, i % 4, 1, "x") for a in (None, "p") for b in (None, 2) for i in range(17)]
    df = spark.createDataFrame(rows, "a string, b int, ord long, token long, chars long, content string")
    got = {}
    for r in assign_segments(df, ["a", "b"], ["ord"], 6, 0).collect():
        got.setdefault((r.a, r.b), {})[r.ord] = r.seg
    want, _ = greedy([(i % 4, 1) for i in range(17)], 6, 0)
    assert len(got) == 4 and all([g[i] for i in range(17)] == want for g in got.values())


def test_a_hot_group_spreads_over_tasks(spark):
    """One group with nearly all rows is cut into runs of several partitions."""
    df = spark.range(50_000).select(F.lit("hot").alias("grp"), "id", (F.col("id") % 7).alias("token"), F.lit(1).alias("chars"))
    narrow = df.select("grp", "id", F.col("id").alias("__id"), F.col("token").alias("__tok"), F.col("chars").cast("long").alias("__chr"))
    seg = packing.greedy_segments(narrow, ["grp"], ["id"], 1000, 0, partitions=8, run_items=500)
    want, _ = greedy([(i % 7, 1) for i in range(50_000)], 1000, 0)
    assert [r.seg for r in seg.orderBy("__id").collect()] == want
