"""Snapshot comparison: changed paths, line-level differences, review and commit bundles.

Two states of a tree are tables ``(path, content)``. The textual diff is relational: lines of
changed files are exploded with their position, divided by anchors that keep their order, and
compared as multisets between them. It partitions by path and never gathers a whole tree.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import cut_lineage


def snapshot_join(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, status)`` with status added / removed / modified / same (D11). A null content is a content
    like any other, so presence is told by a flag."""
    o = old.select("path", F.lit(True).alias("in_old"), F.sha2(F.col("content"), 256).alias("h_old"))
    n = new.select("path", F.lit(True).alias("in_new"), F.sha2(F.col("content"), 256).alias("h_new"))
    j = o.join(n, "path", "full_outer")
    status = (
        F.when(F.col("in_old").isNull(), F.lit("added"))
        .when(F.col("in_new").isNull(), F.lit("removed"))
        .when(~F.col("h_old").eqNullSafe(F.col("h_new")), F.lit("modified"))
        .otherwise(F.lit("same"))
    )
    return j.select("path", status.alias("status"))


def changed_paths(old: DataFrame, new: DataFrame, scope: str | None = None) -> DataFrame:
    """Changed paths (not ``same``), optionally restricted to a folder; blank paths dropped (B9)."""
    s = snapshot_join(old, new).where((F.col("status") != "same") & (F.trim(F.col("path")) != ""))
    if scope:
        s = s.where(F.col("path").startswith(scope))
    return s


def longest_run(places: list[int]) -> list[int]:
    """Indexes of a longest increasing run of distinct numbers: of all the longest, the one whose elements,
    from the last to the first, come latest."""
    tops, ends, before = [], [], []
    for i, x in enumerate(places):
        k = bisect_left(ends, x)
        before.append(tops[k - 1] if k else -1)
        if k == len(ends):
            ends.append(x)
            tops.append(i)
        else:
            ends[k], tops[k] = x, i
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each file's anchors (positions in both states, in the order of the old one) those that keep their order."""
    for batch in batches:
        runs = [(a, longest_run([x["new_pos"] for x in a])) for a in batch.column("anchors").to_pylist()]
        of = lambda name: pa.array([[a[i][name] for i in run] for a, run in runs], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("path"), of("old_pos"), of("new_pos")], names=["path", "old_pos", "new_pos"])


def diff_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, sign, pos, line)``: lines removed (``-``, 0-based position in the old state) and added
    (``+``, position in the new state), in order (I6).

    Lines that each state holds once are anchors; a longest run of anchors in the order of both states is kept
    (:func:`longest_run`) and divides both into gaps. Inside a gap, of a line that one state has k times more
    often, its last k occurrences count. A moved line is thus removed in one place and added in another. Only
    files that changed are taken apart; their lines move once, by path."""
    changed = cut_lineage(snapshot_join(old, new).where(F.col("status") != "same").select("path"))

    def side(df: DataFrame, sign: str) -> DataFrame:
        there = df.select("path", "content").join(changed, "path", "left_semi")
        return there.select("path", F.lit(sign).alias("sign"), F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))

    lines = side(old, "-").unionByName(side(new, "+")).repartition("path")
    times = lambda sign: F.count(F.when(F.col("sign") == sign, 1))
    at = lambda sign: F.min(F.when(F.col("sign") == sign, F.col("pos")))
    once = lines.groupBy("path", "line").agg(times("-").alias("o"), times("+").alias("n"), at("-").alias("old_pos"), at("+").alias("new_pos"))
    anchors = once.where("o = 1 and n = 1").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("old_pos", "new_pos"))).alias("anchors"))
    kept = anchors.mapInArrow(_kept, "path string, old_pos array<int>, new_pos array<int>")
    marks = kept.select("path", F.explode(F.array(F.struct(F.lit("-").alias("sign"), F.col("old_pos").alias("at")), F.struct(F.lit("+").alias("sign"), F.col("new_pos").alias("at")))).alias("m"))
    marks = marks.select("path", "m.sign", F.explode("m.at").alias("pos"), F.lit(1).alias("mark"))
    upto = Window.partitionBy("path", "sign").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.join(marks, ["path", "sign", "pos"], "left").withColumn("gap", F.coalesce(F.sum("mark").over(upto), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("path", "sign", "gap", "line").orderBy("pos"))
    pairs = placed.withColumn("nth", nth).groupBy("path", "gap", "line", "nth").agg(F.count("*").alias("sides"), F.min("sign").alias("sign"), F.min("pos").alias("pos"))
    return pairs.where("sides = 1").select("path", "sign", "pos", "line")


def line_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per path: numbers of lines added and removed."""
    count = lambda sign: F.count(F.when(F.col("sign") == sign, 1)).cast("long")
    return diff_lines(old, new).groupBy("path").agg(count("+").alias("n_added"), count("-").alias("n_removed"))


def diff_texts(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, diff)``: a file's diff lines as one text, by position, removed before added."""
    said = F.expr("listagg(concat(sign, line), '\n') WITHIN GROUP (ORDER BY pos, sign DESC)")
    return diff_lines(old, new).groupBy("path").agg(said.alias("diff"))


def review_bundle(old: DataFrame, new: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """One review prompt per modified file (D12): its whole diff, its new content, and the contents of
    the files that it depends on, ``related`` with columns (path, ord, node), where there are any."""
    mod = changed_paths(old, new).where(F.col("status") == "modified").select("path")
    per = mod.join(diff_texts(old, new), "path", "left").join(new.select("path", "content"), "path", "left")
    block = lambda path, text: F.concat(F.lit("\nFile "), path, F.lit(":\n"), F.coalesce(text, F.lit("")), F.lit("\n"))
    if related is not None:
        there = new.select(F.col("path").alias("node"), F.col("content").alias("there"))
        wanted = related.join(mod, "path", "left_semi").join(there, "node")
        blocks = wanted.select("path", "ord", block(F.col("node"), F.col("there")).alias("block"))
        texts = blocks.groupBy("path").agg(F.expr("listagg(block, '') WITHIN GROUP (ORDER BY ord)").alias("context"))
        per = per.join(texts, "path", "left")
    else:
        per = per.withColumn("context", F.lit(""))
    prompt = F.concat(
        F.lit("Review the change to "), F.col("path"), F.lit(".\nDiff:\n"), F.coalesce("diff", F.lit("")), F.lit("\n"),
        block(F.col("path"), F.col("content")), F.coalesce("context", F.lit("")),
    )
    return per.select("path", prompt.alias("prompt"))


def commit_bundle(old: DataFrame, new: DataFrame, repo_of) -> DataFrame:
    """The bundle of each repository's changes, one row per changed file in the order of paths (D13):
    ``repo, path, status, diff, content`` with the whole diff and the whole new content (null if removed)."""
    ch = changed_paths(old, new).withColumn("repo", repo_of(F.col("path")))
    rows = ch.join(diff_texts(old, new), "path", "left").join(new.select("path", "content"), "path", "left")
    return rows.select("repo", "path", "status", F.coalesce("diff", F.lit("")).alias("diff"), "content")
