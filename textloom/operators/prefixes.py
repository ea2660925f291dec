"""Literal prefixes by sorted ranges.

In sorted order the strings that begin with a prefix stand together behind it. Prefixes and values
are range-partitioned as one list; a task goes through its range with a stack of the prefixes that
hold at the place, so a value meets each of its prefixes and nothing else. A prefix that also holds in
later ranges is handed to those whose first string begins with it: at most one for each length of
that string. No row is made for prefixes that are not there, and nothing is compared in pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut_lineage

HELD = 1 << 16  # pairs that a task holds before it hands them on


def _ranges(prefixes: DataFrame, values: DataFrame) -> DataFrame:
    """``part, key, kind``: prefixes (kind 0) and values (kind 1) in ranges of one order, and in each range also the
    prefixes of earlier ranges that hold at its first string."""
    listed = prefixes.where("prefix is not null").distinct().select(F.col("prefix").alias("key"), F.lit(0).alias("kind"))
    listed = listed.unionByName(values.where("value is not null").distinct().select(F.col("value").alias("key"), F.lit(1).alias("kind")))
    n = max(int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = cut_lineage(listed.repartitionByRange(n, "key", "kind").withColumn("part", F.spark_partition_id()))
    firsts = [tuple(r) for r in dealt.groupBy("part").agg(F.min("key").alias("key")).orderBy("part").collect()]  # a row for each range

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys = [p for p, _ in firsts], [k for _, k in firsts]
        for batch in batches:
            rows = [[], [], []]
            for part, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist()):
                k = max(bisect_left(keys, key), bisect_left(parts, part + 1))
                while k < len(keys) and keys[k].startswith(key):
                    rows[0].append(parts[k])
                    rows[1].append(key)
                    rows[2].append(0)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32())], names=["part", "key", "kind"])

    handed = dealt.where("kind = 0").select("part", "key").mapInArrow(later, "part int, key string, kind int")
    return dealt.select("part", "key", "kind").unionByName(handed).repartition("part").sortWithinPartitions("part", "key", "kind")


def _walk(every: bool, proper: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, stack, found = None, [], ([], [])
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in found], names=["prefix", "value"])
        for batch in batches:
            for part, key, kind in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "kind"))):
                if part != here:
                    here, stack = part, []
                while stack and not key.startswith(stack[-1]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1] != key:
                        stack.append(key)
                    continue
                hits = stack[:-1] if proper and stack and stack[-1] == key else stack
                hits = hits if every else hits[-1:]
                found[0].extend(hits)
                found[1].extend([key] * len(hits))
                if len(found[0]) >= HELD:
                    yield made()
                    found = ([], [])
        if found[0]:
            yield made()

    return run


def prefix_pairs(prefixes: DataFrame, values: DataFrame, proper: bool = False) -> DataFrame:
    """``(prefix, value)`` of every value and each prefix that it begins with, from tables ``(prefix)`` and
    ``(value)``. Nulls meet nothing, repeated rows count once; with ``proper`` a value is no prefix of itself."""
    return _ranges(prefixes, values).mapInArrow(_walk(True, proper), "prefix string, value string")


def longest_prefix(prefixes: DataFrame, values: DataFrame) -> DataFrame:
    """``(prefix, value)`` of every value that begins with a prefix, with the longest of them."""
    return _ranges(prefixes, values).mapInArrow(_walk(False, False), "prefix string, value string")
