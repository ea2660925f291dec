"""Sinks: packed segments to text/parquet, segment numbering for emitting in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import count_tokens


def text_sink(segments: DataFrame, path: str, keys: list[str], content_col: str = "content",
              fmt: str = "parquet") -> None:
    """Write one row per segment, partitioned by the group keys; ``seg`` keeps the order.

    ``fmt='text'`` writes plain text, a folder for each group and segment, as a segment has many
    lines; parquet keeps ``seg`` and sizes as columns.
    """
    if fmt == "text":
        segments.select(*keys, "seg", content_col).write.mode("overwrite").partitionBy(*keys, "seg").text(path)
    else:
        segments.write.mode("overwrite").partitionBy(*keys).parquet(path)


def segment_sink(segments: DataFrame, keys: list[str], content_col: str = "content") -> DataFrame:
    """Segments with "k of n" numbering by position and their sizes."""
    n = segments.groupBy(*[F.col(k).alias(f"__t_{k}") for k in keys]).agg(F.count(F.lit(1)).cast("long").alias("n"))
    same = reduce(lambda a, b: a & b, [segments[k].eqNullSafe(n[f"__t_{k}"]) for k in keys])
    return (
        segments.join(n, same)
        .drop(*[f"__t_{k}" for k in keys])
        .withColumn("k", F.col("seg") + 1)
        .withColumn("label", F.concat(F.lit("Chunk "), F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string")))
        .withColumn("seg_chars", F.length(content_col).cast("long"))
        .withColumn("seg_tokens", count_tokens(content_col))
    )
