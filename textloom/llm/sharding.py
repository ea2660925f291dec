"""Shards of near-equal bytes by sampled splitters, in DataFrame functions only.

Records are ordered by a key: the text's hash, so that equal texts lie together, then doc_id. A
sample in which a record is drawn in proportion to its size gives quantiles of the key as boundaries
of ranges; a range that still holds more than twice its share gets boundaries of its own, so that
also a text or id that many records share is divided. Records are dealt to their ranges, running
sums inside a range and the totals of the ranges before it give each record its place in the whole
order of bytes, and the place gives the shard: shards differ by one record's size at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import cut_lineage

RANGES = 256  # ranges to begin with; divided ranges come on top
PICKS = 64  # expected sample records for each range
OVERFULL = 2  # times a range's share beyond which it is divided
ROUNDS = 3  # times that ranges are divided
KEY = ("h", "doc_id", "tie")
LOWEST = -(1 << 63)


def range_of(bounds: list[tuple]) -> Column:
    """Number of boundaries at or below a record's key, by halving steps through the sorted boundaries."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(c) for v, c in zip(b, KEY)]) for b in bounds])
    key = F.struct(*[(F.coalesce(c, F.lit(LOWEST)) if c == "doc_id" else F.col(c)).alias(c) for c in KEY])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(array, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at),
    )


def sampled_bounds(ranged: DataFrame, share: float) -> list[tuple]:
    """Boundaries inside each range of ``ranged`` about every ``share`` bytes, from a size-weighted sample:
    a record is drawn size / step times, rounded up or down by a hash of its key. At most one boundary
    for each share comes to the driver."""
    step = share / PICKS
    lot = F.pmod(F.xxhash64(*KEY), F.lit(1 << 20)) / float(1 << 20)
    sample = ranged.withColumn("picks", F.floor(F.col("size") / step + lot)).where("picks > 0")
    order = [F.coalesce(c, F.lit(LOWEST)) if c == "doc_id" else F.col(c) for c in KEY]
    upto = F.sum("picks").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    crossed = F.floor(F.col("upto") / PICKS) > F.floor((F.col("upto") - F.col("picks")) / PICKS)
    found = sample.withColumn("upto", upto).where(crossed).select(*[o.alias(c) for o, c in zip(order, KEY)])
    return [tuple(r) for r in found.distinct().collect()]


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """A shard and slot for every record: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 1 (a null text: 1, and the checksum of no bytes, 0).
    The law is ``bytes``: shards are intervals of the order of bytes, equal but for a record's size.
    Slots count a shard's records from 0 without gaps. ``grown_shard`` is null under this law. One row
    per input row: equal rows are placed one after another; a null doc_id counts as the smallest; an
    empty table gives an empty one; other columns of ``docs`` play no part. Texts are read once and
    not moved: what is shuffled is narrow."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = cut_lineage(
        docs.select(
            docs["doc_id"].cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(1).cast("bigint")).alias("size"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("tie"),
        )
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    share = max(1.0, total / RANGES)
    bounds = sorted(sampled_bounds(keyed.withColumn("range", F.lit(0)), share)) if total else []
    for left in reversed(range(ROUNDS + 1)):
        ranged = keyed.withColumn("range", range_of(bounds))
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range").collect()
        over = [r["range"] for r in sums if r["bytes"] > OVERFULL * share and r["n"] > 1]
        if not over or not left:
            break
        bounds = sorted({*bounds, *sampled_bounds(ranged.where(F.col("range").isin(over)), share / 2)})
    before, at, rows = [], 0, 0
    offsets = {r["range"]: r for r in sums}
    for k in range(len(bounds) + 1):
        before.append((at, rows))
        if k in offsets:
            at, rows = at + offsets[k]["bytes"], rows + offsets[k]["n"]
    begin = F.array(*[F.struct(F.lit(b).cast("bigint").alias("bytes"), F.lit(n).cast("bigint").alias("n")) for b, n in before])
    order = [F.col("h"), F.col("doc_id").asc_nulls_first(), F.col("tie")]
    run = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.get(begin, F.col("range"))["bytes"] + F.sum("size").over(run) - F.col("size")
    number = F.get(begin, F.col("range"))["n"] + F.count("*").over(run) - 1
    placed = cut_lineage(
        ranged.withColumn("start", start).withColumn("number", number)
        .select("doc_id", "size", "text_crc32", "number", F.expr(f"cast(start * {n_shards} div {max(total, 1)} as int)").alias("shard"))
    )
    first = placed.groupBy("shard").agg(F.min("number").alias("first"))  # as many rows as shards
    slot = (F.col("number") - F.col("first")).alias("slot")
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard")
    )
