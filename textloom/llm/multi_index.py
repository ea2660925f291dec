"""Nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised by a codebook each, fitted on a bounded sample; a pair of
centroids is a cell, and every vector is indexed under its cell. A query walks the pairs by the sum
of its distances to both centroids, with a heap, until the cells walked hold the wanted share of all
vectors, and the entries of those cells are ranked by their exact distance. The share is calibrated
on the sample: enough that nearly all true neighbours lie in the cells walked.

Cells are dealt to blocks; a query is sent once to each block that it walks. Large blocks are split,
and so is the query set, so that a group of the join stays bounded whatever a cell or the query set holds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import cut_lineage

SAMPLE = 20_000  # rows on which the codebooks and the share to walk are fitted
SAMPLE_QUERIES = 256
REACH = 0.98  # share of the sample's true neighbours that the walk must reach
ROUNDS = 10  # of k-means
BLOCKS = 64
GROUP_ROWS = 20_000  # entries of a block, and queries, in one group
CHUNK = 2_000_000  # numbers handled at once when ranking


def halves_distance(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def codebook(points: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spaced distinct points; empty clusters keep their centre."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = halves_distance(points, centres).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Codebooks:
    def __init__(self, sample: np.ndarray, k: int):
        self.cut = max(1, sample.shape[1] // 2)
        self.books = [codebook(sample[:, : self.cut], k), codebook(sample[:, self.cut :], k)]
        self.width = len(self.books[1])

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return halves_distance(x[:, : self.cut], self.books[0]), halves_distance(x[:, self.cut :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.width + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: float):
        """Cells by summed distance of their centroids until they hold ``wanted`` entries."""
        oa, ob = a.argsort(kind="stable"), b.argsort(kind="stable")
        heap, held = [(a[oa[0]] + b[ob[0]], 0, 0)], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(oa[i] * self.width + ob[j])
            if counts[cell]:
                held += counts[cell]
                yield cell
            if j + 1 < len(ob):
                heapq.heappush(heap, (a[oa[i]] + b[ob[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(oa):
                heapq.heappush(heap, (a[oa[i + 1]] + b[ob[0]], i + 1, 0))


def share_to_walk(sample: np.ndarray, books: Codebooks, k: int) -> float:
    """Share of the entries that a walk must hold to reach nearly all true neighbours, on the sample."""
    cells, n = books.cells(sample), len(sample)
    counts = np.bincount(cells, minlength=len(books.books[0]) * books.width)
    queries = np.linspace(0, n - 1, min(n, SAMPLE_QUERIES)).astype(int)
    a, b = books.distances(sample[queries])
    shares = []
    for row, q in enumerate(queries):
        distance = ((sample - sample[q]) ** 2).sum(1)
        distance[q] = np.inf
        order = list(books.walk(a[row], b[row], counts, n))
        upto = dict(zip(order, np.cumsum(counts[order]) / n))
        shares += [upto[c] for c in cells[np.argpartition(distance, min(k, n - 1) - 1)[: min(k, n - 1)]]]
    return float(np.quantile(shares, REACH)) if shares else 1.0


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``, by Euclidean distance:
    ``query_id, rank, vec_id, score``, nearest first and ties to the smaller vec_id; a query's own id
    is no candidate. With at most ``k`` candidates all are returned.

    No part is taken by null ids and by vectors that are null, zero, hold null or non-finite components
    or have another length than most. Repeated rows of one id and vector count once. Of rows with one
    and the same vector only the k + 1 smallest ids can be among the nearest; the others are left out
    of the groups, which loses nothing. Empty tables give an empty result. Other columns play no part."""
    def usable(df: DataFrame) -> DataFrame:
        v = df[vector_col].cast("array<double>")
        ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(df[id_col].cast("bigint").alias("id"), v.alias("v")).where(ok & F.col("id").isNotNull())

    sizes = usable(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id bigint, vec_id bigint, score double"
    ranked = "query_id bigint, rank int, vec_id bigint, score double"
    spark = vectors.sparkSession
    if sizes is None:
        return spark.createDataFrame([], ranked)
    d, n = sizes["d"], sizes["count"]
    rows = usable(vectors).where(F.size("v") == d)
    asked = usable(queries).where(F.size("v") == d).distinct()
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").collect()])
    books = Codebooks(sample, int(min(1024, max(16, 2 * n**0.25))))
    share = share_to_walk(sample, books, k)
    n_cells = len(books.books[0]) * books.width

    def indexed(batches):
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, d))
            yield pd.DataFrame({"vec_id": pdf["id"], "cell": books.cells(x), "raw": [v.tobytes() for v in x.astype("<f8")]})

    once = rows.groupBy("id", "v").agg(F.lit(1).alias("one")).drop("one")
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = once.withColumn("place", place).where(F.col("place") <= k + 1).select("id", "v")
    index = cut_lineage(kept.mapInPandas(indexed, "vec_id bigint, cell int, raw binary"))
    counts = np.zeros(n_cells, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most as many rows as pairs of centroids
        counts[r["cell"]] = r["count"]
    total = int(counts.sum())
    blocks = min(BLOCKS, n_cells)
    block_rows = np.bincount(np.arange(n_cells) % blocks, counts, minlength=blocks)
    splits = [max(1, -(-int(c) // GROUP_ROWS)) for c in block_rows]
    parts = max(1, -(-asked.count() // GROUP_ROWS))
    wanted = max(share * total, k + 1)

    def walked(batches):
        for pdf in batches:
            out: list[tuple] = []
            x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, d))
            a, b = books.distances(x)
            for row, (q, v) in enumerate(zip(pdf["id"], x.astype("<f8"))):
                to: dict[int, list[int]] = {}
                for cell in books.walk(a[row], b[row], counts, wanted):
                    to.setdefault(cell % blocks, []).append(cell)
                out += [(q, v.tobytes(), block, s, cells) for block, cells in to.items() for s in range(splits[block])]
            yield pd.DataFrame(out, columns=["query_id", "raw", "block", "split", "cells"])

    split_of = F.get(F.array(*map(F.lit, splits)), F.col("block"))
    entries = (
        index.withColumn("block", F.col("cell") % blocks)
        .withColumn("split", F.pmod(F.xxhash64("vec_id", "raw"), split_of).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )
    sent = asked.mapInPandas(walked, "query_id bigint, raw binary, block int, split int, cells array<int>")
    sent = sent.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))

    def rank(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        e = e.sort_values(["cell", "vec_id"], kind="stable")
        x, ids, cells = np.frombuffer(b"".join(e["raw"]), "<f8").reshape(len(e), d), e["vec_id"].to_numpy(), e["cell"].to_numpy()
        found = []
        for query, raw, walk in zip(q["query_id"], q["raw"], q["cells"]):
            take = np.isin(cells, np.asarray(walk)) & (ids != query)
            near, mine = np.empty(int(take.sum())), ids[take]
            y, v, step = x[take], np.frombuffer(raw, "<f8"), max(1, CHUNK // d)
            for at in range(0, len(y), step):
                near[at : at + step] = np.sqrt(((y[at : at + step] - v) ** 2).sum(1))
            best = np.lexsort((mine, near))[:k] if len(near) <= 4 * k else top(near, mine, k)
            found.append((np.full(len(best), query), mine[best], near[best]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(["query_id", "vec_id", "score"], zip(*found))})

    keys = ["block", "split", "part"]
    pairs = sent.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(lambda q, e: rank(e, q), schema)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top(near: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest by distance and id."""
    at = np.flatnonzero(near <= np.partition(near, k - 1)[k - 1])
    return at[np.lexsort((ids[at], near[at]))[:k]]
