"""Greedy packing of ordered items at any size of a group.

A segment begins at the first item, and again at each item that would take the open segment over a
limit. What an item decides depends on the open segment's sizes alone, so a run of items is a
function from the sizes that it finds open to those that it leaves open. Rows are range-partitioned
by group and order and cut into runs of RUN_ITEMS at most. Inside a run the next start after every
item comes from prefix sums; following these pointers by doubling gives the run's function: a few
steps, as chains of starts soon fall together. Groups of several runs then double their pointers to
the run before, composing functions, until every run knows what it finds open. So a group that holds
most rows takes as many rounds as the logarithm of its number of runs, and no task sees it whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.session import cut_lineage

RUN_ITEMS = 1 << 16
NO_LIMIT = 1 << 60


def _bound(limit: int) -> int:
    """A limit of 0 means no limit; a negative one is always exceeded."""
    return NO_LIMIT if limit == 0 else limit


@dataclass
class Run:
    """Prefix sums of a run and the start that follows a start at each of its items (the run's length: none)."""

    before: np.ndarray  # two rows, tokens and characters
    upto: np.ndarray
    following: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, limits: tuple[int, int]) -> Run:
        upto = np.cumsum(sizes, axis=1)
        before = upto - sizes
        ends = [np.searchsorted(u, b + limit, "right") for u, b, limit in zip(upto, before, limits)]
        return cls(before, upto, np.maximum(np.minimum(*ends), np.arange(1, sizes.shape[1] + 1)))

    def first_over(self, found: np.ndarray, limits: tuple[int, int]) -> int:
        """The first item that does not fit into a segment with the sizes ``found``."""
        return int(min(np.searchsorted(u, limit - x, "right") for u, x, limit in zip(self.upto, found, limits)))

    def starts(self, first: int) -> np.ndarray:
        marks = np.zeros(len(self.following), np.int64)
        while first < len(marks):
            marks[first] = 1
            first = int(self.following[first])
        return marks


@dataclass
class Steps:
    """What a run, or several in a row, leave open: the ``left`` sizes of the last step whose ``at`` sizes still
    fit with those found open, or, if all ``total`` sizes fit, their sum with those found."""

    at: np.ndarray
    left: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, run: Run) -> Steps:
        n = len(run.following)
        last = np.where(run.following < n, run.following, np.arange(n))
        while not np.array_equal(further := last[last], last):
            last = further
        firsts = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
        total = run.upto[:, -1]
        return cls(run.before[:, firsts], total[:, None] - run.before[:, last[firsts]], total)

    def __call__(self, found: np.ndarray, limits: tuple[int, int]) -> np.ndarray:
        """The sizes left open, a column for each column of ``found``."""
        room = [limit - x for limit, x in zip(limits, found)]
        fit = np.minimum(*(np.searchsorted(a, r, "right") for a, r in zip(self.at, room)))
        through = np.logical_and(*(t <= r for t, r in zip(self.total, room)))
        return np.where(through, found + self.total[:, None], self.left[:, np.maximum(fit, 1) - 1])

    def after(self, earlier: Steps, limits: tuple[int, int]) -> Steps:
        at = np.concatenate([earlier.at, earlier.total[:, None] + self.at], axis=1)
        left = np.concatenate([self(earlier.left, limits), self.left], axis=1)
        new = np.append(True, (left[:, 1:] != left[:, :-1]).any(axis=0))
        return Steps(at[:, new], left[:, new], earlier.total + self.total)

    def row(self) -> list[list[int]]:
        return [x.tolist() for x in (*self.at, *self.left)] + [self.total.tolist()]

    @classmethod
    def read(cls, at_t, at_c, left_t, left_c, total) -> Steps:
        return cls(np.array([at_t, at_c], np.int64), np.array([left_t, left_c], np.int64), np.array(total, np.int64))


STEPS = "at_t array<bigint>, at_c array<bigint>, left_t array<bigint>, left_c array<bigint>, total array<bigint>"
STEP_COLUMNS = ["at_t", "at_c", "left_t", "left_c", "total"]


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def _cut_runs(n_keys: int, limits: tuple[int, int], most: int, fields: pa.Schema):
    """Rows of one partition, sorted by keys and order (keys..., id, token, chars), as runs. A run is ``open``
    if its group can go on in another run: at an end of the partition, or where a longer group is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, rows, held = TaskContext.get().partitionId(), 0, [], 0
        key, ids, tokens, chars, cut = None, [], [], [], True

        def flush(open_: bool) -> None:
            nonlocal made, held
            steps = Steps.of(Run.of(np.array([tokens, chars], np.int64), limits)).row() if open_ else [None] * 5
            rows.append((*key, part << 32 | made, open_, ids, tokens, chars, *steps))
            made, held = made + 1, held + len(ids)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keys = zip(*columns[:n_keys])
            for k, i, t, c in zip(keys, *columns[n_keys:]):
                if ids and k != key:
                    flush(cut)
                    ids, tokens, chars, cut = [], [], [], False
                elif len(ids) == most:
                    flush(True)
                    ids, tokens, chars, cut = [], [], [], True
                key = k
                ids.append(i)
                tokens.append(t)
                chars.append(c)
                if held >= most:
                    yield _batch(rows, fields)
                    rows, held = [], 0
        if ids:
            flush(True)
        if rows:
            yield _batch(rows, fields)

    return run


def _doubled(limits: tuple[int, int], fields: pa.Schema):
    """Rows of a run and of the run that its pointer leads to: the pointer's own pointer, and both functions as
    one. Without a pointer, ``left`` is what the run leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = Steps.read(*(r[c] for c in STEP_COLUMNS))
                earlier = Steps.read(*(r[f"e_{c}"] for c in STEP_COLUMNS))
                if r["e_before"] is None:
                    left = own(earlier.left[:, :1], limits)
                    rows.append((r["run"], None, *Steps(left * 0, left, left[:, 0] * 0).row()))
                else:
                    rows.append((r["run"], r["e_before"], *own.after(earlier, limits).row()))
            if rows:
                yield _batch(rows, fields)

    return run


def _marked(limits: tuple[int, int], fields: pa.Schema):
    """Each run's items with the number of starts up to them inside the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, tokens, chars, found in zip(*(c.to_pylist() for c in batch.columns)):
                items = Run.of(np.array([tokens, chars], np.int64), limits)
                marks = items.starts(0 if found is None else items.first_over(np.array(found), limits))
                over = tokens[0] > limits[0] or chars[0] > limits[1]
                yield _batch([(number, ids, np.cumsum(marks), int(marks.sum()), over)], fields)

    return run


def _found_open(runs: DataFrame, keys: list[str], limits: tuple[int, int]) -> tuple[DataFrame | None, DataFrame | None]:
    """``(run, keys, before)`` of groups of several runs, and ``(run, found)`` of their runs but the first."""
    of_group = Window.partitionBy(*keys)
    chain = runs.where("open").select("run", *keys, *STEP_COLUMNS, F.lag("run").over(of_group.orderBy("run")).alias("before"), F.count("*").over(of_group).alias("length"))
    chain = cut_lineage(chain.where("length > 1"))
    longest = chain.agg(F.max("length")).first()[0]
    if longest is None:
        return None, None
    links = chain.select("run", *keys, "before")
    schema = f"run bigint, before bigint, {STEPS}"
    fields = to_arrow_schema(StructType.fromDDL(schema))
    # the first run of a group begins with a start: it leaves the same open whatever was before
    state = chain.select("run", "before", *STEP_COLUMNS)
    for _ in range((longest - 1).bit_length()):
        earlier = state.select(F.col("run").alias("e_run"), F.col("before").alias("e_before"), *[F.col(c).alias(f"e_{c}") for c in STEP_COLUMNS])
        met = state.join(earlier, state["before"] == earlier["e_run"]).drop("before", "e_run")
        state = cut_lineage(state.where("before is null").unionByName(met.mapInArrow(_doubled(limits, fields), schema)))
    left = state.select(F.col("run").alias("before"), F.array(F.get("left_t", F.lit(0)), F.get("left_c", F.lit(0))).alias("found"))
    return links, links.join(left, "before").select("run", "found")


def greedy_segments(
    items: DataFrame, keys: list[str], order: list[str], max_token: int, max_char: int, partitions: int, run_items: int | None = None
) -> DataFrame:
    """``(__id, seg, first_over)`` of items ``(keys, order, __id, __tok, __chr)``: the 0-based segment inside the
    group, and whether the group's first item alone is over a limit.

    Sizes must not be null or negative. Null keys form a group. Items with equal order are taken by ``__id``.
    A limit of 0 means no limit; a negative one is always exceeded, each item then stands alone."""
    limits = _bound(max_token), _bound(max_char)
    dealt = items.repartitionByRange(partitions, *keys, *order, "__id").sortWithinPartitions(*keys, *order, "__id")
    narrow = dealt.select(*keys, "__id", "__tok", "__chr")
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*keys).schema)
    schema = f"{key_schema}, run bigint, open boolean, ids array<bigint>, tokens array<bigint>, chars array<bigint>, {STEPS}"
    fields = to_arrow_schema(StructType.fromDDL(schema))
    runs = cut_lineage(narrow.mapInArrow(_cut_runs(len(keys), limits, run_items or RUN_ITEMS, fields), schema))
    links, found = _found_open(runs, keys, limits)
    asked = runs.select("run", "ids", "tokens", "chars")
    asked = asked.withColumn("found", F.lit(None).cast("array<bigint>")) if found is None else asked.join(found, "run", "left")
    schema = "run bigint, ids array<bigint>, upto array<bigint>, starts bigint, first_over boolean"
    marked = asked.mapInArrow(_marked(limits, to_arrow_schema(StructType.fromDDL(schema))), schema)
    if links is None:
        marked = marked.withColumn("earlier", F.lit(0))
    else:
        marked = cut_lineage(marked)
        in_group = Window.partitionBy(*keys).orderBy("run")
        earlier = F.coalesce(F.sum("starts").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = marked.select("run", "starts", "first_over").join(links.select("run", *keys), "run")
        offsets = offsets.select("run", earlier.alias("earlier"), F.first("first_over").over(in_group).alias("group_over"))
        marked = marked.join(offsets, "run", "left").withColumns(
            {"earlier": F.coalesce("earlier", F.lit(0)), "first_over": F.coalesce("group_over", "first_over")}
        )
    each = marked.select("earlier", "first_over", F.explode(F.arrays_zip("ids", "upto")).alias("item"))
    return each.select(F.col("item.ids").alias("__id"), (F.col("item.upto") + F.col("earlier") - 1).alias("seg"), "first_over")
