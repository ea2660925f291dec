"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


BATCH_ROWS = 1000


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine (installed on every worker)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(df: DataFrame) -> None:
    """Documents are long: fewer rows in an Arrow batch of this session keep a task's memory small."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Memory that freed arrays leave with this process's allocators goes back to the system, if the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator], end: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, then ``end``, then :func:`give_back`: Spark keeps a task's Python process for
    later tasks, also for those of other stages, and what one leaves there stands beside what they need."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if end is not None:
                end()
            give_back()

    return tidy


def doc_columns(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null text: empty), whatever else the table holds."""
    small_batches(docs)
    return docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def map_columns(df: DataFrame, fn: Callable[..., Sequence[list]], schema: str, end: Callable[[], None] | None = None) -> DataFrame:
    """Map each Arrow batch, given as one Python list per column, to lists of output columns.

    ``fn`` gets the columns of ``df`` in order and returns the columns of ``schema`` in order. ``end`` is called
    when a task has no more batches."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, fields)], schema=fields)

    return df.mapInArrow(tidied(run, end), schema)
