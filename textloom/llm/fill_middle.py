"""Fill-in-middle documents by a learned rank index.

A text's tokens are runs of other characters with the white space before them. The byte offsets at
which tokens end, by their rank, are fitted by straight pieces: a piece grows while one slope from
its first point keeps all its points within EPSILON, and what the rounded line misses of each
offset is stored as a small residual. A cut after so many tokens is found by its rank: the piece
that holds the rank predicts the offset, the residual corrects it exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.llm.common import small_batches

EPSILON = 100  # bytes that a line may miss an offset by; residuals then fit one byte
WINDOW = 256  # points tried at first for a piece; more while all of them fit
BATCH_BYTES = 32 << 20  # output texts held before a batch is handed on
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def token_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets of the boundaries between tokens, from 0 to the text's end: ``n`` tokens have ``n + 1``.

    Works on UTF-8 bytes, as the white space meant here is below 128."""
    if not len(raw):
        return np.zeros(1, np.int64)
    space = SPACE[raw]
    inner = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return np.concatenate([np.zeros(1, np.int64), inner, np.full(1, len(raw), np.int64)])


class RankIndex:
    """Offsets by rank as straight pieces and residuals: ``offset(rank)`` is exact for every rank."""

    def __init__(self, offsets: np.ndarray, epsilon: int = EPSILON):
        firsts, slopes, at, n = [], [], 0, len(offsets)
        while at < n:
            size = WINDOW
            while True:
                run = (offsets[at + 1 : at + 1 + size] - offsets[at]).astype(np.float64)
                steps = np.arange(1, len(run) + 1)
                low, high = np.maximum.accumulate((run - epsilon) / steps), np.minimum.accumulate((run + epsilon) / steps)
                wrong = low > high
                if wrong.any() or len(run) < size:
                    break
                size *= 4
            fits = int(wrong.argmax()) if wrong.any() else len(run)
            firsts.append(at)
            slopes.append((low[fits - 1] + high[fits - 1]) / 2 if fits else 0.0)
            at += fits + 1
        self.firsts, self.slopes = np.array(firsts, np.int64), np.array(slopes)
        self.bases = offsets[self.firsts]
        missed = offsets - self.predicted(np.arange(n))
        width = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.abs(missed).max() <= np.iinfo(t).max)
        self.residuals = missed.astype(width)

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        piece = np.searchsorted(self.firsts, ranks, "right") - 1
        return self.bases[piece] + np.floor(self.slopes[piece] * (ranks - self.firsts[piece])).astype(np.int64)

    def offset(self, rank: int) -> int:
        return int(self.predicted(np.array([rank]))[0]) + int(self.residuals[rank])


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers that depend on seed and doc_id only (a null id counts as no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def cut(doc_id: int | None, text: bytes, seed: int, percent: int, spm_percent: int) -> tuple:
    """``n, form, prefix_chars, middle_chars, pieces, output`` of one text; pieces: those of its index."""
    raw = np.frombuffer(text, np.uint8)
    ends = token_ends(raw)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or h3 % 100 >= percent or any(m in text for m in marks):
        return n, "plain", None, None, None, text
    index = RankIndex(ends)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = index.offset(first), index.offset(second)
    (p, s, m), (prefix, middle, suffix) = marks, (text[:a], text[a:b], text[b:])
    form, output = ("spm", s + suffix + p + prefix + m + middle) if h4 % 100 < spm_percent else ("psm", p + prefix + s + suffix + m + middle)
    return n, form, code_points(raw[:a]), code_points(raw[a:b]), len(index.firsts), output


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Documents turned for filling in the middle: ``doc_id, n, form, prefix_chars, middle_chars, pieces, output``.

    ``n`` counts tokens, ``pieces`` the straight pieces of the text's rank index, ``output`` is the turned
    text. A null or empty text, one that holds a mark, and those that the draw leaves out stay ``plain``,
    with null lengths and no index; a null doc_id draws like an id without digits and stays null. Equal rows give equal
    rows, an empty table an empty one, other columns of ``docs`` play no part; texts of any length are
    taken whole. A map over rows: nothing is shuffled."""
    small_batches(docs)
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces bigint, output binary"
    fields = to_arrow_schema(StructType.fromDDL(schema))
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append((doc_id, *cut(doc_id, text.as_py(), seed, percent, spm_percent)))
                held += len(rows[-1][-1])
                if held > BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)
                rows, held = [], 0

    return narrow.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def rebuilt(output: Column, form: Column) -> Column:
    """The text that was turned, from output and form. The marks stand once each, as no turned text holds one."""
    part = lambda text, mark, k: F.split_part(text, F.lit(mark), F.lit(k))
    middle = part(output, MIDDLE, 2)
    head = part(output, MIDDLE, 1)
    psm = F.concat(part(part(head, SUFFIX, 1), PREFIX, 2), middle, part(head, SUFFIX, 2))
    spm = F.concat(part(head, PREFIX, 2), middle, part(part(head, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``, with rows as in
    :func:`fill_in_middle`; the second digest is of the text rebuilt from output and form."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    turned = fill_in_middle(docs)
    return turned.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(rebuilt(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
