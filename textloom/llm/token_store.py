"""Token ids in binary files of directly addressable codes.

Documents are dealt to ranges of doc_id, encoded there and written in ascending order. A file holds
whole documents, the first ones that reach FILE_TOKENS ids. An id's low bits are a chunk of level 1;
what is left of ids that are larger goes on as a chunk of level 2, and so on. Each level but the last
has a bitmap that tells which of its ids go on, and a rank directory: the set bits before every 512th
bit. Where an id goes on is the rank of its bit, so any id is read from a few places of the file and
no block is decoded. Chunk widths, multiples of four bits, are those of the least total size.

File: ``DAC1``, a byte count and a JSON header (number of ids and documents, width and length of each
level, places of all parts), then the parts: chunks, bitmaps and directories of the levels, doc_ids
and the documents' first ids.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from textloom.llm.common import map_columns, small_batches, tokenizer_path
from textloom.session import cut_lineage, ensure_checkpoint_dir

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
FILE_TOKENS = 1 << 22  # a file ends with the document that reaches so many ids
WORDS_KEPT = 1 << 20  # words with their ids kept in a worker; beyond that it starts anew
CHUNKS_KEPT = 1 << 19  # the same for the parts of words
KEPT_LENGTH = 64  # longer words are encoded each time
MAGIC = b"DAC1"
RANK_BITS = 512
# The white space of Unicode, as in a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Parts of a text that the library encodes alike alone and in place: each is one or more whole pre-tokens.
CHUNK = re.compile(f" ?[{LETTERS}]+(?=[{WHITE}.,;:!?)\"]|\\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

# Pre-tokens of printable ASCII without white space but a space at the start; each is one pre-token also when it stands alone.
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+")


class _Uneven(Exception):
    """A part between single spaces that begins or ends with white space, or is empty."""


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Chunks(dict):
    """Ids (as little-endian bytes) of parts of texts, by the library."""

    def __init__(self, library: Tokenizer):
        super().__init__()
        self.library, self.model = library, library.model

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isprintable() and not chunk.endswith(" "):  # bytes stand for themselves
            parts = ASCII_PARTS.findall(chunk)
            if len(parts) > 1:
                raw = b"".join(map(self.__getitem__, parts))
            else:
                raw = _raw([t.id for t in self.model.tokenize(chunk.replace(" ", "Ġ"))])
        else:
            raw = _raw(self.library.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= KEPT_LENGTH:
            if len(self) >= CHUNKS_KEPT:
                self.clear()
            self[chunk] = raw
        return raw


class _Words(dict):
    """Ids of what stands between two single spaces, with the space before it."""

    def __init__(self, chunks: _Chunks):
        super().__init__()
        self.chunks = chunks

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Uneven
        if word.isascii() and word.isalpha():  # one part
            raw = self.chunks[" " + word]
        else:
            raw = b"".join(map(self.chunks.__getitem__, CHUNK.findall(" " + word)))
        if len(word) <= KEPT_LENGTH:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = raw
        return raw


class TextEncoder:
    """Ids of whole texts as the library gives them, without special tokens added; parts of texts are
    remembered, so that the library sees each common one once."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("expected a byte-level vocabulary without normalizer or prefix space")
        if spec["model"]["type"] != "BPE" or spec["model"]["dropout"]:
            raise ValueError("expected plain BPE")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.chunks = _Chunks(self.library)
        self.words = _Words(self.chunks)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(t in text for t in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise _Uneven
            return b"".join(map(self.chunks.__getitem__, CHUNK.findall(first))) + b"".join(map(self.words.__getitem__, rest))
        except _Uneven:
            return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


# ------------------------------------------------------------------ the file format

def level_widths(ids: np.ndarray) -> list[int]:
    """Widths of the levels, in bits, that take the least room: a chunk and a bit for each id of a level,
    no bit in the last."""
    lengths = np.bincount(np.ceil(np.log2(ids[ids > 0].astype(np.float64) + 1)).astype(np.int64), minlength=1)
    top = max(4, -(-(len(lengths) - 1) // 4) * 4)
    longer = lambda bits: len(ids) if not bits else int(lengths[bits + 1 :].sum())
    best: dict[int, tuple[int, list[int]]] = {top: (0, [])}
    for done in range(top - 4, -1, -4):
        options = [(longer(done) * (w + (done + w < top)) + best[done + w][0], [w, *best[done + w][1]]) for w in range(4, min(16, top - done) + 1, 4)]
        best[done] = min(options)
    return best[0][1]


def packed(chunks: np.ndarray, width: int) -> bytes:
    """Chunks of 4, 8, 12 or 16 bits, one after another."""
    if width == 8:
        return chunks.astype(np.uint8).tobytes()
    if width == 16:
        return chunks.astype("<u2").tobytes()
    a, b = (np.append(chunks, 0) if len(chunks) % 2 else chunks).reshape(-1, 2).T
    if width == 4:
        return (a | b << 4).astype(np.uint8).tobytes()
    return np.stack([a & 255, a >> 8 | (b & 15) << 4, b >> 4], 1).astype(np.uint8).tobytes()


def unpacked(raw: bytes, width: int, skip: int, n: int) -> np.ndarray:
    """``n`` chunks from the bytes of whole pairs of chunks; ``skip`` (0 or 1) chunks before them are left out."""
    if width == 8:
        return np.frombuffer(raw, np.uint8).astype(np.uint32)[skip : skip + n]
    if width == 16:
        return np.frombuffer(raw, "<u2").astype(np.uint32)[skip : skip + n]
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if width == 4:
        return np.stack([b & 15, b >> 4], 1).ravel()[skip : skip + n]
    b = np.append(b, np.zeros(-len(b) % 3, np.uint32)).reshape(-1, 3)
    return np.stack([b[:, 0] | (b[:, 1] & 15) << 8, b[:, 1] >> 4 | b[:, 2] << 4], 1).ravel()[skip : skip + n]


def file_bytes(doc_ids: list[int | None], starts: list[int], ids: np.ndarray) -> bytes:
    """A whole file: ids of its documents one after another, ``starts`` the first id of each and the end."""
    parts, places, at = [], {}, 0

    def put(name: str, raw: bytes) -> None:
        nonlocal at
        places[name] = [at, len(raw)]
        parts.append(raw)
        at += len(raw)

    widths, lengths, left, done = level_widths(ids), [], ids.astype(np.uint32), 0
    for k, width in enumerate(widths):
        lengths.append(len(left))
        put(f"chunks{k}", packed(left & ((1 << width) - 1), width))
        if k < len(widths) - 1:
            go_on = left >> width > 0
            bits = np.packbits(go_on, bitorder="little")
            put(f"bits{k}", bits.tobytes())
            ones = np.bitwise_count(np.append(bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)).reshape(-1, RANK_BITS // 8)).sum(1)
            put(f"ranks{k}", np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4").tobytes() if len(ones) else b"")
            left = left[go_on] >> width
    put("doc_ids", np.array([i or 0 for i in doc_ids], "<i8").tobytes())
    put("no_id", np.packbits([i is None for i in doc_ids], bitorder="little").tobytes())
    put("starts", np.array(starts, "<u8").tobytes())
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "widths": widths, "lengths": lengths, "places": places}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *parts])


class TokenFile:
    """Reader of one file; ``read_at(size, offset)`` gives its bytes."""

    def __init__(self, read_at):
        raw = read_at(8, 0)
        if raw[:4] != MAGIC:
            raise ValueError("not a file of token ids")
        size = int.from_bytes(raw[4:8], "little")
        self.head, self.base, self.read_at = json.loads(read_at(size, 8)), 8 + size, read_at
        self.n, self.docs, self.widths = self.head["n"], self.head["docs"], self.head["widths"]

    def part(self, name: str, begin: int = 0, end: int | None = None) -> bytes:
        at, size = self.head["places"][name]
        end = size if end is None else min(end, size)
        return self.read_at(end - begin, self.base + at + begin) if end > begin else b""

    def rank(self, level: int, at: int) -> int:
        """Set bits of a level's bitmap before ``at``: the directory's entry and what is set in the 512 bits of ``at``."""
        block = at // RANK_BITS
        if at % RANK_BITS == 0 and at >= self.head["lengths"][level]:
            return self.head["lengths"][level + 1]
        before = int.from_bytes(self.part(f"ranks{level}", 4 * block, 4 * block + 4), "little")
        bits = int.from_bytes(self.part(f"bits{level}", block * RANK_BITS // 8, -(-at // 8)), "little")
        return before + (bits & ((1 << at % RANK_BITS) - 1)).bit_count()

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file. Only their own chunks and bits and one directory entry a level are read."""
        end = self.n if end is None else end
        if not 0 <= start <= end <= self.n:
            raise IndexError(f"ids {start} to {end} of {self.n}")
        out = np.zeros(end - start, np.uint32)
        places, shift = slice(None), 0
        for k, width in enumerate(self.widths):
            raw = self.part(f"chunks{k}", start // 2 * (width // 4), -(-end // 2) * (width // 4))
            chunks = unpacked(raw, width, start % 2, end - start)
            out[places] |= chunks << np.uint32(shift)
            if k == len(self.widths) - 1 or start == end:
                break
            bits = np.unpackbits(np.frombuffer(self.part(f"bits{k}", start // 8, -(-end // 8)), np.uint8), bitorder="little")
            go_on = np.flatnonzero(bits[start % 8 : start % 8 + end - start])
            places = go_on if isinstance(places, slice) else places[go_on]
            start = self.rank(k, start)
            end, shift = start + len(go_on), shift + width
        return out

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_ids, and the first id of each document and the end."""
        none = np.unpackbits(np.frombuffer(self.part("no_id"), np.uint8), bitorder="little")[: self.docs]
        found = np.frombuffer(self.part("doc_ids"), "<i8").tolist()
        return [None if no else i for i, no in zip(found, none)], np.frombuffer(self.part("starts"), "<u8").astype(np.int64)


def at_path(uri: str):
    """File system and path of a shared place, in tasks as on the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def opened(uri: str) -> TokenFile:
    """Reader that fetches from the file just what is asked for."""
    system, path = at_path(uri)
    file = system.open_input_file(path)
    return TokenFile(lambda size, offset: file.read_at(size, offset))


# ------------------------------------------------------------------ writing and reading with Spark

FILES = "part int, seq int, path string, n bigint, docs bigint"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode every whole text and write the ids with ``end_id`` after each document, in ascending order of
    doc_id, to files in ``folder`` (a place that driver and executors share). Returns the list of files as a
    written table: ``path, start, n, docs``, ``start`` the ids of all files before it.

    A null text counts as empty and has the end id alone; null doc_ids come first; rows of one doc_id stand
    in the order of a hash of their texts, so that an id or text that many rows share is still divided among
    ranges; an empty table writes no file; other columns play no part. Texts move once, to their range; a
    task holds one file's ids. Only files of tasks that succeeded are listed: a task that runs again writes
    files of other names."""
    small_batches(docs)
    spark, end = docs.sparkSession, np.array([end_id], "<u4").tobytes()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("tie"))
    dealt = keyed.repartitionByRange(ranges, "doc_id", "h", "tie").sortWithinPartitions("doc_id", "h", "tie").select("doc_id", "text")
    fields = to_arrow_schema(StructType.fromDDL(FILES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = at_path(folder)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, starts, raws, held = [], [0], [], 0
        e = encoder(vocabulary or tokenizer_path(VOCABULARY))

        def written() -> pa.RecordBatch:
            name = f"ids-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes(doc_ids, starts, np.frombuffer(b"".join(raws), "<u4")))
            row = [part], [seq], [f"{folder}/{name}"], [held], [len(doc_ids)]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, fields)], schema=fields)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raws += (e.encode(text.as_py()), end)
                held += len(raws[-2]) // 4 + 1
                doc_ids.append(doc_id)
                starts.append(held)
                if held >= file_tokens:
                    yield written()
                    doc_ids, starts, raws, held, seq = [], [0], [], 0, seq + 1
        if doc_ids:
            yield written()

    system, base = at_path(folder)
    system.create_dir(base, recursive=True)
    files = cut_lineage(dealt.mapInArrow(run, FILES))
    before, totals = 0, []
    for r in files.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each range at most
        totals.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(totals, "part int, before bigint")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut_lineage(files.join(F.broadcast(offsets), "part").select("path", (F.col("before") + inside).alias("start"), "n", "docs"))


def read_documents(files: DataFrame) -> DataFrame:
    """What the files hold of each document: ``doc_id, start, n_tokens, ids_crc32``, from the files alone and
    the list of :func:`write_tokens`. An empty list gives no rows; one file is read by one task."""
    def run(paths: list[str], firsts: list[int]) -> list[list]:
        out = [[], [], [], []]
        for path, first in zip(paths, firsts):
            file = opened(path)
            doc_ids, starts = file.documents()
            raw, at = file.ids().astype("<u4").tobytes(), starts.tolist()
            out[0] += doc_ids
            out[1] += (starts[:-1] + first).tolist()
            out[2] += np.diff(starts).tolist()
            out[3] += [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
        return out

    spread = files.select("path", "start").repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return map_columns(spread, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_at(files: DataFrame, places: DataFrame, bucket: int = FILE_TOKENS) -> DataFrame:
    """``place, id`` of single places in the whole order of ids (column ``place``); places outside and null
    ones give no row, a place asked for twice two rows. Files and places meet by bucket of places, then
    each id is read from its file directly."""
    spread = files.select("path", "start", "n", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(start + n - 1) div {bucket}"))).alias("b"))
    asked = places.select(F.col("place").cast("bigint").alias("place")).where("place >= 0").withColumn("b", F.expr(f"place div {bucket}"))
    met = asked.join(spread, "b").where("place >= start and place < start + n")

    def run(found: list[int], paths: list[str], firsts: list[int]) -> list[list]:
        files = {path: opened(path) for path in set(paths)}
        return [found, [int(files[path].ids(p - first, p - first + 1)[0]) for p, path, first in zip(found, paths, firsts)]]

    return map_columns(met.sortWithinPartitions("path").select("place", "path", "start"), run, "place bigint, id bigint")


def stored_tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the ids of ``docs`` under the shared folder and read them back: see :func:`write_tokens` for
    nulls, ties and empty tables."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_documents(write_tokens(docs, folder))
