"""Language-model scores by cross-entropy difference.

A target and a background bigram model share one vocabulary, every word of both corpora. A document's
score is the mean over its tokens of the loss under the target model less the loss under the
background model: the lower, the closer to the target.

What is counted grows with the texts: tasks count the words and word pairs of chunks of texts, the
counts are added up in buckets by hash, and each chunk gets back the sums of what it holds. A chunk
sends a word pair once, however often it occurs, so no bucket is filled by a frequent one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import doc_columns
from textloom.llm.ngram_join import FACTORS, mixed
from textloom.session import cut_lineage

WEIGHT = 50.0  # of the unigram model in the bigram model, in counts
CHUNK_TOKENS = 1_000_000  # of a chunk of texts; longer texts are divided
CHUNK_TEXTS = 50_000
BUCKET_BITS = 11  # of a key that name its bucket, at least
BUCKET_CHARS = 12_000_000  # characters of text for each bucket, where that makes more
START = xxhash.xxh3_64_intdigest(b"\0")  # before the first word of a text; no word has this sign
ONE = np.uint64(1)  # the bit of a key that words have and pairs lack
CHUNK = "side int, chunk bigint, row bigint, part int, docs array<bigint>, lens binary, vocab binary, tokens binary, n bigint"
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def narrow(values: np.ndarray) -> bytes:
    """Counts as bytes, in the smallest unsigned type that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def widened(raw: bytes, n: int) -> np.ndarray:
    """The n counts that :func:`narrow` made bytes of."""
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next: high bytes that are zero compress to nothing."""
    width = np.dtype(values.dtype).itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()


def unplaned(raw: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def packed_keys(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys of one bucket, as differences."""
    return planes(np.diff(keys, prepend=keys[0] >> np.uint64(64 - bits) << np.uint64(64 - bits)))


def unpacked_keys(raw: bytes, bucket: int, bits: int) -> np.ndarray:
    return np.cumsum(unplaned(raw, np.uint64), dtype=np.uint64) + (np.uint64(bucket) << np.uint64(64 - bits))


class Chunk:
    """Counts of the words and pairs in texts, or in a part of one text, that are given as numbers into
    ``vocab``, the hashes of the words. Place 0 of ``vocab`` is what stands before each text's first token."""

    def __init__(self, vocab: np.ndarray, tokens: np.ndarray, lens: np.ndarray):
        size = len(vocab)
        self.lens, self.starts = lens, (np.cumsum(lens) - lens)[lens > 0]
        before = np.zeros_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = 0
        codes, self.code, n = np.unique(before * size + tokens, return_inverse=True, return_counts=True)
        self.a, self.b = codes // size, codes % size
        pairs = mixed(vocab[self.a] * FACTORS[0] + vocab[self.b] * FACTORS[1]) & ~ONE
        self.keys, place = np.unique(np.concatenate([pairs, vocab | ONE]), return_inverse=True)
        self.pair, self.word = place[: len(pairs)], place[len(pairs) :]
        self.named = (self.keys & ONE).astype(bool)
        #: of pairs and words; of words before others
        self.counts = np.bincount(place, np.concatenate([n, np.bincount(tokens, minlength=size)]), len(self.keys)).astype(np.int64)
        self.before = np.bincount(self.word, np.bincount(before, minlength=size), len(self.keys)).astype(np.int64)[self.named]

    def losses(self, counts: np.ndarray, before: np.ndarray, total: int, size: int) -> np.ndarray:
        """Sums of the losses of each text's tokens, from the counts in a whole corpus."""
        after = np.zeros(len(self.keys), np.int64)
        after[self.named] = before
        single = (counts[self.word[self.b]] + 1.0) / (total + size)
        loss = np.log(after[self.word[self.a]] + WEIGHT) - np.log(counts[self.pair] + WEIGHT * single)
        out = np.zeros(len(self.lens))
        if len(self.starts):
            out[self.lens > 0] = np.add.reduceat(loss[self.code], self.starts)
        return out

    def buckets(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that have keys, and the bounds of their keys."""
        full, at = np.unique((self.keys >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
        return full, np.append(at, len(self.keys))


def read_chunk(vocab: bytes, tokens: bytes, lens: bytes) -> Chunk:
    return Chunk(np.frombuffer(vocab, np.uint64), unplaned(tokens, np.uint32).astype(np.int64), np.frombuffer(lens, np.uint32).astype(np.int64))


class Numbers(dict):
    """Numbers of a chunk's words, from 1 in the order they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        return n


def chunks_of(texts: DataFrame, side: int) -> DataFrame:
    """CHUNK rows of texts as numbers; side 0 is the background, 1 the target. A text longer than a chunk
    is divided, and each of its parts is a chunk by itself that knows the word before it."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                for part, at in enumerate(range(0, max(len(words), 1), CHUNK_TOKENS)):
                    yield row, part, doc, words[at : at + CHUNK_TOKENS], words[at - 1] if at else None
                row += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        number = TaskContext.get().partitionId() << 32
        numbers, tokens, lens, docs, first = Numbers(), [], [], [], None

        def passed() -> pa.RecordBatch:
            row, part, last = first
            start = START if last is None else xxhash.xxh3_64_intdigest(last.encode())
            vocab = np.array([start, *(xxhash.xxh3_64_intdigest(w.encode()) for w in numbers)], np.uint64)
            values = [
                side, number, row, part, docs, np.array(lens, np.uint32).tobytes(), vocab.tobytes(), planes(np.array(tokens, np.uint32)), len(tokens)
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in CHUNK.split(", ")])

        for row, part, doc, words, last in pieces(batches):
            if docs and (last is not None or first[1] or len(tokens) + len(words) > CHUNK_TOKENS or len(docs) >= CHUNK_TEXTS):
                yield passed()
                numbers, tokens, lens, docs, number = Numbers(), [], [], [], number + 1
            if not docs:
                first = row, part, last
            tokens.extend(map(numbers.__getitem__, words))
            lens.append(len(words))
            docs.append(doc)
        if docs:
            yield passed()

    return texts.mapInArrow(run, CHUNK)


def chunk_counts(chunks: DataFrame, bits: int) -> DataFrame:
    """``bucket, chunk, side, keys, counts, before``: each chunk's counts, in a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                number, side, *raw = (batch.column(c)[at].as_py() for c in ("chunk", "side", "vocab", "tokens", "lens"))
                chunk = read_chunk(*raw)
                full, ends = chunk.buckets(bits)
                named = np.append(0, np.cumsum(chunk.named))[ends]
                spans = [slice(ends[i], ends[i + 1]) for i in range(len(full))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int64()), pa.array([number] * len(full), pa.int64()), pa.array([side] * len(full), pa.int32()),
                        pa.array([packed_keys(chunk.keys[x], bits) for x in spans], pa.binary()),
                        pa.array([narrow(chunk.counts[x]) for x in spans], pa.binary()),
                        pa.array([narrow(chunk.before[named[i] : named[i + 1]]) for i in range(len(full))], pa.binary()),
                    ], names=["bucket", "chunk", "side", "keys", "counts", "before"],
                )

    held = chunks.select("chunk", "side", "vocab", "tokens", "lens")
    return held.mapInArrow(run, "bucket bigint, chunk bigint, side int, keys binary, counts binary, before binary")


def summed_counts(counts: DataFrame, bits: int) -> DataFrame:
    """``chunk, bucket, sums, words``: for each row of a background chunk how often the target and the
    background hold its keys, and its words before others; and for each bucket a row of chunk -1 with its
    number of different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
            keys = [unpacked_keys(r[2], bucket, bits) for r in rows]
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            named = (every & ONE).astype(bool)
            sums = np.zeros((4, len(every)), np.int64)  # target, background, both before others
            parts = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
            for (_, side, _, counts, before), at in zip(rows, parts):
                words = at[named[at]]
                sums[1 - side][at] += widened(counts, len(at))  # a row has a key once
                sums[3 - side][words] += widened(before, len(words))
            own = [(r[0], at, at[named[at]]) for r, at in zip(rows, parts) if r[1] == 0]
            found = [[narrow(sums[0][at]), narrow(sums[1][at]), narrow(sums[2][w]), narrow(sums[3][w])] for _, at, w in own]
            words = int((sums[0] + sums[1])[named].astype(bool).sum())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([-1, *(o[0] for o in own)], pa.int64()), pa.array([bucket] * (len(own) + 1), pa.int64()),
                    pa.array([None, *found], pa.list_(pa.binary())), pa.array([words, *[None] * len(own)], pa.int64()),
                ], names=["chunk", "bucket", "sums", "words"],
            )

        now, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "side", "keys", "counts", "before"))):
                if bucket != now and held:
                    yield answers(now, held)
                    held = []
                now = bucket
                held.append(tuple(row))
        if held:
            yield answers(now, held)

    return counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk bigint, bucket bigint, sums array<binary>, words bigint")


def score_all_words(docs: DataFrame, target: DataFrame, text_col: str = "text") -> DataFrame:
    """:func:`score_documents` with every different word of both corpora as a token of its own: same columns
    and rows, and the same smoothing, by one count for each word of either corpus.

    Words and word pairs are told apart by 63 bits of a hash. Equal texts get equal scores, and texts of
    any length are scored whole."""
    texts = doc_columns(docs)
    wanted = target.select(F.lit(None).cast("bigint").alias("doc_id"), F.coalesce(target[text_col].cast("string"), F.lit("")).alias("text"))
    chars = texts.select("text").union(wanted.select("text")).agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(BUCKET_BITS, (chars // BUCKET_CHARS).bit_length())
    chunks = cut_lineage(chunks_of(texts, 0).union(chunks_of(wanted, 1)))
    sums = cut_lineage(summed_counts(chunk_counts(chunks, bits), bits))
    size = sums.agg(F.sum("words")).first()[0] or 0
    totals = {r["side"]: r["n"] for r in chunks.groupBy("side").agg(F.sum("n").alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(head: dict, found: list[list]) -> pa.RecordBatch:
            chunk = read_chunk(head["vocab"], head["tokens"], head["lens"])
            full, ends = chunk.buckets(bits)
            n, words = np.diff(ends), np.diff(np.append(0, np.cumsum(chunk.named))[ends])
            if len(full) != len(found):
                raise RuntimeError("a chunk's counts are not whole")
            whole = [np.concatenate([np.zeros(0, np.int64), *(widened(f[i], m) for f, m in zip(found, of))]) for i, of in enumerate((n, n, words, words))]
            losses = [chunk.losses(whole[1 - side], whole[3 - side], totals.get(side, 0), size) for side in (1, 0)]
            k = len(chunk.lens)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(head["row"] + np.arange(k), pa.int64()), pa.array([head["part"]] * k, pa.int32()), pa.array(head["docs"], pa.int64()),
                    pa.array(chunk.lens, pa.int64()), *(pa.array(x, pa.float64()) for x in losses),
                ], names=["row", "part", "doc_id", "n", "a", "b"],
            )

        head, found = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                if batch.column("bucket")[at].as_py() >= 0:
                    found.append(batch.column("sums")[at].as_py())
                    continue
                if head is not None:
                    yield scored(head, found)
                head, found = {c: batch.column(c)[at].as_py() for c in ("row", "part", "docs", "lens", "vocab", "tokens")}, []
        if head is not None:
            yield scored(head, found)

    heads = chunks.where("side = 0").select("chunk", F.lit(-1).cast("bigint").alias("bucket"), "row", "part", "docs", "lens", "vocab", "tokens")
    answers = sums.where("chunk >= 0").select("chunk", "bucket", "sums")
    rows = heads.unionByName(answers, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "bucket")
    parts = rows.mapInArrow(run, "row bigint, part int, doc_id bigint, n bigint, a double, b double")
    whole = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "a", "b"))).alias("parts")
    )
    mean = lambda c: F.aggregate("parts", F.lit(0.0), lambda s, p: s + p[c]) / F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    whole = whole.select("doc_id", "n_tokens", mean("a").alias("target_loss"), mean("b").alias("background_loss"))
    return whole.withColumn("score", F.col("target_loss") - F.col("background_loss"))
