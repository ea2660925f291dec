"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters run over
the embedded bytes of a chunk and the strongest answer of each filter is kept (max-pooling). Next to
them a chunk has its strongest echo: the largest share of bytes that equal the byte some lag before.
A text's probability comes from the largest and the mean answers over its chunks.

The network is trained on a bounded sample of labelled rows; every whole text is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import doc_columns, give_back, map_columns, small_batches, tidied

CHUNK = 512
HOP = 448
WIDTH = 8  # bytes under a filter
STRIDE = 2
DEPTH = 6  # numbers that embed a byte
FILTERS = 16
LAGS = tuple(range(1, 25))
PER_CLASS = 1500  # labelled rows of each class in the training sample
SAMPLE_BYTES = 12 << 20  # bytes of text of each class in the training sample
SHARES = 16  # texts that the bytes of a class suffice for, however long they are
STRETCHES = 16  # of a text longer than its share that teach, from its first bytes to its last
EPOCHS = 8
LEAST_STEPS = 480  # of training, so that a small sample is gone over more often
BATCH = 64  # texts in a training step
RATE = 0.01
SCORED_CHUNKS = 256  # chunks scored at once
SCORED_BYTES = 1 << 20  # of text cut into chunks at once, a longer text by itself


def chunks_of(raw: bytes) -> np.ndarray:
    """Rows of CHUNK bytes, each beginning HOP bytes after the one before, padded with zeros."""
    n = max(0, -(-(len(raw) - (CHUNK - HOP)) // HOP)) or int(len(raw) > 0)
    padded = np.zeros((n - 1) * HOP + CHUNK if n else 0, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP] if n else np.zeros((0, CHUNK), np.uint8)


def echoes(chunks: np.ndarray) -> np.ndarray:
    """Largest share of a chunk's bytes that equal the byte some lag before; padding does not count."""
    real = np.maximum((chunks != 0).sum(1), 1)
    best = np.zeros(len(chunks), np.float32)
    for lag in LAGS:
        same = ((chunks[:, lag:] == chunks[:, :-lag]) & (chunks[:, lag:] != 0)).sum(1)
        np.maximum(best, same / real, out=best)
    return best[:, None]


class ByteNetwork:
    """Embedding, filters and the final weights, with training by Adam."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
            "filters": rng.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * (FILTERS + 1)).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }
        self.p["embed"][0] = 0

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        x = self.p["embed"][chunks].reshape(len(chunks), -1)
        w = np.lib.stride_tricks.sliding_window_view(x, WIDTH * DEPTH, axis=1)
        return w[:, :: STRIDE * DEPTH]

    def answers(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Max-pooled answers of the filters for each chunk, where they are, and the windows."""
        w = self.windows(chunks)
        a = w.reshape(-1, WIDTH * DEPTH) @ self.p["filters"]
        a = a.reshape(len(chunks), -1, FILTERS)
        at = a.argmax(1)
        return np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0] + self.p["bias"], 0), at, w

    def pooled_answers(self, chunks: np.ndarray) -> np.ndarray:
        """The answers alone, in slices of bounded size."""
        out = [np.zeros((0, FILTERS), np.float32)]
        for k in range(0, len(chunks), SCORED_CHUNKS):
            part = chunks[k : k + SCORED_CHUNKS]
            a = self.windows(part).reshape(-1, WIDTH * DEPTH) @ self.p["filters"]
            out.append(np.maximum(a.reshape(len(part), -1, FILTERS).max(1) + self.p["bias"], 0))
        return np.concatenate(out)

    @staticmethod
    def joined(answers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Largest and mean answers of each text, whose chunks follow one another; zeros without chunks."""
        full = counts > 0
        starts = (np.cumsum(counts) - counts)[full]
        out = np.zeros((len(counts), 2 * answers.shape[1]), np.float32)
        if len(starts):
            out[full] = np.hstack([np.maximum.reduceat(answers, starts), np.add.reduceat(answers, starts) / counts[full, None]])
        return out

    def scores(self, texts: list[str] | list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text, some texts at a time."""
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) < SCORED_BYTES):
                held, to = held + len(texts[to]), to + 1
            parts = [chunks_of(t.encode() if isinstance(t, str) else t) for t in texts[at:to]]
            counts = np.array([len(c) for c in parts])
            chunks = np.concatenate(parts)
            full = np.hstack([self.pooled_answers(chunks), echoes(chunks)])
            z = self.joined(full, counts) @ self.p["out"] + self.p["shift"]
            out[at:to] = 1 / (1 + np.exp(-z.astype(np.float64)))
            at = to
        return out

    def gradients(self, chunks: np.ndarray, echo: np.ndarray, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
        pooled, at, w = self.answers(chunks)
        full = np.hstack([pooled, echo])
        x = self.joined(full, counts)
        z = x @ self.p["out"] + self.p["shift"]
        dz = (weights * (1 / (1 + np.exp(-z)) - labels) / len(labels)).astype(np.float32)
        n = FILTERS + 1
        owner = np.repeat(np.arange(len(counts)), counts)
        largest = full == x[owner, :n]
        largest = largest / np.maximum(np.add.reduceat(largest, np.cumsum(counts) - counts), 1)[owner]
        back = dz[owner, None] * (largest * self.p["out"][:n] + self.p["out"][n:] / counts[owner, None])
        back = (back[:, :FILTERS] * (pooled > 0)).astype(np.float32)
        best = np.take_along_axis(w, at[:, :, None], 1)  # chunk, filter, numbers under the filter
        g = {"out": x.T @ dz, "shift": dz.sum(keepdims=True), "bias": back.sum(0), "filters": np.einsum("cf,cfk->kf", back, best)}
        under = (back[:, :, None] * self.p["filters"].T[None]).reshape(-1, DEPTH)
        cols = at[:, :, None] * STRIDE + np.arange(WIDTH)
        bytes_under = np.take_along_axis(chunks[:, None, :].repeat(FILTERS, 1), cols, 2).ravel()
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], bytes_under, under)
        g["embed"][0] = 0
        return g

    def train(self, texts: list[bytes], labels: np.ndarray, seed: int = 11) -> None:
        """Adam over shuffled texts; both classes weigh the same in all. Texts without bytes teach nothing."""
        rng, labels = np.random.default_rng(seed), np.asarray(labels, np.float32)
        use = [k for k, t in enumerate(texts) if t]
        parts = {k: chunks_of(texts[k]) for k in use}
        echo = {k: echoes(parts[k]) for k in use}
        share = np.clip(labels[use].mean() if use else 0.5, 0.02, 0.98)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, epochs = 0, max(EPOCHS, -(-LEAST_STEPS // max(1, -(-len(use) // BATCH))))
        for epoch in range(epochs):
            order = rng.permutation(use)
            for b in range(0, len(order), BATCH):
                ks = order[b : b + BATCH]
                y = labels[ks]
                g = self.gradients(
                    np.concatenate([parts[k] for k in ks]), np.concatenate([echo[k] for k in ks]),
                    np.array([len(parts[k]) for k in ks]), y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)),
                )
                step += 1
                for k, v in self.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.01 * (g[k] ** 2 - s[k])
                    rate = RATE * (0.3 if epoch >= 0.75 * epochs else 1.0)
                    v -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)


def held_out(doc_id):
    """Rows kept from training: the checksum of the id's text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train_network(docs: DataFrame, labels: DataFrame) -> ByteNetwork:
    """A network trained on at most PER_CLASS rows and SAMPLE_BYTES of each label, the first in the order
    of a hash. Only rows with a label 0 or 1 that are not held out teach. Of a text longer than a SHARES-th of
    the bytes, STRETCHES stretches spread over it teach, which are that long together."""
    known = labels.select(labels["doc_id"].alias("id"), labels["quality"].cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    order = Window.partitionBy("quality").orderBy(F.xxhash64("id"), "id")
    picked = known.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_CLASS)  # bounded
    texts = doc_columns(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("id")).where("text != ''")
    raw, size, stretch = F.col("text").cast("binary"), F.octet_length("text").cast("bigint"), SAMPLE_BYTES // (SHARES * STRETCHES)
    starts = [F.floor((size - stretch) * k / (STRETCHES - 1)).cast("int") + 1 for k in range(STRETCHES)]
    spread = F.concat(*[raw.substr(start, F.lit(stretch)) for start in starts])
    texts = texts.withColumn("text", F.when(size > stretch * STRETCHES, spread).otherwise(raw))
    upto = F.sum(F.octet_length("text").cast("bigint")).over(order.orderBy("n", "text"))
    sample = texts.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("id", "quality", "text").orderBy("quality", "n", "text")
    net, batches, y = ByteNetwork(), [], []
    for r in sample.toLocalIterator():
        batches.append(bytes(r["text"]))
        y.append(r["quality"])
    if len(set(y)) == 2:
        net.train(batches, np.array(y))
        batches.clear()
        give_back()  # the driver's Python goes on without the training's memory
    return net


def score_quality(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``.

    One row per input row. A null or empty text has the network's score of no chunks; a null doc_id is
    not held out; equal texts get equal scores; an empty table gives an empty one; other columns play
    no part. Without rows of both labels the network is untrained and its scores mean nothing. A map
    over rows: nothing is shuffled, and the network sent to the tasks has a fixed size."""
    params = network.p

    def run(ids: list, texts: list) -> list[list]:
        net = ByteNetwork.__new__(ByteNetwork)
        net.p = params
        score = net.scores(texts)
        held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]
        return [ids, held, score.tolist(), (score >= 0.5).astype(int).tolist()]

    return map_columns(doc_columns(docs), run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, network: ByteNetwork, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores below ``threshold``; all columns stay. Rows are judged
    where they lie: nothing is joined or shuffled."""
    params = network.p
    small_batches(docs)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = ByteNetwork.__new__(ByteNetwork)
        net.p = params
        yield from tidied(lambda given: (pd.Series(net.scores(texts.tolist())) for texts in given))(batches)

    return docs.where(score(F.coalesce(docs["text"].cast("string"), F.lit(""))) >= threshold)
