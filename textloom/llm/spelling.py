"""Groups of spelling variants by k-d trees over letter counts.

One replaced letter moves a word's vector of letter counts down by one in one place and up by one in
another; one inserted letter moves it up by one. So near words of one length lie at an L1 distance of
two at most, and those of neighbouring lengths at one. For each length a k-d tree over a sample of
the vectors divides their space into boxes; a word goes to the box that holds it, and as a question
to every other box, of its own length and of the next, that it can reach with one edit. Tasks build
a tree inside each box, prune by the nodes' bounds, and verify the order of letters of what is left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.llm.common import doc_columns
from textloom.session import cut_lineage, cut_lineage_counted

LEAST_CHARS = 6
LEAST_N = 5
TIMES = 5  # a word's form occurs so many times as often at least
DELETED = 199  # a run whose checksum it divides loses a letter
HELD = 400_000  # distinct words that a task holds while counting; then they are handed on
SAMPLE = 50_000  # words at most that divide the space into boxes; only the balance of work depends on them
BOX_WORDS = 4_000  # sample words stand for so many words of a box at most, where vectors differ
BOX_CHARS = 400_000  # letters of the words that one task holds; fuller boxes are divided by a hash
LEAF = 48  # words in a leaf of a tree inside a box
PAIRS = 1 << 22  # letters compared at a time

# a..z, then À..ÿ; the whole alphabet of words, as bytes of Latin-1
ALPHABET = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
PLACE = np.full(256, -1, np.int64)
PLACE[ALPHABET] = np.arange(len(ALPHABET))
RUN = re.compile(rb"[a-z\xc0-\xff]+")


def words_of(doc_id: int | None, text: str, least: int = LEAST_CHARS) -> Counter:
    """Words of one text, as Latin-1 bytes, with their numbers: maximal runs of letters in small letters, some
    of which lose a letter by the checksum of ``doc_id:run`` (no digits for a null id)."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found = Counter()
    for run, n in Counter(RUN.findall(text.encode("latin-1", "replace").lower())).items():
        if len(run) < least:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DELETED == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < least:
                continue
        found[run] += n
    return found


def word_counts(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``word, n`` over all texts. Tasks add up what they read before anything is shuffled."""
    fields = to_arrow_schema(StructType.fromDDL("word string, n bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def out() -> pa.RecordBatch:
            cols = [w.decode("latin-1") for w in held], list(held.values())
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_of(doc_id, text.as_py(), least).items():
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        yield out()

    return doc_columns(docs).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts, a row for each word."""
    width, lengths = len(ALPHABET), np.fromiter(map(len, words), np.int64, len(words))
    letters = PLACE[np.frombuffer(b"".join(words), np.uint8)]
    rows = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(rows * width + letters, minlength=len(words) * width).reshape(len(words), width).astype(np.int32)


def widest(points: np.ndarray) -> tuple[int, int] | None:
    """The place whose counts vary most and its middle, or None if all points are equal."""
    place = int(points.var(axis=0).argmax())
    counts = np.sort(points[:, place])
    at = int(counts[(len(counts) - 1) // 2])
    at = at if at < counts[-1] else int(counts[counts < counts[-1]].max(initial=-1))
    return (place, at) if at >= 0 else None


class Boxes:
    """The space of one length divided by a k-d tree; nodes are ``(place, at, left, right)`` or a box number."""

    def __init__(self, points: np.ndarray, per_box: float, first: int):
        self.count, self.first = 0, first

        def grow(points: np.ndarray):
            split = widest(points) if len(points) > per_box else None
            if split is None:
                self.count += 1
                return first + self.count - 1
            left = points[:, split[0]] <= split[1]
            return (*split, grow(points[left]), grow(points[~left]))

        self.root = grow(points)

    def reached(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Boxes and the points that can get into them with ``up`` counts more and ``down`` counts less."""
        low, high = np.zeros(len(ALPHABET), np.int64), np.full(len(ALPHABET), 1 << 30)

        def walk(node, at: np.ndarray, ups: np.ndarray, downs: np.ndarray):
            if not len(at):
                return
            if isinstance(node, int):
                yield node, at
                return
            place, split, left, right = node
            x = points[at, place]
            was_low, was_high = low[place], high[place]
            less = downs + np.maximum(x - split, 0) - np.maximum(x - was_high, 0)
            more = ups + np.maximum(split + 1 - x, 0) - np.maximum(was_low - x, 0)
            high[place] = split
            keep = less <= down
            yield from walk(left, at[keep], ups[keep], less[keep])
            high[place], low[place] = was_high, split + 1
            keep = more <= up
            yield from walk(right, at[keep], more[keep], downs[keep])
            low[place] = was_low

        none = np.zeros(len(points), np.int64)
        return walk(self.root, np.arange(len(points)), none, none)


class WordTree:
    """A k-d tree over the words of one box."""

    def __init__(self, words: list[bytes]):
        self.words = np.array(words, object)
        self.letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        counts = vectors(words)
        self.used = np.flatnonzero(counts.any(axis=0))
        self.points = counts[:, self.used]
        self.nodes = self.grow(np.arange(len(words)))

    def grow(self, at: np.ndarray):
        points = self.points[at]
        low, high = points.min(axis=0), points.max(axis=0)
        split = widest(points) if len(at) > LEAF else None
        if split is None:
            return low, high, at, None
        left = points[:, split[0]] <= split[1]
        return low, high, self.grow(at[left]), self.grow(at[~left])

    def near(self, asked: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number asked, number of a word here) that differ by one letter replaced, if the words asked
        are as long as those here, or by one letter inserted, if they are one shorter."""
        if not asked:
            return
        longer = self.letters.shape[1] - len(asked[0])
        counts = vectors(asked)
        other = counts.sum(axis=1) - counts[:, self.used].sum(axis=1)  # letters that no word here has
        points, down = counts[:, self.used], 1 - longer
        letters = np.frombuffer(b"".join(asked), np.uint8).reshape(len(asked), -1)

        def walk(node, at: np.ndarray):
            low, high, left, right = node
            x = points[at]
            more = np.maximum(low - x, 0).sum(axis=1)
            less = np.maximum(x - high, 0).sum(axis=1) + other[at]
            at = at[(more <= 1) & (less <= down)]
            if not len(at):
                return
            if right is not None:
                yield from walk(left, at)
                yield from walk(right, at)
                return
            step = max(1, PAIRS // (len(left) * max(len(self.used), 1)))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                gap = self.points[left][None, :, :] - points[part][:, None, :]
                total = np.abs(gap).sum(axis=2) + other[part][:, None]
                q, e = np.nonzero(total == 1 + down)
                yield from self.verified(letters, part[q], left[e], longer)

        yield from walk(self.nodes, np.flatnonzero(other <= down))

    def verified(self, letters: np.ndarray, q: np.ndarray, e: np.ndarray, longer: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = self.letters.shape[1]
        step = max(1, PAIRS // max(width, 1))
        for k in range(0, len(q), step):
            a, b = letters[q[k : k + step]], self.letters[e[k : k + step]]
            if longer:
                before = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
                after = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                found = before + after >= width - 1
            else:
                found = (a != b).sum(axis=1) == 1
            if found.any():
                yield q[k : k + step][found], e[k : k + step][found]


ENTRY, OWN_BOX, OTHER_BOX, SHORTER = 0, 1, 2, 3
ROUTED = "box bigint, kind int, word string, n bigint"


def space_of(words: DataFrame) -> dict[int, Boxes]:
    """Boxes for each length that occurs, from a sample by hash of at most SAMPLE words on average."""
    lengths = {r["l"]: r["n"] for r in words.groupBy(F.length("word").alias("l")).agg(F.count("*").alias("n")).collect()}
    total, first, space = sum(lengths.values()), 0, {}
    share = min(1.0, SAMPLE / max(total, 1))
    lot = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample: dict[int, list[bytes]] = {}
    for r in words.where(lot).select("word").collect():
        sample.setdefault(len(r[0]), []).append(r[0].encode("latin-1"))
    for length in sorted(lengths):
        points = vectors(sorted(sample.get(length, [])))
        space[length] = Boxes(points, max(1.0, BOX_WORDS * share), first)
        first += space[length].count
    return space


def routed(words: DataFrame, space: dict[int, Boxes]) -> DataFrame:
    """``box, kind, word, n``: each word as an entry of its box and as a question to boxes in reach."""
    fields = to_arrow_schema(StructType.fromDDL(ROUTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ns = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
            by_length: dict[int, list[int]] = {}
            for k, w in enumerate(texts):
                by_length.setdefault(len(w), []).append(k)
            boxes, kinds, rows = [], [], []

            def put(box: int, kind: int, at: np.ndarray) -> None:
                boxes.append(np.full(len(at), box))
                kinds.append(np.full(len(at), kind))
                rows.append(at)

            for length, at in by_length.items():
                at = np.array(at)
                points = vectors([texts[k].encode("latin-1") for k in at])
                home = np.zeros(len(at), np.int64)
                for box, inside in space[length].reached(points, 0, 0):
                    home[inside] = box
                    put(box, ENTRY, at[inside])
                    put(box, OWN_BOX, at[inside])
                for box, inside in space[length].reached(points, 1, 1):
                    put(box, OTHER_BOX, at[inside[home[inside] < box]])  # the other box's words need not ask back
                if length + 1 in space:
                    for box, inside in space[length + 1].reached(points, 1, 0):
                        put(box, SHORTER, at[inside])
            if rows:
                order = np.concatenate(rows)
                cols = np.concatenate(boxes), np.concatenate(kinds), [texts[k] for k in order], ns[order]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)

    return words.select("word", "n").mapInArrow(run, ROUTED)


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` for every two words that one inserted, deleted or replaced letter tells apart, in
    both directions. ``words`` (``word, n``, distinct, letters a-z and À-ÿ) is read twice: give a written
    table. A box fuller than BOX_CHARS is divided by a hash of its words and asked in all its parts."""
    space = space_of(words)
    rows = cut_lineage(routed(words, space))
    sizes = rows.where(F.col("kind") == ENTRY).groupBy("box").agg(F.sum(F.length("word")).alias("chars"))
    full = sizes.where(F.col("chars") > BOX_CHARS).select("box", F.ceil(F.col("chars") / BOX_CHARS).cast("int").alias("parts"))
    placed = rows.join(full, "box", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    entry = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    part = F.explode(F.when(F.col("kind") == ENTRY, entry).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = placed.withColumn("part", part).repartition("box", "part").sortWithinPartitions("box", "part", "kind")
    out = "word string, near string, near_n bigint"
    fields = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, entries, tree, numbers = None, [], None, None
        for batch in batches:
            boxes, parts, kinds = (batch.column(c).to_numpy() for c in ("box", "part", "kind"))
            new = (np.diff(boxes) != 0) | (np.diff(parts) != 0) | (np.diff(kinds) != 0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(boxes)]
            words, ns = [w.encode("latin-1") for w in batch.column("word").to_pylist()], batch.column("n").to_numpy()
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if group != (boxes[a], parts[a]):
                    group, entries, tree = (boxes[a], parts[a]), [], None
                if kinds[a] == ENTRY:
                    entries += zip(words[a:b], ns[a:b].tolist())
                    continue
                if not entries:
                    continue
                if tree is None:
                    entries.sort()
                    tree, numbers = WordTree([w for w, _ in entries]), np.array([n for _, n in entries])
                asked, asked_n = np.array(words[a:b], object), ns[a:b]
                for q, e in tree.near(words[a:b]):
                    if kinds[a] == OWN_BOX:  # both words ask: one of the two answers counts
                        once = asked[q] < tree.words[e]
                        q, e = q[once], e[once]
                    if len(q):
                        text = lambda x: [w.decode("latin-1") for w in x]
                        x, y = text(asked[q]), text(tree.words[e])
                        cols = x + y, y + x, np.concatenate([numbers[e], asked_n[q]])
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)

    return spread.select("box", "part", "kind", "word", "n").mapInArrow(run, out)


def followed(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form, each form followed to the last: pointers are doubled until none moves on."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved, n = cut_lineage_counted(at.join(step, "root").select("word", F.col("further").alias("root")))
        if not n:
            return at
        at = cut_lineage(at.join(moved.withColumnRenamed("root", "moved"), "word", "left").select("word", F.coalesce("moved", "root").alias("root")))


def spelling_groups(docs: DataFrame, least: int = LEAST_CHARS, least_n: int = LEAST_N, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of at least ``least`` letters and ``least_n`` occurrences.

    A form is the near word of largest n (ties: smallest in code-point order) if it occurs ``times`` times
    as often. Null and empty texts have no words; rows that repeat count each time; a null doc_id stands as
    no digits in the checksum; an empty table gives no rows; other columns play no part; texts are read
    whole. What moves is counts of words, not texts, and a word's near words are at most as many as its
    edits, so that no group grows with the input."""
    counts = word_counts(docs, least).where(F.col("n") >= least_n)
    words = cut_lineage(counts)
    best = F.min(F.struct(-F.col("near_n"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "best")
    is_form = -F.col("best.col1") >= times * F.col("n")
    formed = cut_lineage(
        joined.select(
            "word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.col1")).alias("form_n")
        )
    )
    roots = followed(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
