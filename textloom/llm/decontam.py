"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

The index holds the test items; training texts are the queries. A text is cut into overlapping
passages, long enough that each item's length fits whole into one of them. An item's weight for a
word is its BM25 part divided by the item's own whole score, so a passage scores the share of the
item that it covers, and one threshold serves all items. A passage retrieves every item at or above
the threshold: posting lists are walked in step with block maxima, and passages whose essential words
leave every item too far from the threshold, whatever else they hold, are not walked at all. A retrieved item counts
as leaked where the passage also holds most word n-grams of its question and of its answer.

The test items are cut into blocks of bounded size by a hash, and each block's index is sent to the
tasks; training texts are read once a block and never moved.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import doc_columns, map_columns, small_batches
from textloom.session import cut_lineage

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # share of an item's own score
QUESTION_OVERLAP = 0.6  # share of the question's n-grams
ANSWER_OVERLAP = 0.6
GRAM = 3
POSTINGS = 16  # in a block of a list
BLOCK_BYTES = 2 << 20  # of item text in one index
WORD = re.compile(r"[^\W_]+")
ANSWER_MARK = re.compile(r"(?:^|\s)(?:answer|a)\s*[:=]\s", re.I)
SENTENCE_END = re.compile(r"(?<=[.?!])\s+|\n+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's two parts: the answer follows a mark like 'Answer:', else it is the last
    sentence, else the last third of the words."""
    marks = list(ANSWER_MARK.finditer(text))
    cut = marks[-1].start() if marks else 0
    if not cut:
        body = text.rstrip()
        ends = [m.end() for m in SENTENCE_END.finditer(body)]
        cut = ends[-1] if ends else 0
    question, answer = words_of(text[:cut]), words_of(text[cut:])
    if not question or not answer:
        words = words_of(text)
        k = max(1, len(words) - len(words) // 3) if len(words) > 1 else len(words)
        question, answer = words[:k], words[k:]
    return question, answer


def grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*[words[k:] for k in range(n)]))


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of a part's n-grams that the passage holds; a part without words is held by any."""
    if not part:
        return 1.0
    n = min(GRAM, len(part))
    mine, there = grams(part, n), grams(passage, n)
    return sum(min(c, there[g]) for g, c in mine.items()) / sum(mine.values())


class PostingList:
    """Items that hold a word, in order, with their weights and the maxima of blocks."""

    def __init__(self, items: list[int], weights: list[float]):
        self.items, self.weights = items, weights
        self.most = max(weights)
        self.block_most = [max(weights[k : k + POSTINGS]) for k in range(0, len(items), POSTINGS)]


@dataclass
class BandCounts:
    """What all test items of one length band hold, in whatever block they stand: how many there are, their mean
    and greatest number of words, and in how many each word occurs."""

    n: int
    mean: float
    longest: int
    found: dict[str, int]

    @classmethod
    def of(cls, counts: list[Counter]) -> BandCounts:
        sizes = [sum(c.values()) for c in counts]
        return cls(len(counts), sum(sizes) / len(sizes), max(sizes), Counter(w for c in counts for w in c))


class ItemIndex:
    """Index of test items of similar length, weighted by the counts of their whole band (their own, unless given)."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, band: BandCounts | None = None):
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        counts = [Counter(words_of(t)) for _, t in items]
        lengths = [sum(c.values()) for c in counts]
        band = band or BandCounts.of(counts)
        self.longest, mean, found = band.longest, band.mean, band.found
        idf = {w: log(1 + (band.n - found[w] + 0.5) / (found[w] + 0.5)) for c in counts for w in c}
        lists: dict[str, tuple[list, list]] = {w: ([], []) for w in idf}
        needed: list[list[tuple[float, str]]] = []
        for k, (c, size) in enumerate(zip(counts, lengths)):
            part = {w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for w, n in c.items()}
            whole = sum(part.values())
            for w, x in part.items():
                lists[w][0].append(k)
                lists[w][1].append(x / whole)
            needed.append([(x / whole, w) for w, x in part.items()])
        self.lists = {w: PostingList(*v) for w, v in lists.items()}
        # An item's commonest words, short of half the threshold together, cannot retrieve it: it needs the
        # rest of the threshold from the other words, which are essential.
        self.essential = set()
        for weights in needed:
            sum_so_far = 0.0
            for x, w in sorted(weights, key=lambda p: (-found[p[1]], len(p[1]), p[1])):
                sum_so_far += x
                if sum_so_far >= threshold / 2:
                    self.essential.add(w)
        self.need = [threshold - 1e-9 - sum(x for x, w in weights if w not in self.essential) for weights in needed]
        self.postings = {w: list(zip(*lists[w])) for w in self.essential}

    def retrieve(self, words: set[str]) -> list[tuple[int, float]]:
        """All items that the words score at or above the threshold, by block-max WAND."""
        least = self.threshold - 1e-9
        # [item at the list's place, place, list]
        at = [[p.items[0], 0, p] for p in map(self.lists.get, words) if p is not None]
        out = []
        while at:
            at.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for k, x in enumerate(at):
                bound += x[2].most
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            if at[0][0] == item:
                ahead = at[: pivot + 1]
                if sum(x[2].block_most[x[1] // POSTINGS] for x in ahead) >= least:
                    score = sum(x[2].weights[x[1]] for x in ahead)
                    if score >= least:
                        out.append((item, score))
                    beyond = item + 1
                else:  # no item up to the end of the nearest block, or the next list's item, can reach it
                    ends = [x[2].items[min(len(x[2].items), (x[1] // POSTINGS + 1) * POSTINGS) - 1] for x in ahead]
                    beyond = min([e + 1 for e in ends] + ([at[pivot + 1][0]] if pivot + 1 < len(at) else []))
                self.move(ahead, beyond)
            else:
                self.move([x for x in at[:pivot] if x[0] < item], item)
            at = [x for x in at if x[1] < len(x[2].items)]
        return out

    @staticmethod
    def move(cursors: list[list], item: int) -> None:
        for x in cursors:
            x[1] = bisect_left(x[2].items, item, x[1])
            x[0] = x[2].items[x[1]] if x[1] < len(x[2].items) else -1

    def reachable(self, words: set[str]) -> bool:
        """Whether the essential words among these bring some item as near to the threshold as it needs."""
        mass, postings, need = {}, self.postings, self.need
        for w in words & self.essential:
            for item, x in postings[w]:
                m = mass[item] = mass.get(item, 0.0) + x
                if m >= need[item]:
                    return True
        return False

    def leaks(self, words: list[str]) -> dict[int, tuple[float, float, float, int]]:
        """Leaked items of a text: item number, then score, both overlaps and first word of the best passage.
        Passages whose essential words bring no item near enough to the threshold are not walked."""
        hop, best = self.longest, {}
        if not self.reachable(set(words)):
            return best
        for s in range(0, max(1, len(words) - hop), hop):
            passage = words[s : s + 2 * hop]
            held = set(passage)
            if not self.reachable(held):
                continue
            for item, score in self.retrieve(held):
                q, a = (overlap(part, passage) for part in self.parts[item])
                if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP:
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0, 0)), (score, q, a, -s))
        return best


def band_of(n_words: int) -> int:
    return max(6, n_words.bit_length())


class BenchmarkIndex:
    """Indexes of a block's items by length band, so that a passage suits the items it may hold."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, counts: dict[int, BandCounts] | None = None):
        bands: dict[int, list] = {}
        for i, text in items:
            if n := len(words_of(text)):
                bands.setdefault(band_of(n), []).append((i, text))
        self.indexes = [ItemIndex(sorted(v), threshold, (counts or {}).get(b)) for b, v in sorted(bands.items())]

    def leaks(self, text: str) -> list[tuple[int, float, float, float, int]]:
        """(item_id, score, question overlap, answer overlap, first word) of each leaked item, by item_id."""
        words, out = words_of(text), []
        for index in self.indexes:
            out += [(index.ids[i], s, q, a, -p) for i, (s, q, a, p) in index.leaks(words).items()]
        return sorted(out)


def counted_items(items: DataFrame) -> DataFrame:
    """``i, t, band, size, words`` of the items that have words; ``words`` are the different ones."""

    def run(ids: list, texts: list) -> list[list]:
        out = [(i, t, band_of(len(ws)), len(ws), sorted(set(ws))) for i, t in zip(ids, texts) if (ws := words_of(t))]
        return [list(c) for c in zip(*out)] if out else [[] for _ in range(5)]

    return map_columns(items.select("i", "t"), run, "i bigint, t string, band int, size bigint, words array<string>")


def index_blocks(benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[BenchmarkIndex]:
    """Indexes of the test items, BLOCK_BYTES of text each at most on average. Their weights come from counts over
    all items of a band, so that what is retrieved does not depend on the division into blocks; a block
    gets the counts of its own words."""
    items = benchmark.select(benchmark["item_id"].cast("bigint").alias("i"), benchmark["text"].cast("string").alias("t"))
    items = cut_lineage(counted_items(items.where("i is not null and t is not null").distinct()))
    size = items.agg(F.sum(F.octet_length("t").cast("bigint"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    sizes = {r["band"]: r for r in items.groupBy("band").agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.max("size").alias("longest")).collect()}
    each = items.select("band", F.explode("words").alias("word"), F.pmod(F.xxhash64("i", "t"), F.lit(n)).alias("block"))
    found = each.groupBy("band", "word").agg(F.count("*").alias("n"), F.collect_set("block").alias("blocks"))
    found = cut_lineage(found) if n > 1 else found
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").select("i", "t").collect()
        counts = {b: BandCounts(r["n"], r["mean"], r["longest"], {}) for b, r in sizes.items()}
        for r in found.where(F.array_contains("blocks", F.lit(k).cast("bigint"))).select("band", "word", "n").collect():
            counts[r["band"]].found[r["word"]] = r["n"]
        yield BenchmarkIndex([(r["i"], r["t"]) for r in rows], threshold, counts)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaked test items in every whole text, one row for each text and item:
    ``doc_id, item_id, score, question_overlap, answer_overlap, first_word`` of the best passage.

    Null and empty texts, and test items that are null or without words, have no leaks; a null doc_id
    stays null; repeated rows and items give repeated rows; an empty table on either side gives an empty
    result; other columns play no part; texts of any length are read whole, in passages that overlap by half.
    A map over rows: no text is shuffled."""
    texts, schema = doc_columns(docs), "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word int"
    out = None
    for index in index_blocks(benchmark):

        def run(ids: list, rows: list, index: BenchmarkIndex = index) -> list[list]:
            found = [(i, *leak) for i, t in zip(ids, rows) for leak in index.leaks(t)]
            return [list(c) for c in zip(*found)] if found else [[] for _ in range(6)]

        part = map_columns(texts, run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a leaked test item; all columns stay, no text is shuffled.

    Null and empty texts hold none and stay with a null text; rows that repeat stay or go together; null doc_ids
    play no part; an empty table on either side drops nothing; texts of any length are read whole."""
    small_batches(docs)
    for index in index_blocks(benchmark):
        docs = docs.where(clean_texts(index)(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    return docs


def clean_texts(index: BenchmarkIndex):
    """Whether a text holds no leaked item of the index, as a column function."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not index.leaks(t) for t in texts], dtype=bool)

    return clean
