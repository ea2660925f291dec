"""Token counts by the whole-token shortcut.

Offline, the vocabulary's strings that encode alone as one token are proved by replaying their
merges. A text's pre-tokens that are such strings count one each; only the rest is merged.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import doc_columns, map_columns, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
KEPT = 1 << 18  # merged pre-tokens in the younger of the memo's two generations; the older is dropped when it is full
SHORT = 64  # bytes up to which pre-tokens are merged by plain rounds and kept
NEVER = 1 << 40
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_marks() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable bytes stand for
    themselves, the others take the code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class TokenCounter:
    """Counts the tokens of one byte-level BPE vocabulary file with the usual pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("expected a byte-level vocabulary without normalizer or prefix space")
        if model["type"] != "BPE" or model["ignore_merges"] or model["dropout"]:
            raise ValueError("expected plain BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("expected special strings that match just themselves")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        byte_of = {c: b for b, c in enumerate(byte_marks())}
        raw = lambda s: bytes(byte_of[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # a symbol is a byte, or 256 plus the rank of the merge that makes it; each token is made by one merge
        symbol = {bytes([b]): b for b in range(256)} | {raw(a + b): 256 + r for r, (a, b) in enumerate(pairs)}
        if len(symbol) != 256 + len(pairs):
            raise ValueError("expected one merge for each token")
        self.rank = {symbol[raw(a)] << 20 | symbol[raw(b)]: r for r, (a, b) in enumerate(pairs)}
        self.whole: dict[str, int] = {}
        for token in model["vocab"]:
            try:
                text = raw(token).decode()
            except (UnicodeDecodeError, KeyError):
                continue  # no text has this string as a pre-token
            if self.merged(text.encode()) == 1:
                self.whole[text] = 1
        self.kept, self.older = {}, {}

    def merged(self, word: bytes) -> int:
        """Number of tokens that merging leaves of a pre-token: lowest rank first, leftmost among equals."""
        if len(word) > SHORT:
            return self.merged_long(word)
        parts, rank = list(word), self.rank.get
        ranks = [rank(a << 20 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            k = ranks.index(best)
            parts[k] = 256 + best
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] << 20 | parts[k], NEVER)
            if k < len(ranks):
                ranks[k] = rank(parts[k] << 20 | parts[k + 1], NEVER)
        return len(parts)

    def merged_long(self, word: bytes) -> int:
        """The same with a heap and links, for pre-tokens of any length."""
        n, rank = len(word), self.rank.get
        parts, after, before, left = list(word), [*range(1, n), -1], [*range(-1, n - 1)], n
        heap = [(rank(a << 20 | b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if r == NEVER or parts[k] < 0 or j < 0 or rank(parts[k] << 20 | parts[j]) != r:
                continue
            parts[k], parts[j] = 256 + r, -1
            after[k], left = after[j], left - 1
            if after[j] >= 0:
                before[after[j]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] >= 0:
                    heapq.heappush(heap, (rank(parts[i] << 20 | parts[after[i]], NEVER), i))
        return left

    def count(self, text: str) -> int:
        total = 0
        if self.special is not None and (hits := len(self.special.findall(text))):
            return hits + sum(self.count(t) for t in self.special.split(text) if t)
        whole, kept = self.whole, self.kept
        for word in PRE_TOKEN.findall(text):
            n = whole.get(word) or kept.get(word)
            if n is None:
                n = self.older.get(word)
                if n is None:
                    n = self.merged(word.encode())
                if len(word) <= SHORT:
                    if len(kept) >= KEPT:
                        self.older, self.kept = kept, {}
                        kept = self.kept
                    kept[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    One row per input row; a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null;
    equal rows give equal rows; an empty table gives an empty one; other columns play no part.
    A map over rows: nothing is shuffled."""
    def run(doc_ids: list, n_bytes: list, texts: list) -> list[list]:
        c = counter(vocabulary or tokenizer_path(VOCABULARY))
        return [doc_ids, n_bytes, [c.count(t) for t in texts]]

    narrow = doc_columns(docs).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    counted = map_columns(narrow, run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
