"""SentencePiece encoding and decoding by a merge-type prefix table.

The vocabulary's pieces are found in a text with one automaton. For every prefix of a chunk the
table keeps the single piece that ends the prefix's encoding: a piece that matches up to the
prefix's end is that one if the piece ending the shorter prefix before it and itself form a
compatible pair, that is, if merging their concatenated text gives back exactly these two. The
ids are then read from the end of the table backwards. The work is linear in the chunk.

A chunk starts at a white-space mark that follows another character: the loader checks that no
piece holds such a mark inside, so no merge can cross the place and chunks encode on their own.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from textloom.llm.common import doc_columns, map_columns, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
PAIRS_KEPT = 1 << 18  # entries of the memo of pair tests; beyond that it starts anew
CHUNKS_KEPT = 1 << 18  # chunks in the younger of the memo's two generations; the older is dropped when it is full
SIGNS = "\n\t.,;:!?#$%&*|()[]{}<>\"/\\"
LONG_CHUNK = 64  # longer chunks are encoded each time and not kept
BEGIN = 1 << 19  # stands before the first piece
NEVER = float("-inf")


class PieceCoder:
    """Encoder and decoder of one SentencePiece model of the BPE type with byte fallback."""

    def __init__(self, path: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unknown = {i for i in range(n) if sp.is_unknown(i)}
        plain = [i for i in range(n) if i not in self.byte_of and i not in self.silent and i not in self.unknown]
        if any(sp.is_unused(i) for i in plain) or len(self.byte_id) != 256:
            raise ValueError("expected a BPE model with byte fallback and no unused pieces")
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.known = {p for p in self.id_of if len(p) == 1}
        self.splits_at_mark = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        # signs that no piece holds right after a letter or digit: a chunk can be cut before them too
        after = {b for p in self.id_of for a, b in zip(p, p[1:]) if a.isalnum()}
        signs = "".join(c for c in SIGNS if c not in after)
        self.word = re.compile(f"{MARK}*[^\\W_]+(?=[{re.escape(signs)}])" if signs else r"(?!)")
        self.plain_rule = sp.normalize(f"  a  {MARK}b \t\n") == f"{MARK * 3}a{MARK * 3}b{MARK}\t\n"
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.bos_raw, self.eos_raw = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if set(p) <= self.known and len(self.merged(p)) == 1:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.text_of = [None if i in self.byte_of else " ⁇ " if i in self.unknown else p.replace(MARK, " ") * (i not in self.silent) for i, p in enumerate(self.pieces)]
        self.width = [len(p) for p in self.pieces]
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short string: best score first, leftmost among equals."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            k = scores.index(best)
            parts[k] += parts[k + 1]
            del parts[k + 1], scores[k]
            if k:
                scores[k - 1] = score(parts[k - 1] + parts[k], NEVER)
            if k < len(scores):
                scores[k] = score(parts[k] + parts[k + 1], NEVER)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two pieces' joined text is the two pieces."""
        if a == BEGIN:
            return True
        left, right = self.pieces[a], self.pieces[b]
        return self.merged(left + right) == [left, right]

    def known_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk whose characters are all pieces."""
        last, pairs, width = [-1] * len(chunk) + [BEGIN], self.pairs, self.width  # last[-1]: the empty prefix
        for end, piece in self.automaton.iter(chunk):
            if last[end] < 0:
                key = last[end - width[piece]] << 20 | piece
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(key >> 20, piece)
                if fits:
                    last[end] = piece
        ids, at = [], len(chunk) - 1
        while at >= 0:
            ids.append(last[at])
            at -= width[last[at]]
        ids.reverse()
        return ids

    def chunk_ids(self, chunk: str) -> list[int]:
        """Characters outside the vocabulary never merge: they become bytes, the rest is encoded between them."""
        if self.known.issuperset(chunk):
            return self.known_ids(chunk)
        ids, run = [], []
        for c in chunk:
            if c in self.known:
                run.append(c)
                continue
            if run:
                ids += self.known_ids("".join(run))
                run = []
            ids += [self.byte_id[b] for b in c.encode()]
        return ids + (self.known_ids("".join(run)) if run else [])

    def chunked(self, text: str) -> list[str]:
        if self.plain_rule:
            marked = MARK + text.replace(" ", MARK) if text else ""
        else:
            marked = self.sp.normalize(text)
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked) if self.splits_at_mark else [marked] * bool(marked)

    def encode(self, text: str, ends: bool = True) -> list[int]:
        """Ids of a text, with begin and end ids unless ``ends`` is false."""
        ids = [i for c in self.chunked(text) for i in self.chunk_ids(c)]
        return [self.bos, *ids, self.eos] if ends else ids

    def surface(self, ids: list[int]) -> str:
        """Text of ids without dropping the leading space."""
        try:
            return "".join([self.text_of[i] for i in ids])
        except TypeError:  # bytes among them
            out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(utf8_or_marks(bytes(run)))
                run = bytearray()
            out.append(self.text_of[i])
        return "".join(out) + (utf8_or_marks(bytes(run)) if run else "")

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding put in front is dropped."""
        text = self.surface(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text

    def coded(self, text: str) -> tuple[bytes, str]:
        """The ids of a text as little-endian 32-bit integers, with begin and end, and their decoded text.
        Encodings of short chunks that decode to themselves are kept, as most words come again."""
        if not self.plain_rule or not self.splits_at_mark:
            ids = self.encode(text)
            return np.array(ids, "<u4").tobytes(), self.decode(ids)
        chunks, odd = self.chunked(text), {}
        parts = list(map(self.chunks.get, chunks))
        for k, raw in enumerate(parts):
            if raw is None:
                parts[k] = self.kept(k, chunks[k], odd)
        decoded = text if not odd else "".join([odd.get(k, c) for k, c in enumerate(chunks)])[1:]
        return b"".join([self.bos_raw, *parts, self.eos_raw]), decoded.replace(MARK, " ")

    def forget(self) -> None:
        """The memos start anew."""
        self.pairs, self.chunks, self.older = {}, {}, {}

    def kept(self, k: int, chunk: str, odd: dict[int, str]) -> bytes:
        """Ids of the k-th chunk, kept from now on; in ``odd`` its decoding if that is not the chunk."""
        raw = self.chunks.get(chunk) or self.older.get(chunk)
        if raw is None:
            cut = self.word.match(chunk)
            if cut and cut.end() < len(chunk):
                odd_part: dict[int, str] = {}
                head, tail = chunk[: cut.end()], chunk[cut.end() :]
                raw = self.kept(0, head, odd_part) + self.kept(1, tail, odd_part)
                if odd_part:
                    odd[k] = odd_part.get(0, head) + odd_part.get(1, tail)
                    return raw
            else:
                ids = self.chunk_ids(chunk)
                raw = struct.pack(f"<{len(ids)}I", *ids)
                back = self.surface(ids)
                if back.replace(" ", MARK) != chunk:
                    odd[k] = back
                    return raw
        if len(chunk) <= LONG_CHUNK:
            if len(self.chunks) >= CHUNKS_KEPT:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = raw
        return raw


def utf8_or_marks(raw: bytes) -> str:
    """Bytes as UTF-8; each byte that is no part of a character becomes a replacement mark."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def encode_pieces(docs: DataFrame, model: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, with
    ``ids`` too if ``keep_ids``.

    One row per input row; a null or empty text has only its begin and end ids and decodes to the
    empty text; a null doc_id stays null; equal rows give equal rows; an empty table gives an empty
    one; other columns of ``docs`` play no part. A map over rows: nothing is shuffled."""

    def run(doc_ids: list, texts: list) -> list[list]:
        c, out = coder(model or tokenizer_path(MODEL)), []
        for text in texts:
            raw, decoded = c.coded(text)
            made = len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
            out.append((*made, np.frombuffer(raw, "<i4")) if keep_ids else made)
        return [doc_ids, *map(list, zip(*out))] if out else [[] for _ in range(4 + keep_ids)]

    def end() -> None:
        coder(model or tokenizer_path(MODEL)).forget()  # a task's memos would stand beside other stages' memory

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_columns(doc_columns(docs), run, schema, end)
