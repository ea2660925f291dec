"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct four-word shingles, as 64-bit hashes, in the order of the hash.
Each document stores the tokens that its prefix can need at most, and how many documents store a
token is counted. A token that more than FREQUENT documents store is frequent. A rare token is a class by
itself and is indexed alone. Frequent tokens are dealt to classes by hash, as many as suit the size
of the document, and two tokens of one class are indexed together. A prefix is extended until what its
classes can lose adds up: of c rare tokens c must differ, of c tokens of a pair class c - 1, before no
combination is left in common. With EXTRA losses more than a linked document may differ by, two linked
documents have EXTRA + 1 combinations in common, so no link is lost, accidental meetings of fewer
combinations are not compared, and a combination of rare tokens has few documents.

Near copies meet a leader first: each document that of its combinations' ends which it shares most with.
Verified links with leaders join documents to components. Documents that leaders connect are dealt to blocks,
and what is left to compare is found by block: two blocks meet when they share enough combinations among
different components. A task compares the bitmaps of two blocks' sets in place, so that only pairs whose sizes
and bitmaps allow a link become rows, however many near copies a group holds; these are verified exactly. Bitmaps
are made with the index; whole sets, far larger, are made again and moved only for pairs that bitmaps allow. Links
inside a component that is already joined change nothing there and are not looked at. Where the number of links
is asked for, blocks are compared whatever the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import doc_columns, tidied
from textloom.llm.sketch import cell_of, flagged
from textloom.session import cut_lineage, cut_lineage_counted, drop_tables

WORDS = 4
PERCENT = 85
FREQUENT = 16  # documents that store a token, beyond which it is indexed in pairs
CLASS_TOKENS = 16  # tokens of a document for each class of frequent tokens
EXTRA = 2  # losses that a prefix is extended by beyond what finds every link
BLOCK_NODES = 512  # documents of a block, whose bitmaps are compared together
BLOCK_PAIRS = 16  # pairs of blocks that are compared in one group
SLICE = 64  # documents of a block that are held against the whole other block at once
SCREEN = 8  # words of a bitmap that are compared first
ROUNDS = 4  # parts of the tokens, by hash, that are counted and met one after the other
SEEN = 1 << 16  # digests that a task remembers, to index copies that follow one another once
BITS = 2048  # cells of a set's bitmap
GROUP_PAIRS = 4000  # pairs that are compared in one group
NO_ID = -(1 << 63)  # stands for a null doc_id
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles. A to Z count as lower case; words end at spaces
    and the signs from tab to carriage return. Fewer words than a shingle has make one shingle."""
    hashes = list(map(xxhash.xxh3_64_intdigest, text.encode().lower().split()))
    w = np.array(hashes, np.uint64)
    if len(w) == 0:
        return w
    factors = np.resize(FACTORS, words) + np.arange(words, dtype=np.uint64) * np.uint64(2)
    if len(w) < words:
        return mixed(np.array([(w * factors[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
    n = len(w) - words + 1
    total = w[:n] * factors[0]
    for k in range(1, words):
        total += w[k : k + n] * factors[k]
    return np.unique(mixed(total))


def digest(tokens: np.ndarray) -> tuple[int, bytes]:
    """A 64-bit number of a set of tokens."""
    d = hashlib.blake2b(tokens.tobytes(), digest_size=8).digest()
    return int.from_bytes(d, "little", signed=True), d


def bands(n: int, percent: int = PERCENT) -> list[int]:
    """Bands of sizes, from a power of two to the next, under which a document of n tokens is compared: its
    own, and the next if a linked document may lie there."""
    own = max(n, 1).bit_length() - 1
    return [own, own + 1] if 100 * n >= percent << (own + 1) else [own]


def classes_of(band: int) -> int:
    """Classes of frequent tokens for documents that are compared under a band."""
    return max(1, (1 << band) // CLASS_TOKENS)


def needed_loss(n: int, percent: int = PERCENT) -> int:
    """Losses that a prefix must have for linked documents to share one combination."""
    return n - -(-percent * n // 100) + 1


def stored(n: int, percent: int = PERCENT) -> int:
    """Tokens that suffice for every prefix, whichever tokens are frequent: a class loses one token at most."""
    return min(n, needed_loss(n, percent) + EXTRA + classes_of(bands(n, percent)[-1]))


def extended(n: int, places: np.ndarray, tokens: np.ndarray, percent: int = PERCENT) -> tuple[int, int, np.ndarray]:
    """The prefix of a document with n tokens whose frequent stored tokens, and their places, are given: its
    length, the combinations that linked documents share at least, and its pair combinations."""
    need, length, least, pairs = needed_loss(n, percent), 0, n, []
    for band in bands(n, percent):
        which = mixed(tokens + np.uint64(band)) % np.uint64(classes_of(band))
        order = np.argsort(which, kind="stable")
        first = np.ones(len(order), bool)  # a class's first token loses nothing
        first[1:] = np.diff(which[order]) != 0
        gain = np.ones(stored(n, percent), np.int64)
        gain[places[order[first]]] = 0
        losses = np.cumsum(gain)
        upto = min(len(gain), int(np.searchsorted(losses, need + EXTRA)) + 1)
        length, least = max(length, upto), min(least, int(losses[upto - 1]) - need + 1)
        bounds = np.flatnonzero(np.r_[first, True])
        for g in np.flatnonzero(np.diff(bounds) > 1):
            group = order[bounds[g] : bounds[g + 1]]
            group = tokens[group[places[group] < upto]]
            i, j = np.triu_indices(len(group), 1)
            pairs.append(mixed(mixed(group[i]) * FACTORS[0] + mixed(group[j]) * FACTORS[1] + np.uint64(band)))
    return length, max(1, least), np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)


def token_batches(batch: pa.RecordBatch, words: int = WORDS) -> Iterator[np.ndarray]:
    for text in batch.column("text").to_pylist():
        yield shingles(text, words)


def indexed_documents(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``doc_id, node, n, tokens, map``: a row per document, its set's number and size, its stored tokens and its
    bitmap; a task leaves the last two out where it gave them for an equal set shortly before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bool] = {}
        for batch in batches:
            nodes, sizes, kept, maps = [], [], [], []
            for tokens in token_batches(batch, words):
                node = digest(tokens)[0]
                again = node in seen or len(tokens) < 2  # sets of one token link with equal sets only
                if not again:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[node] = True
                nodes.append(node if len(tokens) else None)
                sizes.append(len(tokens))
                kept.append(None if again else tokens[: stored(len(tokens), percent)].view(np.int64))
                maps.append(None if again else bitmap(tokens).tobytes())
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "node", "n", "tokens", "map"])

    return docs.mapInArrow(tidied(run), "doc_id bigint, node bigint, n bigint, tokens array<bigint>, map binary")


def combinations(listed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, n, least, combos`` from each document's shared stored tokens, ``node, n, found``: its rare tokens
    within the prefix and its pairs of frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            ends, flat = np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False)), found.flatten()
            pos, tokens, often = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "token", "often"))
            least, combos, start = [], [], 0
            for n, end in zip(batch.column("n").to_pylist(), ends):
                own = slice(start, end)
                order = np.argsort(pos[own], kind="stable")
                p, t, f, start = pos[own][order], tokens[own][order], often[own][order], end
                if f.any():
                    upto, shares, pairs = extended(n, p[f].astype(np.int64), t[f].view(np.uint64), percent)
                    combos.append(np.concatenate([t[~f & (p < upto)], pairs.view(np.int64)]))
                else:
                    upto = min(n, needed_loss(n, percent) + EXTRA)
                    shares = upto - needed_loss(n, percent) + 1
                    combos.append(t[p < upto])
                least.append(shares)
            held = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, combos)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *combos]))
            )
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(least, pa.int32()), held], names=["node", "n", "least", "combos"])

    return listed.select("node", "n", "found").mapInArrow(tidied(run), "node bigint, n bigint, least int, combos array<bigint>")


def linked_sets(texts: DataFrame, found: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """``node, tokens`` of the nodes of ``wanted``, from the text of each node's smallest doc_id. Filters of fixed
    size pick the texts whose shingles are made again, and of these the sets that are given. A few other sets, or
    one twice, may be among them: a join with the wanted nodes is to follow."""
    ids = F.coalesce("doc_id", F.lit(NO_ID)).alias("id")
    of = cut_lineage(found.select("node", ids).join(wanted.select("node").distinct(), "node").groupBy("node").agg(F.min("id").alias("id")))
    packed = flagged(of, "id", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = {c: np.unpackbits(bits).astype(bool) for c, bits in packed.items()}, {}
        for batch in batches:
            some = batch.filter(pa.array(cells["id"][cell_of(batch.column("id").to_numpy(zero_copy_only=False))]))
            nodes, sets = [], []
            for doc, tokens in zip(some.column("id").to_pylist(), token_batches(some, words)):
                node = digest(tokens)[0]
                if len(tokens) and cells["node"][cell_of(np.array([node]))[0]] and seen.get(node) != doc:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[node] = doc
                    nodes.append(node)
                    sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return texts.select(ids, "text").mapInArrow(tidied(run), "node bigint, tokens binary")


def in_blocks(heads: DataFrame) -> DataFrame:
    """``node, block``: all nodes and leaders of ``heads``, dealt to blocks of about BLOCK_NODES. Nodes of one leader
    stay together: a leader with more is divided by hash, smaller ones with one leader, or that lead each other, share
    blocks. Any dealing finds the same links; a good one compares fewer blocks."""
    ends = heads.select("node", "head").union(heads.select("head", F.lit(None).cast("bigint")))
    of = ends.groupBy("node").agg(F.max("head").alias("head"))  # a leader may have none itself
    onward = of.select(F.col("node").alias("at"), F.col("head").alias("next"))
    of = of.withColumn("head", F.coalesce("head", "node"))
    named = cut_lineage(of.join(onward, F.col("head") == F.col("at"), "left").select("node", "head", F.least("head", "next").alias("comp")))
    led = named.groupBy("comp", "head").agg(F.count("*").alias("size"))
    shared = led.where(F.col("size") < BLOCK_NODES).groupBy("comp").agg(F.ceil(F.sum("size") / BLOCK_NODES).alias("bins"))
    led = led.join(shared, "comp", "left").select("head", "size", "bins")
    own = F.xxhash64("comp", "head", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_NODES)))
    bin_of = F.xxhash64("comp", F.pmod(F.xxhash64("head"), F.col("bins")))
    return named.join(led, "head").select("node", F.when(F.col("size") < BLOCK_NODES, bin_of).otherwise(own).alias("block"))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens in BITS cells. Two sets differ in as many tokens as their bitmaps in bits, or more."""
    cells = (mixed(tokens) & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=BITS) & 1).view(np.uint64)


def most_apart(both: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Tokens that a linked pair may differ in, from the sum of its sizes."""
    return both - 2 * -(-percent * both // (100 + percent))


def linked(x: list, y: list, tokens: dict, percent: int) -> np.ndarray:
    """For each pair of nodes whether their sets link: first by what sizes and bitmaps allow, then exactly."""
    at = {n: k for k, n in enumerate(tokens)}
    sets = list(tokens.values())
    sizes, maps = np.array([len(t) for t in sets]), np.array([bitmap(t) for t in sets])
    i, j = np.array([at[n] for n in x]), np.array([at[n] for n in y])
    most = most_apart(sizes[i] + sizes[j], percent)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        part = slice(k, k + (1 << 14))
        keep[part] = np.bitwise_count(maps[i[part]] ^ maps[j[part]]).sum(1) <= most[part]
    for k in np.flatnonzero(keep):
        s, t = sorted((sets[i[k]], sets[j[k]]), key=len)
        place = np.minimum(np.searchsorted(t, s), len(t) - 1)
        common = int((t[place] == s).sum())
        keep[k] = 100 * common >= percent * (len(s) + len(t) - common)
    return keep


def signatures(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """``node, block, n, map``: block, size and bitmap of each node of ``blocks``, once. A filter of fixed size
    picks the bitmaps that are moved."""
    packed = flagged(blocks, "node")["node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.unpackbits(packed).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(cells[cell_of(batch.column("node").to_numpy(zero_copy_only=False))]))

    maps = found.where("map is not null").select("node", "n", "map").mapInArrow(tidied(run), "node bigint, n bigint, map binary")
    return maps.join(blocks, "node").groupBy("node", "block").agg(F.max("n").alias("n"), F.max("map").alias("map")).select("node", "block", "n", "map")


def allowed(pairs: DataFrame, marks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b, block_a, block_b``: the pairs (a, b) whose sizes and bitmaps allow a link, before any set is made."""
    names = ["a", "b", "block_a", "block_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                maps = [np.frombuffer(b"".join(batch.column(f"map_{x}").to_pylist()), np.uint64).reshape(len(batch), -1) for x in "ab"]
                ni, nj = (batch.column(f"n_{x}").to_numpy(zero_copy_only=False) for x in "ab")
                near = np.bitwise_count(maps[0] ^ maps[1]).sum(1, dtype=np.int64) <= most_apart(ni + nj, percent)
                yield batch.filter(pa.array(near & (100 * np.minimum(ni, nj) >= percent * np.maximum(ni, nj)))).select(names)

    for x in "ab":
        pairs = pairs.join(marks.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("block", "n", "map")]), x)
    return pairs.mapInArrow(tidied(run), ", ".join(f"{c} bigint" for c in names))


def near_in_blocks(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, comps: np.ndarray, maps: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i of x, j of y) of different components whose sizes and bitmaps allow a link; of a block with
    itself each pair once. A bitmap's first words tell most pairs apart."""
    of_x, of_y = [], []
    for k in range(0, len(x), SLICE):
        i, ni, nj = x[k : k + SLICE], sizes[x[k : k + SLICE], None], sizes[None, y]
        fits = (comps[i, None] != comps[None, y]) & (100 * np.minimum(ni, nj) >= percent * np.maximum(ni, nj))
        if x is y:
            fits &= i[:, None] < y[None]
        most = most_apart(ni + nj, percent)
        if not fits.any():
            continue
        fits &= np.bitwise_count(maps[i, None, :SCREEN] ^ maps[None, y, :SCREEN]).sum(2, dtype=np.int64) <= most
        p, q = np.nonzero(fits)
        for m in range(0, len(p), 1 << 14):
            u, v = p[m : m + (1 << 14)], q[m : m + (1 << 14)]
            near = np.bitwise_count(maps[i[u]] ^ maps[y[v]]).sum(1, dtype=np.int64) <= most[u, v]
            of_x.append(i[u[near]])
            of_y.append(y[v[near]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *of_x]), np.concatenate([none, *of_y])


def near_pairs(blocks: DataFrame, n: int, marks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b, block_a, block_b``: the pairs of nodes of n pairs of blocks that sizes, components and bitmaps
    leave. ``marks``: ``node, block, n, map, comp``. A block, about BLOCK_NODES bitmaps, is one row, sent once to
    each group of pairs."""
    groups = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK_PAIRS))

    def compare(p: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(held):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "block_a", "block_b")})
        nodes, sizes, comps = (np.concatenate(held[c].tolist()) for c in ("node", "n", "comp"))
        counts = held["node"].map(len).to_numpy()
        own, ends = np.repeat(held["block"].to_numpy(), counts), np.cumsum(counts)
        maps = np.frombuffer(b"".join(m for of in held["map"] for m in of), np.uint64).reshape(len(nodes), -1)
        at = {block: np.arange(end - k, end) for block, k, end in zip(held["block"], counts, ends)}
        found = []
        for s, t in zip(p["block_a"], p["block_b"]):
            if s in at and t in at:
                found.append(near_in_blocks(at[s], at[s] if s == t else at[t], sizes, comps, maps, percent))
        none = np.zeros(0, np.int64)
        i, j = (np.concatenate([none, *(f[side] for f in found)]) for side in (0, 1))
        return pd.DataFrame({"a": nodes[i], "b": nodes[j], "block_a": own[i], "block_b": own[j]})

    pairs = blocks.select("block_a", "block_b", F.pmod(F.xxhash64("block_a", "block_b"), F.lit(groups)).alias("group"))
    of = lambda side: pairs.select(F.col("group").alias("to_group"), F.col(side).alias("block"))
    columns = ("node", "n", "comp", "map")
    packed = marks.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("held")).select("block", *[F.col(f"held.{c}").alias(c) for c in columns])
    sent = of("block_a").union(of("block_b")).distinct().join(packed, "block")
    return pairs.groupBy("group").cogroup(sent.groupBy("to_group")).applyInPandas(compare, "a bigint, b bigint, block_a bigint, block_b bigint")


def verified(pairs: DataFrame, n: int, texts: DataFrame, found: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose sets link: 100 * common >= percent * all. ``pairs``, n of them, name the blocks
    of both nodes; all pairs of two blocks are compared in one group, so a set is sent once for each group. Only
    the sets of these pairs are made and moved."""
    if not n:
        return pairs.select("a", "b")
    sets = linked_sets(texts, found, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), words)
    groups = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // GROUP_PAIRS))

    def compare(p: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        tokens = {n: np.frombuffer(t, np.uint64) for n, t in zip(held["node"], held["tokens"])}
        return p.loc[linked(p["a"].tolist(), p["b"].tolist(), tokens, percent), ["a", "b"]]

    both = F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b"))
    pairs = pairs.select("a", "b", F.pmod(both, F.lit(groups)).alias("group"))
    of = lambda side: pairs.select(F.col("group").alias("to_group"), F.col(side).alias("node")).distinct()
    sent = of("a").union(of("b")).distinct().join(sets, "node")
    return pairs.groupBy("group").cogroup(sent.groupBy("to_group")).applyInPandas(compare, "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """``node, comp``: the smallest node reachable from each node that has an edge. Edges are redrawn to
    the smallest neighbour, from larger and from smaller nodes in turn, until all are stars: each node has one smaller
    neighbour, which has none."""

    def larger(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def smaller(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).distinct()

    def stars(e: DataFrame) -> bool:
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("up")), F.struct(F.col("b").alias("node"), F.lit(None).cast("bigint").alias("up"))))
        held = e.select(ends.alias("end")).groupBy("end.node").agg(F.min("end.up").alias("lo"), F.max("end.up").alias("hi"), (F.count("*") > F.count("end.up")).alias("root"))
        return not held.where("lo < hi or lo is not null and root").count()

    edges = cut_lineage(smaller(edges.where("a != b")))
    while not stars(edges):
        edges = cut_lineage(smaller(larger(edges)))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)


def join_documents(docs: DataFrame, percent: int = PERCENT, links: bool = False, words: int = WORDS) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more:
    ``doc_id, n_shingles, component_id``, and with ``links`` also ``n_links``, the number of other rows
    that the row is linked with. A shingle has ``words`` words.

    One row per input row. Null, empty and blank texts have no shingles and are linked with nothing:
    their component is their own doc_id. Equal sets are always linked. A null doc_id names no component:
    its row has the smallest doc_id of its component, null if there is none. Repeated rows give repeated
    rows. An empty table gives an empty one; other columns play no part."""
    return placed_documents(docs, percent, links, words).drop("node")


def placed_documents(docs: DataFrame, percent: int = PERCENT, links: bool = False, words: int = WORDS) -> DataFrame:
    """The rows of :func:`join_documents` with ``node``, the number of the row's set."""
    texts = doc_columns(docs)
    whole = cut_lineage(indexed_documents(texts, percent, words))
    index = likely_index(whole, percent)
    found = cut_lineage(whole.drop("tokens"))
    drop_tables(whole)  # the tokens are the most of it
    edges = None
    if links:
        edges = cut_lineage(all_links(texts, found, index, percent, words))
        comps = cut_lineage(connected(edges))
    else:
        comps = link_components(texts, found, index, percent, words)
    placed = found.select("doc_id", "node", "n").join(comps, "node", "left")
    placed = placed.withColumn("key", F.coalesce("comp", "node"))
    names = placed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("component"))
    if edges is not None:
        placed = placed.join(link_numbers(found, edges), "node", "left")
    return placed.join(names, "key", "left").select(
        "node", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        *([] if edges is None else [F.coalesce("n_links", F.lit(0)).alias("n_links")]),
    )


def link_numbers(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, n_links``: how many rows link with a row of each set, its own copies and those of linked sets."""
    copies = found.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"))
    ends = edges.select(F.col("a").alias("at"), F.col("b").alias("node")).union(edges.select(F.col("b").alias("at"), F.col("a").alias("node")))
    others = ends.join(copies, "node").groupBy(F.col("at").alias("node")).agg(F.sum("copies").alias("others"))
    return copies.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def shared_tokens(found: DataFrame, part: int) -> DataFrame:
    """``node, n, at``: the stored tokens of a part, by hash, that more than one row stores; ``at`` has a token's place
    and whether it is frequent. Counts are summed before the shuffle, tokens move to their counts once."""
    entries = found.where("tokens is not null").select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    entries = entries.where(F.pmod("token", F.lit(ROUNDS)) == part)
    entries = entries.select("token", "node", F.expr("shiftleft(n, 32) + pos").alias("place"))  # narrow rows for the shuffle
    counts = entries.groupBy("token").count().where("count > 1")
    shared = entries.join(counts.select("token", (F.col("count") > FREQUENT).alias("often")), "token").distinct()
    return shared.select("node", F.expr("shiftright(place, 32)").alias("n"), F.struct(F.expr("cast(place & 4294967295 as int)").alias("pos"), "token", "often").alias("at"))


def likely_index(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, n, least, combos``: the combinations of each node that has as many as linked documents share. Only
    tokens that more than one row stores play a part; how many do says whether one is frequent, alike for every
    document. Most tokens are stored by one row alone, and the shuffles that find this are larger than all others here:
    they hold one part of the tokens at a time. What is left moves to its nodes once."""
    parts = [cut_lineage(shared_tokens(found, part)) for part in range(ROUNDS)]
    listed = reduce(DataFrame.union, parts).groupBy("node", "n").agg(F.collect_list("at").alias("found"))  # a document's own, of bounded length
    index = cut_lineage(combinations(listed, percent).where("size(combos) >= least"))
    drop_tables(*parts)
    return index


def all_links(texts: DataFrame, found: DataFrame, index: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """``a, b``: every two different sets that link, also inside components. The links, and the comparisons in
    tasks, grow with the square of a group of near copies."""
    blocks = cut_lineage(in_blocks(cut_lineage(leaders(index))))
    return open_links(texts, found, index, blocks, cut_lineage(signatures(found, blocks)), None, percent, words)


def with_comps(index: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``index`` with the component of each node, the node itself where it has none."""
    if comps is None:
        return index.withColumn("comp", F.col("node"))
    return index.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def leaders(index: DataFrame) -> DataFrame:
    """``node, head``: for each node the other node, the first or last of a combination, that it shares most
    combinations with, if these are as many as linked documents share."""
    index = index.select(F.explode("combos").alias("combo"), "node", "least")
    ends = index.groupBy("combo").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi")
    other = F.when(F.col("node") != F.col("lo"), F.col("lo")).otherwise(F.col("hi"))
    met = index.join(ends, "combo").groupBy("node", other.alias("head")).agg(F.count("*").alias("times"), F.first("least").alias("least"))
    return met.where("times >= least").groupBy("node").agg(F.max_by("head", F.struct("times", "head")).alias("head"))


def open_blocks(index: DataFrame, comps: DataFrame | None, percent: int) -> DataFrame:
    """``block_a, block_b, single``: the pairs of blocks, a block with itself included, that may hold nodes of
    different components and fitting sizes with as many common combinations as linked documents have. ``single``:
    both are nodes without a block."""
    entries = with_comps(index, comps).select(F.explode("combos").alias("combo"), "block", "n", "least", "comp", "led")
    held = entries.groupBy("combo", "block").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("least").alias("least"), F.min("comp").alias("first"), F.max("comp").alias("last"),
        F.max(F.coalesce("led", F.lit(False))).alias("led"),
    )
    every = cut_lineage(held)
    apart = every.groupBy("combo").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).where("lo != hi").select("combo")
    held = cut_lineage(every.join(apart, "combo"))
    drop_tables(every)
    a, b = (held.select("combo", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "lo", "hi", "least", "first", "last", "led")]) for x in "ab")
    fits = (
        f"block_a <= block_b and least(first_a, first_b) != greatest(last_a, last_b) "
        f"and 100 * hi_a >= {percent} * lo_b and 100 * hi_b >= {percent} * lo_a"
    )
    times = a.join(b, "combo").where(fits).groupBy("block_a", "block_b").agg(
        F.count("*").alias("times"), F.min(F.least("least_a", "least_b")).alias("least"), F.max(F.expr("led_a or led_b")).alias("led")
    )
    met = cut_lineage(times.where("times >= least").select("block_a", "block_b", F.expr("not led").alias("single")))
    drop_tables(held)
    return met


def open_links(texts: DataFrame, found: DataFrame, index: DataFrame, blocks: DataFrame, marks: DataFrame, comps: DataFrame | None, percent: int, words: int) -> DataFrame:
    """``a, b``: the links between nodes of different components, between any two without ``comps``. ``marks`` are
    those of the nodes in ``blocks``; every other node is a block by itself, and those that are compared get theirs."""
    index = index.join(blocks.withColumn("led", F.lit(True)), "node", "left").withColumn("block", F.coalesce("block", "node"))
    met = open_blocks(index, comps, percent)
    named = met.select(F.col("block_a").alias("node")).union(met.select(F.col("block_b").alias("node"))).distinct()
    others, n = cut_lineage_counted(named.join(blocks.select(F.col("block").alias("node")), "node", "left_anti"))
    if n:
        marks = marks.union(cut_lineage(signatures(found, others.withColumn("block", F.col("node")))))
    pairs, n = cut_lineage_counted(met.where("not single").select("block_a", "block_b"))
    placed = cut_lineage(with_comps(marks, comps))
    near = near_pairs(pairs, n, placed, percent)
    alone = allowed(met.where("single").select(F.col("block_a").alias("a"), F.col("block_b").alias("b")), marks, percent)
    pairs, n = cut_lineage_counted(near.unionByName(alone))
    drop_tables(placed)
    return verified(pairs, n, texts, found, percent, words)


def link_components(texts: DataFrame, found: DataFrame, index: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """``node, comp`` for the nodes that have links to other nodes: by verified links with leaders first, then by
    those between blocks that hold different components. The index is spent."""
    heads = cut_lineage(leaders(index))
    blocks = cut_lineage(in_blocks(heads))
    marks = cut_lineage(signatures(found, blocks))
    pairs = heads.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    pairs, n = cut_lineage_counted(allowed(pairs, marks, percent))
    edges, n = cut_lineage_counted(verified(pairs, n, texts, found, percent, words))
    comps = cut_lineage(connected(edges)) if n else None
    rest, more = cut_lineage_counted(open_links(texts, found, index, blocks, marks, comps, percent, words))
    drop_tables(index, heads, blocks, marks)
    return cut_lineage(connected(edges.union(rest))) if more or comps is None else comps


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each component of :func:`join_documents`: the one whose doc_id names
    it, once if its row is repeated. Rows without doc_id and texts without shingles stay. All columns stay,
    whatever their names. Decisions are taken by row: of an id that stands with several texts, each is judged by
    the component of its own text.

    Only rows that a filter of fixed size marks as possibly repeated or named by another document are
    joined, so most texts are not moved."""
    placed = placed_documents(docs, percent, words=words)
    rows = placed.where("doc_id is not null and n_shingles > 0").groupBy("doc_id", "node").agg(
        F.count("*").alias("times"), F.max(F.col("doc_id") == F.col("component_id")).alias("names")
    )
    doubtful = cut_lineage(rows.where("times > 1 or not names").select("doc_id", "node", "names"))
    drop_tables(placed)  # the tables that it reads; the documents are not among them
    packed = flagged(doubtful, "doc_id")["doc_id"]

    @F.pandas_udf("marked boolean, node bigint")
    def placed_at(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from tidied(placed_rows)(batches)

    def placed_rows(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cells = np.unpackbits(packed).astype(bool)
        for ids, texts in batches:
            known = ids.notna().to_numpy()
            mark = np.zeros(len(ids), bool)
            mark[known] = cells[cell_of(ids[known].astype("int64").to_numpy())]
            sets = [shingles(t, words) if m else () for m, t in zip(mark, texts.fillna(""))]
            nodes = [digest(t)[0] if len(t) else None for t in sets]
            yield pd.DataFrame({"marked": mark, "node": pd.array(nodes, "Int64")})

    own = "__"
    while any(c.lower().startswith(own) for c in docs.columns):  # names that the table does not have
        own += "_"
    mark, key, node, held_node, named, nth = (f"{own}{x}" for x in ("marked", "id", "node", "held", "names", "n"))
    at = placed_at(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).alias(mark)
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns], at)
    clear = held.where(~F.col(f"{mark}.marked")).drop(mark)
    some = held.where(f"{mark}.marked").withColumn(held_node, F.col(f"{mark}.node")).drop(mark)
    names = doubtful.select(F.col("doc_id").alias(key), F.col("node").alias(node), F.col("names").alias(named))
    some = some.join(names, (some["doc_id"] == names[key]) & (some[held_node] == names[node]), "left")
    single = some.where(F.col(named).isNull())
    once = Window.partitionBy(key, node).orderBy(F.xxhash64("text"))
    some = some.where(named).withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).unionByName(single, allowMissingColumns=True)
    return clear.union(some.select(*[F.col(f"`{c}`") for c in docs.columns]))
