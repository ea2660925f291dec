"""Bounded graph closures as level-synchronous DataFrame loops.

Each level is one set of joins: frontier ⋈ edges → candidates, ``left_anti`` against the
nodes already seen, union into the seen set. The seen set is checkpointed into the shared
checkpoint folder every level so lineage stays one level long and a lost executor only
recomputes the current level. The edge and file tables are written once to the same folder and
read from there. The driver only sees one row count per level. An unset depth means until no new
node appears.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.ordered import row_index
from textloom.operators.resolve import contains_expand
from textloom.session import cut_lineage, cut_lineage_counted

COMPACT_EVERY = 8


def _ranked(level: DataFrame) -> DataFrame:
    """A level's nodes with numbers in the order of their discovery: by the number of the parent that found
    them first, contained before imported, by position, then by name. Numbers have gaps and one width at any
    depth; they come from the ranges of one sort, so that a level spreads over tasks."""
    by = ["parent", "kind", "pos", "node"]
    dealt = level.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut_lineage(dealt.withColumn("rank", F.monotonically_increasing_id()).select("seed", "node", "depth", "kind", "rank"))


def import_closure(
    files: DataFrame,
    edges: DataFrame,
    starts: DataFrame | None,
    depth: int | None = None,
    contains: bool = True,
    order: bool = False,
) -> DataFrame:
    """Breadth-first closure per seed.

    files:  ``(path)`` — the file set.
    edges:  ``(src, pos, dst)`` resolved imports.
    starts: ``(seed, node)`` start nodes per seed (one closure per seed, G2); ``None`` or
            empty ⇒ every file (depth 0).
    Rules: depth 0 ⇒ starts verbatim, present or not; depth d ⇒ levels 0..d; a start not in
    the file set is dropped but still contributes its contained files (D5); each node is
    reported at its smallest depth. Returns ``(seed, path, depth)``, with ``order`` also ``kind`` (what the
    first discovery was: 0 contained, 1 imported, null a start) and ``rank``; ``(depth, rank)`` ascending
    is discovery order. Results are listed in reverse discovery order.
    """
    spark = files.sparkSession
    fileset = cut_lineage(files.select("path").distinct())
    no_kind, columns = F.lit(None).cast("int"), ["seed", "path", "depth", *(["kind", "rank"] if order else [])]
    if starts is None or starts.isEmpty():
        every = fileset.select(F.lit(None).cast("string").alias("seed"), "path", F.lit(0).alias("depth"), no_kind.alias("kind"), F.lit(0).cast("long").alias("rank"))
        return every.select(*columns)
    first = starts.select("seed", "node").distinct().withColumn("depth", F.lit(0))
    zero = F.lit(0).cast("long")
    seen = _ranked(first.select("*", no_kind.alias("kind"), zero.alias("parent"), zero.alias("pos"))) if order else cut_lineage(first)
    if depth == 0:
        return seen.withColumnRenamed("node", "path").select(*columns)

    # only edges leaving files matter (a node outside the file set is "not found" and has no
    # imports), so the per-level semi-join against the file set happens once, here
    e = edges.select(F.col("src").alias("node"), F.col("pos").cast("long").alias("pos"), "dst")
    e = e.join(fileset.select(F.col("path").alias("node")), "node", "left_semi")
    e = cut_lineage(e)
    n_pairs = 0
    if contains:
        # every node is a start, a file or an edge target, so containment pairs are computed once
        # for all of them; each level is then one equi-join against this table
        nodes = fileset.select(F.col("path").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).unionByName(first.select("node"))
        pairs, n_pairs = cut_lineage_counted(contains_expand(nodes, fileset))
    frontier = seen
    d = 0
    while depth is None or d < depth:
        # (parent, kind, pos) says how a node was found; the least wins
        found = lambda df, nxt, kind, pos: df.select(
            "seed", F.col(nxt).alias("node"), *([F.col("rank").alias("parent"), F.lit(kind).alias("kind"), pos.alias("pos")] if order else [])
        )
        cand = found(frontier.join(e, "node"), "dst", 1, F.col("pos"))
        if n_pairs:  # else no node is a proper prefix of a file
            cand = cand.unionByName(found(frontier.join(pairs, "node"), "path", 0, zero))
        if order:
            cand = cand.groupBy("seed", "node").agg(F.min(F.struct("parent", "kind", "pos")).alias("how")).select("seed", "node", "how.*")
        else:
            cand = cand.distinct()
        new = cand.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        new, n_new = cut_lineage_counted(new.withColumn("depth", F.lit(d + 1)))
        if n_new == 0:
            break
        if order:
            new = _ranked(new)
        # seen is a union of written level tables (lineage one level deep), compacted into
        # one table every COMPACT_EVERY levels so the anti-join does not scan a growing list
        seen = seen.unionByName(new.select(*seen.columns))
        if (d + 1) % COMPACT_EVERY == 0:
            seen = cut_lineage(seen)
        frontier = new
        d += 1
    out = seen.join(fileset.withColumnRenamed("path", "node"), "node", "left_semi")
    return out.withColumnRenamed("node", "path").select(*columns)


def discovery_index(closure: DataFrame) -> DataFrame:
    """``ord``: place of each file in its seed's listing, the last discovered first, numbered by range blocks.
    Takes a closure with its order."""
    at = closure.withColumns({"__depth": -F.col("depth"), "__rank": -F.col("rank")})
    return row_index(at, ["seed"], ["__depth", "__rank"], "ord").drop("__depth", "__rank")


def crawl_closure(
    pages: DataFrame,
    seeds: DataFrame,
    roots=None,
    ignore: list[str] | None = None,
    link_scope: str = "body",
    max_depth: int | None = None,
) -> DataFrame:
    """Link closure over landed pages (G3): start at ``seeds(url)``, follow links that stay
    under a root prefix, skip ignored substrings and binary suffixes, visit each normalized
    URL once. Only URLs present in ``pages`` are fetched (and so produce links).
    Returns ``(url, depth, page_id)`` at the smallest depth."""
    from textloom.functions.urls import normalize_url, skip_binary_url
    from textloom.operators.predicates import prefix_join, url_ignore, url_scope
    from textloom.plans.web_jobs import page_links

    links = page_links(pages, link_scope, roots, ignore).select(F.col("url").alias("src"), F.col("link").alias("dst"))
    links = cut_lineage(links.distinct())
    known = cut_lineage(pages.select("url", "page_id"))
    s = seeds.select(normalize_url("url").alias("url")).distinct().where(~skip_binary_url("url"))
    if isinstance(roots, DataFrame):
        s = prefix_join(s, "url", roots, "root", "left_semi")
    elif roots:
        s = url_scope(s, "url", roots)
    if ignore:
        s = url_ignore(s, "url", ignore)
    frontier = cut_lineage(s.join(known, "url").withColumn("depth", F.lit(0)))
    seen = frontier
    d = 0
    while max_depth is None or d < max_depth:
        nxt = frontier.select(F.col("url").alias("src")).join(links, "src").select(F.col("dst").alias("url")).distinct()
        nxt = nxt.join(known, "url").join(seen.select("url"), "url", "left_anti")
        nxt, n_new = cut_lineage_counted(nxt.withColumn("depth", F.lit(d + 1)))
        if n_new == 0:
            break
        seen = seen.unionByName(nxt)
        frontier = nxt
        d += 1
    return seen
