"""Path hierarchies: ancestor nodes in first-seen order, rendered tree rows, common roots.

A tree is an adjacency table ``(keys..., node array<string>, parent array<string>, depth,
first_ord)``; there is no recursive type. Sibling order is first-seen order (smallest
``ord`` of any item below the node). Rendering order is depth-first pre-order, obtained by
sorting on the array of ``first_ord`` values along the node's path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import _c, format_content
from textloom.functions.urls import is_http_url, url_netloc, url_segments

# Tree drawing pieces and titles.
BRANCH = "├── "
LAST_BRANCH = "└── "
PIPE = "│   "
SPACE = "    "
URL_TITLE = "Web Site Map: "
DIR_TITLE = "Directory Structure Chart: "


def _segments_for(df: DataFrame, keys: list[str], path_col: str, root: str | None, mode: str | None = None) -> DataFrame:
    """Add ``segs`` (URL segments when every path of the group is an http(s) URL, else
    directory segments relative to the parent of the group's common path or ``root``).
    ``mode='url'`` (caller knows every path is a URL) skips the per-group detection."""
    if mode == "url":
        return df.withColumn("segs", url_segments(F.col(path_col)))
    flags = df.groupBy(*keys).agg(
        F.min(is_http_url(path_col).cast("int")).alias("__all_url"),
        F.min(F.split(path_col, "/", -1)).alias("__mn"),
        F.max(F.split(path_col, "/", -1)).alias("__mx"),
        F.countDistinct(url_netloc(path_col)).alias("__hosts"),
        F.min_by(F.col(path_col), F.col("ord")).alias("__first"),
    )
    flags = flags.withColumn("__common", _common_dir(F.col("__mn"), F.col("__mx")))
    j = df.join(flags, keys) if keys else df.withColumn("__g", F.lit(1)).join(flags.withColumn("__g", F.lit(1)), "__g")
    p = F.col(path_col)
    rootc = F.lit(root) if root else F.col("__common")
    parent = F.regexp_extract(rootc, r"^(.*)/[^/]*$", 1)
    rel = F.when(
        p.startswith(rootc) & (parent != ""),
        F.substring(p, F.length(parent) + 2, 1 << 30),
    ).otherwise(p)
    dir_segs = F.filter(F.split(rel, "/", -1), lambda x: x != "")
    return j.withColumn("segs", F.when(F.col("__all_url") == 1, url_segments(p)).otherwise(dir_segs))


def _common_dir(mn: Column, mx: Column) -> Column:
    """``os.path.commonpath`` from the lexicographically smallest and largest split paths."""
    n = F.aggregate(
        F.sequence(F.lit(1), F.least(F.size(mn), F.size(mx)) + 1),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("same")),
        lambda acc, i: F.when(
            acc["same"] & (i <= F.least(F.size(mn), F.size(mx)))
            & (F.element_at(mn, F.greatest(i, F.lit(1))) == F.element_at(mx, F.greatest(i, F.lit(1)))),
            F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("same")),
        ).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("same"))),
    )["n"]
    joined = F.array_join(F.slice(mn, 1, n), "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def tree_nodes(df: DataFrame, keys: list[str], path_col: str = "path", ord_col: str = "ord",
               root: str | None = None, mode: str | None = None) -> DataFrame:
    """All ancestor nodes with their first-seen order (G4)."""
    base = df.select(*keys, F.col(path_col).alias("path"), F.col(ord_col).alias("ord"))
    segs = _segments_for(base, keys, "path", root, mode)
    exploded = segs.select(
        *keys,
        "ord",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("segs")), lambda n: F.slice(F.col("segs"), 1, n))).alias("node"),
    )
    nodes = exploded.groupBy(*keys, "node").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n_items"))
    return nodes.select(
        *keys,
        "node",
        F.slice("node", 1, F.size("node") - 1).alias("parent"),
        F.size("node").alias("depth"),
        "first_ord",
        "n_items",
        F.element_at("node", -1).alias("name"),
    )


def tree_rows(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Rendered rows (F5): sibling order, last-sibling flag, ancestor continuation prefix,
    and a pre-order sort key ``pre`` (array of first_ord along the path)."""
    last = nodes.groupBy(*keys, "parent").agg(F.max("first_ord").alias("__last_ord"), F.count(F.lit(1)).alias("n_siblings"))
    n = nodes.join(last, [*keys, "parent"]).withColumn("is_last", F.col("first_ord") == F.col("__last_ord"))
    # ancestor facts: explode each node's proper ancestors (depth is bounded by path depth)
    anc = n.select(
        *keys,
        F.col("node").alias("__of"),
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size("node")), lambda k: F.slice(F.col("node"), 1, k))).alias("__lvl", "__anc"),
    )
    info = n.select(*[F.col(k).alias(f"__a_{k}") for k in keys], F.col("node").alias("__anc2"), F.col("is_last").alias("__alast"),
                    F.col("first_ord").alias("__aord"), F.col("n_items").alias("__an"), F.col("n_siblings").alias("__as"))
    cond = reduce(lambda a, b: a & b, [anc[k] == info[f"__a_{k}"] for k in keys] + [anc["__anc"] == info["__anc2"]]) if keys else (anc["__anc"] == info["__anc2"])
    aj = anc.join(info, cond)
    piece = F.when(F.col("__lvl") >= 1, F.when(F.col("__alast"), F.lit(SPACE)).otherwise(F.lit(PIPE))).otherwise(F.lit(""))
    # one aggregation per node over its ancestor chain; the chain's last element is the node
    # itself, so its own fields come from there (no join back to the node table)
    agg = aj.groupBy(*keys, "__of").agg(
        F.sort_array(F.collect_list(F.struct("__lvl", "__aord", piece.alias("piece"), "__alast", "__an", "__as"))).alias("__chain")
    )
    me = F.element_at("__chain", -1)
    out = agg.select(
        *keys,
        F.col("__of").alias("node"),
        F.slice("__of", 1, F.size("__of") - 1).alias("parent"),
        F.size("__of").alias("depth"),
        F.element_at("__of", -1).alias("name"),
        me["__aord"].alias("first_ord"),
        me["__an"].alias("n_items"),
        me["__as"].alias("n_siblings"),
        me["__alast"].alias("is_last"),
        F.transform("__chain", lambda s: s["__aord"]).alias("pre"),
        F.array_join(
            F.transform(F.slice("__chain", 1, F.greatest(F.size("__chain") - 1, F.lit(0))), lambda s: s["piece"]), ""
        ).alias("prefix"),
    )
    connector = F.when(F.col("depth") == 1, F.lit("")).when(F.col("is_last"), F.lit(LAST_BRANCH)).otherwise(F.lit(BRANCH))
    line = F.concat(F.col("prefix"), connector, F.col("name"))
    return out.select(*keys, "node", "parent", "depth", "name", "first_ord", "n_items", "n_siblings", "is_last", "pre",
                      line.alias("line"))


def tree_layout(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One layout string per group: rows in pre-order, each followed by a newline."""
    return rows.groupBy(*keys).agg(
        F.expr("listagg(concat(line, '\n'), '') WITHIN GROUP (ORDER BY pre)").alias("layout"),
        F.count(F.lit(1)).alias("n_nodes"),
    )


def tree_map(df: DataFrame, keys: list[str], path_col: str = "path", ord_col: str = "ord",
             root: str | None = None, mode: str | None = None) -> DataFrame:
    """Titled tree block per group (G5): ``format_content(title, layout, 'doc')``."""
    nodes = tree_nodes(df, keys, path_col, ord_col, root, mode)
    layout = tree_layout(tree_rows(nodes, keys), keys)
    base = df.select(*keys, F.col(path_col).alias("__p"), F.col(ord_col).alias("__o"))
    info = base.groupBy(*keys).agg(
        F.min(is_http_url("__p").cast("int")).alias("__all_url"),
        F.countDistinct(url_netloc("__p")).alias("__hosts"),
        F.min_by(url_netloc("__p"), F.col("__o")).alias("__host"),
        F.min_by(F.col("__p"), F.col("__o")).alias("__first"),
        F.min(F.split("__p", "/", -1)).alias("__mn"),
        F.max(F.split("__p", "/", -1)).alias("__mx"),
    )
    root_expr = F.lit(root) if root else None
    url_root = F.when(F.col("__hosts") == 1, F.col("__host")).otherwise(F.col("__first"))
    title = F.when(
        F.col("__all_url") == 1, F.concat(F.lit(URL_TITLE), root_expr if root else url_root)
    ).otherwise(F.concat(F.lit(DIR_TITLE), root_expr if root else _common_dir(F.col("__mn"), F.col("__mx"))))
    j = layout.join(info, keys) if keys else layout.withColumn("__g", F.lit(1)).join(info.withColumn("__g", F.lit(1)), "__g")
    return j.select(*keys, title.alias("title"), "layout", "n_nodes",
                    format_content(title, F.col("layout"), "doc").alias("tree_text"))


def common_host(df: DataFrame, keys: list[str], url_col: str = "url") -> DataFrame:
    """One distinct host → that host; several → null (E5)."""
    h = url_netloc(url_col)
    return df.groupBy(*keys).agg(F.when(F.countDistinct(h) == 1, F.min(h)).alias("common_host"))


def common_path(df: DataFrame, keys: list[str], path_col: str = "path") -> DataFrame:
    """Longest common segment prefix (E6); associative min/max, so partial aggregation applies."""
    s = F.split(_c(path_col), "/", -1)
    return df.groupBy(*keys).agg(F.min(s).alias("__mn"), F.max(s).alias("__mx")).select(
        *keys, _common_dir(F.col("__mn"), F.col("__mx")).alias("common_path")
    )


def tree_rollup(df: DataFrame, keys: list[str], path_col: str, ord_col: str, sums: dict[str, str],
                root: str | None = None) -> DataFrame:
    """Pages and sizes under each prefix (G6)."""
    base = df.select(*keys, F.col(path_col).alias("path"), F.col(ord_col).alias("ord"), *[F.col(c) for c in sums.values()])
    segs = _segments_for(base, keys, "path", root)
    ex = segs.select(
        *keys, "ord", *sums.values(),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("segs")), lambda n: F.slice(F.col("segs"), 1, n))).alias("node"),
    )
    return ex.groupBy(*keys, "node").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.min("ord").alias("first_ord"),
        *[F.sum(c).cast("long").alias(name) for name, c in sums.items()],
    )
