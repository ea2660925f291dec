"""Web-page jobs: landed pages → text, links, crawl closure, budgets, site trees, packed segments.

This is the scraper's work re-expressed over a ``pages(page_id, url, html)`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import sqltext as Q
from textloom.functions.html import html_text, raw_links
from textloom.functions.text import char_count, count_tokens, format_content, line_count
from textloom.functions.urls import normalize_url, resolve_url, skip_binary_url, url_netloc, url_path, url_segments
from textloom.operators.closure import crawl_closure
from textloom.operators.ordered import budget_cutoff, oversize_flag, pack_segments, segment_labels
from textloom.operators.predicates import prefix_join, url_ignore, url_scope
from textloom.operators.tree import common_host, tree_map, tree_nodes, tree_rollup, tree_rows
from textloom.registry import register
from textloom.session import cut_lineage, table
from textloom.sources.files import page_source

# Default budgets of the scrape job (fixed values).
SCRAPE_LIMIT_TOKEN = 100_000
SCRAPE_MAX_TOKEN = 100_000
SCRAPE_MAX_CHAR = 999_999_999


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages keyed by normalized URL; each normalized URL once (smallest page_id wins)."""
    p = page_source(table(spark, sf_dir, "pages")).select("page_id", normalize_url("url").alias("url"), "html")
    return p.groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))


def landed_links(spark: SparkSession, sf_dir: str, link_scope: str = "all") -> DataFrame:
    """``(url, page_id, hrefs)`` per normalized URL (smallest page_id wins). Links are taken from the HTML
    before the de-duplication, so HTML is not moved."""
    p = page_source(table(spark, sf_dir, "pages")).select("page_id", normalize_url("url").alias("url"), raw_links("html", link_scope).alias("hrefs"))
    first = F.min_by(F.struct("page_id", "hrefs"), "page_id").alias("r")
    return p.groupBy("url").agg(first).select("url", F.col("r.page_id").alias("page_id"), F.col("r.hrefs").alias("hrefs"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, host)`` per normalized URL (smallest page_id) without touching HTML."""
    p = page_source(table(spark, sf_dir, "pages")).select("page_id", normalize_url("url").alias("url"))
    return p.groupBy("url").agg(F.min("page_id").alias("page_id")).select("page_id", "url", url_netloc("url").alias("host"))


def scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, host, content, token_size, char_size)``, one row per normalized URL.

    Text is extracted before the de-duplication, so the shuffle moves extracted text rather
    than raw HTML (the widest column of the job)."""
    p = page_source(table(spark, sf_dir, "pages")).select(
        "page_id", normalize_url("url").alias("url"), html_text("html").alias("content"))
    p = p.groupBy("url").agg(F.min_by(F.struct("page_id", "content"), "page_id").alias("r")).select(
        F.col("r.page_id").alias("page_id"), "url", url_netloc("url").alias("host"), F.col("r.content").alias("content"))
    return p.withColumn("token_size", count_tokens("content")).withColumn("char_size", char_count("content"))


def page_links(pages: DataFrame, link_scope: str = "all", roots: list[str] | None = None,
               ignore: list[str] | None = None) -> DataFrame:
    """``(page_id, url, pos, link)``: anchors resolved against the page URL, normalized,
    binary suffixes skipped, then URL scope and ignore rules. ``pages`` holds ``html``, or ``hrefs`` already
    taken from it (:func:`landed_links`)."""
    hrefs = F.col("hrefs") if "hrefs" in pages.columns else raw_links("html", link_scope)
    ex = pages.select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
    ex = ex.select("page_id", "url", F.col("pos").cast("long").alias("pos"), resolve_url("url", "href").alias("link")).where(
        ~skip_binary_url("link"))
    if isinstance(roots, DataFrame):
        ex = prefix_join(ex, "link", roots, "root", "left_semi")
    elif roots:
        ex = url_scope(ex, "link", roots)
    if ignore:
        ex = url_ignore(ex, "link", ignore)
    return ex


def host_items(spark: SparkSession, sf_dir: str, limit_token: int | None) -> DataFrame:
    """Pages per host after the budget cut-off (in URL order), formatted as doc blocks.

    Extracted pages are written once first: the budget's range partitioning samples its
    input, which would otherwise re-run the HTML extraction."""
    s = budget_cutoff(cut_lineage(scraped(spark, sf_dir)), ["host"], ["url"], limit_token=limit_token)
    item = format_content("url", "content", "doc")
    return s.select("host", "url", item.alias("content")).withColumn("token", count_tokens("content")).withColumn(
        "chars", char_count("content")
    )


def scrape_segments(spark: SparkSession, sf_dir: str, limit_token: int | None = SCRAPE_LIMIT_TOKEN,
                    max_token: int | None = SCRAPE_MAX_TOKEN, max_char: int | None = SCRAPE_MAX_CHAR) -> DataFrame:
    """Flagship: per host, site tree header then page texts, packed and wrapped.

    The budgeted items are written once (lineage cut in the shared checkpoint folder); the
    tree, the segment assignment and the per-segment join all read that table instead of
    re-extracting HTML."""
    items = cut_lineage(host_items(spark, sf_dir, limit_token))
    tree = tree_map(items.select("host", "url", F.col("url").alias("ord")), ["host"], "url", "ord", mode="url")
    header = cut_lineage(tree.select("host", F.lit("").alias("url"), F.col("tree_text").alias("content")))
    header = header.withColumn("token", count_tokens("content")).withColumn("chars", char_count("content"))
    all_items = header.unionByName(items)  # "" sorts before every URL: the tree comes first
    packed = pack_segments(all_items, ["host"], ["url"], max_token=max_token, max_char=max_char, with_prompt=True)
    labeled = segment_labels(packed, ["host"], output="path")
    return labeled.select("host", "seg", "k", "n", "role", "n_items", "token", "chars", "wrapped")


# ------------------------------------------------------------------------ SQL pieces

_SQL_PAGES = f"""pg AS (
  SELECT {Q.normalize_url('url')} AS url, min(page_id) AS page_id, arg_min(html, page_id) AS html
  FROM pages GROUP BY 1),
scraped AS (
  SELECT page_id, url, {Q.netloc('url')} AS host, {Q.html_text('html')} AS content FROM pg),
sized AS (
  SELECT *, {Q.tokens('content')} AS token_size, CAST(length(content) AS BIGINT) AS char_size FROM scraped)"""

_SQL_LINKS = f"""lk AS (
  SELECT page_id, url, unnest(generate_series(1, len(hrefs))) - 1 AS pos, unnest(hrefs) AS href
  FROM (SELECT page_id, url, regexp_extract_all(regexp_replace(regexp_replace(html, '{Q.SCRIPT_STYLE_RE}', '<x>', 'g'), '{Q.COMMENT_RE}', '<x>', 'g'), '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1) AS hrefs FROM pg)),
links AS (
  SELECT page_id, url, pos,
         {Q.normalize_url("regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1) || '://' || " + Q.netloc('url') + " || " + Q.decode_entities('href'))} AS link
  FROM lk WHERE starts_with(href, '/') AND NOT starts_with(href, '//'))"""


@register("page_source", f"SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_chars FROM pages")
def q_page_source(spark, sf_dir):
    return page_source(table(spark, sf_dir, "pages")).select("page_id", "url", F.length("html").cast("long").alias("html_chars"))


@register("normalize_url", f"SELECT page_id, {Q.normalize_url('url')} AS norm_url FROM pages")
def q_normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normalize_url("url").alias("norm_url"))


@register("url_segments", f"""SELECT page_id,
  array_to_string(list_concat([{Q.netloc('url')}], list_filter(string_split({Q.url_path('url')}, '/'), lambda x: x <> '')), '|') AS segs,
  CAST(len(list_filter(string_split({Q.url_path('url')}, '/'), lambda x: x <> '')) + 1 AS INTEGER) AS n_segs
FROM pages""")
def q_url_segments(spark, sf_dir):
    s = url_segments("url")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(s, "|").alias("segs"), F.size(s).alias("n_segs"))


@register("html_text", f"SELECT page_id, {Q.html_text('html')} AS text FROM pages")
def q_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))


@register("text_stats", f"""WITH t AS (SELECT page_id, {Q.html_text('html')} AS text FROM pages)
SELECT page_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines,
       {Q.tokens('text')} AS tokens FROM t""")
def q_text_stats(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))
    return t.select("page_id", char_count("text").alias("chars"), line_count("text").alias("lines"),
                    count_tokens("text").alias("tokens"))


@register("page_links", f"WITH {_SQL_PAGES}, {_SQL_LINKS} SELECT page_id, pos, link FROM links")
def q_page_links(spark, sf_dir):
    return page_links(landed_links(spark, sf_dir), "all").select("page_id", "pos", "link")


_ROOTS = ["https://blog.", "http://www."]
_IGNORES = ["spam-farm", "cheap-pills"]


@register("url_scope", f"""SELECT page_id, {Q.normalize_url('url')} AS url FROM pages
WHERE starts_with({Q.normalize_url('url')}, '{_ROOTS[0]}') OR starts_with({Q.normalize_url('url')}, '{_ROOTS[1]}')""")
def q_url_scope(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", normalize_url("url").alias("url"))
    return url_scope(p, "url", _ROOTS)


@register("url_ignore", f"""SELECT page_id, {Q.normalize_url('url')} AS url FROM pages
WHERE NOT (contains({Q.normalize_url('url')}, '{_IGNORES[0]}') OR contains({Q.normalize_url('url')}, '{_IGNORES[1]}'))""")
def q_url_ignore(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", normalize_url("url").alias("url"))
    return url_ignore(p, "url", _IGNORES)


@register("skip_binary_url", f"""SELECT page_id, {Q.normalize_url('url')} AS url,
  (ends_with({Q.normalize_url('url')}, '.pdf') OR ends_with({Q.normalize_url('url')}, '.jpg') OR ends_with({Q.normalize_url('url')}, '.jpeg')
   OR ends_with({Q.normalize_url('url')}, '.html')) AS skipped_html_or_binary,
  (ends_with({Q.normalize_url('url')}, '.pdf') OR ends_with({Q.normalize_url('url')}, '.jpg') OR ends_with({Q.normalize_url('url')}, '.jpeg')) AS skipped
FROM pages""")
def q_skip_binary(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", normalize_url("url").alias("url"))
    return p.select("page_id", "url", (skip_binary_url("url") | F.col("url").endswith(".html")).alias("skipped_html_or_binary"),
                    skip_binary_url("url").alias("skipped"))


@register("budget_cutoff", f"""WITH {_SQL_PAGES},
run AS (SELECT *, sum(token_size) OVER (PARTITION BY host ORDER BY url ROWS UNBOUNDED PRECEDING) AS ct,
               sum(char_size) OVER (PARTITION BY host ORDER BY url ROWS UNBOUNDED PRECEDING) AS cc FROM sized)
SELECT host, url, token_size, char_size FROM run WHERE ct <= 2000 AND cc <= 999999999999""")
def q_budget_cutoff(spark, sf_dir):
    s = scraped(spark, sf_dir)
    return budget_cutoff(s, ["host"], ["url"], limit_token=2000).select("host", "url", "token_size", "char_size")


@register("size_totals", f"""WITH {_SQL_PAGES}
SELECT host, CAST(sum(token_size) AS BIGINT) AS total_tokens, CAST(sum(char_size) AS BIGINT) AS total_chars,
       count(*) AS n_pages FROM sized GROUP BY host""")
def q_size_totals(spark, sf_dir):
    return scraped(spark, sf_dir).groupBy("host").agg(
        F.sum("token_size").cast("long").alias("total_tokens"),
        F.sum("char_size").cast("long").alias("total_chars"),
        F.count(F.lit(1)).alias("n_pages"),
    )


@register("sort_pages", f"WITH {_SQL_PAGES} SELECT url, page_id FROM pg")
def q_sort_pages(spark, sf_dir):
    return landed_pages(spark, sf_dir).select("url", "page_id").orderBy("url")


@register("frontier_fetch", f"""WITH {_SQL_PAGES}
SELECT p.page_id AS frontier_id, p.url AS raw_url, g.page_id, g.url FROM pages p JOIN pg g ON {Q.normalize_url('p.url')} = g.url""")
def q_frontier_fetch(spark, sf_dir):
    front = table(spark, sf_dir, "pages").select(F.col("page_id").alias("frontier_id"), F.col("url").alias("raw_url"))
    front = front.withColumn("__n", normalize_url("raw_url"))
    g = landed_pages(spark, sf_dir).select("page_id", "url")
    return front.join(g, front["__n"] == g["url"]).select("frontier_id", "raw_url", "page_id", "url")


@register("not_seen", f"""WITH {_SQL_PAGES}, {_SQL_LINKS}
SELECT DISTINCT link FROM links WHERE link NOT IN (SELECT url FROM pg)""")
def q_not_seen(spark, sf_dir):
    pages = landed_links(spark, sf_dir)
    cands = page_links(pages, "all").select("link").distinct()
    return cands.join(pages.select(F.col("url").alias("link")), "link", "left_anti")


@register("frontier_except", f"""WITH {_SQL_PAGES}, {_SQL_LINKS}
SELECT link AS url FROM links EXCEPT SELECT url FROM pg""")
def q_frontier_except(spark, sf_dir):
    pages = landed_links(spark, sf_dir)
    found = page_links(pages, "all").select(F.col("link").alias("url"))
    return found.subtract(pages.select("url"))


@register("seed_union", f"""WITH {_SQL_PAGES}, {_SQL_LINKS}
SELECT url FROM pg UNION SELECT link FROM links""")
def q_seed_union(spark, sf_dir):
    pages = landed_links(spark, sf_dir)
    return pages.select("url").union(page_links(pages, "all").select(F.col("link").alias("url"))).distinct()


@register("crawl_closure", f"""WITH RECURSIVE {_SQL_PAGES}, {_SQL_LINKS},
seeds AS (SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY {Q.netloc('url')} ORDER BY page_id) AS r FROM pg) WHERE r = 1),
walk(url, depth) AS (
  SELECT s.url, 0 FROM seeds s JOIN pg ON pg.url = s.url
  UNION
  SELECT l.link, w.depth + 1 FROM walk w JOIN links l ON l.url = w.url
  JOIN pg ON pg.url = l.link
  WHERE w.depth < 50 AND EXISTS (SELECT 1 FROM seeds s WHERE starts_with(l.link, regexp_extract(s.url, '^[a-z]+://[^/?#]*', 0))))
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url""")
def q_crawl_closure(spark, sf_dir):
    pages = landed_links(spark, sf_dir)
    first = pages.groupBy(url_netloc("url").alias("h")).agg(F.min_by("url", "page_id").alias("url"))
    seeds = first.select("url")
    roots = first.select(F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0).alias("root")).distinct()
    res = crawl_closure(pages, seeds, roots=roots, link_scope="all")
    return res.select("url", "depth")


@register("path_tree", f"""WITH {_SQL_PAGES},
segs AS (SELECT host, page_id AS ord, list_concat([{Q.netloc('url')}], list_filter(string_split({Q.url_path('url')}, '/'), lambda x: x <> '')) AS s FROM pg JOIN scraped USING (page_id, url)),
nodes AS (SELECT host, s[1:n] AS node, ord FROM segs, generate_series(1, len(s)) AS g(n))
SELECT host, array_to_string(node, '/') AS node, CAST(len(node) AS INTEGER) AS depth, min(ord) AS first_ord, count(*) AS n_items
FROM nodes GROUP BY host, node""")
def q_path_tree(spark, sf_dir):
    s = page_urls(spark, sf_dir).select("host", "url", F.col("page_id").alias("ord"))
    n = tree_nodes(s, ["host"], "url", "ord")
    return n.select("host", F.array_join("node", "/").alias("node"), "depth", "first_ord", "n_items")


def _tree_rows_sql(final: str) -> str:
    return f"""WITH RECURSIVE {_SQL_PAGES},
segs AS (SELECT host, page_id AS ord, list_concat([{Q.netloc('url')}], list_filter(string_split({Q.url_path('url')}, '/'), lambda x: x <> '')) AS s FROM scraped),
nodes0 AS (SELECT host, s[1:n] AS node, min(ord) AS first_ord FROM segs, generate_series(1, len(s)) AS g(n) GROUP BY host, node),
nodes AS (SELECT *, node[1:len(node)-1] AS parent, len(node) AS depth,
            first_ord = max(first_ord) OVER (PARTITION BY host, node[1:len(node)-1]) AS is_last FROM nodes0),
walk(host, node, prefix, pre) AS (
  SELECT host, node, '', [first_ord] FROM nodes WHERE depth = 1
  UNION ALL
  SELECT c.host, c.node,
         w.prefix || CASE WHEN c.depth <= 2 THEN '' WHEN p.is_last THEN '    ' ELSE '│   ' END,
         list_append(w.pre, c.first_ord)
  FROM walk w JOIN nodes c ON c.host = w.host AND c.parent = w.node
  JOIN nodes p ON p.host = w.host AND p.node = w.node),
rows AS (SELECT n.host, n.node, n.depth, n.is_last, w.pre,
  w.prefix || CASE WHEN n.depth = 1 THEN '' WHEN n.is_last THEN '└── ' ELSE '├── ' END || n.node[len(n.node)] AS line
  FROM nodes n JOIN walk w ON w.host = n.host AND w.node = n.node)
{final}"""


@register("tree_rows", _tree_rows_sql("SELECT host, array_to_string(node, '/') AS node, is_last, line FROM rows"))
def q_tree_rows(spark, sf_dir):
    s = page_urls(spark, sf_dir).select("host", "url", F.col("page_id").alias("ord"))
    r = tree_rows(tree_nodes(s, ["host"], "url", "ord"), ["host"])
    return r.select("host", F.array_join("node", "/").alias("node"), "is_last", "line")


@register("tree_map", _tree_rows_sql(
    f"""SELECT host, {Q.format_content("'Web Site Map: ' || host", "string_agg(line || chr(10), '' ORDER BY pre)", "doc")} AS tree_text
FROM rows GROUP BY host"""))
def q_tree_map(spark, sf_dir):
    s = page_urls(spark, sf_dir).select("host", "url", F.col("page_id").alias("ord"))
    return tree_map(s, ["host"], "url", "ord").select("host", "tree_text")


@register("tree_rollup", f"""WITH {_SQL_PAGES},
segs AS (SELECT host, page_id AS ord, token_size, list_concat([{Q.netloc('url')}], list_filter(string_split({Q.url_path('url')}, '/'), lambda x: x <> '')) AS s FROM sized),
nodes AS (SELECT host, s[1:n] AS node, ord, token_size FROM segs, generate_series(1, len(s)) AS g(n))
SELECT host, array_to_string(node, '/') AS node, count(*) AS n_items, CAST(sum(token_size) AS BIGINT) AS tokens
FROM nodes GROUP BY host, node""")
def q_tree_rollup(spark, sf_dir):
    s = scraped(spark, sf_dir)
    r = tree_rollup(s, ["host"], "url", "page_id", {"tokens": "token_size"})
    return r.select("host", F.array_join("node", "/").alias("node"), "n_items", "tokens")


@register("common_host", f"""SELECT split_part({Q.url_path('url')}, '/', 2) AS lang,
  CASE WHEN count(DISTINCT {Q.netloc('url')}) = 1 THEN min({Q.netloc('url')}) END AS common_host
FROM pages GROUP BY 1""")
def q_common_host(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("lang", F.split(url_path("url"), "/", -1).getItem(1))
    return common_host(p, ["lang"], "url")


def _packed_host_sql(limit_token: int, mt: int, mc: int, final: str) -> str:
    return f"""WITH RECURSIVE {_SQL_PAGES},
run AS (SELECT *, sum(token_size) OVER (PARTITION BY host ORDER BY url ROWS UNBOUNDED PRECEDING) AS ct FROM sized),
kept AS (SELECT host, url, {Q.format_content('url', 'content', 'doc')} AS content FROM run WHERE ct <= {limit_token}),
items AS (SELECT host AS grp, url AS ord, content, {Q.tokens('content')} AS tok, CAST(length(content) AS BIGINT) AS chr FROM kept),
{Q.greedy_pack('items', mt, mc)},
segs AS (SELECT i.grp AS host, s.seg, string_agg(i.content, '' ORDER BY i.ord) AS content,
            CAST(sum(i.tok) AS BIGINT) AS token, CAST(sum(i.chr) AS BIGINT) AS chars, count(*) AS n_items
         FROM items i JOIN packed_seg s ON s.grp = i.grp AND s.ord = i.ord GROUP BY 1, 2)
{final}"""


@register("pack_pages", _packed_host_sql(
    3000, 1000, 0, "SELECT host, seg, md5(content) AS content_md5, token, chars, n_items FROM segs"))
def q_pack_pages(spark, sf_dir):
    items = host_items(spark, sf_dir, 3000)
    p = pack_segments(items, ["host"], ["url"], max_token=1000, max_char=0)
    return p.select("host", "seg", F.md5("content").alias("content_md5"), "token", "chars", "n_items")


@register("segment_labels", _packed_host_sql(
    3000, 1000 - 50, 999_999_999 - 150,
    """SELECT host, seg, seg + 1 AS k, count(*) OVER (PARTITION BY host) AS n,
  CASE WHEN count(*) OVER (PARTITION BY host) = 1 THEN 'only' WHEN seg = 0 THEN 'first'
       WHEN seg + 1 = count(*) OVER (PARTITION BY host) THEN 'last' ELSE 'middle' END AS role,
  md5(CASE WHEN count(*) OVER (PARTITION BY host) = 1
       THEN '# Prompt: Below are the paths to the files related to the question and their dependent files.' || chr(10) || content || chr(10) || '# Prompt: Please answer the questions with an understanding of the above files.' || chr(10) || '@Codebase' || chr(10) || chr(10)
       WHEN seg = 0 THEN '# Prompt: Beginning the document transmission. This is part ' || (seg+1) || ' of ' || count(*) OVER (PARTITION BY host) || ' total segments. Please respond with ''OK, waiting'' and do not take any action until all segments have been sent.' || chr(10) || content
       WHEN seg + 1 = count(*) OVER (PARTITION BY host) THEN '# Prompt: This is the final segment of the document, segment ' || (seg+1) || ' of ' || count(*) OVER (PARTITION BY host) || ' total segments. After this segment, please respond to the questions.' || chr(10) || chr(10) || content
       ELSE '# Prompt: Continuing the document transmission. This is segment ' || (seg+1) || ' of ' || count(*) OVER (PARTITION BY host) || ' total segments. Please respond with ''OK, waiting'' and do not take any action until all segments have been sent.' || chr(10) || content END
   || CASE WHEN count(*) OVER (PARTITION BY host) = 1 THEN '' ELSE chr(10) || '# Prompt: End of segment ' || (seg+1) || ' of ' || count(*) OVER (PARTITION BY host) || ' total segments. Please wait for the next segment to be sent.' END) AS wrapped_md5
FROM segs"""))
def q_segment_labels(spark, sf_dir):
    items = host_items(spark, sf_dir, 3000)
    p = pack_segments(items, ["host"], ["url"], max_token=1000, max_char=None, with_prompt=True)
    lab = segment_labels(p, ["host"], output="path")
    return lab.select("host", "seg", "k", "n", "role", F.md5("wrapped").alias("wrapped_md5"))


@register("oversize_flag", f"""WITH {_SQL_PAGES},
it AS (SELECT page_id, {Q.format_content('url', 'content', 'doc')} AS content FROM sized)
SELECT page_id, ({Q.tokens('content')} > 1000) AS oversize, string_split(content, chr(10))[2] AS title_line FROM it""")
def q_oversize_flag(spark, sf_dir):
    s = scraped(spark, sf_dir).select("page_id", format_content("url", "content", "doc").alias("content"))
    s = s.withColumn("token", count_tokens("content")).withColumn("chars", char_count("content"))
    return oversize_flag(s, 1000, 0).select("page_id", "oversize", "title_line")


def _scrape_sql() -> str:
    mt, mc = SCRAPE_MAX_TOKEN - 50, SCRAPE_MAX_CHAR - 150
    n = "count(*) OVER (PARTITION BY host)"
    k = "(seg + 1)"
    return f"""WITH RECURSIVE {_SQL_PAGES},
run AS (SELECT *, sum(token_size) OVER (PARTITION BY host ORDER BY url ROWS UNBOUNDED PRECEDING) AS ct FROM sized),
kept AS (SELECT host, url, content FROM run WHERE ct <= {SCRAPE_LIMIT_TOKEN}),
tsegs AS (SELECT host, url AS ord, list_concat([{Q.netloc('url')}], list_filter(string_split({Q.url_path('url')}, '/'), lambda x: x <> '')) AS s FROM kept),
nodes0 AS (SELECT host, s[1:n] AS node, min(ord) AS first_ord FROM tsegs, generate_series(1, len(s)) AS g(n) GROUP BY host, node),
nodes AS (SELECT *, node[1:len(node)-1] AS parent, len(node) AS depth,
            first_ord = max(first_ord) OVER (PARTITION BY host, node[1:len(node)-1]) AS is_last FROM nodes0),
twalk(host, node, prefix, pre) AS (
  SELECT host, node, '', [first_ord] FROM nodes WHERE depth = 1
  UNION ALL
  SELECT c.host, c.node, w.prefix || CASE WHEN c.depth <= 2 THEN '' WHEN p.is_last THEN '    ' ELSE '│   ' END,
         list_append(w.pre, c.first_ord)
  FROM twalk w JOIN nodes c ON c.host = w.host AND c.parent = w.node JOIN nodes p ON p.host = w.host AND p.node = w.node),
trows AS (SELECT n.host, w.pre, w.prefix || CASE WHEN n.depth = 1 THEN '' WHEN n.is_last THEN '└── ' ELSE '├── ' END || n.node[len(n.node)] AS line
  FROM nodes n JOIN twalk w ON w.host = n.host AND w.node = n.node),
tree AS (SELECT host, {Q.format_content("'Web Site Map: ' || host", "string_agg(line || chr(10), '' ORDER BY pre)", "doc")} AS content
  FROM trows GROUP BY host),
items0 AS (SELECT host AS grp, '' AS ord, content FROM tree
  UNION ALL SELECT host, url, {Q.format_content('url', 'content', 'doc')} FROM kept),
items AS (SELECT grp, ord, content, {Q.tokens('content')} AS tok, CAST(length(content) AS BIGINT) AS chr FROM items0),
{Q.greedy_pack('items', mt, mc)},
psegs AS (SELECT i.grp AS host, s.seg, string_agg(i.content, '' ORDER BY i.ord) AS content,
            CAST(sum(i.tok) AS BIGINT) AS token, CAST(sum(i.chr) AS BIGINT) AS chars, count(*) AS n_items
          FROM items i JOIN packed_seg s ON s.grp = i.grp AND s.ord = i.ord GROUP BY 1, 2)
SELECT host, seg, {k} AS k, {n} AS n,
  CASE WHEN {n} = 1 THEN 'only' WHEN seg = 0 THEN 'first' WHEN {k} = {n} THEN 'last' ELSE 'middle' END AS role,
  n_items, token, chars,
  md5(CASE WHEN {n} = 1
       THEN '# Prompt: Below are the paths to the files related to the question and their dependent files.' || chr(10) || content || chr(10) || '# Prompt: Please answer the questions with an understanding of the above files.' || chr(10) || '@Codebase' || chr(10) || chr(10)
       WHEN seg = 0 THEN '# Prompt: Beginning the document transmission. This is part ' || {k} || ' of ' || {n} || ' total segments. Please respond with ''OK, waiting'' and do not take any action until all segments have been sent.' || chr(10) || content
       WHEN {k} = {n} THEN '# Prompt: This is the final segment of the document, segment ' || {k} || ' of ' || {n} || ' total segments. After this segment, please respond to the questions.' || chr(10) || chr(10) || content
       ELSE '# Prompt: Continuing the document transmission. This is segment ' || {k} || ' of ' || {n} || ' total segments. Please respond with ''OK, waiting'' and do not take any action until all segments have been sent.' || chr(10) || content END
   || CASE WHEN {n} = 1 THEN '' ELSE chr(10) || '# Prompt: End of segment ' || {k} || ' of ' || {n} || ' total segments. Please wait for the next segment to be sent.' END) AS wrapped_md5
FROM psegs"""


@register("scrape_segments", _scrape_sql())
def q_scrape_segments(spark, sf_dir):
    return scrape_segments(spark, sf_dir).select("host", "seg", "k", "n", "role", "n_items", "token", "chars",
                                                 F.md5("wrapped").alias("wrapped_md5"))


@register("resolve_url", f"WITH {_SQL_PAGES}, {_SQL_LINKS} SELECT page_id, pos, link AS resolved FROM links")
def q_resolve_url(spark, sf_dir):
    p = landed_links(spark, sf_dir)
    ex = p.select("page_id", "url", F.posexplode("hrefs").alias("pos", "href"))
    return ex.select("page_id", F.col("pos").cast("long").alias("pos"), resolve_url("url", "href").alias("resolved"))
