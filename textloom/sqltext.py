"""DuckDB SQL fragments mirroring the column functions (used only to write oracle queries)."""

from __future__ import annotations

from textloom.functions.html import COMMENT_RE, REMOVED_RE, SCRIPT_STYLE_RE, TAG_RE
from textloom.functions.text import JS_BLOCK_RE, JS_LINE_RE, PY_COMMENT_RE, PY_DOC_RE, TOKEN_PATTERN
from textloom.functions.urls import NETLOC_RE, PATH_RE


def tokens(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{TOKEN_PATTERN}')) AS BIGINT)"


def normalize_url(x: str) -> str:
    return f"regexp_replace({x}, '(?s)[?#].*$', '')"


def netloc(x: str) -> str:
    return f"regexp_extract({x}, '{NETLOC_RE}', 1)"


def url_path(x: str) -> str:
    return f"regexp_extract({x}, '{PATH_RE}', 1)"


def decode_entities(x: str) -> str:
    for ent, ch in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return f"replace({x}, '&amp;', '&')"


def body_html(h: str) -> str:
    s = f"regexp_replace({h}, '{SCRIPT_STYLE_RE}', '<x>', 'g')"
    s = f"regexp_replace({s}, '{COMMENT_RE}', '<x>', 'g')"
    return f"regexp_replace({s}, '{REMOVED_RE}', '<x>', 'g')"


def html_text(h: str) -> str:
    s = body_html(h)
    s = f"regexp_replace({s}, '{TAG_RE}', chr(1), 'g')"
    s = f"regexp_replace({s}, chr(1) || '+', ' ', 'g')"
    s = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    return f"replace({decode_entities(s)}, chr(0), '')"


def format_content(name: str, content: str, style: str = "doc") -> str:
    fence = "repeat(chr(96),3)" if style == "code" else "repeat(chr(34),3)"
    return f"(chr(10) || '### ' || {name} || chr(10) || {fence} || chr(10) || {content} || chr(10) || {fence} || chr(10))"


def greedy_pack(items_cte: str, mt: int, mc: int) -> str:
    """Recursive CTE assigning 0-based segment numbers per ``grp`` in ``ord`` order over a
    CTE named ``items_cte`` with columns (grp, ord, tok, chr). Produces CTE ``packed_seg``."""
    def over(t, c):
        parts = []
        if mt != 0:
            parts.append(f"{mt} < {t}")
        if mc != 0:
            parts.append(f"{mc} < {c}")
        return "(" + (" OR ".join(parts) if parts else "false") + ")"

    return f"""numbered AS (
  SELECT grp, ord, tok, chr, row_number() OVER (PARTITION BY grp ORDER BY ord) AS i FROM {items_cte}),
walk(grp, i, tt, tc, seg) AS (
  SELECT grp, i, tok, chr, CAST(0 AS BIGINT) FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.grp, n.i,
         CASE WHEN {over('w.tt + n.tok', 'w.tc + n.chr')} THEN n.tok ELSE w.tt + n.tok END,
         CASE WHEN {over('w.tt + n.tok', 'w.tc + n.chr')} THEN n.chr ELSE w.tc + n.chr END,
         w.seg + CASE WHEN {over('w.tt + n.tok', 'w.tc + n.chr')} THEN 1 ELSE 0 END
  FROM walk w JOIN numbered n ON n.grp = w.grp AND n.i = w.i + 1),
packed_seg AS (
  SELECT n.grp, n.ord, w.seg FROM numbered n JOIN walk w ON w.grp = n.grp AND w.i = n.i)"""


def strip_py_doc(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{PY_DOC_RE}', '', 'g'), '{PY_COMMENT_RE}', '', 'g')"


def strip_js_doc(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{JS_BLOCK_RE}', '', 'g'), '{JS_LINE_RE}', '', 'g')"
