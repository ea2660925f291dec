"""HTML → text and links.

Two paths that give the same result:
  * native: a fixed sequence of regex rewrites, JVM-side and codegen'd, for plain pages;
  * parser: Python ``html.parser`` inside an Arrow-batched ``pandas_udf`` for pages that the
    rewrites are not made for (:func:`needs_parser`); it sees nulls in place of all others.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import _c, strip_nul

# Elements whose whole subtree is removed before taking text.
REMOVED_TAGS = ("header", "footer", "nav", "aside")
# Elements whose content is never text.
RAW_TAGS = ("script", "style")
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)

SEP = "\u0001"


def _element_re(tags) -> str:
    return "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in tags)


SCRIPT_STYLE_RE = _element_re(RAW_TAGS)
COMMENT_RE = r"(?s)<!--.*?-->"
REMOVED_RE = _element_re(REMOVED_TAGS)
TAG_RE = r"(?s)\s*<[^>]*>\s*"
HREF_RE = r"(?is)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\""


def decode_entities(text) -> Column:
    """Decode the common named entities; ``&amp;`` last so ``&amp;lt;`` stays ``&lt;``."""
    t = _c(text)
    for ent, ch in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.replace(t, F.lit("&amp;"), F.lit("&"))


def _without_raw(html) -> Column:
    h = F.regexp_replace(_c(html), SCRIPT_STYLE_RE, "<x>")
    return F.regexp_replace(h, COMMENT_RE, "<x>")


def body_html(html) -> Column:
    """HTML with script/style/comments and the removed elements replaced by an empty tag."""
    return F.regexp_replace(_without_raw(html), REMOVED_RE, "<x>")


# What the native rewrites are not made for: other entities, removed elements one inside another or left
# open, brackets inside attributes, links without double quotes, declarations, elements of raw text,
# blanks that only the parser strips, and script or style that is left open.
_REMOVED = "|".join(REMOVED_TAGS)
ODD_RES = (
    r"&(?!(?:amp|quot|lt|gt|copy|middot|#39);)[#A-Za-z]",
    rf"(?is)<({_REMOVED})\b(?:(?!</\1\s*>|<(?:{_REMOVED})\b).)*+(?:<|\z)(?!/\1)",
    rf"(?is)<(?:{_REMOVED}|script|style)\b[^>]*/>|</(?:{_REMOVED}|script|style)\b(?!\s*>)",
    r"(?s)<[a-zA-Z/][^<>]*+(?:<|\z)|<[a-zA-Z][^<>]*=\s*(?:\"[^\"<>]*+>|'[^'<>]*+>)",
    r"(?is)<a\b(?![^>]*\bhref\s*=\s*\")[^>]*\bhref|<a\b[^>]*[^\s\"]href|<a\b[^>]*\bhref[^>]*\bhref",
    r"(?is)<title\b[^>]*>[^<]*+(?!</title\s*>)|<(?:!\[|\?|textarea|plaintext|xmp|iframe|noembed|noframes|noscript)|<!(?!--|doctype\b)",
    r"[\u001c-\u001f\u000b\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0000]",
    r"(?is)<(script|style)\b(?:(?!</\1\s*>).)*+\z|<!--(?:(?!-->).)*+\z|<!--(?:-?>)|--!>",
    r"<(?![a-zA-Z/!])|</(?![a-zA-Z])",
)


def needs_parser(html) -> Column:
    """Whether a page holds what the native rewrites are not made for."""
    h = _c(html)
    odd = F.lit(False)
    for pattern in ODD_RES:
        odd = odd | h.rlike(pattern)
    return F.coalesce(odd, F.lit(False))


def html_text(html) -> Column:
    """Visible text: removed elements dropped, text nodes trimmed, joined by one space, NUL removed."""
    h, odd = _c(html), needs_parser(html)
    return F.when(odd, html_text_parsed(F.when(odd, h))).otherwise(html_text_native(h))


def html_text_native(html) -> Column:
    """The rewrites alone, right for pages that :func:`needs_parser` leaves to them."""
    h = body_html(html)
    h = F.regexp_replace(h, TAG_RE, SEP)
    h = F.regexp_replace(h, SEP + "+", " ")
    h = F.regexp_replace(h, r"^\s+|\s+$", "")
    return strip_nul(decode_entities(h))


def raw_links(html, link_scope: str = "body") -> Column:
    """``href`` values of ``<a>`` tags. ``body``: outside the removed elements; ``all``: every anchor
    outside script/style/comments."""
    h, odd = _c(html), needs_parser(html)
    src = body_html(h) if link_scope == "body" else _without_raw(h)
    native = F.transform(F.regexp_extract_all(src, F.lit(HREF_RE), F.lit(1)), lambda x: decode_entities(x))
    return F.when(odd, raw_links_parsed(F.when(odd, h), link_scope)).otherwise(native)


# ---------------------------------------------------------------- parser path

def _parse_page(html: str | None, link_scope: str = "body"):
    from html.parser import HTMLParser

    if html is None:
        return None, None

    class _H(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.removed = 0
            self.raw = 0
            self.texts: list[str] = []
            self.links: list[str] = []

        def handle_starttag(self, tag, attrs):
            if tag in REMOVED_TAGS:
                self.removed += 1
            elif tag in RAW_TAGS:
                self.raw += 1
            if tag == "a" and (link_scope == "all" or self.removed == 0):
                for k, v in attrs:
                    if k == "href" and v is not None:
                        self.links.append(v)
                        break

        def handle_startendtag(self, tag, attrs):
            if tag == "a" and (link_scope == "all" or self.removed == 0):
                for k, v in attrs:
                    if k == "href" and v is not None:
                        self.links.append(v)
                        break

        def handle_endtag(self, tag):
            if tag in REMOVED_TAGS and self.removed:
                self.removed -= 1
            elif tag in RAW_TAGS and self.raw:
                self.raw -= 1

        def handle_data(self, data):
            if self.removed == 0 and self.raw == 0:
                s = data.strip()
                if s:
                    self.texts.append(s)

    p = _H()
    try:
        p.feed(html)
        p.close()
    except Exception:  # malformed input still yields what was read
        pass
    return " ".join(p.texts).replace("\0", ""), p.links


def html_text_parsed(html) -> Column:
    import pandas as pd

    @F.pandas_udf(T.StringType())
    def _text(s: pd.Series) -> pd.Series:
        return s.map(lambda h: _parse_page(h)[0], na_action="ignore")

    return _text(_c(html))


def raw_links_parsed(html, link_scope: str = "body") -> Column:
    import pandas as pd

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _links(s: pd.Series) -> pd.Series:
        return s.map(lambda h: _parse_page(h, link_scope)[1], na_action="ignore")

    return _links(_c(html))
