"""Text scalars as Spark column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that results depend on.
# Default token pattern: runs of letters, groups of up to three digits, runs of other
# non-blank symbols. The same pattern runs in Java regex and RE2, so counts agree with SQL.
TOKEN_PATTERN = r"[\p{L}]+|[\p{N}]{1,3}|[^\s\p{L}\p{N}]+"
# Fences of the formatted block: doc style uses three double quotes, code style three backticks.
DOC_FENCE = '"""'
CODE_FENCE = "```"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_tokens(text) -> Column:
    """Default token count (native regex; not a BPE vocabulary)."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0)).cast("long")


def token_counter_udf(encode: Callable[[str], list]) -> Callable[[Column], Column]:
    """Exact counts with a caller-supplied encoder (e.g. a BPE ``encode``), Arrow-batched."""
    import pandas as pd

    @F.pandas_udf(T.LongType())
    def _count(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return lambda col: _count(_c(col))


def char_count(text) -> Column:
    return F.length(_c(text)).cast("long")


def line_count(text) -> Column:
    """Number of pieces of ``text.split("\\n")``."""
    return F.size(F.split(_c(text), "\n", -1)).cast("long")


def strip_nul(text) -> Column:
    return F.regexp_replace(_c(text), "\u0000", "")


def format_content(name, content, style: str = "doc") -> Column:
    """``\\n### {name}\\n{fence}\\n{content}\\n{fence}\\n``; doc → three double quotes, code → backticks."""
    fence = CODE_FENCE if style == "code" else DOC_FENCE
    return F.concat(F.lit("\n### "), _c(name), F.lit(f"\n{fence}\n"), _c(content), F.lit(f"\n{fence}\n"))


def fmt_number(n) -> Column:
    """Thousands separators, no decimals."""
    return F.format_number(_c(n), 0)


def truncate_text(text, n: int) -> Column:
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


PY_DOC_RE = r'(?s)""".*?"""\n'
PY_COMMENT_RE = r"# [^\n]*\n"
JS_BLOCK_RE = r"(?s)/\*.*?\*/"
JS_LINE_RE = r"// [^\n]*\n"


def strip_py_doc(text) -> Column:
    """Remove triple-double-quote blocks followed by a newline, then ``# ...\\n`` comments.

    Like the reference this is textual: it also hits ``# `` inside strings and eats the newline.
    """
    t = F.regexp_replace(_c(text), PY_DOC_RE, "")
    return F.regexp_replace(t, PY_COMMENT_RE, "")


def strip_js_doc(text) -> Column:
    """Remove ``/* ... */`` blocks, then ``// ...\\n`` comments (also inside URLs like ``https:// x``)."""
    t = F.regexp_replace(_c(text), JS_BLOCK_RE, "")
    return F.regexp_replace(t, JS_LINE_RE, "")


def strip_doc(text, lang, enabled: bool = True) -> Column:
    """Choose the stripper by language; only when asked."""
    if not enabled:
        return _c(text)
    lang = _c(lang)
    return (
        F.when(lang == "PYTHON", strip_py_doc(text))
        .when(lang == "JAVASCRIPT", strip_js_doc(text))
        .otherwise(_c(text))
    )


# Fenced code block: optional word after the opening fence, body up to a newline + fence.
CODE_BLOCK_PATTERN = r"(?s)```(?:\w+)?\n(.*?)\n```"


def extract_code(text) -> Column:
    """All fenced blocks, each stripped of surrounding whitespace, joined by three newlines;
    the input unchanged when there is none."""
    t = _c(text)
    blocks = F.regexp_extract_all(t, F.lit(CODE_BLOCK_PATTERN), 1)
    trimmed = F.transform(blocks, lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    return F.when(F.size(blocks) > 0, F.array_join(trimmed, "\n\n\n")).otherwise(t)


def fmt_class_name(name) -> Column:
    """Remove generic parameters ``[...]``."""
    return F.regexp_replace(_c(name), r"\[[^\n]*?\]", "")
