"""URL scalars: normalization, resolution against a base, host and path segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import _c

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def normalize_url(url) -> Column:
    """Drop query and fragment (everything from the first ``?`` or ``#``)."""
    return F.regexp_replace(_c(url), r"(?s)[?#].*$", "")


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), SCHEME_RE, 1))


def url_netloc(url) -> Column:
    """Network location as ``urlparse(url).netloc`` (empty when there is none)."""
    return F.regexp_extract(_c(url), NETLOC_RE, 1)


def url_path(url) -> Column:
    return F.regexp_extract(_c(url), PATH_RE, 1)


def is_http_url(url) -> Column:
    u = _c(url)
    return u.startswith("http://") | u.startswith("https://")


def url_segments(url) -> Column:
    """``[netloc] + non-empty path parts``."""
    parts = F.filter(F.split(url_path(url), "/", -1), lambda x: x != "")
    return F.concat(F.array(url_netloc(url)), parts)


def _fold_dots(segs: Column) -> Column:
    """Resolve ``.`` and ``..`` like ``urljoin`` (pop on ``..``, skip ``.``)."""
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(x == ".", acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    last = F.element_at(segs, -1)
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(folded, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def resolve_url(base, href) -> Column:
    """``urljoin(base, href)`` followed by :func:`normalize_url`.

    Cases: absolute href (has a scheme) passes; ``//host/x`` takes the base scheme;
    empty / ``?q`` / ``#f`` keep the base path; ``/x`` replaces the path; anything else is
    merged with the base folder. Dot segments are folded the way ``urljoin`` folds them.
    """
    b, h = _c(base), _c(href)
    b_scheme = F.regexp_extract(b, SCHEME_RE, 1)
    b_netloc = url_netloc(b)
    b_path = url_path(b)
    h_path = F.regexp_extract(h, r"^([^?#]*)", 1)

    base_dir = F.split(b_path, "/", -1)
    base_dir = F.when(F.element_at(base_dir, -1) != "", F.slice(base_dir, 1, F.size(base_dir) - 1)).otherwise(
        base_dir
    )
    rel = F.concat(base_dir, F.split(h_path, "/", -1))
    rel = F.filter(rel, lambda x, i: (i == 0) | (i == F.size(rel) - 1) | (x != ""))
    segs = F.when(h_path.startswith("/"), F.split(h_path, "/", -1)).otherwise(rel)
    path = _fold_dots(segs)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    merged = F.concat(b_scheme, F.lit("://"), b_netloc, path)

    resolved = (
        F.when(h.isNull() | (h == ""), b)
        .when(h.rlike(SCHEME_RE), h)
        .when(h.startswith("//"), F.concat(b_scheme, F.lit(":"), h))
        .when(h_path == "", F.concat(b_scheme, F.lit("://"), b_netloc, b_path))
        .otherwise(merged)
    )
    return normalize_url(resolved)


def skip_binary_url(url) -> Column:
    """True when the URL ends with one of the skipped binary suffixes (case-sensitive)."""
    u = _c(url)
    return u.endswith(".pdf") | u.endswith(".jpg") | u.endswith(".jpeg")


# Suffixes never visited or followed.
BINARY_SUFFIXES = (".pdf", ".jpg", ".jpeg")
