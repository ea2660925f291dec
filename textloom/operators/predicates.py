"""Row predicates: prefix scope / ignore, substring ignore, exact exclusion, routing rules.

Prefix lists given as Python lists are parameters (a handful of entries) and compile to an
OR-chain of ``startswith`` inside the scan's filter. Prefix *tables* are met through sorted
ranges (:mod:`textloom.operators.prefixes`), whatever their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import _c
from textloom.operators.prefixes import longest_prefix


def any_prefix(col, prefixes: list[str]) -> Column:
    c = _c(col)
    if not prefixes:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def any_substring(col, parts: list[str]) -> Column:
    c = _c(col)
    if not parts:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def scope_filter(df: DataFrame, col: str, prefixes: list[str]) -> DataFrame:
    """Keep rows whose ``col`` starts with any prefix (string prefix: ``ts_mock`` also keeps
    ``ts_mock2/...``). Empty list keeps everything."""
    return df.where(any_prefix(col, prefixes)) if prefixes else df


def ignore_filter(df: DataFrame, col: str, prefixes: list[str]) -> DataFrame:
    return df.where(~any_prefix(col, prefixes)) if prefixes else df


def prefix_join(df: DataFrame, col: str, prefixes: DataFrame, prefix_col: str, how: str = "left_semi") -> DataFrame:
    """Semi/anti join on ``df[col].startswith(prefixes[prefix_col])``, through sorted ranges of both sides'
    distinct strings at every size. A null value begins with nothing."""
    values = df.select(F.col(col).alias("value"))
    hit = longest_prefix(prefixes.select(F.col(prefix_col).alias("prefix")), values).select(F.col("value").alias("__v"))
    return df.join(hit, F.col(col) == F.col("__v"), how)


def url_scope(df: DataFrame, col: str, roots: list[str], boundary: bool = False) -> DataFrame:
    """URL starts with any root (``boundary=True`` additionally requires the next character
    to be ``/``, ``?``, ``#`` or the end, so ``https://a.com`` does not admit ``https://a.com.evil``)."""
    if not boundary:
        return df.where(any_prefix(col, roots))
    c = F.col(col)
    conds = [
        (c == r) | c.startswith(r.rstrip("/") + "/") | c.startswith(r + "?") | c.startswith(r + "#")
        for r in roots
    ]
    return df.where(reduce(lambda a, b: a | b, conds))


def url_ignore(df: DataFrame, col: str, parts: list[str]) -> DataFrame:
    """Drop URLs containing any ignore entry as a substring (not a prefix)."""
    return df.where(~any_substring(col, parts)) if parts else df


def exact_exclude(df: DataFrame, col: str, excluded: DataFrame, excluded_col: str) -> DataFrame:
    return df.join(excluded.select(F.col(excluded_col).alias("__x")), F.col(col) == F.col("__x"), "left_anti")


def public_member(name) -> Column:
    """``__init__`` is public; other names starting with ``_`` are hidden."""
    n = _c(name)
    return (n == "__init__") | ~n.startswith("_")


def needs_continuation(finish_reason, provider: str = "openai", max_tokens_set: bool = False) -> Column:
    """Was the answer cut at the length limit? ``openai`` style: reason ``length``;
    ``gemini`` style: finish code 2 and no explicit max_tokens."""
    fr = _c(finish_reason)
    if provider == "gemini":
        return (fr.cast("string") == "2") & F.lit(not max_tokens_set)
    return F.coalesce(fr == "length", F.lit(False))


def route_work(has_diff, test_code, exit_code, round_) -> Column:
    """Workflow per target: diff ∧ test ∧ first round → from_diff; test ∧ failed → repair;
    test → update; else generate. "Has test" means at least 20 characters."""
    has_test = F.coalesce(F.length(_c(test_code)) >= 20, F.lit(False))
    return (
        F.when(_c(has_diff) & has_test & (_c(round_) == 1), F.lit("from_diff"))
        .when(has_test & (_c(exit_code) != 0), F.lit("repair"))
        .when(has_test, F.lit("update"))
        .otherwise(F.lit("generate"))
    )
