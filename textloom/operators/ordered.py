"""Ordered-sequence operators: running totals, budget cut-off, greedy packing, segment labels.

Scale notes
-----------
* ``running_totals`` never puts one group into one task: rows are range-partitioned on
  (keys, order) into blocks and written with their block number, each block computes local
  running sums, and the blocks' totals (at most #groups + #blocks rows) give each block its
  offset. The written table is what both sides read, so they agree on the blocks. A hot key
  that holds a third of all rows spreads over many blocks; every size takes this path.
* Greedy packing takes narrow rows (item number and two sizes) through :mod:`textloom.operators.packing`:
  runs of bounded length, whose effect on the open segment is composed by pointer doubling, so that
  a hot group spreads over all tasks. Texts are joined only per segment, which the budget bounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.packing import greedy_segments
from textloom.session import cut_lineage

DEFAULT_MAX_TOKEN = 25_000
DEFAULT_MAX_CHAR = 999_999_999
# Wrapper text costs this much of the budget when segments are wrapped (fixed values).
WRAP_TOKEN_RESERVE = 50
WRAP_CHAR_RESERVE = 150


def _n_blocks(df: DataFrame, n_blocks: int | None) -> int:
    if n_blocks:
        return n_blocks
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    n_blocks: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``sums`` per ``keys`` in ``order``. Null values count as 0, null keys
    form a group of their own, and rows with equal order values get distinct running values in an
    unspecified tie order."""
    base = df.select(
        *[c for c in df.columns if c not in sums], *[F.coalesce(col, F.lit(0)).alias(f"__v_{name}") for name, col in sums.items()]
    )
    by = [*[F.col(k) for k in keys], *[F.col(o) for o in order]]
    ranged = cut_lineage(base.repartitionByRange(_n_blocks(df, n_blocks), *by).withColumn("__blk", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "__blk").agg(*[F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums])
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__blk").alias("__kb"),
        *[F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__o_{name}") for name in sums],
    )
    upto = Window.partitionBy(*keys, "__blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(f"__v_{name}").over(upto).alias(f"__l_{name}") for name in sums])
    cond = reduce(
        lambda a, b: a & b,
        [local[k].eqNullSafe(offsets[f"__k_{k}"]) for k in keys] + [local["__blk"] == offsets["__kb"]],
    )
    return local.join(offsets, cond, "inner").select(
        *[c for c in df.columns if c not in sums],
        *[(F.col(f"__l_{name}") + F.col(f"__o_{name}")).alias(name) for name in sums],
    )


def row_index(df: DataFrame, keys: list[str], order: list[str], name: str = "idx", n_blocks: int | None = None) -> DataFrame:
    """1-based position within ``keys`` by ``order`` (skew-safe row_number)."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")}, n_blocks)


# ------------------------------------------------------------------ F1 budget cut-off

def budget_cutoff(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    token_col: str = "token_size",
    char_col: str = "char_size",
    limit_token: int | None = None,
    limit_char: int | None = None,
    n_blocks: int | None = None,
) -> DataFrame:
    """Accept rows in order until the first one that would take the running token or
    character total over its limit; that row and all later rows are dropped. Meeting a limit
    exactly is accepted. A limit of None does not limit."""
    limits = {"__cum_tok": limit_token, "__cum_chr": limit_char}
    rt = running_totals(
        df, keys, order, {"__cum_tok": F.col(token_col).cast("long"), "__cum_chr": F.col(char_col).cast("long")}, n_blocks
    )
    for name, limit in limits.items():
        if limit is not None:
            rt = rt.where(F.col(name) <= limit)
    return rt.drop(*limits)


# ------------------------------------------------------------------ F2 greedy packing

def effective_limits(max_token: int | None, max_char: int | None, with_prompt: bool) -> tuple[int, int]:
    """Unset → defaults; wrapping reserves room for the wrapper text (may go negative)."""
    mt = DEFAULT_MAX_TOKEN if max_token is None else max_token
    mc = DEFAULT_MAX_CHAR if max_char is None else max_char
    if with_prompt:
        mt -= WRAP_TOKEN_RESERVE
        mc -= WRAP_CHAR_RESERVE
    return mt, mc


def numbered(items: DataFrame) -> DataFrame:
    """``items`` written once with a number for each row, so that rows can be told apart whatever they hold."""
    return cut_lineage(items.withColumn("__id", F.monotonically_increasing_id()))


def _segments_by_id(items: DataFrame, keys, order, max_token, max_char, with_prompt, keep_empty, token_col, char_col) -> DataFrame:
    mt, mc = effective_limits(max_token, max_char, with_prompt)
    size = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    narrow = items.select(*keys, *order, "__id", size(token_col).alias("__tok"), size(char_col).alias("__chr"))
    seg = greedy_segments(narrow, keys, order, mt, mc, _n_blocks(items, None))
    empty = F.col("first_over") if keep_empty else F.lit(False)
    return seg.select("__id", (F.col("seg") + empty.cast("long")).alias("seg"), empty.alias("empty_first"))


def assign_segments(
    items: DataFrame,
    keys: list[str],
    order: list[str],
    max_token: int | None = None,
    max_char: int | None = None,
    with_prompt: bool = False,
    keep_empty: bool = False,
    token_col: str = "token",
    char_col: str = "chars",
) -> DataFrame:
    """(keys, order, seg, empty_first) for every item; ``seg`` is 0-based per group. Null keys form a group,
    null sizes count as 0, and items with equal keys and order stay apart."""
    rows = numbered(items.select(*keys, *order, token_col, char_col))
    seg = _segments_by_id(rows, keys, order, max_token, max_char, with_prompt, keep_empty, token_col, char_col)
    return rows.join(seg, "__id").select(*keys, *order, "seg", "empty_first")


def pack_segments(
    items: DataFrame,
    keys: list[str],
    order: list[str],
    content_col: str = "content",
    max_token: int | None = None,
    max_char: int | None = None,
    with_prompt: bool = False,
    keep_empty: bool = False,
    token_col: str = "token",
    char_col: str = "chars",
) -> DataFrame:
    """Greedy in-order packing under a token and a character budget.

    Returns ``(keys..., seg, content, token, chars, n_items)`` with ``token``/``chars`` the
    sums of the packed items. An item over budget on its own becomes its own segment. With
    ``keep_empty`` the empty first segment (first item over budget) is kept. Null keys form a
    group, null sizes and contents count as 0 and nothing.
    """
    rows = numbered(items)
    seg = _segments_by_id(rows, keys, order, max_token, max_char, with_prompt, keep_empty, token_col, char_col)
    if keep_empty:
        seg = cut_lineage(seg)
    order_expr = ", ".join(f"`{o}`" for o in [*order, "__id"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    packed = rows.join(seg.drop("empty_first"), "__id").groupBy(*keys, "seg").agg(
        F.expr(f"coalesce(listagg(`{content_col}`, '') WITHIN GROUP (ORDER BY {order_expr}), '')").alias("content"),
        total(token_col).alias("token"),
        total(char_col).alias("chars"),
        F.count(F.lit(1)).cast("long").alias("n_items"),
    )
    if keep_empty:
        zero = F.lit(0).cast("long")
        firsts = rows.join(seg.where("empty_first"), "__id").select(*keys).distinct()
        packed = packed.unionByName(
            firsts.select(*keys, zero.alias("seg"), F.lit("").alias("content"), *[zero.alias(c) for c in ("token", "chars", "n_items")])
        )
    return packed


# ------------------------------------------------------------------ F3 labels, F4 oversize

# Wrapper wording of packed segments.
SINGLE_CODE_START = (
    "# Prompt: Below is the complete document, consisting of a single segment. "
    "Please respond to the questions after reading this document.\n"
)
SINGLE_CODE_END = "\n# Prompt: Document transmission of the single segment is complete. Please respond to the questions now.\n\n"
SINGLE_PATH_START = "# Prompt: Below are the paths to the files related to the question and their dependent files.\n"
SINGLE_PATH_END = "\n# Prompt: Please answer the questions with an understanding of the above files.\n@Codebase\n\n"
FIRST_START = (
    "# Prompt: Beginning the document transmission. This is part {k} of {n} total segments. "
    "Please respond with 'OK, waiting' and do not take any action until all segments have been sent.\n"
)
LAST_START = (
    "# Prompt: This is the final segment of the document, segment {k} of {n} total segments. "
    "After this segment, please respond to the questions.\n\n"
)
MIDDLE_START = (
    "# Prompt: Continuing the document transmission. This is segment {k} of {n} total segments. "
    "Please respond with 'OK, waiting' and do not take any action until all segments have been sent.\n"
)
SEGMENT_END = "\n# Prompt: End of segment {k} of {n} total segments. Please wait for the next segment to be sent."


@dataclass(frozen=True)
class Wording:
    """Texts around a segment; ``{k}`` is its position and ``{n}`` the number of segments."""

    code_start: str = SINGLE_CODE_START
    code_end: str = SINGLE_CODE_END
    path_start: str = SINGLE_PATH_START
    path_end: str = SINGLE_PATH_END
    first_start: str = FIRST_START
    middle_start: str = MIDDLE_START
    last_start: str = LAST_START
    segment_end: str = SEGMENT_END


def _fill(template: str) -> Column:
    text = F.replace(F.lit(template), F.lit("{k}"), F.col("__k").cast("string"))
    return F.replace(text, F.lit("{n}"), F.col("__n").cast("string"))


def segment_labels(
    segments: DataFrame, keys: list[str], output: str = "path", content_col: str = "content", wording: Wording | None = None
) -> DataFrame:
    """Position ``k`` (1-based), total ``n``, role (only/first/middle/last) and the wrapped text."""
    say = wording or Wording()
    totals = segments.groupBy(*[F.col(k).alias(f"__t_{k}") for k in keys]).agg(F.count(F.lit(1)).cast("long").alias("__n"))
    same = reduce(lambda a, b: a & b, [segments[k].eqNullSafe(totals[f"__t_{k}"]) for k in keys])
    s = segments.join(totals, same).withColumn("__k", F.col("seg") + 1)
    role = (
        F.when(F.col("__n") == 1, F.lit("only"))
        .when(F.col("__k") == 1, F.lit("first"))
        .when(F.col("__k") == F.col("__n"), F.lit("last"))
        .otherwise(F.lit("middle"))
    )
    only = (say.code_start, say.code_end) if output == "code" else (say.path_start, say.path_end)
    start = (
        F.when(F.col("__k") == 1, _fill(say.first_start))
        .when(F.col("__k") == F.col("__n"), _fill(say.last_start))
        .otherwise(_fill(say.middle_start))
    )
    c = F.col(content_col)
    wrapped = F.when(F.col("__n") == 1, F.concat(F.lit(only[0]), c, F.lit(only[1]))).otherwise(F.concat(start, c, _fill(say.segment_end)))
    return s.select(
        *segments.columns, F.col("__k").alias("k"), F.col("__n").alias("n"), role.alias("role"), wrapped.alias("wrapped")
    )


def oversize_flag(items: DataFrame, max_token: int | None, max_char: int | None, with_prompt: bool = False,
                  token_col: str = "token", char_col: str = "chars", content_col: str = "content") -> DataFrame:
    """Items that alone exceed a limit, with their title line (second line of the content)."""
    mt, mc = effective_limits(max_token, max_char, with_prompt)
    over = ((F.lit(mt) != 0) & (F.lit(mt) < F.col(token_col))) | ((F.lit(mc) != 0) & (F.lit(mc) < F.col(char_col)))
    return items.withColumn("oversize", over).withColumn(
        "title_line", F.element_at(F.split(F.col(content_col), "\n", -1), 2)
    )
