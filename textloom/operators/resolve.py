"""Module resolution joins: imports → file paths (Python absolute/relative, JS/TS by
extension priority, package expansion) and literal-prefix containment.

Lookups are equi-joins against the file table, containment goes through sorted ranges; nothing probes a
file system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.paths import JAVASCRIPT_EXTS, dirname
from textloom.operators.prefixes import prefix_pairs
from textloom.session import cut_lineage

# Fixed value: extension priority when resolving JS/TS imports (first hit wins).
JS_RESOLVE_ORDER = JAVASCRIPT_EXTS
# Imports and files that one piece of a package's expansion joins on average, and the most tasks of it.
PIECE = 1 << 10
PIECE_TASKS = 10_000


def _join_root(root: str, rel) -> F.Column:
    if not root:
        return rel
    return F.concat(F.lit(root.rstrip("/") + "/"), rel)


def _rel_dir_module(root: str, base_dir) -> F.Column:
    """Package name of a folder: its path relative to ``root`` with '/' → '.'."""
    r = root.rstrip("/")
    rel = F.when(F.lit(bool(r)) & base_dir.startswith(r + "/"), F.substring(base_dir, len(r) + 2, 1 << 30)).when(
        F.lit(bool(r)) & (base_dir == r), F.lit(".")
    ).otherwise(base_dir)
    return F.translate(rel, "/", ".")


def absolute_modules(py_imports: DataFrame, root: str = "") -> DataFrame:
    """Relative imports climb ``level`` folders from the importing file (D3) and become
    absolute module names; absolute imports pass."""
    segs = F.split(F.col("src"), "/", -1)
    base = F.array_join(F.slice(segs, 1, F.greatest(F.size(segs) - F.col("level"), F.lit(0))), "/")
    pkg = _rel_dir_module(root, base)
    mod = F.when(F.col("level") > 0, F.concat(pkg, F.lit("."), F.col("module"))).otherwise(F.col("module"))
    return py_imports.withColumn("abs_module", mod)


def resolve_py(py_imports: DataFrame, files: DataFrame, root: str = "", expand_packages: bool = True,
               keep_unresolved: bool = False) -> DataFrame:
    """``(src, pos, module, dst)``: module ``a.b.c`` → ``root/a/b/c.py`` when that file is in
    the set (D1, D3). With ``expand_packages`` a module naming a folder resolves to the
    ``.py`` files directly inside it (D4, decided from the file table). Unresolved imports are
    dropped, or kept with ``dst = null`` when ``keep_unresolved``."""
    m = cut_lineage(absolute_modules(py_imports, root))  # parsed once
    # each module is looked up once, however many imports name it
    mods = m.groupBy("abs_module").agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", _join_root(root, F.translate("abs_module", ".", "/")))
    py = files.where(F.col("path").endswith(".py")).select(F.col("path").alias("dst"))
    direct = mods.join(py.withColumn("__base", F.expr("substr(dst, 1, length(dst) - 3)")), "__base").select("abs_module", "dst")
    out = m.join(direct, "abs_module", "left" if keep_unresolved else "inner").select(*m.columns, "dst")
    if not expand_packages:
        return out
    children = py.withColumn("__base", dirname("dst"))
    lost = mods.join(direct.select("abs_module").distinct(), "abs_module", "left_anti")
    sizes = lost.join(children.groupBy("__base").agg(F.count(F.lit(1)).alias("__files")), "__base")
    packages = cut_lineage(sizes.select("abs_module", "__base", F.ceil(F.col("__n") / PIECE).alias("__rows"), F.ceil(F.col("__files") / PIECE).alias("__cols")))
    pieces = packages.agg(F.sum(F.col("__rows") * F.col("__cols"))).first()[0]
    if pieces is None:  # no module names a folder
        return out
    return out.join(packages.select("abs_module"), "abs_module", "left_anti").select(*out.columns).unionByName(_expanded(m, packages, children, pieces))


def _expanded(m: DataFrame, packages: DataFrame, children: DataFrame, pieces: int) -> DataFrame:
    """Every import of a package with every file in its folder. Both are dealt by a hash into pieces of a grid, so that a
    popular package spreads over tasks; an import moves once for each column of its package, a file once for each row."""
    at = ["abs_module", "__row", "__col"]
    tasks = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(pieces), PIECE_TASKS))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt = lambda by, c: F.pmod(F.xxhash64(*by), F.col(c))
    left = m.join(packages, "abs_module").select(*m.columns, dealt(["src", "pos"], "__rows").alias("__row"), upto("__cols").alias("__col"))
    right = children.join(packages, "__base").select("abs_module", "dst", dealt(["dst"], "__cols").alias("__col"), upto("__rows").alias("__row"))
    return left.repartition(tasks, *at).join(right.repartition(tasks, *at), at).select(*m.columns, "dst")


def resolve_js(js_imports: DataFrame, files: DataFrame, root: str = "", keep_unresolved: bool = False) -> DataFrame:
    """``(src, pos, module, dst)``: try ``root/module`` + ``.js .json .jsx .ts .tsx``; the first
    extension that exists wins (D2)."""
    exts = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("ext")) for i, e in enumerate(JS_RESOLVE_ORDER)])
    base = js_imports.withColumn("__base", _join_root(root, F.col("module")))
    cand = base.select("*", F.explode(exts).alias("__e")).withColumn("__cand", F.concat("__base", F.col("__e.ext")))
    fp = files.select(F.col("path").alias("__p"))
    hit = cand.join(fp, cand["__cand"] == fp["__p"], "inner")
    best = hit.groupBy("src", "pos", "module").agg(F.min_by("__p", F.col("__e.rank")).alias("dst"))
    if keep_unresolved:
        return js_imports.join(best, ["src", "pos", "module"], "left")
    return best


def contains_expand(frontier: DataFrame, files: DataFrame, node_col: str = "node", keys: list[str] | None = None) -> DataFrame:
    """Files whose path has a frontier node as a proper string prefix (D5, literal semantics:
    ``a.ts`` also pulls ``a.tsx``, ``dir`` also pulls ``dir2/x``), by sorted ranges
    (:mod:`textloom.operators.prefixes`). Returns ``(keys..., node, path)``."""
    nodes = frontier.select(*(keys or []), F.col(node_col).alias("node")).distinct()
    found = prefix_pairs(nodes.select(F.col("node").alias("prefix")), files.select(F.col("path").alias("value")), proper=True)
    found = found.select(F.col("prefix").alias("node"), F.col("value").alias("path"))
    return nodes.join(found, "node").select(*keys, "node", "path") if keys else found
