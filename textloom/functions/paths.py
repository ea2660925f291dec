"""Path scalars: extension, language, absolute/relative forms, segments, module names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import _c

# Extension sets per program type.
PYTHON_EXTS = (".py",)
JAVASCRIPT_EXTS = (".js", ".json", ".jsx", ".ts", ".tsx")
# Default extensions kept by the corpus scan.
DEFAULT_EXTENSIONS = (".py", ".js", ".json", ".jsx", ".ts", ".tsx")
# Default directory names pruned by the corpus scan (the misspelt cache name is kept as a
# fixed value; the correct spelling is added by ``ignore_dirs`` below).
DEFAULT_IGNORE_DIRS = (
    "__pycashe__",
    "node_modules",
    "cypress",
    "coverage",
    ".next",
    ".devcontainer",
    ".storybook",
    ".swc",
    ".vscode",
    ".mypy_cache",
)
EXTRA_IGNORE_DIRS = ("__pycache__",)


def basename(path) -> Column:
    return F.regexp_extract(_c(path), r"[^/]*$", 0)


def dirname(path) -> Column:
    """``os.path.dirname``: everything before the last ``/`` (``/`` kept for the root)."""
    p = _c(path)
    d = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.when(~p.contains("/"), F.lit("")).when(d == "", F.lit("/")).otherwise(d)


def file_ext(path) -> Column:
    """``os.path.splitext(path)[1]``: last dot of the file name, leading dots ignored."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def program_type(path) -> Column:
    ext = file_ext(path)
    return (
        F.when(ext.isin(*PYTHON_EXTS), F.lit("PYTHON"))
        .when(ext.isin(*JAVASCRIPT_EXTS), F.lit("JAVASCRIPT"))
        .otherwise(F.lit("UNKNOWN"))
    )


def ext_filter(path, extensions=DEFAULT_EXTENSIONS) -> Column:
    """``path.endswith(extensions)``."""
    p = _c(path)
    cond = F.lit(False)
    for e in extensions:
        cond = cond | p.endswith(e)
    return cond


def dir_segments(path, root: str = "") -> Column:
    """Directory names between ``root`` and the file name (the file name itself excluded)."""
    p = _c(path)
    rel = F.when(F.lit(root != "") & p.startswith(root.rstrip("/") + "/"), F.substring(p, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(p)
    parts = F.split(rel, "/", -1)
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")


def not_in_ignored_dir(path, root: str = "", ignore_dirs=DEFAULT_IGNORE_DIRS + EXTRA_IGNORE_DIRS) -> Column:
    return ~F.arrays_overlap(dir_segments(path, root), F.array(*[F.lit(d) for d in ignore_dirs]))


def abs_path(root, path) -> Column:
    """Absolute path passes; otherwise ``os.path.join(root, path)``."""
    r, p = _c(root), _c(path)
    joined = F.when(r == "", p).when(r.endswith("/"), F.concat(r, p)).otherwise(F.concat(r, F.lit("/"), p))
    return F.when(p.startswith("/"), p).otherwise(joined)


def _norm_segments(path: Column) -> Column:
    """Segments of a normalized absolute path (empties and ``.`` dropped, ``..`` folded)."""
    parts = F.filter(F.split(path, "/", -1), lambda x: (x != "") & (x != "."))
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(x))
        ),
    )


def rel_path(root, path) -> Column:
    """Relative path passes; otherwise ``os.path.relpath(path, root)`` (may start with ``..``)."""
    r, p = _c(root), _c(path)
    rs, ps = _norm_segments(r), _norm_segments(p)
    # length of the common segment prefix
    common = F.aggregate(
        F.sequence(F.lit(1), F.least(F.size(rs), F.size(ps)) + 1),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("same")),
        lambda acc, i: F.when(
            acc["same"] & (i <= F.least(F.size(rs), F.size(ps))) & (F.element_at(rs, F.greatest(i, F.lit(1))) == F.element_at(ps, F.greatest(i, F.lit(1)))),
            F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("same")),
        ).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("same"))),
    )["n"]
    ups = F.array_repeat(F.lit(".."), F.size(rs) - common)
    rest = F.slice(ps, common + 1, F.greatest(F.size(ps) - common, F.lit(0)))
    joined = F.array_join(F.concat(ups, rest), "/")
    rel = F.when(joined == "", F.lit(".")).otherwise(joined)
    return F.when(~p.startswith("/"), p).otherwise(rel)


def rel_below(root: str, path) -> Column:
    """Fast form of :func:`rel_path` for paths known to lie below ``root``."""
    p = _c(path)
    r = root.rstrip("/")
    if not r:
        return F.regexp_replace(p, r"^/+", "")
    return F.when(p.startswith(r + "/"), F.substring(p, len(r) + 2, 1 << 30)).otherwise(p)


def module_to_path(module) -> Column:
    """``a.b.c`` → ``a/b/c.py``."""
    return F.concat(F.translate(_c(module), ".", "/"), F.lit(".py"))


def path_to_module(path) -> Column:
    """``a/b/c.py`` → ``a.b.c`` (suffix always stripped; leading dot removed)."""
    p = _c(path)
    stem = F.when(file_ext(p) != "", F.regexp_replace(p, r"\.[^./]*$", "")).otherwise(p)
    dotted = F.translate(stem, "/", ".")
    return F.regexp_replace(dotted, r"^\.", "")


def path_segments(path, root: str | None = None) -> Column:
    """Segments relative to the parent of ``root`` (when the path lies under ``root``)."""
    p = _c(path)
    if root:
        parent = root.rstrip("/").rsplit("/", 1)[0] if "/" in root.rstrip("/") else ""
        rel = F.when(p.startswith(root), rel_path(F.lit(parent or "/"), p)).otherwise(p)
    else:
        rel = p
    return F.filter(F.split(rel, "/", -1), lambda x: x != "")
