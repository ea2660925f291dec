"""Import extraction from source text.

Native (regex) forms run JVM-side; the ``ast`` form runs Python's parser per file inside
``mapInArrow`` and is exact for Python (nested imports, no false hits inside strings).
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import _c

# Fixed patterns.
# JS/TS: one-line ``import ... from '<m>'`` / ``export ... from '<m>'``.
JS_IMPORT_RE = r"(?:import [^\n]* from|export [^\n]* from) ['\"](@?[^'\"]+)['\"]"
# Python: ``from <dots><module> import`` at the start of a line (any indentation).
PY_FROM_RE = r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import\b"


def js_import_targets(content) -> Column:
    """Alias targets (``@/...``) with the leading ``@`` and ``/`` characters stripped, in order."""
    found = F.regexp_extract_all(_c(content), F.lit(JS_IMPORT_RE), 1)
    kept = F.filter(found, lambda m: m.startswith("@/"))
    return F.transform(kept, lambda m: F.regexp_replace(m, r"^[@/]+", ""))


def py_from_modules(content) -> Column:
    """``from X import`` module strings (leading dots kept), in text order."""
    return F.regexp_extract_all(_c(content), F.lit(PY_FROM_RE), 1)


def js_imports(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``(src, pos, module)`` for JS/TS alias imports."""
    ex = files.select(F.col(path_col).alias("src"), F.posexplode(js_import_targets(content_col)).alias("pos", "module"))
    return ex.select("src", F.col("pos").cast("long").alias("pos"), "module")


def py_imports(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``(src, pos, level, module)`` for ``from`` imports by pattern, for text that no parser reads."""
    ex = files.select(F.col(path_col).alias("src"), F.posexplode(py_from_modules(content_col)).alias("pos", "raw"))
    return ex.select(
        "src", F.col("pos").cast("long").alias("pos"),
        F.length(F.regexp_extract("raw", r"^(\.*)", 1)).alias("level"),
        F.regexp_replace("raw", r"^\.+", "").alias("module"),
    )


PY_IMPORT_SCHEMA = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("module", T.StringType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)
PARSED_ROWS = 1 << 12  # rows that a task holds before it hands them on
_ARROW = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.ArrayType(T.StringType()): pa.list_(pa.string())}


def parse_files(
    batches: Iterator[pa.RecordBatch], parse: Callable[[str, str], list[tuple]], schema: T.StructType
) -> Iterator[pa.RecordBatch]:
    """Rows of ``schema`` that ``parse(path, text)`` gives for each file of ``batches(path, content)``. Files are taken out
    of their batch one by one and rows go on in small batches, so that a task's memory does not follow the size of its batches."""
    types, rows = [_ARROW[f.dataType] for f in schema], []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.fieldNames())
    for batch in batches:
        for path, code in zip(batch.column(0), batch.column(1)):
            if code.is_valid:
                rows += parse(path.as_py(), code.as_py())
            if len(rows) >= PARSED_ROWS:
                yield made()
                rows = []
    if rows:
        yield made()


def parsed_imports(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``(src, pos, level, module)`` of the files that parse, in the order of the syntax tree."""
    rows = py_imports_ast(files, path_col, content_col).where(F.col("error").isNull())
    return rows.select("src", F.col("pos").cast("long").alias("pos"), "level", "module")


def py_imports_ast(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Exact ``from`` imports in AST walk order (nested ones too). A file that does not parse
    yields one row with ``error`` set instead of failing the job."""

    return files.select(path_col, content_col).mapInArrow(lambda batches: parse_files(batches, _from_imports, PY_IMPORT_SCHEMA), PY_IMPORT_SCHEMA)


def _from_imports(src: str, code: str) -> list[tuple]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return [(src, -1, 0, None, None, f"{type(e).__name__}: {e}")]
    found = (n for n in ast.walk(tree) if isinstance(n, ast.ImportFrom))
    return [(src, pos, n.level, n.module or "", [a.name for a in n.names], None) for pos, n in enumerate(found)]
