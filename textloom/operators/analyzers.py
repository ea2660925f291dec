"""Analyzers of source files by language: how imports are found in a text and which file each leads to.

An analyzer is registered once for a language and its extensions; closures, reports and collectors
then follow its imports like those of the languages that are there from the start. Files of a language
without an analyzer have no imports.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.code import js_imports, parsed_imports
from textloom.functions.paths import JAVASCRIPT_EXTS, PYTHON_EXTS, file_ext
from textloom.operators.resolve import resolve_js, resolve_py


@dataclass(frozen=True)
class Analyzer:
    """``imports(files(path, content))`` gives ``(src, pos, module, ...)``; ``resolve(imports, files, root)`` gives
    ``(src, pos, name, dst)``, a row for each import at least, with a null ``dst`` where no file is found."""

    lang: str
    extensions: tuple[str, ...]
    imports: Callable[[DataFrame], DataFrame]
    resolve: Callable[[DataFrame, DataFrame, str], DataFrame]

    def edges(self, files: DataFrame, root: str = "") -> DataFrame:
        """All imports of this language's files, ``src, pos, name, dst``."""
        own = files.where(file_ext("path").isin(*self.extensions))
        return self.resolve(self.imports(own), files, root).select("src", F.col("pos").cast("long").alias("pos"), "name", "dst")


def _python(imports: DataFrame, files: DataFrame, root: str) -> DataFrame:
    return resolve_py(imports, files, root, keep_unresolved=True).withColumnRenamed("abs_module", "name")


def _javascript(imports: DataFrame, files: DataFrame, root: str) -> DataFrame:
    return resolve_js(imports, files, root, keep_unresolved=True).withColumnRenamed("module", "name")


ANALYZERS: dict[str, Analyzer] = {
    "PYTHON": Analyzer("PYTHON", PYTHON_EXTS, parsed_imports, _python),
    "JAVASCRIPT": Analyzer("JAVASCRIPT", JAVASCRIPT_EXTS, js_imports, _javascript),
}


def register_analyzer(analyzer: Analyzer) -> None:
    """Add an analyzer, or put another in the place of the one of its language. An extension belongs to one
    language only."""
    for other in ANALYZERS.values():
        if other.lang != analyzer.lang and set(other.extensions) & set(analyzer.extensions):
            raise ValueError(f"{set(other.extensions) & set(analyzer.extensions)} belong to {other.lang}")
    ANALYZERS[analyzer.lang] = analyzer


def by_columns(
    lang: str, extensions: tuple[str, ...], targets: Callable[[Column], Column], candidates: Callable[[Column, Column], Column]
) -> Analyzer:
    """An analyzer in column functions: ``targets(content)`` is the array of the names that a text imports, in order,
    and ``candidates(src, name)`` the array of the paths, relative to the root, that a name can stand for;
    the first that is a file wins. A null array has no entries."""

    def imports(files: DataFrame) -> DataFrame:
        return files.select(F.col("path").alias("src"), F.posexplode(targets(F.col("content"))).alias("pos", "module"))

    def resolve(found: DataFrame, files: DataFrame, root: str) -> DataFrame:
        stem = F.lit(root.rstrip("/") + "/" if root else "")
        tried = found.select("src", "pos", "module", F.posexplode_outer(candidates(F.col("src"), F.col("module"))).alias("rank", "path"))
        there = files.select(F.col("path").alias("there")).distinct()
        met = tried.join(there, F.concat(stem, F.col("path")) == F.col("there"), "left")
        first = F.min_by("there", F.when(F.col("there").isNotNull(), F.col("rank")))
        return met.groupBy("src", "pos", "module").agg(first.alias("dst")).withColumnRenamed("module", "name")

    return Analyzer(lang, extensions, imports, resolve)


def all_imports(files: DataFrame, root: str = "") -> DataFrame:
    """``src, pos, name, dst`` of every import that an analyzer finds; ``dst`` is null where it leads to no file."""
    return reduce(DataFrame.unionByName, [a.edges(files, root) for a in ANALYZERS.values()])


def file_edges(files: DataFrame, root: str = "") -> DataFrame:
    """Resolved import edges ``(src, pos, dst)`` of any ``files(path, content)`` table."""
    return all_imports(files, root).where("dst is not null").select("src", "pos", "dst")
