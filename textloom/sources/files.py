"""File-tree sources (corpus scan, whole-file text) and page tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.paths import DEFAULT_EXTENSIONS, DEFAULT_IGNORE_DIRS, EXTRA_IGNORE_DIRS, ext_filter, not_in_ignored_dir, program_type
from textloom.operators.predicates import ignore_filter, scope_filter
from textloom.session import ensure_checkpoint_dir
from textloom.sources.file_tree import file_system, file_tree


def land_files(files: DataFrame) -> str:
    """Write ``files(path, content)`` as files below a new folder of the shared checkpoint folder; its root."""
    import uuid

    root = f"{ensure_checkpoint_dir(files.sparkSession).rstrip('/')}/files/{uuid.uuid4().hex}"
    base = root if ":" in root else f"file:{root}"

    def write(batches):
        import pandas as pd

        cache: dict = {}
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                fs, at = file_system(f"{base}/{path}", cache)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(at) as h:
                    h.write((content or "").encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return root


def below(root: str, path) -> Column:
    """A listed path relative to its root."""
    stem = re.sub(r"^file:(//)?", "", root).rstrip("/") + "/"
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p.startswith(stem), p.substr(F.lit(len(stem) + 1), F.length(p))).otherwise(p)


def corpus_scan(
    spark: SparkSession,
    root: str,
    scope_paths: list[str] | None = None,
    ignore_paths: list[str] | None = None,
    ignore_dirs=None,
    extensions=DEFAULT_EXTENSIONS,
    with_content: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Recursive listing under ``root`` → ``files(path, size, lang[, content, error])``, read through the
    ``filetree`` source.

    Extension, ignored-folder, scope and ignore predicates keep folders from being walked and files from
    being opened; contents are decoded as UTF-8 with replacement (bad bytes never fail the job), and a file that
    cannot be read has a null content and says why in ``error``."""
    root = root.rstrip("/") or "/"
    at = re.sub(r"^file:(//)?", "", root)
    skipped = (DEFAULT_IGNORE_DIRS + EXTRA_IGNORE_DIRS) if ignore_dirs is None else tuple(ignore_dirs)
    tree = file_tree(
        spark, root, content=str(with_content).lower(), extensions=extensions or None, ignoreDirs=skipped or None,
        scope=[_abs(at, p) for p in scope_paths] if scope_paths else None,
        ignore=[_abs(at, p) for p in ignore_paths] if ignore_paths else None, partitions=partitions,
    )
    return corpus_filter(tree, at, scope_paths, ignore_paths, ignore_dirs, extensions).drop("modified")


def corpus_filter(
    files: DataFrame,
    root: str = "",
    scope_paths: list[str] | None = None,
    ignore_paths: list[str] | None = None,
    ignore_dirs=None,
    extensions=DEFAULT_EXTENSIONS,
) -> DataFrame:
    """Apply the scan's predicates to an existing ``files`` table (extension, ignored
    directory names below ``root``, scope prefixes, ignore prefixes)."""
    out = files
    if extensions:
        out = out.where(ext_filter("path", extensions))
    if ignore_dirs is None:
        out = out.where(not_in_ignored_dir("path", root))
    elif ignore_dirs:
        out = out.where(not_in_ignored_dir("path", root, tuple(ignore_dirs)))
    if scope_paths:
        out = scope_filter(out, "path", [_abs(root, p) for p in scope_paths])
    if ignore_paths:
        out = ignore_filter(out, "path", [_abs(root, p) for p in ignore_paths])
    return out.withColumn("lang", program_type("path"))


def _abs(root: str, p: str) -> str:
    if p.startswith("/") or not root:
        return p
    return root.rstrip("/") + "/" + p.lstrip("/")


def file_text(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` as one row of text with its path, whatever its name or length, and why it could
    not be read where it could not: ``path, content, error``."""
    return corpus_scan(spark, root, ignore_dirs=(), extensions=()).select("path", "content", "error")


def page_source(pages: DataFrame) -> DataFrame:
    """Landed pages; rows with a non-200 status are dropped when a status column exists."""
    if "status" in pages.columns:
        pages = pages.where(F.col("status") == 200)
    return pages
