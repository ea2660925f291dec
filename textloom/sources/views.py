"""Derived views over the driver tables.

Each view exists twice with the same meaning: a DataFrame builder (what the jobs use) and
the SQL text used inside oracle queries (DuckDB gets only the base tables, so oracles inline
these as CTEs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import table


def _s(c) -> F.Column:
    return c.cast("string")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic code tree from ``documents``: 3/4 Python, 1/4 TypeScript files that carry the
    documents' whole texts in a docstring or comment. Their imports form tree edges 2i+1, 2i+2, a
    back edge i/3 (cycles), relative and dangling modules; their classes inherit through imported
    names, share names between files, and hold fields, methods, enum members and exceptions."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    nl, q = F.lit("\n"), F.lit("'")

    def mod(x):
        return F.concat(F.lit("pkg_"), _s(x % 5), F.lit("/sub_"), _s(x % 3), F.lit("/mod_"), _s(x))

    def dotted(x):
        return F.concat(F.lit("pkg_"), _s(x % 5), F.lit(".sub_"), _s(x % 3), F.lit(".mod_"), _s(x))

    third = F.floor(i / 3).cast("long")
    is_ts = (i % 4) == 3
    body = F.translate(F.coalesce("text", F.lit("")), "\\\"'*", "")
    ts = F.concat(
        F.lit("/* file "), _s(i), nl, body, F.lit(" */"), nl,
        F.lit("import { a } from "), q, F.lit("@/"), mod(2 * i + 1), q, F.lit(";"), nl,
        F.lit("import { z } from "), q, F.lit("external"), q, F.lit(";"), nl,
        F.lit("// note "), _s(i), nl,
    )
    py = F.concat(
        F.lit('"""File '), _s(i), nl, body, F.lit('"""'), nl,
        F.lit("import os\nimport enum"), nl,
        F.lit("from "), dotted(2 * i + 1), F.lit(" import a"), nl,
        F.lit("from "), dotted(2 * i + 2), F.lit(" import b"), nl,
        F.lit("from "), dotted(third), F.lit(" import c"), nl,
        F.when((i % 7) == 0, F.concat(F.lit("from missing_"), _s(i), F.lit(" import d"), nl)).otherwise(F.lit("")),
        F.when((i % 6) == 1, F.concat(F.lit("from .mod_"), _s(i + 15), F.lit(" import z"), nl)).otherwise(F.lit("")),
        F.lit("from "), dotted(third), F.lit(" import Thing"), _s(third), F.lit(" as Parent"), nl,
        F.lit("# note "), _s(i), nl,
        F.lit("class Thing"), _s(i), F.lit("("), F.when((i % 5) == 0, F.concat(F.lit("Base"), _s(i % 4))).otherwise(F.lit("Parent")), F.lit("):"), nl,
        F.lit("    size: "), F.when((i % 2) == 0, F.lit("int")).otherwise(F.lit("float")), nl,
        F.lit("    parts: list[Config]\n    near: Parent | None\n    def run(self, n: int = 1): ...\n    def _hidden(self): ...\n"),
        F.when((i % 2) == 1, F.concat(F.lit("    def only_"), _s(i), F.lit("(self): ..."), nl)).otherwise(F.lit("")),
        F.lit("class Config:\n    name: str\n    owner: Thing"), _s(i), nl,
        F.lit("class Color"), _s(i), F.lit("(enum.Enum):\n    RED = 1\n    NAME = 'x'\n"),
        F.lit("class Error"), _s(i), F.lit("(ValueError):\n    pass\n"),
        F.lit("class Oops"), _s(i), F.lit("(Error"), _s(i), F.lit("):\n    pass\n"),
    )
    return d.select(
        "doc_id",
        F.concat(mod(i), F.when(is_ts, F.lit(".ts")).otherwise(F.lit(".py"))).alias("path"),
        F.when(is_ts, ts).otherwise(py).alias("content"),
    )


def code_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the code tree: files that were not there yet, others with another note, and some that
    have gone since."""
    f, i = code_files(spark, sf_dir), F.col("doc_id")
    kept = f.where(i % 11 != 0).select(
        "path", F.when(i % 10 == 1, F.replace("content", F.lit("note "), F.lit("earlier note "))).otherwise(F.col("content")).alias("content")
    )
    return kept.unionByName(f.where(i % 13 == 0).select(F.concat(F.lit("gone/"), "path").alias("path"), "content"))


def snap_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("doc_id") % 11 != 0).select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), _s(F.col("doc_id")), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )


def snap_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i, text = F.col("doc_id"), F.col("text")
    several = text.contains("\n")
    last, first = F.substring_index(text, "\n", -1), F.substring_index(text, "\n", 1)
    but_last = F.when(several, F.substring(text, F.lit(1), F.length(text) - F.length(last) - 1)).otherwise(text)
    but_first = F.when(several, F.substring(text, F.length(first) + 2, F.length(text))).otherwise(text)
    return d.where(i % 13 != 0).select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), _s(i), F.lit(".txt")).alias("path"),
        F.when(i % 5 == 0, F.concat(text, F.lit("\nedited")))
        .when(i % 5 == 1, but_last)
        .when(i % 5 == 2, F.concat(text, F.lit("\n"), last))
        .when(i % 10 == 3, F.array_join(F.reverse(F.split(text, "\n", -1)), "\n"))
        .when(i % 20 == 8, F.concat(but_first, F.lit("\n"), first))
        .otherwise(text).alias("content"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    f = "```"
    one = F.concat(F.col("text"), F.lit(f"\n{f}python\nx = "), _s(i), F.lit("\n"), F.col("text"), F.lit(f"\n{f}\n"))
    two = F.concat(F.lit(f"{f}\na\n{f}\n"), F.col("text"), F.lit(f"\n{f}ts\n b "), _s(i), F.lit(f"\n{f}"))
    return d.select(
        "doc_id",
        F.when(i % 3 == 0, F.col("text")).when(i % 3 == 1, one).otherwise(two).alias("text"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("answer_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("text"),
        F.when(F.col("event_type") == "error", F.lit("length"))
        .when(F.col("event_id") % 10 == 0, F.lit("stop"))
        .alias("finish_reason"),
    )


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        ((i % 2) == 0).alias("has_diff"),
        (i % 3).alias("exit_code"),
        F.when(i % 5 == 0, F.lit("")).when(i % 5 == 1, F.lit("assert x"))
        .otherwise(F.concat(F.lit("def test_"), _s(i), F.lit("():\n"), F.col("text"))).alias("test_code"),
        (i % 2 + 1).alias("round"),
    )


# ----------------------------------------------------------------- SQL text (DuckDB CTEs)

SQL_CODE_FILES = """code_files AS (
SELECT doc_id,
       'pkg_' || (doc_id % 5) || '/sub_' || (doc_id % 3) || '/mod_' || doc_id
         || CASE WHEN doc_id % 4 = 3 THEN '.ts' ELSE '.py' END AS path,
       CASE WHEN doc_id % 4 = 3 THEN
         '/* file ' || doc_id || chr(10) || body || ' */' || chr(10)
         || 'import { a } from ' || chr(39) || '@/pkg_' || ((2*doc_id+1) % 5) || '/sub_' || ((2*doc_id+1) % 3) || '/mod_' || (2*doc_id+1) || chr(39) || ';' || chr(10)
         || 'import { z } from ' || chr(39) || 'external' || chr(39) || ';' || chr(10)
         || '// note ' || doc_id || chr(10)
       ELSE
         repeat(chr(34),3) || 'File ' || doc_id || chr(10) || body || repeat(chr(34),3) || chr(10)
         || 'import os' || chr(10) || 'import enum' || chr(10)
         || 'from pkg_' || ((2*doc_id+1) % 5) || '.sub_' || ((2*doc_id+1) % 3) || '.mod_' || (2*doc_id+1) || ' import a' || chr(10)
         || 'from pkg_' || ((2*doc_id+2) % 5) || '.sub_' || ((2*doc_id+2) % 3) || '.mod_' || (2*doc_id+2) || ' import b' || chr(10)
         || 'from pkg_' || (CAST(floor(doc_id/3.0) AS BIGINT) % 5) || '.sub_' || (CAST(floor(doc_id/3.0) AS BIGINT) % 3) || '.mod_' || CAST(floor(doc_id/3.0) AS BIGINT) || ' import c' || chr(10)
         || CASE WHEN doc_id % 7 = 0 THEN 'from missing_' || doc_id || ' import d' || chr(10) ELSE '' END
         || CASE WHEN doc_id % 6 = 1 THEN 'from .mod_' || (doc_id + 15) || ' import z' || chr(10) ELSE '' END
         || 'from pkg_' || ((doc_id // 3) % 5) || '.sub_' || ((doc_id // 3) % 3) || '.mod_' || (doc_id // 3) || ' import Thing' || (doc_id // 3) || ' as Parent' || chr(10)
         || '# note ' || doc_id || chr(10)
         || 'class Thing' || doc_id || '(' || CASE WHEN doc_id % 5 = 0 THEN 'Base' || (doc_id % 4) ELSE 'Parent' END || '):' || chr(10)
         || '    size: ' || CASE WHEN doc_id % 2 = 0 THEN 'int' ELSE 'float' END || chr(10)
         || '    parts: list[Config]' || chr(10) || '    near: Parent | None' || chr(10) || '    def run(self, n: int = 1): ...' || chr(10) || '    def _hidden(self): ...' || chr(10)
         || CASE WHEN doc_id % 2 = 1 THEN '    def only_' || doc_id || '(self): ...' || chr(10) ELSE '' END
         || 'class Config:' || chr(10) || '    name: str' || chr(10) || '    owner: Thing' || doc_id || chr(10)
         || 'class Color' || doc_id || '(enum.Enum):' || chr(10) || '    RED = 1' || chr(10) || '    NAME = ' || chr(39) || 'x' || chr(39) || chr(10)
         || 'class Error' || doc_id || '(ValueError):' || chr(10) || '    pass' || chr(10)
         || 'class Oops' || doc_id || '(Error' || doc_id || '):' || chr(10) || '    pass' || chr(10)
       END AS content
FROM (SELECT doc_id, translate(coalesce(text, ''), '\\"''*', '') AS body FROM documents))"""

SQL_CODE_OLD = """snap_old AS (
SELECT path, CASE WHEN doc_id % 10 = 1 THEN replace(content, 'note ', 'earlier note ') ELSE content END AS content FROM code_files WHERE doc_id % 11 <> 0
UNION ALL SELECT 'gone/' || path, content FROM code_files WHERE doc_id % 13 = 0)"""

SQL_SNAP_OLD = """snap_old AS (
SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content FROM documents WHERE doc_id % 11 <> 0)"""

SQL_SNAP_NEW = """snap_new AS (
SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path,
       CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'edited'
            WHEN doc_id % 5 = 1 THEN regexp_replace(text, '\n[^\n]*$', '')
            WHEN doc_id % 5 = 2 THEN text || chr(10) || regexp_extract(text, '[^\n]*$')
            WHEN doc_id % 10 = 3 THEN array_to_string(list_reverse(string_split(text, chr(10))), chr(10))
            WHEN doc_id % 20 = 8 THEN regexp_replace(text, '^[^\n]*\n', '') || chr(10) || regexp_extract(text, '^[^\n]*') ELSE text END AS content
FROM documents WHERE doc_id % 13 <> 0)"""

SQL_ANSWERS = """answers AS (
SELECT doc_id,
       CASE WHEN doc_id % 3 = 0 THEN text
            WHEN doc_id % 3 = 1 THEN text || chr(10) || repeat(chr(96),3) || 'python' || chr(10) || 'x = ' || doc_id || chr(10) || text || chr(10) || repeat(chr(96),3) || chr(10)
            ELSE repeat(chr(96),3) || chr(10) || 'a' || chr(10) || repeat(chr(96),3) || chr(10) || text || chr(10) || repeat(chr(96),3) || 'ts' || chr(10) || ' b ' || doc_id || chr(10) || repeat(chr(96),3)
       END AS text
FROM documents)"""

SQL_CHUNKS = """chunks AS (
SELECT user_id AS answer_id, event_id AS seq, event_type AS text,
       CASE WHEN event_type = 'error' THEN 'length' WHEN event_id % 10 = 0 THEN 'stop' END AS finish_reason
FROM events)"""

SQL_WORK = """work AS (
SELECT doc_id, doc_id % 2 = 0 AS has_diff, doc_id % 3 AS exit_code,
       CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'assert x'
            ELSE 'def test_' || doc_id || '():' || chr(10) || text END AS test_code, doc_id % 2 + 1 AS round FROM documents)"""
