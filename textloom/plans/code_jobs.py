"""Code-tree jobs: listing predicates, path scalars, import extraction and resolution,
dependency closures, and the import-collector job (closure → tree → contents → packing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import sqltext as Q
from textloom.functions.code import js_imports, parsed_imports
from textloom.functions.paths import (
    abs_path,
    dirname,
    ext_filter,
    file_ext,
    module_to_path,
    not_in_ignored_dir,
    path_segments,
    path_to_module,
    program_type,
    rel_path,
)
from textloom.functions.text import char_count, count_tokens, format_content, line_count, strip_doc, strip_js_doc, strip_py_doc
from textloom.operators.analyzers import all_imports, file_edges
from textloom.operators.closure import discovery_index, import_closure
from textloom.operators.ordered import pack_segments, segment_labels
from textloom.operators.predicates import exact_exclude, ignore_filter, scope_filter
from textloom.operators.resolve import contains_expand, resolve_js, resolve_py
from textloom.operators.tree import common_path, tree_map
from textloom.registry import register
from textloom.session import cut_lineage
from textloom.sources.files import below, corpus_scan, file_text, land_files
from textloom.sources.views import SQL_CODE_FILES, code_files

# Collector defaults and the six presets (output, no_comment, with_prompt,
# max_char, max_token).
COLLECT_DEFAULT_DEPTH = None  # until no new file appears
COLLECT_DEFAULT_MAX_CHAR = 999_999_999
COLLECT_DEFAULT_MAX_TOKEN = 125_000
PRESETS = [
    ("cursor", "path", False, False, 999_999_999, 128_000),
    ("chatgpt", "code", False, False, 999_999_999, 20_000),
    ("o1-mini", "code", False, False, 999_999_999, 128_000),
    ("gemini1.5pro", "code", False, False, 999_999_999, 2_000_000),
    ("claude", "code", False, False, 999_999_999, 100_000),
    ("dify", "code", False, False, 999_999_999, 2_000_000),
]

CLOSURE_SEED = "pkg_0/sub_0/mod_0.py"


def edges(spark: SparkSession, sf_dir: str, root: str = "") -> DataFrame:
    """Resolved import edges ``(src, pos, dst)`` of the code tree (Python and JS/TS)."""
    return file_edges(code_files(spark, sf_dir), root)


def closure_of(spark: SparkSession, sf_dir: str, seeds: DataFrame, depth: int | None = None, order: bool = False) -> DataFrame:
    files = code_files(spark, sf_dir)
    return import_closure(files.select("path"), edges(spark, sf_dir), seeds, depth, order=order)


def closure_context(files: DataFrame, changed: DataFrame, depth: int | None = 1, root: str = "") -> DataFrame:
    """``path, ord, node``: the files that each of ``changed(path)`` depends on, by its own closure over ``files``, in
    the order of a listing (last discovered first)."""
    seeds = changed.select(F.col("path").alias("seed"), F.col("path").alias("node"))
    clo = discovery_index(import_closure(files.select("path"), file_edges(files, root), seeds, depth, order=True))
    return clo.where("path <> seed").select(F.col("seed").alias("path"), "ord", F.col("path").alias("node"))


def collect_files(files: DataFrame, seeds: DataFrame, depth: int | None = COLLECT_DEFAULT_DEPTH,
                  output: str = "code", no_comment: bool = False, with_prompt: bool = False,
                  max_char: int | None = COLLECT_DEFAULT_MAX_CHAR, max_token: int | None = COLLECT_DEFAULT_MAX_TOKEN,
                  root: str = "") -> DataFrame:
    """Per seed: closure, directory tree header, formatted file contents (reverse discovery
    order), packed into segments. ``output='path'`` gives one string of paths and no packing."""
    clo = import_closure(files.select("path"), file_edges(files, root), seeds, depth, order=True)
    ordered = cut_lineage(discovery_index(clo))
    if output == "path":
        return ordered.groupBy("seed").agg(
            F.expr("listagg(path, ' ') WITHIN GROUP (ORDER BY ord)").alias("content")
        )
    body = ordered.join(files.select("path", "content"), "path").withColumn("lang", program_type("path"))
    text = strip_doc("content", "lang", enabled=no_comment)
    items = body.select("seed", F.col("ord").cast("long").alias("ord"), format_content("path", text, "code").alias("content"))
    tree = tree_map(ordered.select("seed", "path", "ord"), ["seed"], "path", "ord")
    header = tree.select("seed", F.lit(0).cast("long").alias("ord"), F.col("tree_text").alias("content"))
    all_items = header.unionByName(items).withColumn("token", count_tokens("content")).withColumn("chars", char_count("content"))
    packed = pack_segments(all_items, ["seed"], ["ord"], max_token=max_token, max_char=max_char, with_prompt=with_prompt)
    if with_prompt:
        packed = segment_labels(packed, ["seed"], output=output).withColumn("content", F.col("wrapped"))
    return packed


# --------------------------------------------------------------------------- SQL pieces

_CF = f"WITH {SQL_CODE_FILES}"
_PY_IMPORTS = f"""pyi AS (
  SELECT path AS src, unnest(generate_series(1, len(m))) - 1 AS pos, unnest(m) AS raw
  FROM (SELECT path, regexp_extract_all(content, '(?m)^[ \\t]*from[ \\t]+(\\.*[\\w.]*)[ \\t]+import\\b', 1) AS m
        FROM code_files WHERE ends_with(path, '.py'))),
pyimp AS (SELECT src, pos, CAST(length(regexp_extract(raw, '^(\\.*)', 1)) AS INTEGER) AS level, regexp_replace(raw, '^\\.+', '') AS module FROM pyi)"""
_JS_IMPORTS = f"""jsi AS (
  SELECT path AS src, unnest(generate_series(1, len(m))) - 1 AS pos, unnest(m) AS raw
  FROM (SELECT path, list_filter(regexp_extract_all(content, '(?:import [^\\n]* from|export [^\\n]* from) [''"](@?[^''"]+)[''"]', 1), lambda x: starts_with(x, '@/')) AS m
        FROM code_files WHERE ends_with(path, '.ts') OR ends_with(path, '.js') OR ends_with(path, '.tsx') OR ends_with(path, '.jsx') OR ends_with(path, '.json'))),
jsimp AS (SELECT src, pos, regexp_replace(raw, '^[@/]+', '') AS module FROM jsi)"""
_EDGES = f"""{_PY_IMPORTS}, {_JS_IMPORTS},
pyres AS (SELECT i.src, i.pos, i.module, f.path AS dst FROM pyimp i JOIN code_files f ON f.path = CASE WHEN level > 0
  THEN array_to_string(string_split(src, '/')[1:len(string_split(src, '/')) - level], '/') || '/' ELSE '' END || replace(i.module, '.', '/') || '.py'),
jscand AS (SELECT i.src, i.pos, i.module, f.path AS dst, e.r FROM jsimp i
           CROSS JOIN (VALUES (0, '.js'), (1, '.json'), (2, '.jsx'), (3, '.ts'), (4, '.tsx')) e(r, ext)
           JOIN code_files f ON f.path = i.module || e.ext),
jsres AS (SELECT src, pos, module, arg_min(dst, r) AS dst FROM jscand GROUP BY 1, 2, 3),
edges AS (SELECT src, pos, dst FROM pyres UNION ALL SELECT src, pos, dst FROM jsres)"""


def _closure_sql(seed_sql: str, final: str, more: str = "", depth: int | None = None, before: str = "") -> str:
    """Closures in SQL: each node enters once, at its smallest depth, with the least (parent's rank, kind, position).
    ``before`` and ``more`` are views that stand before the seeds and after the closure ``clo``."""
    limit = "" if depth is None else f"w.depth < {depth} AND "
    return f"""WITH RECURSIVE {SQL_CODE_FILES}, {_EDGES},{before}
seeds AS ({seed_sql}),
x AS MATERIALIZED (
  SELECT src AS node, dst AS nxt, 1 AS kind, pos FROM edges
  UNION ALL
  SELECT g.node, f.path, 0, 0 FROM (SELECT path AS node FROM code_files UNION SELECT node FROM seeds) g
  JOIN code_files f ON starts_with(f.path, g.node) AND f.path <> g.node),
walk(seed, node, depth, kind, rank) USING KEY (seed, node) AS (
  SELECT seed, node, 0, CAST(NULL AS INTEGER), row_number() OVER (PARTITION BY seed ORDER BY node) FROM (SELECT DISTINCT seed, node FROM seeds)
  UNION
  SELECT seed, node, depth, how.k, row_number() OVER (PARTITION BY seed ORDER BY how, node) FROM (
    SELECT w.seed, x.nxt AS node, min(w.depth) + 1 AS depth, min({{'r': w.rank, 'k': x.kind, 'p': x.pos}}) AS how
    FROM walk w JOIN x ON x.node = w.node
    WHERE {limit}NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.seed = w.seed AND r.node = x.nxt)
    GROUP BY w.seed, x.nxt)),
clo AS (SELECT seed, node AS path, CAST(depth AS INTEGER) AS depth, kind, rank FROM walk WHERE node IN (SELECT path FROM code_files)){more}
{final}"""


# ---------------------------------------------------------------------- registered queries

def landed_code(spark: SparkSession, sf_dir: str) -> str:
    """The code tree written as files under the shared folder; its root."""
    return land_files(code_files(spark, sf_dir).select("path", "content"))


_LANG = """CASE WHEN ends_with(path, '.py') THEN 'PYTHON' ELSE 'JAVASCRIPT' END"""


@register("corpus_scan", f"""{_CF} SELECT path, {_LANG} AS lang, CAST(octet_length(encode(content)) AS BIGINT) AS size, md5(content) AS content_md5
FROM code_files WHERE NOT starts_with(path, 'pkg_2/') AND ends_with(path, '.py')""")
def q_corpus_scan(spark, sf_dir):
    root = landed_code(spark, sf_dir)
    f = corpus_scan(spark, root, ignore_paths=["pkg_2/"], extensions=(".py",))
    return f.select(below(root, "path").alias("path"), "lang", "size", F.md5("content").alias("content_md5"))


@register("file_text", f"""{_CF} SELECT path, CAST(length(content) AS BIGINT) AS chars,
  CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines, md5(content) AS content_md5 FROM code_files""")
def q_file_text(spark, sf_dir):
    root = landed_code(spark, sf_dir)
    f = file_text(spark, root)
    return f.select(below(root, "path").alias("path"), char_count("content").alias("chars"), line_count("content").alias("lines"),
                    F.md5("content").alias("content_md5"))


@register("ext_filter", f"{_CF} SELECT path FROM code_files WHERE ends_with(path, '.py')")
def q_ext_filter(spark, sf_dir):
    return code_files(spark, sf_dir).where(ext_filter("path", (".py",))).select("path")


@register("ignore_dirs", f"{_CF} SELECT path FROM code_files WHERE NOT list_contains(string_split(path, '/')[1:-1], 'sub_1')")
def q_ignore_dirs(spark, sf_dir):
    return code_files(spark, sf_dir).where(not_in_ignored_dir("path", "", ("sub_1",))).select("path")


_SCOPE = ["pkg_1", "pkg_3/sub_2"]


@register("scope_filter", f"{_CF} SELECT path FROM code_files WHERE starts_with(path, 'pkg_1') OR starts_with(path, 'pkg_3/sub_2')")
def q_scope_filter(spark, sf_dir):
    return scope_filter(code_files(spark, sf_dir), "path", _SCOPE).select("path")


@register("ignore_filter", f"{_CF} SELECT path FROM code_files WHERE NOT starts_with(path, 'pkg_2/')")
def q_ignore_filter(spark, sf_dir):
    return ignore_filter(code_files(spark, sf_dir), "path", ["pkg_2/"]).select("path")


@register("exact_exclude", f"""WITH {SQL_CODE_FILES}, {_EDGES}
SELECT path FROM code_files WHERE path NOT IN (SELECT dst FROM jsres)""")
def q_exact_exclude(spark, sf_dir):
    files = code_files(spark, sf_dir)
    js = resolve_js(js_imports(files.where(program_type("path") == "JAVASCRIPT")), files)
    return exact_exclude(files, "path", js, "dst").select("path")


@register("program_type", f"""{_CF} SELECT path, CASE WHEN regexp_extract(path, '(\\.[^./]*)$', 1) = '.py' THEN 'PYTHON'
  WHEN regexp_extract(path, '(\\.[^./]*)$', 1) IN ('.js', '.json', '.jsx', '.ts', '.tsx') THEN 'JAVASCRIPT' ELSE 'UNKNOWN' END AS lang
FROM code_files""")
def q_program_type(spark, sf_dir):
    return code_files(spark, sf_dir).select("path", program_type("path").alias("lang"))


@register("file_ext", f"{_CF} SELECT path, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext FROM code_files")
def q_file_ext(spark, sf_dir):
    return code_files(spark, sf_dir).select("path", file_ext("path").alias("ext"))


@register("abs_path", f"{_CF} SELECT path, '/repo/' || path AS abs FROM code_files")
def q_abs_path(spark, sf_dir):
    return code_files(spark, sf_dir).select("path", abs_path(F.lit("/repo"), "path").alias("abs"))


@register("rel_path", f"""{_CF} SELECT path, CASE WHEN starts_with(path, 'pkg_1/') THEN substr(path, 7) ELSE '../' || path END AS rel
FROM code_files""")
def q_rel_path(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return f.select("path", rel_path(F.lit("/repo/pkg_1"), F.concat(F.lit("/repo/"), "path")).alias("rel"))


@register("path_segments", f"""{_CF} SELECT path, array_to_string(CASE WHEN starts_with(path, 'pkg_1/') THEN string_split(path, '/')
  ELSE list_concat(['repo'], string_split(path, '/')) END, '|') AS segs FROM code_files""")
def q_path_segments(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return f.select("path", F.array_join(path_segments(F.concat(F.lit("/repo/"), "path"), "/repo/pkg_1"), "|").alias("segs"))


@register("module_path", f"""{_CF} SELECT path, replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.') AS module,
  replace(replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.'), '.', '/') || '.py' AS py_path FROM code_files""")
def q_module_path(spark, sf_dir):
    f = code_files(spark, sf_dir).select("path", path_to_module("path").alias("module"))
    return f.withColumn("py_path", module_to_path("module"))


@register("format_content", f"""{_CF} SELECT path, md5({Q.format_content('path', 'content', 'code')}) AS block_md5,
  md5({Q.format_content('path', 'content', 'doc')}) AS doc_md5 FROM code_files""")
def q_format_content(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return f.select("path", F.md5(format_content("path", "content", "code")).alias("block_md5"),
                    F.md5(format_content("path", "content", "doc")).alias("doc_md5"))


@register("strip_py_doc", f"""{_CF} SELECT path, {Q.strip_py_doc('content')} AS stripped
FROM code_files WHERE ends_with(path, '.py')""")
def q_strip_py_doc(spark, sf_dir):
    f = code_files(spark, sf_dir).where(F.col("path").endswith(".py"))
    return f.select("path", strip_py_doc("content").alias("stripped"))


@register("strip_js_doc", f"""{_CF} SELECT path, {Q.strip_js_doc('content')} AS stripped
FROM code_files WHERE ends_with(path, '.ts')""")
def q_strip_js_doc(spark, sf_dir):
    f = code_files(spark, sf_dir).where(F.col("path").endswith(".ts"))
    return f.select("path", strip_js_doc("content").alias("stripped"))


@register("strip_doc", f"""{_CF} SELECT path, CASE WHEN ends_with(path, '.py')
  THEN {Q.strip_py_doc('content')} ELSE {Q.strip_js_doc('content')} END AS stripped FROM code_files""")
def q_strip_doc(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return f.select("path", strip_doc("content", program_type("path")).alias("stripped"))


@register("js_imports", f"WITH {SQL_CODE_FILES}, {_JS_IMPORTS} SELECT src, pos, module FROM jsimp")
def q_js_imports(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return js_imports(f.where(program_type("path") == "JAVASCRIPT"))


@register("py_imports", f"WITH {SQL_CODE_FILES}, {_PY_IMPORTS} SELECT src, pos, level, module FROM pyimp")
def q_py_imports(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return parsed_imports(f.where(program_type("path") == "PYTHON"))


@register("resolve_py", f"WITH {SQL_CODE_FILES}, {_EDGES} SELECT src, pos, module, dst FROM pyres")
def q_resolve_py(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return resolve_py(parsed_imports(f.where(program_type("path") == "PYTHON")), f).select("src", "pos", "module", "dst")


@register("resolve_relative", f"""WITH {SQL_CODE_FILES}, {_EDGES}
SELECT src, pos, CASE WHEN level > 0 THEN replace(array_to_string(string_split(src, '/')[1:len(string_split(src, '/')) - level], '/'), '/', '.') || '.' || module ELSE module END AS abs_module FROM pyimp""")
def q_resolve_relative(spark, sf_dir):
    from textloom.operators.resolve import absolute_modules

    f = code_files(spark, sf_dir)
    return absolute_modules(parsed_imports(f.where(program_type("path") == "PYTHON"))).select("src", "pos", "abs_module")


@register("resolve_js", f"WITH {SQL_CODE_FILES}, {_EDGES} SELECT src, pos, module, dst FROM jsres")
def q_resolve_js(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return resolve_js(js_imports(f.where(program_type("path") == "JAVASCRIPT")), f).select("src", "pos", "module", "dst")


@register("package_expand", f"""WITH {SQL_CODE_FILES}, {_PY_IMPORTS},
pk AS (SELECT src, pos, regexp_replace(module, '\\.[^.]*$', '') AS module FROM pyimp WHERE contains(module, '.'))
SELECT p.src, p.pos, p.module, f.path AS dst FROM pk p JOIN code_files f
  ON regexp_extract(f.path, '^(.*)/[^/]*$', 1) = replace(p.module, '.', '/') AND ends_with(f.path, '.py')""")
def q_package_expand(spark, sf_dir):
    f = code_files(spark, sf_dir)
    imp = parsed_imports(f.where(program_type("path") == "PYTHON")).where(F.col("module").contains("."))
    pk = imp.withColumn("module", F.regexp_replace("module", r"\.[^.]*$", ""))
    out = resolve_py(pk, f, expand_packages=True)
    return out.select("src", "pos", "module", "dst")


@register("contains_expand", f"""{_CF}, nodes AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS node FROM code_files
  UNION SELECT DISTINCT regexp_replace(path, '\\.[^./]*$', '') FROM code_files
  UNION SELECT DISTINCT regexp_replace(path, '[0-9]\\.[^./]*$', '') FROM code_files)
SELECT n.node, f.path FROM nodes n JOIN code_files f ON starts_with(f.path, n.node) AND f.path <> n.node""")
def q_contains_expand(spark, sf_dir):
    f = code_files(spark, sf_dir).select("path")
    nodes = (
        f.select(dirname("path").alias("node"))
        .union(f.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("node")))
        .union(f.select(F.regexp_replace("path", r"[0-9]\.[^./]*$", "").alias("node")))
        .distinct()
    )
    return contains_expand(nodes, f, "node").select("node", "path")


@register("import_closure", _closure_sql(f"SELECT '{CLOSURE_SEED}' AS seed, '{CLOSURE_SEED}' AS node",
                                         "SELECT path, depth FROM clo"))
def q_import_closure(spark, sf_dir):
    seeds = spark.createDataFrame([(CLOSURE_SEED, CLOSURE_SEED)], "seed string, node string")
    return closure_of(spark, sf_dir, seeds).select("path", "depth")


@register("multi_closure", _closure_sql(
    "SELECT path AS seed, path AS node FROM code_files WHERE starts_with(path, 'pkg_0/sub_0/')",
    "SELECT seed, path, depth FROM clo", depth=2))
def q_multi_closure(spark, sf_dir):
    f = code_files(spark, sf_dir)
    seeds = f.where(F.col("path").startswith("pkg_0/sub_0/")).select(F.col("path").alias("seed"), F.col("path").alias("node"))
    return closure_of(spark, sf_dir, seeds, depth=2).select("seed", "path", "depth")


@register("closure_profile", _closure_sql(f"SELECT '{CLOSURE_SEED}' AS seed, '{CLOSURE_SEED}' AS node",
                                          "SELECT depth, count(*) AS n_files FROM clo GROUP BY depth"))
def q_closure_profile(spark, sf_dir):
    seeds = spark.createDataFrame([(CLOSURE_SEED, CLOSURE_SEED)], "seed string, node string")
    return closure_of(spark, sf_dir, seeds).groupBy("depth").agg(F.count(F.lit(1)).alias("n_files"))


# names that lead to no file, at the depth where they were looked for
_NOT_FOUND = """un AS (SELECT name, CAST(min(depth) AS INTEGER) AS depth FROM (
  SELECT CASE WHEN i.level > 0 THEN replace(array_to_string(string_split(i.src, '/')[1:len(string_split(i.src, '/')) - i.level], '/'), '/', '.') || '.' || i.module ELSE i.module END AS name, clo.depth + 1 AS depth
  FROM pyimp i JOIN clo ON clo.path = i.src WHERE NOT EXISTS (SELECT 1 FROM pyres r WHERE r.src = i.src AND r.pos = i.pos)
  UNION ALL SELECT i.module, clo.depth + 1 FROM jsimp i JOIN clo ON clo.path = i.src WHERE NOT EXISTS (SELECT 1 FROM jsres r WHERE r.src = i.src AND r.pos = i.pos)
  UNION ALL SELECT node, 0 FROM seeds WHERE node NOT IN (SELECT path FROM code_files)) GROUP BY name),
status AS (SELECT path AS name, CASE WHEN kind = 0 THEN 'contained' ELSE 'covered' END AS status, depth FROM clo
  UNION ALL SELECT name, 'not_found', depth FROM un)"""


def closure_status(files: DataFrame, seeds: DataFrame, root: str = "", depth: int | None = None) -> DataFrame:
    """What a closure found at each depth (E10): ``seed, name, status, depth`` — files that imports lead to are
    ``covered``, files that lie under a node's path are ``contained``, modules and starts without a file are
    ``not_found`` at the least depth where they were looked for. ``depth`` limits the closure."""
    clo = cut_lineage(import_closure(files.select("path"), file_edges(files, root), seeds, depth, order=True))
    inside = F.col("kind").eqNullSafe(0)
    found = clo.select("seed", F.col("path").alias("name"), F.when(inside, F.lit("contained")).otherwise(F.lit("covered")).alias("status"), "depth")
    lost = all_imports(files, root).where("dst is null").select("src", "name")
    missing = lost.join(clo.select("seed", F.col("path").alias("src"), "depth"), "src").select("seed", "name", (F.col("depth") + 1).alias("depth"))
    starts = seeds.select("seed", F.col("node").alias("name")).join(files.select(F.col("path").alias("name")), "name", "left_anti")
    missing = missing.unionByName(starts.select("seed", "name", F.lit(0).alias("depth"))).groupBy("seed", "name").agg(F.min("depth").alias("depth"))
    return found.unionByName(missing.select("seed", "name", F.lit("not_found").alias("status"), "depth"))


STATUS_FOLDER = "pkg_4/sub_1/mod_1"  # a start that is no file, only the beginning of files' paths
_STATUS_SEEDS = f"SELECT 's' AS seed, unnest(['{CLOSURE_SEED}', '{STATUS_FOLDER}']) AS node"


def _status_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("s", CLOSURE_SEED), ("s", STATUS_FOLDER)], "seed string, node string")
    return closure_status(code_files(spark, sf_dir), seeds)


@register("closure_status", _closure_sql(_STATUS_SEEDS, "SELECT name, status, depth FROM status", more=f", {_NOT_FOUND}"))
def q_closure_status(spark, sf_dir):
    return _status_of(spark, sf_dir).select("name", "status", "depth")


@register("closure_report", _closure_sql(_STATUS_SEEDS, "SELECT depth, status, count(*) AS n FROM status GROUP BY depth, status", more=f", {_NOT_FOUND}"))
def q_closure_report(spark, sf_dir):
    """The report of a closure (E10): how many names were covered, contained and not found at each depth."""
    return _status_of(spark, sf_dir).groupBy("depth", "status").agg(F.count(F.lit(1)).alias("n"))


@register("discovery_order", _closure_sql(
    f"SELECT '{CLOSURE_SEED}' AS seed, unnest(['{CLOSURE_SEED}', 'pkg_1/sub_']) AS node",
    "SELECT path, depth, row_number() OVER (ORDER BY depth DESC, rank DESC) AS ord FROM clo"))
def q_discovery_order(spark, sf_dir):
    seeds = spark.createDataFrame([(CLOSURE_SEED, CLOSURE_SEED), (CLOSURE_SEED, "pkg_1/sub_")], "seed string, node string")
    return discovery_index(closure_of(spark, sf_dir, seeds, order=True)).select("path", "depth", "ord")


@register("common_path", f"""{_CF}, sp AS (SELECT split_part(path, '/', 1) AS top, string_split(path, '/') AS s FROM code_files),
mm AS (SELECT top, min(s) AS mn, max(s) AS mx FROM sp GROUP BY top)
SELECT top, array_to_string(mn[1:(SELECT max(k) FROM generate_series(0, least(len(mn), len(mx))) t(k) WHERE mn[1:k] = mx[1:k])], '/') AS common_path FROM mm""")
def q_common_path(spark, sf_dir):
    f = code_files(spark, sf_dir).withColumn("top", F.split("path", "/", -1).getItem(0))
    return common_path(f, ["top"], "path")


@register("preset_defaults", f"""WITH presets(mode, output, no_comment, with_prompt, max_char, max_token) AS (VALUES
  {", ".join(f"('{m}', '{o}', {str(nc).lower()}, {str(wp).lower()}, {mc}, {mt})" for m, o, nc, wp, mc, mt in PRESETS)}),
args AS (SELECT source AS mode_src, CASE WHEN doc_id % 6 = 0 THEN 'cursor' WHEN doc_id % 6 = 1 THEN 'chatgpt' WHEN doc_id % 6 = 2 THEN 'o1-mini'
  WHEN doc_id % 6 = 3 THEN 'gemini1.5pro' WHEN doc_id % 6 = 4 THEN 'claude' ELSE 'dify' END AS mode, doc_id,
  CASE WHEN lang = 'en' THEN n_chars END AS max_token_arg FROM documents)
SELECT a.doc_id, p.output, CAST(coalesce(nullif(a.max_token_arg, 0), p.max_token) AS BIGINT) AS max_token, CAST(p.max_char AS BIGINT) AS max_char FROM args a JOIN presets p ON p.mode = a.mode""")
def q_preset_defaults(spark, sf_dir):
    from textloom.session import table

    presets = spark.createDataFrame(PRESETS, "mode string, output string, no_comment boolean, with_prompt boolean, max_char long, max_token long")
    d = table(spark, sf_dir, "documents")
    # presets: a fixed six-row table, so the broadcast below is bounded by construction
    i = F.col("doc_id") % 6
    mode = F.element_at(F.array(*[F.lit(p[0]) for p in PRESETS]), (i + 1).cast("int"))
    args = d.select("doc_id", mode.alias("mode"), F.when(F.col("lang") == "en", F.col("n_chars")).alias("max_token_arg"))
    j = args.join(F.broadcast(presets), "mode")
    return j.select("doc_id", "output", F.coalesce(F.nullif("max_token_arg", F.lit(0)), "max_token").alias("max_token"), "max_char")


@register("preset_fit", f"""WITH {SQL_CODE_FILES}, presets(mode, max_char, max_token) AS (VALUES
  {", ".join(f"('{m}', {mc}, {mt})" for m, o, nc, wp, mc, mt in PRESETS)}),
sz AS (SELECT split_part(path, '/', 1) AS top, sum({Q.tokens(Q.format_content('path', 'content', 'code'))}) AS tokens,
  sum(length({Q.format_content('path', 'content', 'code')})) AS chars FROM code_files GROUP BY 1)
SELECT top, mode, (tokens <= max_token AND chars <= max_char) AS fits FROM sz CROSS JOIN presets""")
def q_preset_fit(spark, sf_dir):
    f = code_files(spark, sf_dir).select(F.split("path", "/", -1).getItem(0).alias("top"), format_content("path", "content", "code").alias("b"))
    sz = f.groupBy("top").agg(F.sum(count_tokens("b")).alias("tokens"), F.sum(F.length("b")).alias("chars"))
    # the six presets are a literal array expanded per row: no join at all
    presets = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(mc).cast("long").alias("max_char"),
                                 F.lit(mt).cast("long").alias("max_token")) for m, o, nc, wp, mc, mt in PRESETS])
    ex = sz.select("top", "tokens", "chars", F.explode(presets).alias("p"))
    return ex.select("top", F.col("p.mode").alias("mode"),
                     ((F.col("tokens") <= F.col("p.max_token")) & (F.col("chars") <= F.col("p.max_char"))).alias("fits"))


def import_collect(spark: SparkSession, sf_dir: str, seeds: DataFrame, **kw) -> DataFrame:
    return collect_files(code_files(spark, sf_dir), seeds, **kw)


@register("import_collect")
def q_import_collect(spark, sf_dir):
    f = code_files(spark, sf_dir)
    seeds = f.where(F.col("path").startswith("pkg_1/sub_1/")).select(F.col("path").alias("seed"), F.col("path").alias("node"))
    packed = import_collect(spark, sf_dir, seeds, depth=3, output="code", max_token=20_000, with_prompt=True)
    return packed.select("seed", "seg", "n_items", "token", "chars", F.md5("content").alias("content_md5"))
