"""Class-structure and snapshot jobs over the code tree and the two document snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.paths import program_type
from textloom.functions.text import fmt_class_name
from textloom.operators.predicates import public_member
from textloom.operators.snapshots import changed_paths, commit_bundle, diff_lines, review_bundle, snapshot_join
from textloom.operators.structure import (
    class_inventory,
    classes_with_kind,
    compose_edges,
    enum_members,
    inherit_edges,
    inherit_lines,
    methods_for,
    mine_structure,
    own_fields,
)
from textloom.plans.code_jobs import _closure_sql, closure_context
from textloom.registry import register
from textloom.session import cut_lineage
from textloom.sources.views import SQL_CODE_FILES, SQL_CODE_OLD, SQL_SNAP_NEW, SQL_SNAP_OLD, code_files, code_old, snap_new, snap_old

_SNAPS = f"WITH RECURSIVE {SQL_SNAP_OLD}, {SQL_SNAP_NEW}"
_JOIN = """j AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
  WHEN sha256(o.content) <> sha256(n.content) THEN 'modified' ELSE 'same' END AS status
  FROM snap_old o FULL OUTER JOIN snap_new n ON o.path = n.path)"""
_JOIN_SQL = f"{_SNAPS},\n{_JOIN}"
# anchors, a longest run of them (of each length the latest), gaps, and multisets of lines in each gap
_LINES_SQL = """lo AS (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(1, len(string_split(content, chr(10))))) - 1 AS pos
  FROM snap_old SEMI JOIN (SELECT path FROM j WHERE status <> 'same') USING (path)),
ln AS (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(1, len(string_split(content, chr(10))))) - 1 AS pos
  FROM snap_new SEMI JOIN (SELECT path FROM j WHERE status <> 'same') USING (path)),
anchor AS (SELECT path, o.pos AS op, n.pos AS np, row_number() OVER (PARTITION BY path ORDER BY o.pos) AS i
  FROM (SELECT path, line, min(pos) AS pos FROM lo GROUP BY 1, 2 HAVING count(*) = 1) o
  JOIN (SELECT path, line, min(pos) AS pos FROM ln GROUP BY 1, 2 HAVING count(*) = 1) n USING (path, line)),
lis(path, i, np, len) USING KEY (path, i) AS (
  SELECT path, i, np, 1 FROM anchor WHERE i = 1
  UNION SELECT a.path, a.i, a.np, 1 + coalesce(max(r.len), 0) FROM lis w JOIN anchor a ON a.path = w.path AND a.i = w.i + 1
  LEFT JOIN recurring.lis r ON r.path = a.path AND r.np < a.np GROUP BY a.path, a.i, a.np),
back(path, i, len) AS (
  SELECT path, max(i), len FROM lis l WHERE len = (SELECT max(len) FROM lis m WHERE m.path = l.path) GROUP BY path, len
  UNION ALL SELECT b.path, max(l.i), b.len - 1 FROM back b JOIN lis l ON l.path = b.path AND l.len = b.len - 1 AND l.i < b.i GROUP BY b.path, b.len),
kept AS (SELECT path, op, np FROM anchor JOIN back USING (path, i)),
og AS (SELECT lo.path, lo.line, lo.pos, count(k.op) AS gap FROM lo LEFT JOIN kept k ON k.path = lo.path AND k.op <= lo.pos GROUP BY 1, 2, 3),
ng AS (SELECT ln.path, ln.line, ln.pos, count(k.np) AS gap FROM ln LEFT JOIN kept k ON k.path = ln.path AND k.np <= ln.pos GROUP BY 1, 2, 3),
oo AS (SELECT *, row_number() OVER (PARTITION BY path, gap, line ORDER BY pos) AS nth FROM og),
nn AS (SELECT *, row_number() OVER (PARTITION BY path, gap, line ORDER BY pos) AS nth FROM ng),
d AS (SELECT path, '-' AS sign, pos, line FROM oo ANTI JOIN nn USING (path, gap, line, nth)
      UNION ALL SELECT path, '+', pos, line FROM nn ANTI JOIN oo USING (path, gap, line, nth)),
dt AS (SELECT path, string_agg(sign || line, chr(10) ORDER BY pos, sign DESC) AS diff FROM d GROUP BY path)"""

# The code tree's classes by the rule that its view follows.
_CLS = f"""WITH RECURSIVE {SQL_CODE_FILES},
py AS (SELECT doc_id AS i, path FROM code_files WHERE ends_with(path, '.py')),
imported AS (SELECT c.i, c.path, p.i AS p, p.path AS p_path FROM py c JOIN py p ON p.i = c.i // 3),
par AS (SELECT * FROM imported WHERE i % 5 <> 0),
anc(i, a, a_path) AS (SELECT i, p, p_path FROM par UNION SELECT anc.i, par.p, par.p_path FROM anc JOIN par ON par.i = anc.a),
cls AS (SELECT i, path, 'Thing' || i AS class_name, CASE WHEN i % 5 = 0 THEN 'Base' || (i % 4) ELSE 'Parent' END AS bases, 'VALUE_OBJECT' AS kind FROM py
  UNION ALL SELECT i, path, 'Config', '', 'VALUE_OBJECT' FROM py UNION ALL SELECT i, path, 'Color' || i, 'enum.Enum', 'ENUM' FROM py
  UNION ALL SELECT i, path, 'Error' || i, 'ValueError', 'EXCEPTION' FROM py UNION ALL SELECT i, path, 'Oops' || i, 'Error' || i, 'EXCEPTION' FROM py),
fields AS (SELECT i, path, 'Thing' || i AS class_name, 'size' AS name, CASE WHEN i % 2 = 0 THEN 'int' ELSE 'float' END AS type, 'name' AS shape,
    CASE WHEN i % 2 = 0 THEN 'int' ELSE 'float' END AS elements FROM py
  UNION ALL SELECT i, path, 'Thing' || i, 'parts', 'list[Config]', 'list', 'Config' FROM py
  UNION ALL SELECT i, path, 'Thing' || i, 'near', 'Parent | None', 'union', 'Parent|None' FROM py
  UNION ALL SELECT i, path, 'Config', 'name', 'str', 'name', 'str' FROM py UNION ALL SELECT i, path, 'Config', 'owner', 'Thing' || i, 'name', 'Thing' || i FROM py),
own AS (SELECT f.* FROM fields f WHERE NOT EXISTS (SELECT 1 FROM par JOIN fields g ON g.path = par.p_path AND g.class_name = 'Thing' || par.p
    WHERE par.path = f.path AND f.class_name = 'Thing' || par.i AND g.name = f.name AND g.type = f.type)),
methods AS (SELECT i, path, 'Thing' || i AS class_name, 'run' AS name, 'run(self, n: int=1)' AS signature FROM py
  UNION ALL SELECT i, path, 'Thing' || i, 'only_' || i, 'only_' || i || '(self)' FROM py WHERE i % 2 = 1)"""


def _mined(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return cut_lineage(mine_structure(f.where(program_type("path") == "PYTHON")))  # parsed once


@register("mine_classes", f"{_CLS} SELECT path, class_name, bases FROM cls")
def q_mine_classes(spark, sf_dir):
    m = _mined(spark, sf_dir)
    c = m.where(F.col("kind") == "class").select("path", "class_name")
    b = m.where(F.col("kind") == "base").groupBy("path", "class_name").agg(
        F.expr("listagg(detail, ', ') WITHIN GROUP (ORDER BY pos)").alias("bases"))
    return c.join(b, ["path", "class_name"], "left").fillna("", ["bases"])


@register("mine_fields", f"{_CLS} SELECT path, class_name, name, type, shape FROM fields")
def q_mine_fields(spark, sf_dir):
    m = _mined(spark, sf_dir).where(F.col("kind") == "field")
    return m.select("path", "class_name", "name", F.col("detail").alias("type"), "shape")


@register("mine_enum", f"""{_CLS} SELECT path, 'Color' || i AS class_name, 'RED' AS name, 'int' AS value_type FROM py
UNION ALL SELECT path, 'Color' || i, 'NAME', 'str' FROM py""")
def q_mine_enum(spark, sf_dir):
    return enum_members(_mined(spark, sf_dir))


@register("type_shape", f"{_CLS} SELECT path, class_name, name, shape, elements FROM fields")
def q_type_shape(spark, sf_dir):
    m = _mined(spark, sf_dir).where(F.col("kind") == "field")
    return m.select("path", "class_name", "name", "shape", F.array_join("elements", "|").alias("elements"))


@register("mine_methods", f"""{_CLS} SELECT path, class_name, name, signature, path AS defined_path, class_name AS defined_in FROM methods
UNION ALL SELECT c.path, 'Thing' || c.i, m.name, m.signature, m.path, m.class_name FROM anc JOIN py c ON c.i = anc.i
  JOIN methods m ON m.i = anc.a AND m.name <> 'run'""")
def q_mine_methods(spark, sf_dir):
    return methods_for(_mined(spark, sf_dir), "all").select("path", "class_name", "name", "signature", "defined_path", "defined_in")


@register("public_methods", f"""{_CLS}, named AS (SELECT path, class_name, name FROM methods UNION ALL SELECT path, 'Thing' || i, '_hidden' FROM py)
SELECT path, class_name, name, (name = '__init__' OR NOT starts_with(name, '_')) AS public FROM named""")
def q_public_methods(spark, sf_dir):
    m = methods_for(_mined(spark, sf_dir), "defined", public_only=False)
    return m.select("path", "class_name", "name", public_member("name").alias("public"))


@register("method_display", f"{_CLS} SELECT path, class_name, name, class_name AS defined_in FROM methods")
def q_method_display(spark, sf_dir):
    m = _mined(spark, sf_dir)
    return methods_for(m, "defined").select("path", "class_name", "name", "defined_in")


@register("class_kind", f"{_CLS} SELECT path, class_name, kind AS class_type FROM cls")
def q_class_kind(spark, sf_dir):
    return classes_with_kind(_mined(spark, sf_dir)).select("path", "class_name", "class_type")


@register("fmt_class_name", f"""WITH {SQL_CODE_FILES}
SELECT path, regexp_replace(regexp_extract(content, '(?m)^class (\\w+\\([^)]*\\))', 1) || '[T]', '\\[[^\\n]*?\\]', '', 'g') AS display
FROM code_files WHERE ends_with(path, '.py')""")
def q_fmt_class_name(spark, sf_dir):
    f = code_files(spark, sf_dir).where(F.col("path").endswith(".py"))
    raw = F.concat(F.regexp_extract("content", r"(?m)^class (\w+\([^)]*\))", 1), F.lit("[T]"))
    return f.select("path", fmt_class_name(raw).alias("display"))


@register("inherit_edges", f"""{_CLS} SELECT path, 'Thing' || i AS class_name, p_path AS base_path, 'Thing' || p AS base FROM par
UNION ALL SELECT path, 'Oops' || i, path, 'Error' || i FROM py""")
def q_inherit_edges(spark, sf_dir):
    return inherit_edges(_mined(spark, sf_dir))


@register("inherit_scope", f"""{_CLS}, edges AS (SELECT path, 'Thing' || i AS class_name, p_path AS base_path, 'Thing' || p AS base FROM par
  UNION ALL SELECT path, 'Oops' || i, path, 'Error' || i FROM py)
SELECT path, class_name, base_path, base, 'solid' AS line FROM edges WHERE path < 'pkg_3'
  AND (base_path < 'pkg_3' OR (starts_with(base_path, 'pkg_') AND NOT starts_with(base_path, 'pkg_4/')))""")
def q_inherit_scope(spark, sf_dir):
    """Bases of the classes of some packages: these packages, and a further one that is under the root and not ignored."""
    mined = _mined(spark, sf_dir)
    return inherit_lines(mined, mined.where("path < 'pkg_3'").select("path"), "pkg_", ("pkg_4/",))


@register("compose_edges", f"""{_CLS} SELECT path, 'Thing' || i AS class_name, path AS target_path, 'Config' AS target, '0..*' AS multiplicity FROM py
UNION ALL SELECT path, 'Thing' || i, p_path, 'Thing' || p, '0..*' FROM imported
UNION ALL SELECT path, 'Config', path, 'Thing' || i, '1' FROM py""")
def q_compose_edges(spark, sf_dir):
    return compose_edges(_mined(spark, sf_dir))


@register("own_fields", f"{_CLS} SELECT path, class_name, name, type FROM own")
def q_own_fields(spark, sf_dir):
    return own_fields(_mined(spark, sf_dir)).select("path", "class_name", "name", "type")


@register("class_inventory", f"""{_CLS} SELECT c.path, c.class_name,
  CAST((SELECT count(*) FROM own f WHERE f.path = c.path AND f.class_name = c.class_name) AS INTEGER) AS n_fields,
  CAST((SELECT count(*) FROM methods m WHERE m.path = c.path AND m.class_name = c.class_name) AS INTEGER) AS n_methods FROM cls c""")
def q_class_inventory(spark, sf_dir):
    inv = class_inventory(_mined(spark, sf_dir))
    return inv.select("path", "class_name", F.coalesce(F.size("fields"), F.lit(0)).alias("n_fields"),
                      F.coalesce(F.size("methods"), F.lit(0)).alias("n_methods"))


@register("snapshot_source", f"""{_SNAPS} SELECT path, md5(content) AS content_md5 FROM snap_new""")
def q_snapshot_source(spark, sf_dir):
    return snap_new(spark, sf_dir).select("path", F.md5("content").alias("content_md5"))


@register("snapshot_join", f"{_JOIN_SQL} SELECT path, status FROM j WHERE status <> 'same'")
def q_snapshot_join(spark, sf_dir):
    return snapshot_join(snap_old(spark, sf_dir), snap_new(spark, sf_dir)).where(F.col("status") != "same")


@register("changed_scope", f"{_JOIN_SQL} SELECT path, status FROM j WHERE status <> 'same' AND starts_with(path, 'src1')")
def q_changed_scope(spark, sf_dir):
    return changed_paths(snap_old(spark, sf_dir), snap_new(spark, sf_dir), "src1")


@register("line_diff", f"{_JOIN_SQL}, {_LINES_SQL} SELECT path, sign, CAST(pos AS INTEGER) AS pos, md5(line) AS line_md5 FROM d")
def q_line_diff(spark, sf_dir):
    d = diff_lines(snap_old(spark, sf_dir), snap_new(spark, sf_dir))
    return d.select("path", "sign", "pos", F.md5("line").alias("line_md5"))


@register("review_bundle", _closure_sql(
    "SELECT path AS seed, path AS node FROM j WHERE status = 'modified'",
    """SELECT j.path, md5('Review the change to ' || j.path || '.' || chr(10) || 'Diff:' || chr(10) || coalesce(dt.diff, '') || chr(10)
  || chr(10) || 'File ' || j.path || ':' || chr(10) || n.content || chr(10) || coalesce(ctx.context, '')) AS prompt_md5
FROM j JOIN snap_new n ON n.path = j.path LEFT JOIN dt ON dt.path = j.path LEFT JOIN ctx ON ctx.seed = j.path WHERE j.status = 'modified'""",
    depth=1, before=f"\n{SQL_CODE_OLD},\nsnap_new AS (SELECT path, content FROM code_files),\n{_JOIN},",
    more=f""",
{_LINES_SQL},
ctx AS (SELECT c.seed, string_agg(chr(10) || 'File ' || c.path || ':' || chr(10) || f.content || chr(10), '' ORDER BY c.depth DESC, c.rank DESC) AS context
  FROM clo c JOIN code_files f ON f.path = c.path WHERE c.path <> c.seed GROUP BY c.seed)"""))
def q_review_bundle(spark, sf_dir):
    """Changes of the code tree, each with the files that it imports or contains."""
    old, new = code_old(spark, sf_dir), code_files(spark, sf_dir).select("path", "content")
    modified = cut_lineage(changed_paths(old, new).where(F.col("status") == "modified").select("path"))
    r = review_bundle(old, new, closure_context(new, modified))
    return r.select("path", F.md5("prompt").alias("prompt_md5"))


@register("commit_bundle", f"""{_JOIN_SQL}, {_LINES_SQL}
SELECT split_part(j.path, '/', 1) AS repo, j.path, j.status, md5(coalesce(dt.diff, '')) AS diff_md5, md5(n.content) AS content_md5
FROM j LEFT JOIN dt ON dt.path = j.path LEFT JOIN snap_new n ON n.path = j.path WHERE j.status <> 'same'""")
def q_commit_bundle(spark, sf_dir):
    c = commit_bundle(snap_old(spark, sf_dir), snap_new(spark, sf_dir), lambda p: F.split(p, "/", -1).getItem(0))
    return c.select("repo", "path", "status", F.md5("diff").alias("diff_md5"), F.md5("content").alias("content_md5"))
