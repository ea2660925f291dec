from pyspark.sql import functions as F

from textloom.operators.closure import discovery_index, import_closure
from textloom.operators.resolve import contains_expand


def _files(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def _edges(spark, pairs):
    return spark.createDataFrame([(s, i, d) for i, (s, d) in enumerate(pairs)], "src string, pos int, dst string")


def _run(spark, files, edges, starts, depth=None, contains=True):
    st = spark.createDataFrame([("s", n) for n in starts], "seed string, node string")
    out = import_closure(_files(spark, files), _edges(spark, edges), st, depth, contains)
    return {r.path: r.depth for r in out.collect()}


def test_cycle_self_diamond_missing(spark):
    files = ["a.py", "b.py", "c.py", "d.py", "e.py"]
    edges = [("a.py", "b.py"), ("a.py", "c.py"), ("b.py", "d.py"), ("c.py", "d.py"), ("d.py", "a.py"),
             ("d.py", "d.py"), ("d.py", "zzz.py")]
    assert _run(spark, files, edges, ["a.py"]) == {"a.py": 0, "b.py": 1, "c.py": 1, "d.py": 2}
    assert _run(spark, files, edges, ["a.py"], depth=1) == {"a.py": 0, "b.py": 1, "c.py": 1}
    # depth 0: starts verbatim, even when missing
    assert _run(spark, files, edges, ["a.py", "nope.py"], depth=0) == {"a.py": 0, "nope.py": 0}
    # a missing start is dropped
    assert _run(spark, files, edges, ["nope.py", "e.py"]) == {"e.py": 0}


def test_directory_start_and_literal_prefix(spark):
    files = ["pkg/a.ts", "pkg/a.tsx", "pkg/sub/x.py", "pkg2/y.py", "other/z.py"]
    got = _run(spark, files, [], ["pkg"], depth=1)
    assert got == {"pkg/a.ts": 1, "pkg/a.tsx": 1, "pkg/sub/x.py": 1, "pkg2/y.py": 1}
    nodes = spark.createDataFrame([("pkg/a.ts",), ("pkg/su",), ("dir",)], "node string")
    pairs = {(r.node, r.path) for r in contains_expand(nodes, _files(spark, files), "node").collect()}
    assert pairs == {("pkg/a.ts", "pkg/a.tsx"), ("pkg/su", "pkg/sub/x.py")}


def test_containment_after_level_zero(spark):
    files = ["a.py", "x.ts", "x.tsx", "y.py"]
    edges = [("a.py", "x.ts"), ("x.tsx", "y.py")]
    # a.py imports x.ts (level 1); x.ts is a string prefix of x.tsx (level 2), which imports y.py
    assert _run(spark, files, edges, ["a.py"]) == {"a.py": 0, "x.ts": 1, "x.tsx": 2, "y.py": 3}
    assert _run(spark, files, edges, ["a.py"], contains=False) == {"a.py": 0, "x.ts": 1}


def test_collect_files_paths_and_segments(spark):
    from pyspark.sql import functions as F

    from textloom.plans.code_jobs import collect_files

    files = spark.createDataFrame([
        ("app/main.py", "from app.util import f\nfrom app.models.user import U\n"),
        ("app/util.py", "# helper\nx = 1\n"),
        ("app/models/user.py", '"""doc"""\nclass U: pass\n'),
        ("app/unused.py", "y = 2\n"),
    ], "path string, content string")
    seeds = spark.createDataFrame([("m", "app/main.py")], "seed string, node string")
    paths = collect_files(files, seeds, output="path").first().content
    # reverse discovery order: the last discovered file first, the start last
    assert paths == "app/models/user.py app/util.py app/main.py"
    one = collect_files(files, seeds, output="code", max_token=100000).collect()
    assert len(one) == 1 and one[0].content.startswith("\n### Directory Structure Chart: app\n")
    assert "### app/unused.py" not in one[0].content and one[0].n_items == 4  # tree header + 3 files
    many = collect_files(files, seeds, output="code", max_token=1)
    assert many.count() == 4  # every item over the budget stands alone


def test_discovery_order(spark):
    files = ["a.py", "b.py", "c.py", "d.py"]
    edges = [("a.py", "b.py"), ("a.py", "c.py"), ("b.py", "d.py"), ("c.py", "b.py")]
    st = spark.createDataFrame([("s", "a.py")], "seed string, node string")
    out = discovery_index(import_closure(_files(spark, files), _edges(spark, edges), st, order=True))
    # discovered a, then b and c (import order), then d; listed newest first
    assert [r.path for r in out.orderBy("ord").collect()] == ["d.py", "c.py", "b.py", "a.py"]


def _walk(files, edges, starts, depth=None):
    """Level by level: each node by the least (place of its parent, contained before imported, position, name)."""
    files, out, level = set(files), {}, sorted(starts)
    for n in level:
        out[n] = (0, None)
    order, d = list(level), 0
    while level and (depth is None or d < depth):
        found = {}
        for rank, node in enumerate(level):
            inside = [(0, 0, f) for f in files if f.startswith(node) and f != node]
            imported = [(1, pos, dst) for pos, (src, dst) in enumerate(edges) if src == node and node in files]
            for kind, pos, nxt in inside + imported:
                if nxt not in out:
                    found[nxt] = min(found.get(nxt, (rank, kind, pos)), (rank, kind, pos))
        d += 1
        level = sorted(found, key=lambda n: (found[n], n))
        out |= {n: (d, found[n][1]) for n in level}
        order += level
    listed = [n for n in reversed(order) if n in files]
    return {(n, *out[n], k + 1) for k, n in enumerate(listed)}


def test_discovery_order_of_random_graphs(spark):
    """Kinds, depths and places of seeds over one graph, with folders, prefixes, cycles and names without a file."""
    import random

    rnd = random.Random(8)
    files = sorted({f"{rnd.choice(['p', 'q', 'p2'])}/{rnd.choice('ab')}{rnd.randint(0, 6)}{rnd.choice(['.ts', '.tsx', '.py'])}" for _ in range(45)})
    edges = [(rnd.choice(files), rnd.choice([*files, "gone/x.py"])) for _ in range(60)]
    seeds = {"one": [files[0]], "many": [files[3], files[7], "p/a", "nothing"], "folder": ["q"]}
    st = spark.createDataFrame([(s, n) for s, nodes in seeds.items() for n in nodes], "seed string, node string")
    for depth in (None, 2):
        out = discovery_index(import_closure(_files(spark, files), _edges(spark, edges), st, depth, order=True))
        got = {}
        for r in out.collect():
            got.setdefault(r.seed, set()).add((r.path, r.depth, r.kind, r.ord))
        assert got == {s: _walk(files, edges, nodes, depth) for s, nodes in seeds.items()}
    plain = import_closure(_files(spark, files), _edges(spark, edges), st)
    assert plain.columns == ["seed", "path", "depth"]
    assert {tuple(r) for r in plain.where("seed = 'many'").select("path", "depth").collect()} == {(n, d) for n, d, _, _ in _walk(files, edges, seeds["many"])}


LUA = [
    ("main.lua", 'local a = require "lib.a"\nlocal b = require "lib.b"\nrequire "gone"\n'),
    ("lib/a.lua", 'require "lib.c"\n'), ("lib/b/init.lua", ""), ("lib/c.lua", None), ("lib/c/init.lua", 'require "main"'),
    ("other.rb", 'require "lib.a"\n'), ("x.py", "from y import z\n"), ("y.py", ""),
]


def test_a_third_language_reaches_the_closure(spark, monkeypatch):
    """Imports of a registered language are followed and reported; a language that no analyzer knows has none."""
    import pytest

    from textloom.operators import analyzers
    from textloom.plans.code_jobs import closure_status

    monkeypatch.setattr(analyzers, "ANALYZERS", dict(analyzers.ANALYZERS))
    files = spark.createDataFrame(LUA, "path string, content string")
    edges = lambda: {(r.src, r.dst) for r in analyzers.file_edges(files).collect()}
    assert edges() == {("x.py", "y.py")}
    path = lambda name: F.translate(name, ".", "/")
    lua = analyzers.by_columns(
        "LUA", (".lua",), lambda text: F.regexp_extract_all(text, F.lit('require "([^"]+)"'), 1),
        lambda src, name: F.array(F.concat(path(name), F.lit(".lua")), F.concat(path(name), F.lit("/init.lua"))),
    )
    analyzers.register_analyzer(lua)
    assert edges() == {("main.lua", "lib/a.lua"), ("main.lua", "lib/b/init.lua"), ("lib/a.lua", "lib/c.lua"), ("lib/c/init.lua", "main.lua"), ("x.py", "y.py")}
    seeds = spark.createDataFrame([("s", "main.lua")], "seed string, node string")
    got = {(r.name, r.status, r.depth) for r in closure_status(files, seeds).collect()}
    assert got == {("main.lua", "covered", 0), ("lib/a.lua", "covered", 1), ("lib/b/init.lua", "covered", 1), ("lib/c.lua", "covered", 2), ("gone", "not_found", 1)}
    with pytest.raises(ValueError):
        analyzers.register_analyzer(analyzers.by_columns("OTHER", (".py",), lua.imports, lua.resolve))


def test_a_popular_package_spreads_over_tasks(spark, monkeypatch):
    """All imports name one folder; the pairs come from several tasks, none is lost or doubled, and files and modules keep their ways."""
    from textloom.operators import resolve

    monkeypatch.setattr(resolve, "PIECE", 16, raising=False)
    files = [f"pkg/sub/f{k}.py" for k in range(50)] + ["pkg/one.py", "pkg/sub/deep/g.py", "pkg/sub/t.ts", "other/h.py"]
    imports = [(f"s{k}.py", p, 0, m) for k in range(100) for p, m in enumerate(["pkg.sub", "pkg.one", "no.such"])] + [("s0.py", 3, 0, None)]
    imp = spark.createDataFrame(imports, "src string, pos long, level int, module string")
    out = resolve.resolve_py(imp, _files(spark, files))
    assert out.columns == ["src", "pos", "level", "module", "abs_module", "dst"]
    inside = [f for f in files if f.startswith("pkg/sub/f")]
    exp = {(s, p, f) for s, p, _, m in imports for f in (inside if m == "pkg.sub" else ["pkg/one.py"] if m == "pkg.one" else [])}
    rows = out.select("src", "pos", "dst").collect()
    assert {tuple(r) for r in rows} == exp and len(rows) == len(exp)
    kept = resolve.resolve_py(imp, _files(spark, files), keep_unresolved=True).select("src", "pos", "dst").collect()
    assert {tuple(r) for r in kept if r.dst} == exp and len(kept) == len(exp) + 101
    tasks = out.where("module = 'pkg.sub'").groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 5000 / 3
