"""File sources over a really written tree, imports by the parser, containment by exact names."""

from textloom.functions.code import parsed_imports
from textloom.operators.resolve import contains_expand, resolve_py
from textloom.sources.files import below, corpus_scan, file_text, land_files

TREE = {
    "pkg/__init__.py": "", "pkg/a.py": '"""\nfrom fake import x\n"""\nfrom . import b\nif True:\n    from .sub import c as d\n', "pkg/b.py": "x = 1\n",
    "pkg/sub/__init__.py": "from ..a import y\n", "pkg/sub/c.py": "def (:\n", "pkg/_hidden.py": "é\n", "notes.txt": "n\n", "web/a.ts": "t", "web/a.tsx": "x",
}


def _tree(spark):
    files = spark.createDataFrame(list(TREE.items()), "path string, content string")
    return files, land_files(files)


def test_every_file_is_read_whatever_its_name_or_length(spark):
    _, root = _tree(spark)
    got = {r.path: r.content for r in file_text(spark, root).select(below(root, "path").alias("path"), "content").collect()}
    assert got == TREE
    scan = corpus_scan(spark, root, scope_paths=["pkg"], ignore_paths=["pkg/sub"], extensions=(".py",)).select(below(root, "path").alias("path"), "size", "lang")
    want = {p: len(c.encode()) for p, c in TREE.items() if p.startswith("pkg/") and not p.startswith("pkg/sub") and p.endswith(".py")}
    assert {r.path: r["size"] for r in scan.collect()} == want


def test_imports_are_the_parsers(spark):
    files, _ = _tree(spark)
    py = files.where("path like '%.py'")
    got = {(r.src, r.pos, r.level, r.module) for r in parsed_imports(py).collect()}
    assert got == {("pkg/a.py", 0, 1, ""), ("pkg/a.py", 1, 1, "sub"), ("pkg/sub/__init__.py", 0, 2, "a")}
    dst = {(r.src, r.module, r.dst) for r in resolve_py(parsed_imports(py), files).collect()}
    assert ("pkg/sub/__init__.py", "a", "pkg/a.py") in dst and ("pkg/a.py", "sub", "pkg/sub/c.py") in dst


def test_containment_is_by_literal_prefix(spark):
    paths = ["d/component_one.ts", "d/component_one.tsx", "d/component_two.ts", "d2/x.ts", "d/e/f.ts", "component_one.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    nodes = ["d/component_one.ts", "d", "d/e", "d/component_", "x"]
    got = {(r.node, r.path) for r in contains_expand(spark.createDataFrame([(n,) for n in nodes], "node string"), files).collect()}
    assert got == {(n, p) for n in nodes for p in paths if p.startswith(n) and p != n}


def _trees(root):
    from textloom.sources.file_tree import Wanted, _Tree

    tree = _Tree({"path": root, "partitions": "2"})
    return tree, Wanted


def test_pieces_hold_each_file_once(spark, monkeypatch):
    from textloom.sources import file_tree

    _, root = _tree(spark)
    for each, folders in ((1000, 4), (2, 1), (1, 100)):
        monkeypatch.setattr(file_tree, "FILES_EACH", each)
        monkeypatch.setattr(file_tree, "FOLDERS_EACH", folders)
        tree, wanted = _trees(root)
        pieces = tree.plan(wanted())
        stem = root.removeprefix("file:").rstrip("/") + "/"
        got = [r["path"].removeprefix(stem) for p in pieces for b in tree.rows(p) for r in b.to_pylist()]
        assert sorted(got) == sorted(TREE), (each, folders)


def test_filters_reach_the_source(spark):
    from pyspark.sql import functions as F

    from textloom.sources.file_tree import file_tree

    _, root = _tree(spark)
    stem = root.removeprefix("file:").rstrip("/") + "/"
    t = file_tree(spark, root)
    names = lambda df: sorted(r.path.removeprefix(stem) for r in df.select("path").collect())
    ends = t.where(F.col("path").endswith(".py") & ~F.col("path").endswith("a.py") & F.col("path").startswith(stem + "pkg/"))
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "EndsWith" not in plan.split("BatchScan")[0], plan  # nothing is left for Spark to filter
    assert names(ends) == sorted(p for p in TREE if p.endswith(".py") and not p.endswith("a.py") and p.startswith("pkg/"))
    assert names(t.where(F.col("path") == stem + "web/a.ts")) == ["web/a.ts"]
    assert names(t.where(F.col("path") != stem + "web/a.ts")) == sorted(set(TREE) - {"web/a.ts"})
    assert names(t.where(F.col("path").contains("sub") | F.col("path").endswith(".txt"))) == ["notes.txt", "pkg/sub/__init__.py", "pkg/sub/c.py"]
    assert names(t.where(~F.col("path").startswith(stem + "pkg"))) == ["notes.txt", "web/a.ts", "web/a.tsx"]
    listed = file_tree(spark, root, content="false", ignoreDirs=["sub"], extensions=[".py", ".ts"], scope=[stem + "pkg", stem + "we"])
    assert listed.columns == ["path", "size", "modified"]
    assert names(listed) == sorted(p for p in TREE if p.endswith((".py", ".ts")) and "/sub/" not in p)


def test_folders_that_cannot_match_are_not_walked():
    from textloom.sources.file_tree import Wanted

    w = Wanted(begins=[("/r/pk",)], not_begins=["/r/pkg/old/"], skip_dirs=frozenset({"node_modules"}))
    assert w.folder("/r/pkg", "pkg") and w.folder("/r", "r") and w.folder("/r/pkg/new", "new")
    assert not w.folder("/r/web", "web") and not w.folder("/r/pkg/old", "old") and not w.folder("/r/pkg/node_modules", "node_modules")
    assert not Wanted(equal=["/r/a/b.py"]).folder("/r/c", "c") and Wanted(equal=["/r/a/b.py"]).folder("/r/a", "a")


def test_files_that_cannot_be_read_are_marked(spark, tmp_path, monkeypatch):
    from textloom.sources import file_tree

    (tmp_path / "good.py").write_text("x")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "gone.py").write_text("y")
    real = file_tree.file_system

    class Failing:
        def __init__(self, fs):
            self.fs = fs

        def get_file_info(self, selector):
            return self.fs.get_file_info(selector)

        def open_input_stream(self, path):
            if path.endswith("gone.py"):
                raise FileNotFoundError(path)
            return self.fs.open_input_stream(path)

    def failing(uri, cache):
        fs, path = real(uri, cache)
        return Failing(fs), path

    monkeypatch.setattr(file_tree, "file_system", failing)
    tree, wanted = _trees(str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for p in tree.plan(wanted()) for b in tree.rows(p) for r in b.to_pylist()}
    assert rows["good.py"]["content"] == "x" and rows["good.py"]["error"] is None
    assert rows["bad.py"]["content"] == "\ufffd\ufffd" and rows["bad.py"]["error"] is None
    assert rows["gone.py"]["content"] is None and rows["gone.py"]["error"].startswith("FileNotFoundError")
    monkeypatch.undo()
    assert {r.content: r.error for r in file_text(spark, str(tmp_path)).collect()} == {"x": None, "y": None, "\ufffd\ufffd": None}
    assert file_text(spark, str(tmp_path / "nothing")).count() == 0


def test_a_stream_gives_new_and_changed_files(spark, tmp_path):
    import os
    import time

    from textloom.sources.file_tree import file_tree

    tree, base = tmp_path / "tree", str(tmp_path / "s")
    (tree / "d").mkdir(parents=True)

    def drain():
        s = file_tree(spark, str(tree), stream=True, extensions=[".py"])
        q = s.select("path", "content").writeStream.option("checkpointLocation", base + "/c").format("parquet").option("path", base + "/out")
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path.rsplit("/", 1)[1], r.content) for r in spark.read.schema("path string, content string").parquet(base + "/out").collect())

    (tree / "a.py").write_text("1")
    (tree / "d" / "b.py").write_text("2")
    (tree / "d" / "b.txt").write_text("no")
    os.makedirs(base + "/out")
    assert drain() == [("a.py", "1"), ("b.py", "2")]
    time.sleep(0.01)
    (tree / "d" / "c.py").write_text("3")
    (tree / "a.py").write_text("4")
    assert drain() == [("a.py", "1"), ("a.py", "4"), ("b.py", "2"), ("c.py", "3")]
    assert drain() == [("a.py", "1"), ("a.py", "4"), ("b.py", "2"), ("c.py", "3")]
