from urllib.parse import urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from textloom.functions.paths import file_ext, rel_path
from textloom.functions.text import extract_code, strip_js_doc, strip_py_doc
from textloom.functions.urls import resolve_url


def _norm(u):
    p = urlparse(u)
    return urlunparse(p._replace(query="", fragment=""))


CASES = [
    ("https://a.com/x/y/z.html?q=1", "http://b.org/p"),
    ("https://a.com/x/y/z.html", "//c.net/k"),
    ("https://a.com/x/y/z.html", "/root/leaf"),
    ("https://a.com/x/y/z.html", "leaf"),
    ("https://a.com/x/y/z.html", "./leaf"),
    ("https://a.com/x/y/z.html", "../leaf"),
    ("https://a.com/x/y/z.html", "../../../../leaf"),
    ("https://a.com/x/y/", "a/./b/../c"),
    ("https://a.com/x/y/z.html", "?page=2"),
    ("https://a.com/x/y/z.html", "#top"),
    ("https://a.com/x/y/z.html", ""),
    ("https://a.com", "leaf"),
    ("https://a.com/x/y/z.html", "mailto:someone@example.com"),
    ("https://a.com/x/y/z.html", "dir/"),
    ("https://a.com/x/y/z.html", "éte/ü"),
]


def test_resolve_url_matches_urljoin(spark):
    df = spark.createDataFrame(CASES, "base string, href string")
    got = [r.r for r in df.select(resolve_url("base", "href").alias("r")).collect()]
    exp = [_norm(urljoin(b, h)) for b, h in CASES]
    assert got == exp


def test_file_ext_and_rel_path(spark):
    import os.path

    paths = ["a/b.py", "a/.bashrc", "a/..x.y", "a/b.", "noext", "a/b.tar.gz"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.e for r in df.select(file_ext("p").alias("e")).collect()] == [os.path.splitext(p)[1] for p in paths]
    pairs = [("/r/a", "/r/a/b/c.py"), ("/r/a", "/r/x/y.py"), ("/r/a/b", "/r/a/b"), ("/r", "rel/p.py")]
    df = spark.createDataFrame(pairs, "root string, p string")
    got = [r.x for r in df.select(rel_path("root", "p").alias("x")).collect()]
    exp = [p if not p.startswith("/") else os.path.relpath(p, r) for r, p in pairs]
    assert got == exp


def test_strippers_and_code_blocks(spark):
    import re

    py = 'x = 1\n"""doc\nmore"""\ny = "# not a comment\\n"\n# drop me\nz = 2\n'
    js = "/* a\n b */ let u = 'https:// x';\n// gone\nok();\n"
    ans = "intro\n```python\n  x = 1  \n```\ntext\n```\ny\n```"
    df = spark.createDataFrame([(py, js, ans, "plain")], "py string, js string, ans string, plain string")
    r = df.select(strip_py_doc("py").alias("a"), strip_js_doc("js").alias("b"), extract_code("ans").alias("c"),
                  extract_code("plain").alias("d")).first()
    assert r.a == re.sub(r"# .*?\n", "", re.sub(r'""".*?"""\n', "", py, flags=re.DOTALL))
    assert r.b == re.sub(r"// .*?\n", "", re.sub(r"/\*.*?\*/", "", js, flags=re.DOTALL))
    assert r.c == "x = 1\n\n\ny"
    assert r.d == "plain"


def test_corpus_scan_and_prefix_join(spark, tmp_path):
    from textloom.operators.predicates import prefix_join
    from textloom.sources.files import corpus_scan

    # b/__init__.py and ts_mock/j.ts are empty: the scan must still list them
    files = {"a/x.py": "from b.y import z\n", "a/node_modules/m.js": "x", "b/y.py": "y = 1\n", "b/notes.txt": "t",
             "ts_mock2/k.ts": "k", "ts_mock/j.ts": "", "b/__init__.py": ""}
    for rel, text in files.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    root = str(tmp_path)
    scan = corpus_scan(spark, root)
    got = sorted(r.path[len(root) + 1:] for r in scan.collect())
    assert {r.path[len(root) + 1:]: r.content for r in scan.collect()}["b/y.py"] == "y = 1\n"
    assert got == ["a/x.py", "b/__init__.py", "b/y.py", "ts_mock/j.ts", "ts_mock2/k.ts"]
    scoped = sorted(r.path[len(root) + 1:] for r in corpus_scan(spark, root, scope_paths=["ts_mock"]).collect())
    assert scoped == ["ts_mock/j.ts", "ts_mock2/k.ts"]  # string prefix, like the reference
    ign = sorted(r.path[len(root) + 1:] for r in corpus_scan(spark, root, ignore_paths=["a"]).collect())
    assert ign == ["b/__init__.py", "b/y.py", "ts_mock/j.ts", "ts_mock2/k.ts"]
    urls = spark.createDataFrame([("https://a.com/x",), ("https://a.com.evil/y",), ("https://b.com/z",)], "u string")
    roots = spark.createDataFrame([("https://a.com",)], "root string")
    kept = sorted(r.u for r in prefix_join(urls, "u", roots, "root", "left_semi").collect())
    assert kept == ["https://a.com.evil/y", "https://a.com/x"]
    anti = sorted(r.u for r in prefix_join(urls, "u", roots, "root", "left_anti").collect())
    assert anti == ["https://b.com/z"]


def test_prefixes_by_sorted_ranges(spark):
    """Nested, equal and empty prefixes that reach over several ranges, against every pair."""
    import random

    from textloom.operators.prefixes import longest_prefix, prefix_pairs

    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choices("abé中", k=rnd.randint(0, n)))
    prefixes, values = {word(4) for _ in range(120)} | {"", "a"}, {word(7) for _ in range(700)} | {"a", "ab"}
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in [*rows, None, *list(rows)[:3]]], f"{name} string").repartition(3)
    p, v = frame(prefixes, "prefix"), frame(values, "value")
    want = sorted((a, b) for a in prefixes for b in values if b.startswith(a))
    assert sorted(tuple(r) for r in prefix_pairs(p, v).collect()) == want
    assert sorted(tuple(r) for r in prefix_pairs(p, v, proper=True).collect()) == [(a, b) for a, b in want if a != b]
    longest = {}
    for a, b in want:
        longest[b] = max(longest.get(b, ""), a, key=len)
    assert {r.value: r.prefix for r in longest_prefix(p, v).collect()} == longest
    none = p.where("prefix = 'no such'")
    assert prefix_pairs(none, v).count() == 0 and prefix_pairs(p, v.where("value = 'no such'")).count() == 0


def test_parsed_files_go_on_in_small_batches():
    import pyarrow as pa

    from textloom.functions import code
    from textloom.operators.structure import MINED_SCHEMA, _mine_file

    text = "import os\nfrom a.b import c\n" + "".join(f"class C{k}(c):\n    x: int\n    def m(self): ...\n" for k in range(50))
    taken = []

    def parse(path, content):
        taken.append(path)
        return _mine_file(path, content)

    files = pa.RecordBatch.from_pydict({"path": [f"{k}.py" for k in range(300)], "content": [None if k % 10 == 9 else text for k in range(300)]})
    per_file, got, most = len(_mine_file("x", text)), [], 0
    for batch in code.parse_files(iter([files]), parse, MINED_SCHEMA):
        got += batch.to_pylist()
        most = max(most, batch.num_rows)
        assert len(taken) * per_file - len(got) <= per_file  # nothing is held beyond what was handed on
    assert most < code.PARSED_ROWS + per_file
    assert [tuple(r.values()) for r in got] == [r for k in range(300) if k % 10 != 9 for r in _mine_file(f"{k}.py", text)]
