from pyspark.sql import functions as F

from sf_tables import SF
from textloom.functions.html import html_text, html_text_parsed
from textloom.operators.structure import (
    class_inventory, classes_with_kind, compose_edges, enum_members, inherit_edges, inherit_lines, methods_for, mine_structure, own_fields,
)
from textloom.operators.tree import tree_map


def test_native_html_matches_parser_on_pages(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    d = p.select(html_text("html").alias("a"), html_text_parsed("html").alias("b")).where(F.col("a") != F.col("b"))
    assert d.count() == 0


def test_html_edge_cases(spark):
    html = ("<html><head><title>T &amp; U</title><script>var s='</p>';</script></head><body><nav><a href='/x'>n</a></nav>"
            "<!-- hidden --><p>one<b>two</b>  three <p>four&quot;</body></html>")
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(html_text("html").alias("a"), html_text_parsed("html").alias("b")).first()
    assert r.a == r.b == 'T & U one two three four"'


PARTS = [
    "one", " two ", "&amp;", "&amp;lt;", "&nbsp;", "&#8217;", "&euro;", "&copy", "&", "<p>", "</p>", "<b>", "</b>", "<br/>", "<nav>", "</nav>", "<nav id='x>y'>", "<footer>",
    "</footer>", "<header class=h>", "</header>", "<aside/>", "<script>var a='</p>' <b;</script>", "<style>p{}</style>", "<!-- x <p> -->", "<!-- open", "<title>T &amp; t</title>",
    '<a href="/d">', "<a href='/s'>", "<a href=/u>", "<a class='k' href=\"/k?a=1&amp;b=2\">", '<a HREF = "/c">', '<a data-href="/no">', "<a>", "</a>", '<a title="a>b" href="/t">',
    "\n", "\u00a0", "<", ">", "</", "<3", '"quoted"', "\u00e9", "<textarea><b>x</textarea>", "<![CDATA[x]]>", "<?php x ?>", "<script>", "</script>",
]


def test_native_text_and_links_are_the_parsers_on_odd_pages(spark):
    import random

    from textloom.functions.html import _parse_page, needs_parser, raw_links

    rng = random.Random(12)
    pages = ["".join(rng.choices(PARTS, k=rng.randint(1, 12))) for _ in range(4000)] + ["<p>" + "long words " * 20_000 + "<nav>" + "x " * 20_000 + "</nav>"]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(pages)], "i int, html string").repartition(4)
    odd = 0
    for r in df.select("html", html_text("html").alias("t"), raw_links("html", "all").alias("a"), raw_links("html", "body").alias("b"), needs_parser("html").alias("o")).collect():
        odd += r.o
        assert (r.t, r.a) == _parse_page(r.html, "all"), r.html
        assert r.b == _parse_page(r.html, "body")[1], r.html
    assert odd < len(pages) - 200
    real = spark.read.parquet(f"{SF}/pages.parquet")
    assert real.where(needs_parser("html")).count() == 0


def test_url_tree_layout(spark):
    urls = ["https://h.com/a/b", "https://h.com/a/c", "https://h.com/d", "https://h.com/a/b/e"]
    df = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, ord long").withColumn("g", F.lit(1))
    t = tree_map(df, ["g"], "url", "ord").first()
    layout = "h.com\n├── a\n│   ├── b\n│   │   └── e\n│   └── c\n└── d\n"
    assert t.layout == layout
    assert t.tree_text == '\n### Web Site Map: h.com\n"""\n' + layout + '\n"""\n'


CODE = '''
import enum
from typing import Optional, Union

class Color(enum.Enum):
    RED = 1
    BLUE = "b"

class Part:
    def __init__(self, size: int, name, *args, **kwargs):
        self.size = size
    def _hidden(self): ...
    def run(self, n: int = 1): ...

class Car(Part):
    size: int
    parts: list[Part]
    maybe: Optional[Part]
    either: Part | Color
    def __init__(self, size: int): ...

class BadError(ValueError):
    pass
'''


def test_mine_structure(spark):
    files = spark.createDataFrame([("m.py", CODE), ("bad.py", "def (:")], "path string, content string")
    m = mine_structure(files).cache()
    classes = [r.class_name for r in m.where("kind = 'class'").orderBy("pos").collect()]
    assert classes == ["BadError", "Car", "Color", "Part"]
    assert m.where("kind = 'error'").count() == 1
    members = {(r.name, r.value_type) for r in enum_members(m).collect()}
    assert members == {("RED", "int"), ("BLUE", "str")}
    fields = {(r.class_name, r.name): (r.shape, tuple(r.elements or ())) for r in m.where("kind = 'field'").collect()}
    assert fields[("Part", "name")] == ("other", ())
    assert fields[("Car", "parts")] == ("list", ("Part",))
    assert fields[("Car", "maybe")] == ("union", ("Part",))
    assert fields[("Car", "either")] == ("union", ("Part", "Color"))
    own = {(r.class_name, r.name) for r in own_fields(m).collect()}
    assert ("Car", "size") not in own and ("Car", "parts") in own
    comp = {(r.class_name, r.target, r.multiplicity) for r in compose_edges(m).collect()}
    assert comp == {("Car", "Part", "0..*"), ("Car", "Color", "0..*")}
    kinds = {r.class_name: r.class_type for r in classes_with_kind(m).collect()}
    assert kinds == {"Color": "ENUM", "Part": "VALUE_OBJECT", "Car": "VALUE_OBJECT", "BadError": "EXCEPTION"}


def test_homonyms_imports_and_whole_ancestry(spark):
    """Classes of one name stay apart; bases go through imports, relative and aliased; methods come from
    every ancestor, the nearest first; enums and exceptions through project classes; cycles end."""
    files = spark.createDataFrame(
        [
            ("a/m.py", "class Config:\n    x: int\n    def go(self): ...\n    def far(self): ...\nclass Loop(Loop2): ...\nclass Loop2(Loop): ...\n"),
            ("b/m.py", "class Config:\n    y: int\nclass Plain: ...\n"),
            ("b/__init__.py", "class Packed:\n    def packed(self): ...\n"),
            ("b/n.py", "from a.m import Config as C\nimport a.m\nimport a.m as am\nfrom . import m\nfrom .m import Plain\nimport b\n"
             "class Sub(C):\n    x: int\n    def go(self, k): ...\nclass Whole(a.m.Config): ...\nclass Alias(am.Config): ...\nclass Rel(m.Config): ...\n"
             "class Pl(Plain):\n    c: C\n    d: m.Config\nclass Pk(b.Packed): ...\n"),
            ("c.py", "from b.n import Sub\nfrom enum import IntEnum as E\nclass Grand(Sub): ...\nclass Mark(E):\n    A = 1\nclass Kind(Mark):\n    B = 2.5\n"
             "class Oops(OSError): ...\nclass Worse(Oops): ...\nclass Config(dict): ...\n"),
        ], "path string, content string",
    )
    m = mine_structure(files).cache()
    edges = {(r.path, r.class_name, r.base_path, r.base) for r in inherit_edges(m).collect()}
    assert edges == {
        ("a/m.py", "Loop", "a/m.py", "Loop2"), ("a/m.py", "Loop2", "a/m.py", "Loop"), ("b/n.py", "Sub", "a/m.py", "Config"),
        ("b/n.py", "Whole", "a/m.py", "Config"), ("b/n.py", "Alias", "a/m.py", "Config"), ("b/n.py", "Rel", "b/m.py", "Config"),
        ("b/n.py", "Pl", "b/m.py", "Plain"), ("b/n.py", "Pk", "b/__init__.py", "Packed"), ("c.py", "Grand", "b/n.py", "Sub"),
        ("c.py", "Kind", "c.py", "Mark"), ("c.py", "Worse", "c.py", "Oops"),
    }
    grand = {(r.name, r.signature, r.defined_in) for r in methods_for(m, "all").where("class_name = 'Grand'").collect()}
    assert grand == {("go", "go(self, k)", "Sub"), ("far", "far(self)", "Config")}
    fields = {(r.path, r.class_name, r.name) for r in own_fields(m).collect()}
    assert ("b/n.py", "Sub", "x") not in fields and {("a/m.py", "Config", "x"), ("b/m.py", "Config", "y")} <= fields
    assert {(r.path, r.class_name): [f.name for f in r.fields or []] for r in class_inventory(m).where("class_name = 'Config'").collect()} == {
        ("a/m.py", "Config"): ["x"], ("b/m.py", "Config"): ["y"], ("c.py", "Config"): []}
    comp = {(r.class_name, r.target_path, r.target) for r in compose_edges(m).collect()}
    assert comp == {("Pl", "a/m.py", "Config"), ("Pl", "b/m.py", "Config")}
    kinds = {r.class_name: r.class_type for r in classes_with_kind(m).where("path = 'c.py'").collect()}
    assert kinds == {"Grand": "VALUE_OBJECT", "Mark": "ENUM", "Kind": "ENUM", "Oops": "EXCEPTION", "Worse": "EXCEPTION", "Config": "VALUE_OBJECT"}
    assert {(r.class_name, r.name, r.value_type) for r in enum_members(m).collect()} == {("Mark", "A", "int"), ("Kind", "B", "float")}


def test_scope_and_lines_of_inheritance(spark):
    """Analysed bases always count, others under the root unless ignored; interfaces have dotted lines."""
    files = spark.createDataFrame(
        [
            ("app/a.py", "from typing import Protocol\nfrom lib.b import Far\nfrom lib.gen.c import Made\nfrom ext.d import Out\n"
             "class Port(Protocol):\n    def go(self): ...\nclass One(Port): ...\nclass Two(Far): ...\nclass Three(Made): ...\nclass Four(Out): ...\n"),
            ("lib/b.py", "class Top: ...\nclass Far(Top): ...\n"), ("lib/gen/c.py", "class Made: ...\n"), ("ext/d.py", "class Out: ...\n"),
        ], "path string, content string",
    )
    mined, app = mine_structure(files).cache(), files.where("path = 'app/a.py'")
    found = lambda *a: {(r.class_name, r.base, r.line) for r in inherit_lines(mined, *a).collect()}
    inside, far, made, out = ("One", "Port", "dotted"), ("Two", "Far", "solid"), ("Three", "Made", "solid"), ("Four", "Out", "solid")
    assert found() == {inside, far, made, out, ("Far", "Top", "solid")}
    assert found(app) == found(app, "nowhere/") == {inside}
    assert found(app, "lib/") == {inside, far, made}
    assert found(app, "lib/", ("lib/gen",)) == {inside, far}
    assert found(app, "", ("lib/gen", "app/")) == {inside, far, out}
    assert found(app.limit(0), "lib/") == set()


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_kinds_follow_marks_only(spark, monkeypatch):
    """Marks go down through a cycle, from two parents and past a plain class, and no other ancestry is followed."""
    from textloom.operators import structure

    code = "import enum\nclass E(enum.Enum): ...\nclass X(ValueError): ...\nclass P(Protocol): ...\nclass A(B): ...\nclass B(A): ...\nclass M(E, X): ...\nclass N(M): ...\nclass Q(P): ...\nclass R(A, N): ...\nclass K0: ...\n"
    code += "".join(f"class K{k + 1}(K{k}): ...\n" for k in range(12))
    mined = mine_structure(spark.createDataFrame([("a.py", code), ("b.py", "class E(A): ...\nclass F(E): ...\n")], "path string, content string"))
    runs = []
    counted = structure.cut_lineage_counted
    monkeypatch.setattr(structure, "cut_lineage_counted", lambda df: runs.append(1) or counted(df))
    got = {(r.path, r.class_name): (r.is_enum, r.is_exception, r.is_protocol) for r in classes_with_kind(mined).collect()}
    marked = {"E": (True, False, False), "X": (False, True, False), "P": (False, False, True), "M": (True, True, False), "N": (True, True, False), "R": (True, True, False)}
    assert got == {("a.py", c): marked.get(c, (False, False, False)) for c in [*"EXPABMNQR", *(f"K{k}" for k in range(13))]} | {("b.py", c): (False, False, False) for c in "EF"}
    assert len(runs) <= 5  # R is three steps below E; K12 is twelve below K0
