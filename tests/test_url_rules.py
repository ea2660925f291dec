"""URL rules, formatted page blocks and size totals on small literal tables."""

from pyspark.sql import functions as F

from textloom.functions.text import format_content
from textloom.functions.urls import normalize_url
from textloom.operators.predicates import url_ignore, url_scope

PAGES = [
    ("https://boats.test/", "Sloops and ketches", 3, 18),
    ("https://boats.test/knots", "Bowline, reef knot", 4, 18),
    ("https://boats.test/tides", "High water at noon", 6, 18),
]


def test_normalize_scope_ignore(spark):
    df = spark.createDataFrame([("http://boats.test/knots?page=2#top",), ("http://boats.test/knots#end?x",)], "u string")
    assert [r.n for r in df.select(normalize_url("u").alias("n")).collect()] == ["http://boats.test/knots"] * 2
    urls = ["http://boats.test/knots", "http://boats.test/knotsandbends", "http://boats.test/tides", "http://other.test/knots"]
    u = spark.createDataFrame([(x,) for x in urls], "url string")
    assert sorted(r.url for r in url_scope(u, "url", ["http://boats.test/knots"]).collect()) == urls[:2]
    assert sorted(r.url for r in url_ignore(u, "url", ["/knots"]).collect()) == ["http://boats.test/tides"]


def test_page_blocks_and_totals(spark):
    df = spark.createDataFrame(PAGES, "url string, content string, token_size long, char_size long")
    blocks = [r.b for r in df.select(format_content("url", "content", "doc").alias("b")).collect()]
    assert blocks[1] == '\n### https://boats.test/knots\n"""\nBowline, reef knot\n"""\n'
    tot = df.agg(F.sum("token_size").alias("t"), F.sum("char_size").alias("c")).first()
    assert (tot.t, tot.c) == (13, 54)
