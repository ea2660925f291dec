"""Tree layouts and common roots on small lists; the expected trees are drawn by hand."""

from textloom.operators.tree import common_host, tree_map

URLS = [
    "https://garden.test/herbs",
    "https://garden.test/herbs/sage",
    "https://garden.test/tools/spade/short",
    "https://garden.test/herbs/mint/wild",
    "https://garden.test/tools/rake",
]
URL_LAYOUT = (
    "garden.test\n├── herbs\n│   ├── sage\n│   └── mint\n│       └── wild\n└── tools\n    ├── spade\n    │   └── short\n    └── rake\n"
)
PATHS = [
    "/srv/music/scores/bach.pdf",
    "/srv/music/takes",
    "/srv/music/takes/mono/one.wav",
    "/srv/music/scores/solo/suite.pdf",
    "/srv/music/takes/two.wav",
]
PATH_LAYOUT = (
    "music\n├── scores\n│   ├── bach.pdf\n│   └── solo\n│       └── suite.pdf\n└── takes\n    ├── mono\n    │   └── one.wav\n    └── two.wav\n"
)


def _df(spark, items):
    return spark.createDataFrame([(1, p, i) for i, p in enumerate(items)], "g int, path string, ord long")


def test_url_layout(spark):
    t = tree_map(_df(spark, URLS), ["g"]).first()
    assert t.layout == URL_LAYOUT
    assert t.title == "Web Site Map: garden.test"


def test_path_layout_with_and_without_root(spark):
    t = tree_map(_df(spark, PATHS), ["g"]).first()
    assert t.layout == PATH_LAYOUT
    assert t.title == "Directory Structure Chart: /srv/music"
    assert tree_map(_df(spark, PATHS), ["g"], root="/srv/music").first().layout == PATH_LAYOUT


def test_common_host_single_and_multiple(spark):
    more = URLS + ["https://orchard.test/apple", "https://orchard.test/pear/late"]
    one = common_host(_df(spark, URLS).withColumnRenamed("path", "url"), ["g"]).first().common_host
    many = common_host(_df(spark, more).withColumnRenamed("path", "url"), ["g"]).first().common_host
    assert one == "garden.test" and many is None
