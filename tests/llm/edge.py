"""Tables that hold what operators must withstand."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{k % 977} und {k}" for k in range(30_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, spans int, node string, score string, h int, shard string, __marked string, __id int, __text string, __email int"
ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (None, "a null id with words enough to count"), (None, None),
    (4, "same text twice in the table, row for row"), (4, "same text twice in the table, row for row"),
    (5, "same text twice in the table, row for row"), (6, "x" * 50_000), (7, LONG), (8, "Ünï ©ödé 中文 😀 \u0000 ▁ <s>"),
    (9, "one"), (10, "one two three"),
]


def edge_docs(spark):
    rows = [(i, t, None, "s", None, "clash", 1, "clash", "clash", 2, "clash", "m", 3, "x", 4) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def no_docs(spark):
    return edge_docs(spark).where(F.lit(False))
