"""Tables written by loops, and what they leave on the disks."""

import time

from pyspark.sql import functions as F

from textloom.session import cut_lineage, cut_lineage_counted, drop_tables

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffles(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for k in range(blocks.size()) if (b := blocks.apply(k).name()).startswith("shuffle_")}


def test_shuffles_of_a_written_table_go_with_the_write(spark):
    before = shuffles(spark)
    out, n = cut_lineage_counted(spark.range(0, 20000, 1, 4).groupBy((F.col("id") % 7000).alias("k")).count().repartition(5, "count"))
    until = time.time() + 10
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles(spark) - before
    assert n == 7000 and out.agg(F.sum("count")).first()[0] == 20000


def test_the_session_keeps_its_own_choice(spark):
    for own in (None, "false", "true"):
        if own:
            spark.conf.set(KEY, own)
        cut_lineage(spark.range(3))
        assert spark.conf.get(KEY, None) == own
    spark.conf.unset(KEY)


def test_only_tables_of_cuts_are_dropped(spark, tmp_path):
    kept, spent, empty = cut_lineage(spark.range(5)), cut_lineage(spark.range(6)), cut_lineage(spark.range(0))
    spark.range(4).write.parquet(f"{tmp_path}/own")
    own = spark.read.parquet(f"{tmp_path}/own")
    files = spent.inputFiles()
    drop_tables(spent, empty, own)
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert kept.count() == 5 and spark.read.parquet(f"{tmp_path}/own").count() == 4
