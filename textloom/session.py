"""Session helpers: local session for tests/bench, table loading, checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "textloom") -> SparkSession:
    """A local session configured the way the jobs expect (AQE on, UI off, Arrow on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder and is used as is. Only when it
    is unset (local tests) do we create a scratch folder for it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            # a machine-local folder would not survive executor loss on a cluster
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        conf_dir = tempfile.mkdtemp(prefix="textloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends in here go at once. Else they stay until the driver's JVM happens to collect
    its garbage, and lie on the disks beside those of all later queries."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a parquet table under the shared checkpoint folder and reading
    it back: one job, and the result survives executor loss (unlike local checkpoints)."""
    return cut_lineage_counted(df)[0]


def cut_lineage_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`cut_lineage` that also returns the row count, observed during the write
    (no extra job). Nothing reads the shuffles of the write again, so they go with it."""
    import uuid

    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    with shuffles_go(spark):
        df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    n = int(obs.get.get("n", 0) or 0)
    return spark.read.parquet(path), n


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables as :func:`cut_lineage` returned them. Nothing that is still to run may read them."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        own = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables").toUri().getPath()
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().toUri().getPath() == own:
                path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
