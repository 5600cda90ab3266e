"""Session set-up, table access and staged tables.

``cut`` ends a lineage by writing a parquet table into the folder named by
``spark.checkpoint.dir``, which all executors share.  The table survives the loss of
executors, is compressed and columnar, and gives the planner true sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def build_session(app: str = "shelfspark", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stage_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where none is named and all runs in one process."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if named:
        return named.rstrip("/")
    own = getattr(spark.sparkContext, "_shelf_stage_dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="shelf-stage-")
        spark.sparkContext._shelf_stage_dir = own
    return own


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again; the plan starts anew from there."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shelf_stage = path
    return out


def discard(*staged: DataFrame) -> None:
    """Removes tables made by ``cut`` that no later plan reads."""
    for df in staged:
        path = getattr(df, "_shelf_stage", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
