"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# A folder for the tables of some piece of work, below the shared one.
SCRATCH_DIR = "vulntide.scratch.dir"

# Runtime SQL settings. AQE turns shuffled joins into broadcast joins from the measured
# size of a side, and splits partitions that one hot key makes too large.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A repeated object key keeps its last value instead of making the document invalid.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Shuffle files go when their query ends, not when the driver next collects garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vulntide")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a folder in the warehouse, which the executors share as well. No
    temporary folder of a machine is ever taken.
    """
    folder = spark.conf.get(SCRATCH_DIR, None) or checkpoint_dir(spark)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/vulntide/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the stored table.

    This cuts the lineage of iterative operators. The table outlives executors, so a
    lost one never forces earlier rounds to run again.
    """
    return stored(df, new_folder(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path``, as small as Parquet makes it, and read from there."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, stored; the tables that were stored on the way go at once."""
    path = new_folder(spark, name)
    with scratch(spark):
        return stored(build(), path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a stored table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators store inside go when it ends.

    For work that ends with a write of its own, such as a micro-batch of a stream: the
    scratch folder of the session is one of its own meanwhile.
    """
    before = spark.conf.get(SCRATCH_DIR, None)
    folder = new_folder(spark, "scratch")
    spark.conf.set(SCRATCH_DIR, folder)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SCRATCH_DIR)
        else:
            spark.conf.set(SCRATCH_DIR, before)
        drop_folder(spark, folder)
