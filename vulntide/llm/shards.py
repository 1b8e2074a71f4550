"""Sharding by a two-pass external shuffle. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import materialise, new_folder

SHARDS = 16
BUCKET_BYTES = 16 << 20
TASK_BYTES = 64 << 20
SEED = 7_919

_NEW = ["shard", "slot"]


def record_size(text: str) -> F.Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def shuffled_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    doc_id: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """``docs`` in random order, dealt to ``shards`` shards: adds ``shard`` and ``slot``.

    First pass: a seeded hash of id and text scatters the rows into buckets of about
    ``bucket_bytes``. Second pass: each bucket, put in a fixed order, is shuffled by
    Fisher-Yates (the engine's ``shuffle``). Buckets are dealt to a number of tasks that the
    table's size alone decides, ``task_bytes`` each on average, and each task takes its own in
    order, so the order of the rows depends on them and on ``seed``, not on the cluster.
    Texts are only sized and hashed, so their length does not matter. A row's place in the whole order is its place
    in its bucket plus the rows of all buckets before; place ``p`` goes to shard ``p %
    shards``, slot ``p // shards``. So the law is ``rows``: counts differ by one at most and
    slots have no gaps.

    Null ids, null texts and repeated rows are rows like others; rows equal in id and text
    share a bucket unless they would fill one: then they are numbered, and the number is
    hashed too. More shards than rows leave shards empty; an empty table gives an empty
    table. Columns named ``shard`` or ``slot`` are replaced.
    """
    rows = docs.drop(*[c for c in docs.columns if c.lower() in _NEW])
    total = rows.agg(F.sum(record_size(text))).first()[0] or 0
    buckets, tasks = (max(1, math.ceil(total / size)) for size in (bucket_bytes, task_bytes))
    draw = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    keyed = rows.select(draw.alias("draw"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    alike = rows.groupBy(draw.alias("draw")).agg(F.count(F.lit(1)).alias("rows"), F.sum(record_size(text)).alias("bytes"))
    large = materialise(alike.where((F.col("rows") > 1) & (F.col("bytes") > bucket_bytes)).select("draw"), "shard-copies")
    if not large.isEmpty():
        spread = _numbered(keyed.join(large, "draw", "left_semi"))
        spread = spread.select(F.xxhash64("draw", "number").alias("draw"), "row")
        keyed = keyed.join(large, "draw", "left_anti").union(spread)
    bucket = F.pmod("draw", F.lit(buckets)).cast("int")
    counts = keyed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long"))
    bases = materialise(counts.withColumn("base", base).select("bucket", "base"), "shard-bases")
    scattered = keyed.select(bucket.alias("bucket"), "draw", "row").repartition(tasks, "bucket")
    gathered = scattered.groupBy("bucket").agg(F.collect_list(F.struct("draw", "row")).alias("records"))
    shuffled = (
        gathered.withColumn("records", F.array_sort("records", _by_draw))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    )
    permuted = shuffled.join(bases, "bucket").select("base", F.posexplode("records").alias("place", "record"))
    place = F.col("base") + F.col("place")
    return permuted.select(
        "record.row.*",
        (place % shards).cast("int").alias("shard"),
        F.floor(place / shards).cast(LongType()).alias("slot"),
    )


def _numbered(keyed: DataFrame) -> DataFrame:
    """``draw, number, row``: rows of one draw numbered from 0, in their input partitions first.

    The rows are stored once, so that each keeps its number whenever it is read.
    """
    at = [F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")]
    stored = materialise(keyed.select("draw", "row", *at), "shard-numbers")
    earlier = Window.partitionBy("draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("draw", "part").agg(F.count(F.lit(1)).alias("rows"))
    bases = parts.select("draw", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("draw", "part").orderBy("at"))
    numbered = stored.withColumn("within", within).join(bases, ["draw", "part"])
    return numbered.select("draw", (F.col("base") + F.col("within") - 1).alias("number"), "row")


def _by_draw(left: F.Column, right: F.Column) -> F.Column:
    a, b = left["draw"], right["draw"]
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def write_shards(sharded: DataFrame) -> str:
    """Write a folder of Parquet files per shard, in slot order; gives the folder."""
    folder = new_folder(sharded.sparkSession, "shards")
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return folder


def read_shards(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The rows of written shards, with the columns of ``like``."""
    return spark.read.schema(like.schema).parquet(folder).select(*like.columns)
