"""Exact ranks and quantiles, without collecting a group or a table into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def grouped_quantiles(
    df: DataFrame, group: str, value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles of groups of any size, a column per name.

    Nulls have no rank; a group of nulls alone has null quantiles. Equal values are counted first, the counts are range-partitioned by (group, value), and a
    running count gives each value its ranks: within a partition by a window over that
    partition, across partitions by the partitions' totals. A large group spreads over as
    many partitions as it needs.
    """
    counts = df.groupBy(group, value).agg(F.count(value).alias("n"))
    parted = materialise(
        counts.repartitionByRange(group, value).withColumn("part", F.spark_partition_id()),
        "quantiles",
    )
    totals = parted.groupBy(group, "part").agg(F.sum("n").alias("part_n"))
    before = Window.partitionBy(group).orderBy("part")
    offsets = totals.select(
        group,
        "part",
        (F.sum("part_n").over(before) - F.col("part_n")).alias("offset"),
        F.sum("part_n").over(Window.partitionBy(group)).alias("total"),
    )
    within = Window.partitionBy(group, "part").orderBy(value)
    ranked = parted.join(offsets, [group, "part"]).select(
        group,
        value,
        "total",
        (F.col("offset") + F.sum("n").over(within)).alias("upper"),
        (F.col("offset") + F.sum("n").over(within) - F.col("n")).alias("lower"),
    )

    def at(rank):
        return F.max(F.when((F.col("lower") <= rank) & (rank < F.col("upper")), F.col(value)))

    picks, columns = [], []
    for name, p in probabilities.items():
        rank = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(rank), F.ceil(rank)
        picks += [
            at(low).alias(f"{name}_low"),
            at(high).alias(f"{name}_high"),
            F.max(rank - low).alias(f"{name}_part"),
        ]
        columns.append(
            (
                F.col(f"{name}_low")
                + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")
            ).alias(name)
        )
    return ranked.groupBy(group).agg(*picks).select(group, *columns)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Number the rows from 1 in a total order.

    Rows are range-partitioned, numbered within their partition, and shifted by the row
    counts of the partitions before. An unpartitioned window would sort everything in one
    task; here only the list of partition counts does.
    """
    parted = materialise(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered"
    )
    counts = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_shift")
    )
    within = Window.partitionBy("_part").orderBy(*order)
    shifted = parted.join(shifts, "_part")
    number = F.row_number().over(within) + F.col("_shift")
    return shifted.withColumn(name, number).drop("_part", "_shift")
