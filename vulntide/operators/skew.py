"""Joins whose heavy keys are found beforehand and spread by a salt, on their own and visibly.

Adaptive execution splits a hot partition from what it measures. This is the way that does
not depend on it: a sketch of the keys names the heavy ones, at most as many as their least
share allows, and the plan spreads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is heavy from this share of the rows on, so at most 200 are.
LEAST_SHARE = 0.005
# Counters of the sketch: its counts are off by at most a few rows in so many.
COUNTERS = 4096
SALTS = 32


def heavy_keys(rows: DataFrame, key: Column | str, least_share: float = LEAST_SHARE) -> list:
    """Keys that hold at least ``least_share`` of the rows; nulls are none.

    One pass over the key alone, by a frequent-items sketch of fixed size whose parts merge.
    What comes to the driver is bounded by ``1 / least_share`` keys. The sketch never misses a
    heavy key; one slightly below the share may be named too, which costs a copy and no row.
    """
    most = int(1 / least_share) + 1
    named = rows.select((F.col(key) if isinstance(key, str) else key).alias("k")).where("k IS NOT NULL")
    found = named.agg(
        F.expr(f"approx_top_k(k, {most}, {max(COUNTERS, 8 * most)})").alias("top"), F.count(F.lit(1)).alias("rows")
    ).first()
    # Counts are upper estimates, so none is missed.
    return sorted(item["item"] for item in found["top"] or [] if item["count"] >= least_share * found["rows"])


def salted_join(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, heavy: list, how: str = "left", salts: int = SALTS
) -> DataFrame:
    """``left`` joined to ``right`` on one key; rows of heavy keys spread over ``salts`` partitions.

    Left rows of a heavy key take one of the salts by a hash of the whole row's number, right
    rows of a heavy key are there once per salt, and all other rows have the salt 0. So each
    pair meets once, for inner, left, semi and anti joins alike. No heavy key, no salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no salted {how} join")
    if not heavy:
        return left.join(right, left_key == right_key, how)
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    spread = left.withColumn("_salt", F.when(left_key.isin(heavy), drawn).otherwise(F.lit(0)))
    copies = F.when(right_key.isin(heavy), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.withColumn("_copy", F.explode(copies))
    return spread.join(copied, (left_key == right_key) & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy")
