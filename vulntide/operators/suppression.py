"""Suppressed issues: same hash, and no expiry or an expiry after ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import FINDING_HASH
from ..session import materialise


def _now(as_of: Column | None) -> Column:
    return F.current_timestamp() if as_of is None else as_of


def live(expiry: Column, as_of: Column | None = None) -> Column:
    """An expiry equal to ``as_of`` has passed."""
    return expiry.isNull() | (expiry > _now(as_of))


def any_live_match(issues: Column, issue_hash: Column, as_of: Column | None = None) -> Column:
    return F.coalesce(
        F.exists(
            issues,
            lambda s: (s.getField("issue_hash") == issue_hash)
            & live(s.getField("expiry_date"), as_of),
        ),
        F.lit(False),
    )


def apply_suppressions(findings: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Set ``suppressed`` from the list that the finding's own report carried."""
    flag = any_live_match(F.col("suppressed_issues"), F.col("issue_hash"), as_of)
    hashed = findings.withColumn("issue_hash", F.expr(FINDING_HASH))
    return hashed.withColumn("suppressed", flag)


def live_suppressions(suppressions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Distinct (application, hash) pairs with at least one live suppression, stored.

    Stored, the pairs have a known size and, if it is large, a shuffle of their own in the
    join. Adaptive execution splits a hot key only between two plain shuffles, and would
    not where one side comes straight from an aggregate.
    """
    kept = suppressions.filter(live(F.col("expiry_date"), as_of))
    pairs = kept.select("application_name", F.lower("issue_hash").alias("issue_hash"))
    return materialise(pairs.distinct(), "suppressions")


def _split(
    findings: DataFrame, suppressions: DataFrame, as_of: Column | None, how: str
) -> DataFrame:
    hashed = findings.withColumn("issue_hash", F.expr(FINDING_HASH))
    pairs = live_suppressions(suppressions, as_of)
    return hashed.join(pairs, ["application_name", "issue_hash"], how)


def suppressed_by_table(
    findings: DataFrame, suppressions: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Findings a suppression table covers."""
    return _split(findings, suppressions, as_of, "left_semi")


def unsuppressed_by_table(
    findings: DataFrame, suppressions: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Findings a suppression table leaves open."""
    return _split(findings, suppressions, as_of, "left_anti")


def unsuppressed(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("suppressed"))
