"""Questions about findings: counts, remediation times, risk, trends."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import seconds_between
from ..session import materialise
from .commits import next_commit
from .ranking import grouped_quantiles, numbered
from .skew import salted_join

APP = "application_name"
SKETCH_LOG_SIZE = 12
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def events_per_app(findings: DataFrame) -> DataFrame:
    return findings.groupBy(APP).agg(F.count(F.lit(1)).alias("n_events"))


def one_application(findings: DataFrame, name: str) -> DataFrame:
    return findings.filter(F.col(APP) == name)


def cves_only(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("advisory_id").startswith("CVE"))


def distinct_cves(findings: DataFrame) -> DataFrame:
    return cves_only(findings).select("advisory_id").distinct()


def cves_per_app(findings: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct CVEs per application; the sketch is there for dashboards, not the default."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return cves_only(findings).groupBy(APP).agg(count("advisory_id").alias("n_cves"))


def cve_sketches(findings: DataFrame, log_size: int = SKETCH_LOG_SIZE) -> DataFrame:
    """A sketch of the distinct CVEs per application and day, to be stored and merged.

    Sketches of disjoint or overlapping findings add up, so a day's findings are read once
    and any range of days is answered from a few kilobytes per day.
    """
    day = F.to_date("timestamp").alias("day")
    return cves_only(findings).groupBy(APP, day).agg(F.hll_sketch_agg("advisory_id", log_size).alias("sketch"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of equal application and day as one, such as those of several batches."""
    return sketches.groupBy(APP, "day").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated_cves(sketches: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Distinct CVEs per application from ``first`` to ``last``, estimated.

    At the default size, 2 ** 12 registers, the standard error is below 2 per cent; small
    counts are exact.
    """
    if first is not None:
        sketches = sketches.where(F.col("day") >= first)
    if last is not None:
        sketches = sketches.where(F.col("day") <= last)
    return sketches.groupBy(APP).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_cves"))


def first_last_seen(findings: DataFrame) -> DataFrame:
    """First and last sighting of each CVE per application, ties broken by event id.

    Least and greatest struct combine on the map side, so a hot key sends a row per task;
    within a task Spark sorts the rows of a split by key to do so.
    """
    sighting = F.struct("timestamp", "event_id", "git_commit_hash")
    ends = cves_only(findings).groupBy(APP, "advisory_id").agg(
        F.min(sighting).alias("first"), F.max(sighting).alias("last")
    )
    return ends.select(
        APP,
        "advisory_id",
        F.col("first.git_commit_hash").alias("first_commit"),
        F.col("last.git_commit_hash").alias("last_commit"),
        F.col("first.timestamp").alias("first_seen"),
        F.col("last.timestamp").alias("last_seen"),
    )


def locate_fix(seen: DataFrame, branch_commits: DataFrame) -> DataFrame:
    """Add ``fixing_commit`` and ``fix_date``, null when the last sighting has no successor."""
    following = next_commit(branch_commits).withColumnRenamed("commit_id", "last_commit")
    return seen.join(following, [APP, "last_commit"], "left")


def join_publication(seen: DataFrame, published: DataFrame) -> DataFrame:
    """Add ``cve_date``, null for a CVE that no feed lists."""
    dates = published.select(
        F.col("cve_id").alias("advisory_id"), F.col("published").alias("cve_date")
    )
    return seen.join(dates, "advisory_id", "left")


def complete_rows(rows: DataFrame) -> DataFrame:
    """Drop rows with any null. The optimiser turns the left joins before it into inner ones."""
    return rows.na.drop("any")


def remediation_times(
    findings: DataFrame, branch_commits: DataFrame, published: DataFrame
) -> DataFrame:
    """Per (application, CVE): first commit, fixing commit, dates and seconds to remediate.

    The sightings are stored, so that what the findings shuffled is gone when they are joined.
    """
    seen = first_last_seen(findings).select(APP, "advisory_id", "first_commit", "last_commit")
    located = locate_fix(materialise(seen, "seen"), branch_commits)
    rows = complete_rows(
        join_publication(located, published).select(
            APP, "advisory_id", "first_commit", "fixing_commit", "fix_date", "cve_date"
        )
    )
    return rows.withColumn(
        "remediation_time", F.col("fix_date") - F.col("cve_date")
    ).withColumn("seconds", F.expr(seconds_between("cve_date", "fix_date")))


def positive_remediation(rows: DataFrame) -> DataFrame:
    """Fixes made before the CVE was published are no remediation."""
    return rows.filter(F.col("seconds") > 0)


def remediated_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy(APP).agg(F.count_if(F.col("seconds") > 0).alias("n_remediated"))


def remediation_stats(rows: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of positive remediation times.

    The times are stored first, one row per application and CVE, so that the findings
    behind them are read once and not for each statistic.
    """
    positive = materialise(positive_remediation(rows).select(APP, "seconds"), "times")
    moments = positive.groupBy(APP).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("seconds").alias("mean"),
        F.stddev_samp("seconds").alias("std"),
        F.min("seconds").alias("min"),
        F.max("seconds").alias("max"),
    )
    return moments.join(grouped_quantiles(positive, APP, "seconds", QUARTILES), APP)


def mean_time_to_remediate(rows: DataFrame) -> DataFrame:
    return positive_remediation(rows).groupBy(APP).agg(
        F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean_seconds")
    )


def slow_to_fix(stats: DataFrame, threshold_seconds: float) -> DataFrame:
    return stats.filter(F.col("mean") > threshold_seconds)


def slowest_fix(rows: DataFrame) -> DataFrame:
    """The CVE that took longest per application; ties fall to the greater id."""
    longest = F.max(F.struct("seconds", "advisory_id", "fixing_commit")).alias("longest")
    return positive_remediation(rows).groupBy(APP).agg(longest).select(APP, "longest.*")


def riskiest_apps(findings: DataFrame) -> DataFrame:
    """Applications by vulnerable dependencies, with their CVSS scores.

    The same package version reported many times counts once, at its highest score. Scores
    add up as decimals, so that the order of the rows does not show in the sums.
    """
    dependency = findings.groupBy(APP, "affected_package", "installed_version").agg(
        F.max("cvss.score").cast("decimal(9,4)").alias("score")
    )
    totals = dependency.groupBy(APP).agg(
        F.count(F.lit(1)).alias("n_dependencies"),
        F.max("score").cast("double").alias("max_score"),
        F.count("score").alias("_scored"),
        F.coalesce(F.sum("score").cast("double"), F.lit(0.0)).alias("total_score"),
    )
    average = F.when(F.col("_scored") > 0, F.col("total_score") / F.col("_scored"))
    return totals.withColumn("avg_score", average).drop("_scored")


def ranked_risk(risk: DataFrame) -> DataFrame:
    """Add ``risk_rank``, 1 for the greatest total score."""
    return numbered(risk, "risk_rank", F.desc("total_score"), F.col(APP))


def trend(findings: DataFrame, width: str = "30 days") -> DataFrame:
    """Findings per application and time window, on batch and stream alike."""
    return findings.groupBy(APP, F.window("timestamp", width).alias("span")).agg(
        F.count(F.lit(1)).alias("n_findings")
    )


def sample_per_app(findings: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows per application by time.

    Each application is numbered within each partition of the input first, so a task sorts
    no more of a large application than a partition holds, and only n rows of each part go
    on, whatever n is.
    """
    order = ["timestamp", "event_id"]
    parted = findings.withColumn("_part", F.spark_partition_id())
    first = Window.partitionBy(APP, "_part").orderBy(*order)
    few = parted.withColumn("row", F.row_number().over(first)).filter(F.col("row") <= n).drop("_part")
    last = Window.partitionBy(APP).orderBy(*order)
    return few.withColumn("row", F.row_number().over(last)).filter(F.col("row") <= n)


def lineage(findings: DataFrame, reports: DataFrame, heavy: Iterable[str] = ()) -> DataFrame:
    """Findings beside the tool and environment of the report they came from.

    ``heavy`` names reports with so many findings that the plan is to spread them.
    """
    source = reports.select(F.col("event_id").alias("_report"), "tool_name", "tool_version", "environment")
    joined = salted_join(findings, source, F.col("parent_event_id"), F.col("_report"), list(heavy), "inner").drop("_report")
    first = ["parent_event_id", *(c for c in findings.columns if c != "parent_event_id")]
    return joined.select(*first, "tool_name", "tool_version", "environment")


def orphans(findings: DataFrame, reports: DataFrame) -> DataFrame:
    known = reports.select(F.col("event_id").alias("parent_event_id"))
    return findings.join(known, "parent_event_id", "left_anti")


def reports_with_findings(reports: DataFrame, findings: DataFrame) -> DataFrame:
    parents = findings.select(F.col("parent_event_id").alias("event_id")).distinct()
    return reports.join(parents, "event_id", "left_semi")
