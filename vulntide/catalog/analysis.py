"""Queries: commits, remediation, risk, trends, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..operators import analytics, commits as history
from ..plans.pipelines import remediation
from ..session import materialise, new_folder, settled
from ..sinks import writers
from ..sources import readers
from . import oracles as o
from .registry import commits, cve_table, findings, flat_cvss, micros, query, reports

SLOW_SECONDS = 60 * 60 * 24 * 365


def _times(spark, sf_dir):
    # The commits are a stored table in use; here they are derived, so store them.
    log = materialise(commits(spark, sf_dir), "commits")
    return remediation(findings(spark, sf_dir), log, cve_table(spark, sf_dir))


def _stats(spark, sf_dir):
    rows = analytics.remediation_stats(_times(spark, sf_dir))
    rounded = [F.round(c, 3).alias(c) for c in ("mean", "std", "p25", "p50", "p75")]
    return rows.select("application_name", "n", *rounded, "min", "max")


@query("remediation_stats", duck(o.STATS, **o.REMEDIATION))
def remediation_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(
    "mean_time_to_remediate",
    duck(
        "SELECT application_name, count(*) AS n, round(avg(seconds), 3) AS mean_seconds "
        "FROM times WHERE seconds > 0 GROUP BY application_name",
        **o.REMEDIATION,
    ),
)
def mean_time_to_remediate(spark, sf_dir):
    rows = analytics.mean_time_to_remediate(_times(spark, sf_dir))
    return rows.withColumn("mean_seconds", F.round("mean_seconds", 3))


@query(
    "slow_to_fix",
    duck(f"SELECT * FROM ({o.STATS}) s WHERE mean > {SLOW_SECONDS}", **o.REMEDIATION),
)
def slow_to_fix(spark, sf_dir):
    return analytics.slow_to_fix(_stats(spark, sf_dir), SLOW_SECONDS)


@query(
    "remediation_times",
    duck(
        "SELECT application_name, advisory_id, first_commit, fixing_commit, epoch_us(fix_date) AS fix_date, "
        "epoch_us(cve_date) AS cve_date, seconds FROM times",
        **o.REMEDIATION,
    ),
)
def remediation_times(spark, sf_dir):
    return _times(spark, sf_dir).select(
        "application_name", "advisory_id", "first_commit", "fixing_commit", micros("fix_date"),
        micros("cve_date"), "seconds",
    )


@query(
    "positive_remediation",
    duck(
        "SELECT application_name, advisory_id, seconds FROM times WHERE seconds > 0", **o.REMEDIATION
    ),
)
def positive_remediation(spark, sf_dir):
    rows = analytics.positive_remediation(_times(spark, sf_dir))
    # The interval column carries the same length as the number.
    length = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.col("remediation_time")) / 1_000_000
    return rows.select("application_name", "advisory_id", length.alias("seconds"))


@query(
    "remediated_count",
    duck(
        "SELECT application_name, count(*) FILTER (seconds > 0) AS n_remediated "
        "FROM times GROUP BY application_name",
        **o.REMEDIATION,
    ),
)
def remediated_count(spark, sf_dir):
    return analytics.remediated_count(_times(spark, sf_dir))


@query(
    "slowest_fix",
    duck(
        "SELECT application_name, max(seconds) AS seconds, "
        "arg_max(advisory_id, row(seconds, advisory_id)) AS advisory_id, "
        "arg_max(fixing_commit, row(seconds, advisory_id)) AS fixing_commit "
        "FROM times WHERE seconds > 0 GROUP BY application_name",
        **o.REMEDIATION,
    ),
)
def slowest_fix(spark, sf_dir):
    return analytics.slowest_fix(_times(spark, sf_dir))


@query(
    "first_last_seen",
    duck(
        "SELECT application_name, advisory_id, first_commit, last_commit, epoch_us(first_seen) AS first_seen, "
        "epoch_us(last_seen) AS last_seen FROM seen",
        seen=o.SEEN,
    ),
)
def first_last_seen(spark, sf_dir):
    return analytics.first_last_seen(findings(spark, sf_dir)).select(
        "application_name", "advisory_id", "first_commit", "last_commit",
        micros("first_seen"), micros("last_seen"),
    )


@query(
    "join_publication",
    duck(
        "SELECT s.application_name, s.advisory_id, epoch_us(c.published) AS cve_date "
        "FROM seen s LEFT JOIN fx_cve c ON c.cve_id = s.advisory_id",
        seen=o.SEEN,
    ),
)
def join_publication(spark, sf_dir):
    listed = view(spark, sf_dir, "fx_cve")
    rows = analytics.join_publication(analytics.first_last_seen(findings(spark, sf_dir)), listed)
    return rows.select("application_name", "advisory_id", micros("cve_date"))


@query(
    "locate_commit",
    duck(
        "SELECT s.application_name, s.advisory_id, s.last_commit, n.fixing_commit, m.seq "
        "FROM seen s LEFT JOIN main m ON m.application_name = s.application_name AND m.commit_id = s.last_commit "
        "LEFT JOIN following n ON n.application_name = s.application_name AND n.commit_id = s.last_commit",
        main=o.MAIN, following=o.NEXT, seen=o.SEEN,
    ),
)
def locate_commit(spark, sf_dir):
    log = materialise(commits(spark, sf_dir), "commits")
    sequence = settled(spark, "sequence", lambda: history.first_parent_sequence(log))
    key = ["application_name", "commit_id"]
    branch = log.join(sequence.select(*key), key, "left_semi")
    seen = analytics.first_last_seen(findings(spark, sf_dir)).select("application_name", "advisory_id", "last_commit")
    seen = materialise(seen, "seen")
    located = analytics.locate_fix(seen, branch).withColumnRenamed("last_commit", "commit_id")
    placed = located.join(sequence, key, "left").withColumnRenamed("commit_id", "last_commit")
    return placed.select("application_name", "advisory_id", "last_commit", "fixing_commit", "seq")


@query("first_parent_sequence", duck("SELECT application_name, commit_id, seq FROM main", main=o.MAIN))
def first_parent_sequence(spark, sf_dir):
    return history.first_parent_sequence(commits(spark, sf_dir))


@query(
    "next_commit",
    duck(
        "SELECT application_name, commit_id, fixing_commit, epoch_us(fix_date) AS fix_date "
        "FROM following WHERE fixing_commit IS NOT NULL",
        main=o.MAIN, following=o.NEXT,
    ),
)
def next_commit(spark, sf_dir):
    rows = history.next_commit(history.mainline(commits(spark, sf_dir)))
    return rows.withColumn("fix_date", F.unix_micros("fix_date"))


@query(
    "complete_rows",
    duck(
        "SELECT event_id, git_branch, cvss_score FROM (SELECT event_id, git_branch, "
        "round(CAST(cvss_score AS DOUBLE), 4) AS cvss_score FROM fx_findings) f "
        "WHERE git_branch IS NOT NULL AND cvss_score IS NOT NULL"
    ),
)
def complete_rows(spark, sf_dir):
    rows = findings(spark, sf_dir).select("event_id", "git_branch", flat_cvss()[1])
    return analytics.complete_rows(rows)


@query(
    "read_findings",
    duck(
        "SELECT event_id, parent_event_id, application_name, epoch_us(timestamp) AS timestamp, advisory_id, "
        "cvss_version, round(CAST(cvss_score AS DOUBLE), 4) AS cvss_score, suppressed FROM fx_findings"
    ),
)
def read_findings(spark, sf_dir):
    path = new_folder(spark, "findings")
    writers.append_findings(findings(spark, sf_dir), path)
    return readers.read_findings(spark, path).select(
        "event_id", "parent_event_id", "application_name", micros("timestamp"), "advisory_id",
        *flat_cvss(), "suppressed",
    )


@query(
    "events_per_app",
    duck("SELECT application_name, count(*) AS n_events FROM fx_findings GROUP BY application_name"),
)
def events_per_app(spark, sf_dir):
    return analytics.events_per_app(findings(spark, sf_dir))


@query(
    "one_application",
    duck("SELECT event_id, advisory_id FROM fx_findings WHERE application_name = 'app-0'"),
)
def one_application(spark, sf_dir):
    return analytics.one_application(findings(spark, sf_dir), "app-0").select("event_id", "advisory_id")


@query("cves_only", duck("SELECT event_id, advisory_id FROM fx_findings WHERE starts_with(advisory_id, 'CVE')"))
def cves_only(spark, sf_dir):
    return analytics.cves_only(findings(spark, sf_dir)).select("event_id", "advisory_id")


@query(
    "distinct_cves",
    duck("SELECT DISTINCT advisory_id FROM fx_findings WHERE starts_with(advisory_id, 'CVE')"),
)
def distinct_cves(spark, sf_dir):
    return analytics.distinct_cves(findings(spark, sf_dir))


@query(
    "cves_per_app",
    duck(
        "SELECT application_name, count(DISTINCT advisory_id) AS n_cves FROM fx_findings "
        "WHERE starts_with(advisory_id, 'CVE') GROUP BY application_name"
    ),
)
def cves_per_app(spark, sf_dir):
    return analytics.cves_per_app(findings(spark, sf_dir))


@query(
    "estimated_cves",
    duck(
        "SELECT application_name, count(DISTINCT advisory_id) AS n_cves, TRUE AS close FROM fx_findings "
        "WHERE starts_with(advisory_id, 'CVE') AND timestamp >= TIMESTAMP '1994-01-01' AND timestamp < TIMESTAMP '1996-01-01' "
        "GROUP BY application_name"
    ),
)
def estimated_cves(spark, sf_dir):
    """Estimates of two years, from stored sketches by day of two halves of the findings."""
    rows = findings(spark, sf_dir)
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    halves = [analytics.cve_sketches(rows.where(half == k)) for k in (0, 1)]
    stored = materialise(analytics.merged_sketches(halves[0].unionByName(halves[1])), "sketches")
    days = [F.lit(day).cast("date") for day in ("1994-01-01", "1995-12-31")]
    estimates = analytics.estimated_cves(stored, *days).withColumnRenamed("n_cves", "estimate")
    exact = analytics.cves_per_app(rows.where(F.to_date("timestamp").between(*days)))
    close = F.abs(F.col("estimate") - F.col("n_cves")) <= F.greatest(F.lit(1.0), F.col("n_cves") * 0.06)
    return exact.join(estimates, "application_name", "left").select("application_name", "n_cves", close.alias("close"))


_RISK = """
    SELECT application_name, count(*) AS n_dependencies, CAST(max(score) AS DOUBLE) AS max_score,
           round(CAST(sum(score) AS DOUBLE) / count(score), 6) AS avg_score,
           coalesce(CAST(sum(score) AS DOUBLE), 0) AS total_score
    FROM (SELECT application_name, affected_package, installed_version,
                 CAST(max(cvss_score) AS DECIMAL(9, 4)) AS score
          FROM fx_findings GROUP BY application_name, affected_package, installed_version) d
    GROUP BY application_name"""


@query(
    "riskiest_apps",
    duck(
        f"SELECT *, row_number() OVER (ORDER BY total_score DESC, application_name) AS risk_rank "
        f"FROM ({_RISK}) r"
    ),
)
def riskiest_apps(spark, sf_dir):
    risk = analytics.riskiest_apps(findings(spark, sf_dir))
    ranked = analytics.ranked_risk(risk)
    return ranked.select(
        "application_name", "n_dependencies", "max_score",
        F.round("avg_score", 6).alias("avg_score"), "total_score",
        F.col("risk_rank").cast("bigint").alias("risk_rank"),
    )


@query(
    "trend",
    duck(
        "SELECT application_name, CAST(floor(epoch_us(timestamp) / 2592000000000) AS BIGINT) * 2592000000000 "
        "AS span_start, count(*) AS n_findings FROM fx_findings GROUP BY 1, 2"
    ),
)
def trend(spark, sf_dir):
    rows = analytics.trend(findings(spark, sf_dir))
    return rows.select("application_name", micros("span.start", "span_start"), "n_findings")


@query(
    "sample_per_app",
    duck(
        "SELECT application_name, event_id, CAST(r AS INTEGER) AS row FROM (SELECT application_name, event_id, "
        "row_number() OVER (PARTITION BY application_name ORDER BY timestamp, event_id) AS r FROM fx_findings) f "
        "WHERE r <= 5"
    ),
)
def sample_per_app(spark, sf_dir):
    rows = analytics.sample_per_app(findings(spark, sf_dir))
    return rows.select("application_name", "event_id", "row")


@query(
    "lineage",
    duck(
        "SELECT f.event_id, tool_name, tool_version, environment FROM fx_findings f "
        "JOIN fx_reports r ON r.event_id = f.parent_event_id"
    ),
)
def lineage(spark, sf_dir):
    rows = analytics.lineage(findings(spark, sf_dir), reports(spark, sf_dir))
    return rows.select("event_id", "tool_name", "tool_version", "environment")


@query(
    "orphans",
    duck("SELECT event_id FROM fx_findings WHERE parent_event_id NOT IN (SELECT event_id FROM fx_raw_reports)"),
)
def orphans(spark, sf_dir):
    """The raw reports hold some under an empty id, whose findings are orphans."""
    known = view(spark, sf_dir, "fx_raw_reports")
    return analytics.orphans(findings(spark, sf_dir), known).select("event_id")


@query(
    "reports_with_findings",
    duck(
        "SELECT event_id, tool_name FROM fx_reports WHERE event_id IN "
        "(SELECT parent_event_id FROM fx_findings)"
    ),
)
def reports_with_findings(spark, sf_dir):
    rows = analytics.reports_with_findings(reports(spark, sf_dir), findings(spark, sf_dir))
    return rows.select("event_id", "tool_name")
