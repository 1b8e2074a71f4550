"""Time the headline flows over stored input tables and print one JSON line.

The inputs (payloads, reports, findings, commits, dimensions) are derived from the test
tables and stored first; ``prepare`` is the time that takes. Each flow then runs twice from
the stored tables, all of its rows written to a sink that drops them, and the faster run
counts. Building the plan is part of the time.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from vulntide.catalog import registry
from vulntide.fixtures import view
from vulntide.operators import analytics, dimensions, notification, suppression, validation
from vulntide.operators.commits import first_parent_sequence
from vulntide.plans.pipelines import findings_of, remediation
from vulntide.session import local_session, materialise

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
RUNS = 2


def main() -> None:
    spark = local_session(CPUS, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="vulntide-bench-")})
    start = time.time()

    def stored(df, name):
        return materialise(df.repartition(int(CPUS)), name)

    payloads = stored(view(spark, SF_DIR, "fx_payloads"), "payloads")
    reports = stored(registry.reports(spark, SF_DIR), "reports")
    findings = stored(registry.findings(spark, SF_DIR), "findings")
    commits = stored(registry.commits(spark, SF_DIR), "commits")
    cve = stored(registry.cve_table(spark, SF_DIR), "cve")
    feeds = stored(view(spark, SF_DIR, "fx_feed_documents"), "feeds")
    listed = view(spark, SF_DIR, "fx_advisories").select("id", "cve_list")
    advisories = stored(dimensions.dedup_advisories(listed), "advisories")
    suppressions = stored(view(spark, SF_DIR, "fx_suppressions"), "suppressions")
    prepare = time.time() - start
    now = registry.as_of()

    flows = {
        "validate_reports": lambda: validation.validate_reports(payloads),
        "extract_and_enrich": lambda: findings_of(reports, cve, advisories, now).good,
        "rejected_extractions": lambda: findings_of(reports, cve, advisories, now).bad,
        "remediation_stats": lambda: analytics.remediation_stats(remediation(findings, commits, cve)),
        "mean_time_to_remediate": lambda: analytics.mean_time_to_remediate(
            remediation(findings, commits, cve)
        ),
        "first_last_seen": lambda: analytics.first_last_seen(findings),
        "first_parent_sequence": lambda: first_parent_sequence(commits),
        "riskiest_apps": lambda: analytics.ranked_risk(analytics.riskiest_apps(findings)),
        "events_per_app": lambda: analytics.events_per_app(findings),
        "cves_per_app": lambda: analytics.cves_per_app(findings),
        "trend": lambda: analytics.trend(findings),
        "sample_per_app": lambda: analytics.sample_per_app(findings),
        "suppressed_by_table": lambda: suppression.suppressed_by_table(findings, suppressions, now),
        "unsuppressed_by_table": lambda: suppression.unsuppressed_by_table(
            findings, suppressions, now
        ),
        "outbox": lambda: notification.outbox(findings, "security"),
        "lineage": lambda: analytics.lineage(findings, reports),
        "latest_cve": lambda: dimensions.latest_cve(
            dimensions.explode_cve_items(dimensions.parse_feed_documents(feeds))
        ),
    }
    seconds = {}
    for name, flow in flows.items():
        best = None
        for _ in range(RUNS):
            begin = time.time()
            flow().write.format("noop").mode("overwrite").save()
            took = time.time() - begin
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "prepare": round(prepare, 3),
                "rows": {
                    "payloads": payloads.count(),
                    "reports": reports.count(),
                    "findings": findings.count(),
                    "commits": commits.count(),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
