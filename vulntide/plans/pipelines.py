"""The three data flows, each one DataFrame lineage over the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import FINDING_HASH
from ..operators import analytics, commits as history
from ..operators.enrichment import (
    checked_safety_fan_out,
    enrich_bundler,
    failed_reports,
    rejected_fan_out,
    union_findings,
    without_failed_reports,
)
from ..operators.extraction import (
    STAMPED_ID,
    bundler_findings,
    checked_bundler_blocks,
    checked_safety_items,
    refused,
    route_by_tool,
    safety_findings,
    unroutable,
)
from ..operators.suppression import apply_suppressions
from ..operators.validation import accepted, rejected, validate_reports
from ..session import materialise, settled


@dataclass(frozen=True)
class Split:
    """Rows that go on, and rows that were refused with their error."""

    good: DataFrame
    bad: DataFrame


def intake(payloads: DataFrame, *keep: str) -> Split:
    """Request bodies to report rows."""
    checked = validate_reports(payloads)
    return Split(accepted(checked), rejected(checked, "body", *keep))


def findings_of(
    reports: DataFrame,
    cve: DataFrame,
    advisories: DataFrame,
    as_of: Column | None = None,
    known: DataFrame | None = None,
) -> Split:
    """Report rows to enriched findings of all tools, with the suppression flag.

    The parsed reports and the fan-out are stored when this is called. ``known`` is
    :func:`cves_by_advisory` of the two tables, if the caller has it stored. Findings are
    flagged before they are enriched, which no part of the hash depends on, so that the
    lists of suppressed issues stay with the reports and take part in no join.
    """
    routed = route_by_tool(reports)
    # Each report's output is parsed once; good and bad rows come from what is stored.
    blocks = materialise(checked_bundler_blocks(routed.filter("route = 'bundler'")), "blocks")
    items = materialise(checked_safety_items(routed.filter("route = 'safety'")), "items")
    from_bundler = enrich_bundler(_flagged(bundler_findings(blocks), as_of), cve)
    fan_out = checked_safety_fan_out(_flagged(safety_findings(items), as_of), advisories, cve, known=known)
    checked = materialise(fan_out, "fan-out")
    failed = failed_reports(checked)
    from_safety = without_failed_reports(checked, failed).drop("cve_list", "advisory_known")
    findings = union_findings(from_bundler, from_safety).withColumns(
        {"event_id": F.expr(STAMPED_ID), "issue_hash": F.expr(FINDING_HASH)}
    )
    findings = findings.select("event_version", "event_id", *(c for c in findings.columns if c not in ("event_version", "event_id")))
    bad = (
        unroutable(routed)
        .unionByName(refused(blocks))
        .unionByName(refused(items))
        .unionByName(rejected_fan_out(failed))
    )
    return Split(findings, bad)


def _flagged(findings: DataFrame, as_of: Column | None) -> DataFrame:
    """Flagged findings without what the other columns tell: id and hash are long and at random."""
    return apply_suppressions(findings, as_of).drop("suppressed_issues", "event_id", "issue_hash")


def remediation(
    findings: DataFrame, commits: DataFrame, published: DataFrame
) -> DataFrame:
    """Findings, commits and publication dates to one row per remediated CVE.

    The branch is stored, and what its walk stored goes before the findings are read.
    """
    links = settled(commits.sparkSession, "links", lambda: history.branch_links(commits))
    return analytics.remediation_times(findings, links, published)
