"""Notification texts for open findings."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import FINDING_HASH
from ..functions.sql import text
from ..functions.text import branch_text, cvss_text
from .suppression import unsuppressed

# Fixed value: the message, with its slots.
TEMPLATE = (
    "Vulnerable package found in: {application}\n"
    "What package is affected? {package} {version}\n"
    "Where was this found? Commit {commit} on branch {branch}\n"
    "What is the problem? {problem}\n"
    "How serious is it? CVSS {cvss}\n"
    "Where can I find out more? {url}\n"
    "Issue hash if this should be suppressed: {hash}"
)


SLOTS = {
    "application": "application_name",
    "package": "affected_package",
    "version": "installed_version",
    "commit": "git_commit_hash",
    "branch": branch_text("git_branch"),
    "problem": "advisory_description",
    "cvss": cvss_text("cvss"),
    "url": "advisory_url",
    "hash": FINDING_HASH,
}


def message_text() -> str:
    parts = []
    for literal, slot, _, _ in Formatter().parse(TEMPLATE):
        parts += [text(literal)] + ([SLOTS[slot]] if slot else [])
    return f"concat({', '.join(parts)})"


def outbox(findings: DataFrame, channel: str) -> DataFrame:
    """One message per open finding, keyed by the finding."""
    position = F.col("cve_position") if "cve_position" in findings.columns else F.lit(0)
    return unsuppressed(findings).select(
        F.lit(channel).alias("channel"),
        "event_id",
        position.alias("cve_position"),
        "parent_event_id",
        F.expr(message_text()).alias("text"),
    )
