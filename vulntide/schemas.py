"""Declared schemas of every table the operators read or write."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INSTANT, FLAG = T.StringType(), T.TimestampType(), T.BooleanType()
LONG, SMALL, REAL, SINGLE = T.LongType(), T.IntegerType(), T.DoubleType(), T.FloatType()


def _table(*texts: str, **typed: T.DataType) -> T.StructType:
    """Text columns by name, then columns with their types."""
    fields = [T.StructField(name, TEXT) for name in texts]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in typed.items()])


def _list(element: T.DataType) -> T.ArrayType:
    return T.ArrayType(element)


ERROR = _table(error_code=SMALL, error_message=TEXT, json_field_name=TEXT)

SUPPRESSED_ISSUE = _table(
    "issue_hash", expiry_date=INSTANT, suppression_reason=TEXT, suppressed_by=TEXT
)

SUPPRESSION = _table(
    "application_name", "issue_hash",
    expiry_date=INSTANT, suppression_reason=TEXT, suppressed_by=TEXT,
)

REPORT = _table(
    "event_version", "event_id", "application_name", "git_branch", "git_commit_hash",
    "tool_name", "tool_output", "output_format",
    start_time=INSTANT, end_time=INSTANT, environment=TEXT, tool_version=TEXT,
    suppressed_issues=_list(SUPPRESSED_ISSUE),
)

CVSS = _table("version", score=SINGLE)

FINDING = _table(
    "event_version", "event_id", "parent_event_id", "application_name", "git_branch",
    "git_commit_hash",
    timestamp=INSTANT, affected_package=TEXT, installed_version=TEXT, advisory_id=TEXT,
    advisory_url=TEXT, advisory_description=TEXT, cvss=CVSS, suppressed=FLAG,
)

COMMIT = _table(
    "application_name", "commit_id", parents=_list(TEXT), commit_time=LONG, is_head=FLAG
)

CVE_ITEM = _table(
    cve=_table(
        CVE_data_meta=_table("ID"),
        description=_table(description_data=_list(_table("lang", "value"))),
        references=_table(reference_data=_list(_table("url"))),
    ),
    impact=_table(
        baseMetricV3=_table(cvssV3=_table(baseScore=REAL)),
        baseMetricV2=_table(cvssV2=_table(baseScore=REAL)),
    ),
    publishedDate=TEXT,
)

CVE_FEED = _table(CVE_Items=_list(CVE_ITEM))
