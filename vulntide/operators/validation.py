"""Report, suppression and finding validation: the first failing rule names the error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import COMMIT_HASH, HEX_64, canonical_uuid, is_uuid
from ..functions.sql import first_match, let, struct, text, with_computed
from ..functions.times import parse_rfc3339
from ..functions.urls import normalise_url
from ..functions.variants import as_string, elements_of, field, fields_of, kind, parse_document
from ..schemas import REPORT
from .errors import error_struct, fails, first_of

FORMATS = ("JSON", "PlainText")
ENVIRONMENTS = ("Local", "CI")

# Order of the checks; every field but the optional ones must be present.
REPORT_FIELDS = [
    "event_version", "event_id", "application_name", "git_branch", "git_commit_hash",
    "tool_name", "tool_output", "output_format", "start_time", "end_time", "environment",
    "tool_version",
]
OPTIONAL = {"git_branch", "tool_version", "expiry_date"}
# Timestamps report a wrong type, an empty text and a bad text alike.
TIMESTAMPS = {"start_time", "end_time"}
NO_EMPTY_RULE = TIMESTAMPS | {"issue_hash", "expiry_date"}
ISSUE_FIELDS = ["issue_hash", "expiry_date", "suppression_reason", "suppressed_by"]
# A suppression list on its own is checked in another order than one inside a report.
LISTED_ISSUE_FIELDS = ["issue_hash", "suppression_reason", "expiry_date", "suppressed_by"]


def _one_of(value: str, allowed: tuple[str, ...]) -> str:
    return f"{value} NOT IN ({', '.join(map(text, allowed))})"


# Condition under which a text that is not empty breaks its field's own rule.
INVALID = {
    "event_version": lambda v: f"{v} <> '1'",
    "event_id": lambda v: f"NOT ({is_uuid(v)})",
    "git_commit_hash": lambda v: f"NOT ({v} RLIKE {text(COMMIT_HASH)})",
    "output_format": lambda v: _one_of(v, FORMATS),
    "environment": lambda v: _one_of(v, ENVIRONMENTS),
    "start_time": lambda v: f"{parse_rfc3339(v)} IS NULL",
    "end_time": lambda v: f"{parse_rfc3339(v)} IS NULL",
    "issue_hash": lambda v: f"NOT ({v} RLIKE {text(HEX_64)})",
    "expiry_date": lambda v: f"{parse_rfc3339(v)} IS NULL",
}


def text_rule(name: str, value: str) -> str:
    """Rules on a text that is there: not empty, then the field's own rule."""
    checks = []
    if name not in NO_EMPTY_RULE:
        checks.append(fails(f"{value} = ''", f"{name}_empty"))
    if name in INVALID:
        checks.append(fails(INVALID[name](value), f"{name}_invalid"))
    return first_of(*checks)


def json_rule(name: str, value: str) -> str:
    """Rules on a JSON value: present, a string, then the text rules."""
    wrong_type = f"{name}_invalid" if name in TIMESTAMPS else f"{name}_type"
    missing = text(None if name in OPTIONAL else f"{name}_missing")
    return let(
        "v",
        struct(kind=kind(value), text=as_string(value)),
        lambda v: (
            f"CASE WHEN {v}.kind = 'missing' THEN {missing} "
            f"WHEN {v}.kind <> 'string' THEN {text(wrong_type)} "
            f"ELSE {text_rule(name, v + '.text')} END"
        ),
    )


def _issue_rule(order: list[str], not_a_record: str | None = None):
    def rule(issue: str) -> str:
        rules = first_of(*[json_rule(name, field(issue, f"$.{name}")) for name in order])
        if not_a_record is None:
            return rules
        return f"if({kind(issue)} <> 'object', {text(not_a_record)}, {rules})"

    return rule


def _typed_issue(issue: str) -> str:
    return struct(
        issue_hash=f"lower({as_string(issue, '$.issue_hash')})",
        expiry_date=let("e", as_string(issue, "$.expiry_date"), parse_rfc3339),
        suppression_reason=as_string(issue, "$.suppression_reason"),
        suppressed_by=as_string(issue, "$.suppressed_by"),
    )


def _with_error(rows: DataFrame, name: str) -> DataFrame:
    """``error``, the record of the rule named by an expression that runs once per row."""
    named = with_computed(rows, _error=name)
    return named.withColumn("error", F.expr(error_struct("_error")))


def validate_reports(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Typed report columns plus ``error``; the columns are null where ``error`` is set.

    Other columns of ``payloads`` are kept. Each document is parsed once, and all fields
    come out of it in one pass. A repeated key keeps its last value on a session that
    ``session.tune`` has set up; without ``spark.sql.variant.allowDuplicateKeys`` such a
    document is not JSON (101).
    """
    names = REPORT_FIELDS + ["suppressed_issues"]
    issues = "_f.suppressed_issues"
    error = first_of(
        fails(f"{body} IS NULL OR {body} = ''", "body_empty"),
        fails("_doc IS NULL", "body_not_json"),
        *[json_rule(name, f"_f.{name}") for name in REPORT_FIELDS],
        fails(f"{kind(issues)} <> 'array'", "suppressed_issues_type"),
        first_match(elements_of(issues), "i", _issue_rule(ISSUE_FIELDS)),
    )
    opened = with_computed(payloads, _doc=parse_document(body), _f=fields_of("_doc", names))
    checked = _with_error(opened, error)

    values = {name: as_string(f"_f.{name}") for name in REPORT_FIELDS}
    for name, convert in (
        ("event_id", canonical_uuid), ("start_time", parse_rfc3339), ("end_time", parse_rfc3339),
    ):
        values[name] = let("t", values[name], convert)
    values["suppressed_issues"] = f"transform({elements_of(issues)}, i -> {_typed_issue('i')})"
    typed = [
        F.expr(f"if(_error IS NULL, {values[f.name]}, NULL)").cast(f.dataType).alias(f.name)
        for f in REPORT
    ]
    return checked.select(*[F.col(name) for name in payloads.columns], *typed, "error")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("error IS NULL").select(*REPORT.fieldNames())


def rejected(validated: DataFrame, *keep: str) -> DataFrame:
    """Rows that failed, with the error record and the named columns."""
    return validated.filter("error IS NOT NULL").select(*keep, "error")


def validate_suppressions(listed: DataFrame, document: str = "document") -> DataFrame:
    """Check suppression records given on their own, one JSON value per row."""
    rule = _issue_rule(LISTED_ISSUE_FIELDS, "suppression_not_table")
    checked = _with_error(with_computed(listed, _doc=parse_document(document)), rule("_doc"))
    issue = F.expr(f"if(_error IS NULL, {_typed_issue('_doc')}, NULL)").alias("issue")
    return checked.select(*[F.col(c) for c in listed.columns], issue, "error")


def first_suppression_error(lists: DataFrame, documents: str = "documents") -> DataFrame:
    """Error of the first bad record of a whole list, an array of JSON values per row."""
    values = f"transform({documents}, t -> {parse_document('t')})"
    rule = _issue_rule(LISTED_ISSUE_FIELDS, "suppression_not_table")
    return _with_error(lists, first_match(values, "i", rule)).drop("_error")


def _blank(column: str) -> str:
    return f"coalesce({column}, '')"


def _not_empty(column: str) -> str:
    return fails(f"{_blank(column)} = ''", f"{column}_empty")


# Rule of every checked finding column, in column order.
FINDING_RULES = {
    "event_version": text_rule("event_version", _blank("event_version")),
    "event_id": text_rule("event_id", _blank("event_id")),
    "parent_event_id": text_rule("event_id", _blank("parent_event_id")),
    "application_name": _not_empty("application_name"),
    "git_branch": fails("git_branch = ''", "git_branch_empty"),
    "git_commit_hash": text_rule("git_commit_hash", _blank("git_commit_hash")),
    "timestamp": fails("timestamp IS NULL", "timestamp_invalid"),
    "affected_package": _not_empty("affected_package"),
    "installed_version": _not_empty("installed_version"),
    "advisory_id": _not_empty("advisory_id"),
    "advisory_url": first_of(
        _not_empty("advisory_url"),
        fails(f"{normalise_url('advisory_url')} IS NULL", "advisory_url_invalid"),
    ),
    "advisory_description": _not_empty("advisory_description"),
    "cvss": first_of(
        fails("cvss.version IN ('V2', 'V3') AND cvss.score IS NULL", "cvss_score_missing"),
        fails("cvss.version NOT IN ('V2', 'V3') AND cvss.score IS NOT NULL", "cvss_score_unexpected"),
    ),
}

# The extractors build the advisory id before everything else.
EXTRACTION_ORDER = [
    "advisory_id", "timestamp", "affected_package", "installed_version", "advisory_url",
    "advisory_description", "cvss",
]


def validate_findings(findings: DataFrame) -> DataFrame:
    """Findings with ``error``, checked in the order in which extraction builds them."""
    rules = [FINDING_RULES[name] for name in EXTRACTION_ORDER]
    return _with_error(findings, first_of(*rules)).drop("_error")


def revalidate_findings(findings: DataFrame) -> DataFrame:
    """Findings with ``error``, checked in column order as on a read from the log.

    Wrong column types never get this far: the declared schema refuses them.
    """
    return _with_error(findings, first_of(*FINDING_RULES.values())).drop("_error")


def _typed_rule(name: str) -> str | None:
    """Rule of a report column on a read from the log; an empty tool version passes."""
    if name in TIMESTAMPS:
        return fails(f"{name} IS NULL", f"{name}_invalid")
    if name == "git_branch":
        return fails("git_branch = ''", "git_branch_empty")
    return None if name == "tool_version" else text_rule(name, _blank(name))


def revalidate_reports(reports: DataFrame) -> DataFrame:
    """Report rows with ``error``, checked as on a read from the log.

    A typed expiry date is valid by its type.
    """
    issue_rule = lambda i: first_of(
        *[text_rule(n, _blank(f"{i}.{n}")) for n in ISSUE_FIELDS if n != "expiry_date"]
    )
    checks = [rule for rule in map(_typed_rule, REPORT_FIELDS) if rule]
    checks.append(fails("suppressed_issues IS NULL", "suppressed_issues_type"))
    checks.append(first_match("suppressed_issues", "i", issue_rule))
    return _with_error(reports, first_of(*checks)).drop("_error")
