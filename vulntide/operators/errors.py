"""Catalogue of validation errors."""

from __future__ import annotations

from ..functions.sql import mapping, struct, text

# Name -> (code, message, field). Codes are not unique, and some field names
# differ from the key they report on; both are part of the interface.
CATALOGUE: dict[str, tuple[int, str, str | None]] = {
    "body_empty": (100, "Request body empty", None),
    "body_not_json": (101, "Request body not correct media type", None),
    "application_name_missing": (102, "Application name required", "application_name"),
    "git_commit_hash_missing": (104, "Git commit hash required", "git_commit_hash"),
    "tool_name_missing": (105, "Tool name required", "tool_name"),
    "tool_output_missing": (106, "Tool output required", "tool_output"),
    "output_format_missing": (107, "Tool output format required", "tool_output_format"),
    "start_time_missing": (108, "Start time required", "start_time"),
    "end_time_missing": (109, "End time required", "end_time"),
    "environment_missing": (110, "Environment required", "environment"),
    "application_name_empty": (111, "Application name present but empty", "application_name"),
    "application_name_type": (112, "Application name not a valid string", "application_name"),
    "git_branch_empty": (113, "Git branch name present but empty", "git_branch"),
    "git_branch_type": (114, "Git branch name not a valid string", "git_branch"),
    "git_commit_hash_empty": (115, "Git commit hash present but empty", "git_commit_hash"),
    "git_commit_hash_invalid": (116, "Git commit hash not valid", "git_commit_hash"),
    "git_commit_hash_type": (117, "Git commit hash not a valid string", "git_commit_hash"),
    "tool_name_empty": (118, "Tool name present but empty", "tool_name"),
    "tool_name_type": (119, "Tool name not a valid string", "tool_name"),
    "tool_output_empty": (120, "Tool output present but empty", "tool_output"),
    "tool_output_type": (121, "Tool output not a valid string", "tool_output"),
    "output_format_empty": (122, "Tool output format present but empty", "tool_output_format"),
    "output_format_type": (123, "Tool output format not a valid string", "tool_output_format"),
    "output_format_invalid": (124, "Tool output format not acceptable", "tool_output_format"),
    "start_time_invalid": (125, "Start time not a valid timestamp", "start_time"),
    "end_time_invalid": (126, "End time not a valid timestamp", "end_time"),
    "environment_type": (127, "Environment not a valid string", "environment"),
    "environment_invalid": (128, "Environment not a valid option", "environment"),
    "tool_version_empty": (129, "Tool version present but empty", "tool_version"),
    "tool_version_type": (130, "Tool version not a valid string", "tool_version"),
    "report_schema": (
        130,
        "Tried to deserialise a ToolReport from Avro but value didn't pass schema validation",
        None,
    ),
    "output_format_not_enum": (131, "Tool output format not an avro enum", None),
    "environment_not_enum": (132, "Environment not an avro enum", None),
    "environment_empty": (133, "Environment present but empty", "environment"),
    "event_version_missing": (133, "Event version missing", "event_version"),
    "event_version_type": (134, "Event version not a string", "event_version"),
    "event_version_empty": (135, "Event version present but empty", "event_version"),
    "event_version_invalid": (136, "Event version unknown", "event_version"),
    "event_id_missing": (137, "Event ID missing", "event_version"),
    "event_id_type": (138, "Event ID not a string", "event_version"),
    "event_id_empty": (138, "Event ID present but empty", "event_version"),
    "event_id_invalid": (139, "Event ID does not look like a UUID", "event_version"),
    "advisory_description_empty": (140, "Advisory description empty", "advisory_description"),
    "advisory_id_empty": (141, "Advisory Id empty", "advisory_id"),
    "affected_package_empty": (142, "Affected package empty", "affected_package"),
    "installed_version_empty": (143, "Installed version empty", "installed_version"),
    "timestamp_invalid": (144, "Timestamp does not look like a valid timestamp", "timestamp"),
    "timestamp_type": (145, "Timestamp does not look like a string", "timestamp"),
    "affected_package_type": (146, "Affected package not a string", "affected_package"),
    "installed_version_type": (147, "Installed version not a string", "installed_version"),
    "advisory_id_type": (148, "Advisory Id not a string", "advisory_id"),
    "advisory_url_empty": (149, "Advisory url empty", "advisory_url"),
    "advisory_url_invalid": (150, "Advisory Url not a valid Url", "advisory_url"),
    "advisory_url_type": (151, "Advisory Url not a string", "advisory_url"),
    "advisory_description_type": (
        151, "Advisory description not a string", "advisory_description",
    ),
    "cvss_version_type": (152, "CVSS Version field not parsable as a string", None),
    "cvss_score_type": (153, "CVSS score not valid", None),
    "cvss_score_missing": (154, "CVSS version is known but score not provided", None),
    "cvss_score_unexpected": (155, "CVSS version is unknown but score was provided", None),
    "cvss_type": (156, "CVSS avro value not a record", None),
    "suppressed_issues_type": (
        157, "Suppressed Issues not an array of objects", "suppressed_issues",
    ),
    "issue_hash_invalid": (
        158,
        "One or more issue hashes do not look like a valid SHA256 hashes",
        "suppressed_issues[].issue_hash",
    ),
    "expiry_date_invalid": (
        159,
        "One or more issue suppression expiry dates do not look like valid dates",
        "suppressed_issues[].expiry_date",
    ),
    "suppression_reason_empty": (
        160,
        "One or more issue suppression reasons are empty",
        "suppressed_issues[].suppression_reason",
    ),
    "issue_hash_missing": (
        161, "One or more issue hashes are missing", "suppressed_issues[].issue_hash",
    ),
    "issue_hash_type": (
        162, "One or more issue hashes are not strings", "suppressed_issues[].issue_hash",
    ),
    "suppression_reason_missing": (
        163,
        "One or more issue suppression reasons are missing",
        "suppressed_issues[].suppression_reason",
    ),
    "suppression_reason_type": (
        164,
        "One or more issue suppression reasons are not strings",
        "suppressed_issues[].suppression_reason",
    ),
    "expiry_date_type": (
        165,
        "One or more issue suppression expiry dates are not strings",
        "suppressed_issues[].expiry_date",
    ),
    "suppressed_issue_type": (166, "Suppressed Issue Avro object is not a record", None),
    "suppressed_type": (167, "Suppression flag Avro value is not a boolean", None),
    "suppression_not_table": (168, "Suppressed Issue TOML type must be a Table", None),
    "suppressed_by_type": (
        169,
        "One or more Suppressed Issues SuppressedBy fields are not a string",
        "suppressed_issues[].suppressed_by",
    ),
    "suppressed_by_missing": (
        170,
        "One or more Suppressed Issues SuppressedBy fields missing",
        "suppressed_issues[].suppressed_by",
    ),
    "suppressed_by_empty": (
        171,
        "One or more Suppressed Issues SuppressedBy fields are present but empty",
        "suppressed_issues[].suppressed_by",
    ),
}

# Reports that pass validation but that no extractor can read. These carry no code.
UNREADABLE: dict[str, str] = {
    "bundler_format": "No extractor reads this output format of bundler-audit",
    "safety_plain_text": "No extractor reads plain text of safety; its JSON output is needed",
    "safety_format": "No extractor reads this output format of safety",
    "unknown_tool": "No extractor for this tool",
    "safety_output": "Output is no JSON list of safety findings",
}


def _literal(code: int | None, message: str, field: str | None) -> str:
    return struct(
        error_code=f"CAST({'NULL' if code is None else code} AS INT)",
        error_message=text(message),
        json_field_name=text(field),
    )


_RECORDS = mapping(
    {name: _literal(*entry) for name, entry in CATALOGUE.items()}
    | {name: _literal(None, message, None) for name, message in UNREADABLE.items()}
)


def error_struct(name: str) -> str:
    """Error record of a catalogue name; null stays null."""
    return f"if({name} IS NULL, NULL, try_element_at({_RECORDS}, {name}))"


def first_of(*names: str) -> str:
    """The first rule that failed."""
    return f"coalesce({', '.join(names)})" if len(names) > 1 else names[0]


def fails(condition: str, name: str) -> str:
    """``name`` if the condition holds, else null."""
    return f"if({condition}, {text(name)}, NULL)"
