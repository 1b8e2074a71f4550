import json

import pytest
from samples import HASH, ISSUE, PAYLOAD, utc

from vulntide.operators.errors import CATALOGUE
from vulntide.operators.validation import (
    accepted,
    first_suppression_error,
    rejected,
    validate_reports,
    validate_suppressions,
)

GONE = object()


def with_field(name, value):
    body = dict(PAYLOAD)
    if value is GONE:
        del body[name]
    else:
        body[name] = value
    return json.dumps(body)


def with_issue(name, value):
    issue = dict(ISSUE)
    if value is GONE:
        del issue[name]
    else:
        issue[name] = value
    return with_field("suppressed_issues", [issue])


FIELD_CASES = [
    ("event_version", GONE, 133), ("event_version", None, 133), ("event_version", 1, 134),
    ("event_version", "", 135), ("event_version", "2", 136),
    ("event_id", GONE, 137), ("event_id", True, 138), ("event_id", "", 138), ("event_id", "x", 139),
    ("event_id", PAYLOAD["event_id"] + "\n", 139),
    ("application_name", GONE, 102), ("application_name", "", 111), ("application_name", False, 112),
    ("git_branch", "", 113), ("git_branch", False, 114),
    ("git_commit_hash", GONE, 104), ("git_commit_hash", "", 115), ("git_commit_hash", "zzz", 116),
    ("git_commit_hash", "a" * 40 + "\n", 116), ("git_commit_hash", {}, 117),
    ("tool_name", GONE, 105), ("tool_name", "", 118), ("tool_name", 2, 119),
    ("tool_output", GONE, 106), ("tool_output", "", 120), ("tool_output", False, 121),
    ("output_format", GONE, 107), ("output_format", "", 122), ("output_format", True, 123),
    ("output_format", "json", 124),
    ("start_time", GONE, 108), ("start_time", "", 125), ("start_time", 3, 125),
    ("start_time", "2019-09-13", 125), ("start_time", "2019-02-30T00:00:00Z", 125),
    ("end_time", GONE, 109), ("end_time", "not a time", 126), ("end_time", [], 126),
    ("environment", GONE, 110), ("environment", False, 127), ("environment", "", 133),
    ("environment", "Moon", 128),
    ("tool_version", "", 129), ("tool_version", False, 130),
    ("suppressed_issues", GONE, 157), ("suppressed_issues", "[]", 157),
    ("suppressed_issues", [7], 161), ("suppressed_issues", [None], 161),
]
ISSUE_CASES = [
    ("issue_hash", GONE, 161), ("issue_hash", 1, 162), ("issue_hash", "", 158),
    ("issue_hash", "g" * 64, 158), ("issue_hash", HASH + "\n", 158),
    ("expiry_date", 1, 165), ("expiry_date", "", 159), ("expiry_date", "soon", 159),
    ("suppression_reason", GONE, 163), ("suppression_reason", 1, 164), ("suppression_reason", "", 160),
    ("suppressed_by", GONE, 170), ("suppressed_by", 1, 169), ("suppressed_by", "", 171),
]
GOOD = [
    json.dumps(PAYLOAD), with_field("git_branch", None), with_field("git_branch", GONE),
    with_field("tool_version", None), with_field("suppressed_issues", []),
    with_field("event_id", "95130BEE95AE4DACAECF5650FF646EA1"),
    with_field("end_time", "2019-09-13t19:37:14.123456789-23:59"),
    with_field("environment", "CI"), with_issue("expiry_date", GONE), with_issue("expiry_date", None),
    with_issue("issue_hash", HASH.upper()), with_field("more", {"a": [1]}),
    json.dumps(PAYLOAD).replace("{", '{"event_version": "9",', 1),
]
BODIES = [
    ("", 100), (" ", 101), ("text", 101), ("{", 101), ("{} {}", 101), (json.dumps(PAYLOAD) + "x", 101),
    (json.dumps(PAYLOAD) + "]", 101), ("{'a': 1}", 101), ("\u0000\u0001", 101),
    ("[]", 133), ("1", 133), ('"text"', 133), ("null", 133), ("{}", 133),
]
CASES = (
    [(with_field(n, v), code) for n, v, code in FIELD_CASES]
    + [(with_issue(n, v), code) for n, v, code in ISSUE_CASES]
    + [(body, 0) for body in GOOD]
    + BODIES
)


def test_every_defect_has_its_code(spark):
    rows = [(i, body) for i, (body, _) in enumerate(CASES)]
    checked = validate_reports(spark.createDataFrame(rows, "id int, body string"))
    codes = {r.id: r.error.error_code if r.error else 0 for r in checked.collect()}
    wrong = [(CASES[i], codes[i]) for i in codes if codes[i] != CASES[i][1]]
    assert len(codes) == len(CASES) and not wrong


def test_error_record_and_split(spark):
    bodies = [(with_field("event_id", "x"),), (json.dumps(PAYLOAD),)]
    checked = validate_reports(spark.createDataFrame(bodies, "body string"))
    (bad,) = rejected(checked, "body").collect()
    assert tuple(bad.error) == CATALOGUE["event_id_invalid"]
    (good,) = accepted(checked).collect()
    assert good.end_time == utc(2030, 6, 7, 8, 10, 11)
    assert good.suppressed_issues[0].expiry_date == utc(2031, 2, 3, 4, 5, 6)
    assert good.event_id == PAYLOAD["event_id"] and good.tool_version == "3.2"


def test_first_failing_field_wins(spark):
    body = dict(PAYLOAD, tool_name="", git_branch=1, suppressed_issues=[{}])
    checked = validate_reports(spark.createDataFrame([(json.dumps(body),)], "body string"))
    assert checked.first().error.error_code == 114


@pytest.mark.parametrize(
    "issue, code",
    [
        (ISSUE, None), ("text", 168), ([], 168), ({}, 161),
        ({k: v for k, v in ISSUE.items() if k != "expiry_date"}, None),
        # Reason before expiry here, the other way round inside a report.
        (dict(ISSUE, suppression_reason="", expiry_date="soon"), 160),
        (dict(ISSUE, expiry_date="soon", suppressed_by=""), 159),
    ],
)
def test_listed_suppression(spark, issue, code):
    rows = spark.createDataFrame([(json.dumps(issue),)], "document string")
    row = validate_suppressions(rows).first()
    assert (row.error and row.error.error_code) == code
    assert (row.issue is None) == (code is not None)


def test_first_bad_suppression_of_a_list(spark):
    bad = [dict(ISSUE, issue_hash="x"), "text"]
    lists = [([json.dumps(x) for x in [ISSUE, *bad]],), ([json.dumps(ISSUE)],), ([],)]
    rows = spark.createDataFrame(lists, "documents array<string>")
    errors = [r.error and r.error.error_code for r in first_suppression_error(rows).collect()]
    assert errors == [158, None, None]


def test_row_order_changes_nothing(spark):
    rows = [(i, body) for i, (body, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "id int, body string")
    key = lambda df: sorted((r.id, r.error and r.error.error_message or "") for r in df.collect())
    assert key(validate_reports(frame)) == key(validate_reports(frame.orderBy("body").repartition(5)))


def test_fixed_errors():
    # Code, message and field of some errors, as their readers know them.
    assert CATALOGUE["body_empty"] == (100, "Request body empty", None)
    assert CATALOGUE["git_commit_hash_invalid"] == (116, "Git commit hash not valid", "git_commit_hash")
    assert CATALOGUE["event_id_missing"] == (137, "Event ID missing", "event_version")
    assert CATALOGUE["suppressed_by_empty"][0] == 171
