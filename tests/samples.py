"""Records the tests share."""

import datetime as dt

HASH = "9c" * 32

ISSUE = {
    "issue_hash": HASH,
    "suppression_reason": "Not reachable from our code",
    "expiry_date": "2031-02-03T04:05:06+00:00",
    "suppressed_by": "Platform team",
}

PAYLOAD = {
    "event_version": "1",
    "event_id": "0f8fad5b-d9cb-469f-a165-70867728950e",
    "application_name": "storefront",
    "git_branch": "release",
    "git_commit_hash": "5f2a" * 10,
    "tool_name": "audit-o-matic",
    "tool_output": "{}",
    "output_format": "JSON",
    "start_time": "2030-06-07T08:09:10+00:00",
    "end_time": "2030-06-07T08:10:11+00:00",
    "environment": "Local",
    "tool_version": "3.2",
    "suppressed_issues": [ISSUE],
}


def utc(*parts):
    return dt.datetime(*parts)


def report(tool="bundler-audit", output="", output_format="PlainText", issues=(), event_id=None):
    return (
        "1", event_id or PAYLOAD["event_id"], PAYLOAD["application_name"], PAYLOAD["git_branch"],
        PAYLOAD["git_commit_hash"], tool, output, output_format, utc(2030, 6, 7, 8, 9, 10),
        utc(2030, 6, 7, 8, 10, 11), "Local", "3.2", list(issues),
    )


def block(name="rack", version="1.0", advisory="CVE-2019-1", url="https://example.org/a",
          title="Bad thing", solution=" upgrade", end="\n"):
    lines = [f"Name: {name}", f"Version: {version}", f"Advisory: {advisory}", "Criticality: High",
             f"URL: {url}", f"Title: {title}", f"Solution:{solution}"]
    return end.join(lines) + end
