"""SQL texts shared by several oracles."""

from __future__ import annotations

from ..operators.errors import CATALOGUE, UNREADABLE


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def error_list() -> str:
    """The catalogue as rows (name, error_code, error_message, json_field_name)."""
    rows = [
        f"({_text(name)}, {code}, {_text(message)}, {_text(field)})"
        for name, (code, message, field) in CATALOGUE.items()
    ]
    rows += [f"({_text(name)}, NULL, {_text(text)}, NULL)" for name, text in UNREADABLE.items()]
    return (
        "SELECT name, CAST(code AS INTEGER) AS error_code, message AS error_message, "
        f"field AS json_field_name FROM (VALUES {', '.join(rows)}) v(name, code, message, field)"
    )


UUID = "'(urn:uuid:)?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32}'"
TIME = "'\\d{4}-\\d\\d-\\d\\d[Tt]\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?([Zz]|[+-]\\d\\d:\\d\\d)'"


def json_case(doc: str, path: str, field: str, rule: str | None, *, optional=False, time=False,
              has_empty=True) -> str:
    """WHEN arms for one JSON field: missing, wrong type, empty, invalid."""
    kind = f"coalesce(json_type({doc}, '{path}'), 'NULL')"
    value = f"json_extract_string({doc}, '{path}')"
    arms = "" if optional else f" WHEN {kind} = 'NULL' THEN '{field}_missing'"
    wrong = f"{field}_invalid" if time else f"{field}_type"
    arms += f" WHEN {kind} NOT IN ('NULL', 'VARCHAR') THEN '{wrong}'"
    if has_empty and not time:
        arms += f" WHEN {kind} = 'VARCHAR' AND {value} = '' THEN '{field}_empty'"
    if rule:
        arms += f" WHEN {kind} = 'VARCHAR' AND NOT ({rule.replace('@', value)}) THEN '{field}_invalid'"
    return arms


def issue_arms(doc: str, base: str, order: list[str]) -> str:
    rules = {
        "issue_hash": ("regexp_full_match(@, '[0-9a-fA-F]{64}')", dict(has_empty=False)),
        "expiry_date": (f"regexp_full_match(@, {TIME})", dict(has_empty=False, optional=True)),
        "suppression_reason": (None, {}),
        "suppressed_by": (None, {}),
    }
    return "".join(
        json_case(doc, f"{base}.{name}", name, rules[name][0], **rules[name][1]) for name in order
    )


def report_case(doc: str) -> str:
    arms = (
        json_case(doc, "$.event_version", "event_version", "@ = '1'")
        + json_case(doc, "$.event_id", "event_id", f"regexp_full_match(@, {UUID})")
        + json_case(doc, "$.application_name", "application_name", None)
        + json_case(doc, "$.git_branch", "git_branch", None, optional=True)
        + json_case(doc, "$.git_commit_hash", "git_commit_hash", "regexp_full_match(@, '[0-9a-fA-F]{40}')")
        + json_case(doc, "$.tool_name", "tool_name", None)
        + json_case(doc, "$.tool_output", "tool_output", None)
        + json_case(doc, "$.output_format", "output_format", "@ IN ('JSON', 'PlainText')")
        + json_case(doc, "$.start_time", "start_time", f"regexp_full_match(@, {TIME})", time=True)
        + json_case(doc, "$.end_time", "end_time", f"regexp_full_match(@, {TIME})", time=True)
        + json_case(doc, "$.environment", "environment", "@ IN ('Local', 'CI')")
        + json_case(doc, "$.tool_version", "tool_version", None, optional=True)
        + f" WHEN coalesce(json_type({doc}, '$.suppressed_issues'), 'NULL') <> 'ARRAY'"
        + " THEN 'suppressed_issues_type'"
        + f" WHEN json_array_length({doc}, '$.suppressed_issues') = 0 THEN NULL"
        + issue_arms(doc, "$.suppressed_issues[0]",
                     ["issue_hash", "expiry_date", "suppression_reason", "suppressed_by"])
    )
    return f"CASE{arms} END"


# Payloads with the name of their first error. Lists in fx_payloads hold one element at most.
CHECKED = f"""
    SELECT payload_id, body, doc,
           CASE WHEN body = '' THEN 'body_empty' WHEN NOT json_valid(body) THEN 'body_not_json'
                ELSE ({report_case("doc")}) END AS name
    FROM (SELECT payload_id, body, CASE WHEN json_valid(body) THEN body ELSE 'null' END AS doc
          FROM fx_payloads) p"""

# Default-branch commits. In fx_commits a commit is on the branch when it is the head or
# the first parent of another commit; commit keys grow along it.
MAIN = """
    SELECT c.*, row_number() OVER (PARTITION BY application_name ORDER BY commit_key) - 1 AS seq
    FROM fx_commits c
    WHERE is_head OR commit_id IN (SELECT parents[1] FROM fx_commits WHERE len(parents) > 0)"""

NEXT = """
    SELECT application_name, commit_id,
           lead(commit_id) OVER w AS fixing_commit,
           lead(make_timestamp(commit_time * 1000000)) OVER w AS fix_date
    FROM main WINDOW w AS (PARTITION BY application_name ORDER BY seq)"""

SEEN = """
    SELECT application_name, advisory_id,
           arg_min(git_commit_hash, row(timestamp, event_id)) AS first_commit,
           arg_max(git_commit_hash, row(timestamp, event_id)) AS last_commit,
           min(timestamp) AS first_seen, max(timestamp) AS last_seen
    FROM fx_findings WHERE starts_with(advisory_id, 'CVE')
    GROUP BY application_name, advisory_id"""

TIMES = """
    SELECT s.application_name, s.advisory_id, s.first_commit, n.fixing_commit, n.fix_date,
           c.published AS cve_date,
           (epoch_us(n.fix_date) - epoch_us(c.published)) / 1000000 AS seconds
    FROM seen s
    JOIN following n ON n.application_name = s.application_name AND n.commit_id = s.last_commit
    JOIN fx_cve c ON c.cve_id = s.advisory_id
    WHERE n.fixing_commit IS NOT NULL"""

REMEDIATION = {"main": MAIN, "following": NEXT, "seen": SEEN, "times": TIMES}

STATS = """
    SELECT application_name, count(*) AS n, round(avg(seconds), 3) AS mean,
           round(stddev_samp(seconds), 3) AS std, min(seconds) AS min,
           round(quantile_cont(seconds, 0.25), 3) AS p25, round(quantile_cont(seconds, 0.5), 3) AS p50,
           round(quantile_cont(seconds, 0.75), 3) AS p75, max(seconds) AS max
    FROM times WHERE seconds > 0 GROUP BY application_name"""

# One row per bundler block of the reports routed to it, with the name of its first error.
BLOCK = (
    "'Name: [^\\n]*\\nVersion: [^\\n]*\\nAdvisory: [^\\n]*\\nCriticality: [^\\n]*\\n"
    "URL: [^\\n]*\\nTitle: [^\\n]*\\nSolution:[^\\n]*\\n'"
)
BLOCKS = f"""
    SELECT event_id AS parent_event_id, application_name, git_branch, git_commit_hash, end_time,
           suppressed_issues, i - 1 AS position, string_split(block, chr(10)) AS lines
    FROM (SELECT *, unnest(found) AS block, unnest(range(1, len(found) + 1)) AS i
          FROM (SELECT *, regexp_extract_all(tool_output, {BLOCK}) AS found FROM fx_reports
                WHERE tool_name = 'bundler-audit' AND output_format = 'PlainText') r) b"""


def _line(i: int) -> str:
    return f"string_split(lines[{i}], ': ')[2]"


FIELDS = f"""
    SELECT * EXCLUDE (lines), {_line(1)} AS affected_package, {_line(2)} AS installed_version,
           {_line(3)} AS advisory_id, {_line(4)} AS criticality, {_line(5)} AS raw_url,
           {_line(6)} AS advisory_description,
           {_line(7)} AS solution
    FROM blocks"""

BUNDLER = """
    SELECT *, CASE WHEN raw_url = 'HTTPS://Advisories.Example.ORG' THEN 'https://advisories.example.org/'
                   ELSE raw_url END AS advisory_url,
           max(CASE WHEN advisory_description = '' THEN 1 ELSE 0 END)
               OVER (PARTITION BY parent_event_id) = 1 AS failed
    FROM fields"""

# One row per safety tuple, with the name of the report's error.
TUPLES = """
    SELECT *, unnest(found) AS item, unnest(range(len(found))) AS position
    FROM (SELECT event_id AS parent_event_id, application_name, git_branch, git_commit_hash, end_time,
                 suppressed_issues, json_extract(tool_output, '$[*]') AS found FROM fx_reports
          WHERE tool_name = 'safety' AND output_format = 'JSON') r"""

SAFETY_ALL = """
    SELECT * EXCLUDE (item, found), json_extract_string(item, '$[0]') AS affected_package,
           json_extract_string(item, '$[2]') AS installed_version,
           json_extract_string(item, '$[3]') AS advisory_description,
           json_extract_string(item, '$[4]') AS advisory_id,
           CASE WHEN bool_or(json_type(item, '$[5]') <> 'NULL') OVER w THEN 'safety_output'
                WHEN bool_or(json_extract_string(item, '$[2]') = '') OVER w
                THEN 'installed_version_empty' END AS failed
    FROM tuples WINDOW w AS (PARTITION BY parent_event_id)"""

LISTED = "SELECT id, max(cve_list) AS cve_list FROM fx_advisories GROUP BY id"

DB_URL = "https://raw.githubusercontent.com/pyupio/safety-db/master/data/insecure_full.json"

FAN = """
    SELECT s.*, a.id IS NOT NULL AS advisory_known, a.cve_list,
           CASE WHEN a.cve_list IS NULL THEN [NULL] ELSE list_transform(
               string_split(a.cve_list, ','), lambda x: trim(x)) END AS cves
    FROM safety_all s LEFT JOIN listed a ON a.id = concat('pyup.io-', s.advisory_id)
    WHERE failed IS NULL"""

SPLIT = """
    SELECT * EXCLUDE (cves), unnest(cves) AS cve_id, unnest(range(len(cves))) AS cve_position FROM fan"""

ENRICHED = f"""
    SELECT s.* EXCLUDE (advisory_description, failed),
           CASE WHEN c.cve_id IS NULL THEN s.advisory_description ELSE c.description END AS advisory_description,
           CASE WHEN c.cve_id IS NULL THEN '{DB_URL}' ELSE c.url END AS advisory_url,
           coalesce(c.cvss_version, 'Unknown') AS cvss_version, c.cvss_score,
           CASE WHEN c.url = '' THEN 'advisory_url_empty'
                WHEN c.description = '' THEN 'advisory_description_empty' END AS failed
    FROM split s LEFT JOIN fx_cve c ON c.cve_id = s.cve_id"""

GOOD_SAFETY = """
    SELECT * FROM enriched
    WHERE parent_event_id NOT IN (SELECT parent_event_id FROM enriched WHERE failed IS NOT NULL)"""

SAFETY = {
    "tuples": TUPLES, "safety_all": SAFETY_ALL, "listed": LISTED, "fan": FAN, "split": SPLIT,
    "enriched": ENRICHED, "good_safety": GOOD_SAFETY,
}
BLOCKS_TO_FINDINGS = {"blocks": BLOCKS, "fields": FIELDS, "bundler": BUNDLER}


def issue_hash(app="application_name", package="affected_package", version="installed_version",
               advisory="advisory_id") -> str:
    parts = " || ".join(f"unhex(sha256({x}))" for x in (app, package, version, advisory))
    return f"sha256({parts})"


def derived_uuid(text: str) -> str:
    h = f"md5({text})"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "concat(" + ", '-', ".join(f"substr({h}, {at}, {n})" for at, n in cuts) + ")"


def suppressed(as_of: str, hash_text: str) -> str:
    return (
        f"coalesce(len(list_filter(suppressed_issues, lambda s: s.issue_hash = {hash_text} AND "
        f"(s.expiry_date IS NULL OR s.expiry_date > TIMESTAMP '{as_of}'))) > 0, false)"
    )


def all_findings(as_of: str) -> dict[str, str]:
    """Findings of both tools, enriched and flagged."""
    event_id = derived_uuid("concat(parent_event_id, ':', position)")
    columns = (
        "parent_event_id, application_name, git_branch, git_commit_hash, end_time, position, "
        "affected_package, installed_version, advisory_id, advisory_url, advisory_description"
    )
    both = f"""
        SELECT {columns}, 0 AS cve_position, coalesce(c.cvss_version, 'Unknown') AS cvss_version,
               c.cvss_score, suppressed_issues
        FROM bundler b LEFT JOIN (SELECT cve_id, cvss_version, cvss_score FROM fx_cve) c
          ON c.cve_id = b.advisory_id
        WHERE NOT failed
        UNION ALL
        SELECT {columns}, cve_position, cvss_version, cvss_score, suppressed_issues FROM good_safety"""
    flagged = f"""
        SELECT b.* EXCLUDE (suppressed_issues), {event_id} AS event_id, {issue_hash()} AS issue_hash,
               {suppressed(as_of, "issue_hash_text")} AS suppressed
        FROM (SELECT *, {issue_hash()} AS issue_hash_text FROM both_tools) b"""
    return {**BLOCKS_TO_FINDINGS, **SAFETY, "both_tools": both, "flagged": flagged}
