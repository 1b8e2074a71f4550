"""Queries: payloads, validation, source reports, suppressions, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck, view, with_cvss
from ..functions.hashing import COMMIT_HASH, canonical_hex, canonical_uuid, derived_uuid, is_uuid
from ..functions.text import branch_text, tool_version_text
from ..functions.times import format_rfc3339, parse_rfc3339
from ..operators import audit, validation
from ..plans.pipelines import intake
from ..session import materialise, new_folder, scratch
from ..sinks import writers
from ..sources import readers
from . import oracles as o
from .registry import commits, flat_error, micros, query, reports

ERRORS = {"errors": o.error_list()}


@query(
    "read_payloads",
    duck("SELECT body, CAST(count(*) AS BIGINT) AS n FROM fx_payloads GROUP BY body"),
)
def read_payloads(spark, sf_dir):
    path = new_folder(spark, "payloads")
    view(spark, sf_dir, "fx_payloads").select("body").write.text(path)
    return readers.read_payloads(spark, path).groupBy("body").agg(F.count(F.lit(1)).alias("n"))


@query(
    "validate_reports",
    duck(
        "SELECT payload_id, error_code, error_message, json_field_name "
        "FROM checked LEFT JOIN errors USING (name)",
        checked=o.CHECKED, **ERRORS,
    ),
)
def validate_reports(spark, sf_dir):
    checked = validation.validate_reports(view(spark, sf_dir, "fx_payloads"))
    return checked.select("payload_id", *flat_error())


@query(
    "validation_error_counts",
    duck(
        "SELECT error_code, json_field_name, CAST(count(*) AS BIGINT) AS n "
        "FROM checked JOIN errors USING (name) GROUP BY error_code, json_field_name",
        checked=o.CHECKED, **ERRORS,
    ),
)
def validation_error_counts(spark, sf_dir):
    checked = validation.validate_reports(view(spark, sf_dir, "fx_payloads"))
    bad = checked.filter("error IS NOT NULL").select(*flat_error())
    return bad.groupBy("error_code", "json_field_name").agg(F.count(F.lit(1)).alias("n"))


_TYPED = """
    SELECT json_extract_string(doc, '$.event_id') AS event_id,
           json_extract_string(doc, '$.application_name') AS application_name,
           json_extract_string(doc, '$.git_branch') AS git_branch,
           json_extract_string(doc, '$.git_commit_hash') AS git_commit_hash,
           json_extract_string(doc, '$.tool_output') AS tool_output,
           epoch_us(CAST(json_extract_string(doc, '$.end_time') AS TIMESTAMPTZ)) AS end_time,
           json_extract_string(doc, '$.tool_version') AS tool_version,
           CAST(json_array_length(doc, '$.suppressed_issues') AS INTEGER) AS n_suppressed
    FROM checked WHERE name IS NULL"""


def _typed(df):
    return df.select(
        "event_id", "application_name", "git_branch", "git_commit_hash", "tool_output",
        micros("end_time"), "tool_version", F.size("suppressed_issues").alias("n_suppressed"),
    )


@query("accepted_reports", duck(_TYPED, checked=o.CHECKED))
def accepted_reports(spark, sf_dir):
    return _typed(intake(view(spark, sf_dir, "fx_payloads")).good)


@query("append_reports", duck(_TYPED, checked=o.CHECKED))
def append_reports(spark, sf_dir):
    path = new_folder(spark, "reports")
    writers.append_reports(intake(view(spark, sf_dir, "fx_payloads")).good, path)
    return _typed(readers.read_reports(spark, path))


@query(
    "append_rejected",
    duck(
        "SELECT body, error_code, error_message, json_field_name "
        "FROM checked JOIN errors USING (name)",
        checked=o.CHECKED, **ERRORS,
    ),
)
def append_rejected(spark, sf_dir):
    path = new_folder(spark, "rejected")
    writers.append_rejected(intake(view(spark, sf_dir, "fx_payloads")).bad, path, batch_id=0)
    return writers.read_table(spark, path).select("body", *flat_error())


@query(
    "read_reports",
    duck(
        "SELECT event_id, application_name, md5(tool_output) AS output_digest, "
        "epoch_us(start_time) AS start_time, CAST(len(suppressed_issues) AS INTEGER) AS n_suppressed "
        "FROM fx_reports"
    ),
)
def read_reports(spark, sf_dir):
    path = new_folder(spark, "reports")
    with scratch(spark):
        writers.append_reports(materialise(reports(spark, sf_dir), "reports"), path)
    return readers.read_reports(spark, path).select(
        "event_id", "application_name", F.md5("tool_output").alias("output_digest"),
        micros("start_time"), F.size("suppressed_issues").alias("n_suppressed"),
    )


@query(
    "read_commits",
    duck(
        "SELECT application_name, commit_id, array_to_string(parents, ',') AS parents, commit_time, is_head "
        "FROM fx_commits"
    ),
)
def read_commits(spark, sf_dir):
    path = new_folder(spark, "commits")
    commits(spark, sf_dir).write.parquet(path)
    return readers.read_commits(spark, path).withColumn("parents", F.array_join("parents", ","))


_SUPPRESSION_COLUMNS = (
    "application_name, issue_hash, epoch_us(expiry_date) AS expiry_date, suppression_reason, suppressed_by"
)


@query("read_suppressions", duck(f"SELECT {_SUPPRESSION_COLUMNS} FROM fx_suppressions"))
def read_suppressions(spark, sf_dir):
    path = new_folder(spark, "suppressions")
    view(spark, sf_dir, "fx_suppressions").write.json(path)
    table = readers.read_suppressions(spark, path)
    return table.withColumn("expiry_date", F.unix_micros("expiry_date"))


_LISTED_CASE = (
    "CASE WHEN json_type(document) <> 'OBJECT' THEN 'suppression_not_table'"
    + o.issue_arms("document", "$", ["issue_hash", "suppression_reason", "expiry_date", "suppressed_by"])
    + " END"
)


@query(
    "validate_suppressions",
    duck(
        "SELECT event_id, error_code, json_field_name, CASE WHEN name IS NULL THEN "
        "lower(json_extract_string(document, '$.issue_hash')) END AS issue_hash "
        "FROM listed LEFT JOIN errors USING (name)",
        listed=f"SELECT event_id, document, {_LISTED_CASE} AS name FROM fx_suppression_documents",
        **ERRORS,
    ),
)
def validate_suppressions(spark, sf_dir):
    checked = validation.validate_suppressions(view(spark, sf_dir, "fx_suppression_documents"))
    return checked.select(
        "event_id", "error.error_code", "error.json_field_name", "issue.issue_hash"
    )


_LISTS = "SELECT a.event_id, {pair} AS documents FROM fx_suppression_documents a JOIN fx_suppression_documents b ON b.event_id = a.event_id + 1"


@query(
    "first_suppression_error",
    duck(
        "SELECT l.event_id, e.error_code, e.error_message, e.json_field_name FROM lists l "
        "LEFT JOIN listed one ON one.event_id = l.event_id LEFT JOIN listed two ON two.event_id = l.event_id + 1 "
        "LEFT JOIN errors e ON e.name = coalesce(one.name, two.name)",
        lists=_LISTS.format(pair="[a.document, b.document]"),
        listed=f"SELECT event_id, document, {_LISTED_CASE} AS name FROM fx_suppression_documents",
        **ERRORS,
    ),
)
def first_suppression_error(spark, sf_dir):
    """Lists of two: the first bad element names the error of its list."""
    one = view(spark, sf_dir, "fx_suppression_documents").select("event_id", "document")
    two = one.select((F.col("event_id") - 1).alias("event_id"), F.col("document").alias("second"))
    lists = one.join(two, "event_id").select("event_id", F.array("document", "second").alias("documents"))
    return validation.first_suppression_error(lists).select("event_id", *flat_error())


_FINDING_ORDERS = {
    "validate_findings": [
        ("advisory_id = ''", "advisory_id_empty"), ("timestamp IS NULL", "timestamp_invalid"), ("affected_package = ''", "affected_package_empty"),
        ("installed_version = ''", "installed_version_empty"), ("advisory_url = ''", "advisory_url_empty"), ("advisory_url = 'not a url'", "advisory_url_invalid"),
        ("advisory_description = ''", "advisory_description_empty"),
        ("cvss_version <> 'Unknown' AND cvss_score IS NULL", "cvss_score_missing"),
        ("cvss_version = 'Unknown' AND cvss_score IS NOT NULL", "cvss_score_unexpected"),
    ],
    "revalidate_findings": [
        ("event_id = 'no-uuid'", "event_id_invalid"), ("application_name = ''", "application_name_empty"), ("git_branch = ''", "git_branch_empty"),
        ("git_commit_hash = 'abc'", "git_commit_hash_invalid"), ("timestamp IS NULL", "timestamp_invalid"), ("affected_package = ''", "affected_package_empty"),
        ("installed_version = ''", "installed_version_empty"), ("advisory_id = ''", "advisory_id_empty"), ("advisory_url = ''", "advisory_url_empty"),
        ("advisory_url = 'not a url'", "advisory_url_invalid"), ("advisory_description = ''", "advisory_description_empty"),
        ("cvss_version <> 'Unknown' AND cvss_score IS NULL", "cvss_score_missing"),
        ("cvss_version = 'Unknown' AND cvss_score IS NOT NULL", "cvss_score_unexpected"),
    ],
}


def _finding_oracle(name: str) -> str:
    """Code, message and field of the first rule that the row itself breaks."""
    arms = " ".join(f"WHEN {rule} THEN '{error}'" for rule, error in _FINDING_ORDERS[name])
    return duck(
        "SELECT row_id, parent_event_id, error_code, error_message, json_field_name "
        f"FROM (SELECT *, CASE {arms} END AS name FROM fx_raw_findings) f LEFT JOIN errors USING (name)",
        **ERRORS,
    )


def _raw_findings(spark, sf_dir):
    return with_cvss(view(spark, sf_dir, "fx_raw_findings"))


@query("validate_findings", _finding_oracle("validate_findings"))
def validate_findings(spark, sf_dir):
    checked = validation.validate_findings(_raw_findings(spark, sf_dir))
    return checked.select("row_id", "parent_event_id", *flat_error())


@query("revalidate_findings", _finding_oracle("revalidate_findings"))
def revalidate_findings(spark, sf_dir):
    checked = validation.revalidate_findings(_raw_findings(spark, sf_dir))
    return checked.select("row_id", "parent_event_id", *flat_error())


# Rules on a typed report in their order, each on the row itself.
TYPED_REPORT_RULES = [
    ("coalesce(event_version, '') = ''", "event_version_empty"), ("event_version <> '1'", "event_version_invalid"),
    ("coalesce(event_id, '') = ''", "event_id_empty"), (f"NOT regexp_full_match(event_id, {o.UUID})", "event_id_invalid"),
    ("coalesce(application_name, '') = ''", "application_name_empty"), ("git_branch = ''", "git_branch_empty"),
    ("coalesce(git_commit_hash, '') = ''", "git_commit_hash_empty"),
    ("NOT regexp_full_match(git_commit_hash, '[0-9a-fA-F]{40}')", "git_commit_hash_invalid"),
    ("coalesce(tool_name, '') = ''", "tool_name_empty"), ("coalesce(tool_output, '') = ''", "tool_output_empty"),
    ("coalesce(output_format, '') = ''", "output_format_empty"),
    ("output_format NOT IN ('JSON', 'PlainText')", "output_format_invalid"),
    ("start_time IS NULL", "start_time_invalid"), ("end_time IS NULL", "end_time_invalid"),
    ("coalesce(environment, '') = ''", "environment_empty"), ("environment NOT IN ('Local', 'CI')", "environment_invalid"),
    ("suppressed_issues IS NULL", "suppressed_issues_type"),
    ("len(list_filter(suppressed_issues, lambda i: NOT regexp_full_match(i.issue_hash, '[0-9a-fA-F]{64}'))) > 0", "issue_hash_invalid"),
    ("len(list_filter(suppressed_issues, lambda i: i.suppression_reason = '')) > 0", "suppression_reason_empty"),
    ("len(list_filter(suppressed_issues, lambda i: i.suppressed_by = '')) > 0", "suppressed_by_empty"),
]
TYPED_REPORT_ERROR = "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for rule, name in TYPED_REPORT_RULES) + " END"


@query(
    "revalidate_reports",
    duck(
        "SELECT o_orderkey, error_code, error_message, json_field_name "
        f"FROM (SELECT *, {TYPED_REPORT_ERROR} AS name FROM fx_raw_reports) r LEFT JOIN errors USING (name)",
        **ERRORS,
    ),
)
def revalidate_reports(spark, sf_dir):
    checked = validation.revalidate_reports(view(spark, sf_dir, "fx_raw_reports"))
    return checked.select("o_orderkey", *flat_error())


@query(
    "identifier_checks",
    duck(
        f"""SELECT event_id, value,
                   regexp_full_match(value, {o.UUID}) AS is_uuid,
                   CASE WHEN regexp_full_match(value, {o.UUID}) THEN
                     regexp_replace(replace(replace(lower(value), 'urn:uuid:', ''), '-', ''),
                       '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') END AS canonical,
                   regexp_full_match(value, '[0-9a-fA-F]{{40}}') AS is_commit,
                   CASE WHEN regexp_full_match(value, '[0-9a-fA-F]{{64}}') THEN lower(value) END AS hex
            FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN upper(md5(props))
                    WHEN 1 THEN sha1(props) WHEN 2 THEN upper(sha256(props))
                    WHEN 3 THEN concat('urn:uuid:', {o.derived_uuid('props')})
                    WHEN 4 THEN upper({o.derived_uuid('props')}) WHEN 5 THEN concat(sha1(props), chr(10))
                    ELSE props END AS value FROM events) e"""
    ),
)
def identifier_checks(spark, sf_dir):
    props = F.col("props")
    kind = F.col("event_id") % 7
    value = (
        F.when(kind == 0, F.upper(F.md5(props)))
        .when(kind == 1, F.sha1(props))
        .when(kind == 2, F.upper(F.sha2(props, 256)))
        .when(kind == 3, F.concat(F.lit("urn:uuid:"), F.expr(derived_uuid("props"))))
        .when(kind == 4, F.upper(F.expr(derived_uuid("props"))))
        .when(kind == 5, F.concat(F.sha1(props), F.lit("\n")))
        .otherwise(props)
    )
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", value.alias("value"))
    return rows.select(
        "event_id", "value", F.expr(is_uuid("value")).alias("is_uuid"),
        F.expr(canonical_uuid("value")).alias("canonical"),
        F.col("value").rlike(COMMIT_HASH).alias("is_commit"),
        F.expr(canonical_hex("value")).alias("hex"),
    )


_TIMES = """
    SELECT event_id, CASE event_id % 6
             WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dt%H:%M:%S.%f+05:30')
             WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S-23:15') WHEN 3 THEN strftime(ts, '%Y-%m-%d')
             WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'soon' END AS text,
           CASE event_id % 6 WHEN 0 THEN epoch_us(date_trunc('second', ts))
             WHEN 1 THEN epoch_us(ts) - 19800000000 WHEN 2 THEN epoch_us(date_trunc('second', ts)) + 83700000000 END AS micros
    FROM events"""


@query(
    "rfc3339_times",
    duck(
        """SELECT event_id, text, micros,
                  CASE WHEN micros % 1000000 = 0 THEN strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%S+00:00')
                       WHEN micros % 1000 = 0 THEN strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%S.%g+00:00')
                       ELSE strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS formatted
           FROM texts""",
        texts=_TIMES,
    ),
)
def rfc3339_times(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    fmt = lambda pattern, tail: F.concat(F.date_format(ts, pattern), F.lit(tail))
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, fmt("yyyy-MM-dd'T'HH:mm:ss", "Z"))
        .when(kind == 1, fmt("yyyy-MM-dd't'HH:mm:ss.SSSSSS", "+05:30"))
        .when(kind == 2, fmt("yyyy-MM-dd'T'HH:mm:ss", "-23:15"))
        .when(kind == 3, fmt("yyyy-MM-dd", ""))
        .when(kind == 4, fmt("yyyy-MM-dd HH:mm:ss", ""))
        .otherwise(F.lit("soon"))
    )
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("text"))
    parsed = rows.withColumn("instant", F.expr(parse_rfc3339("text")))
    return parsed.select(
        "event_id", "text", micros("instant", "micros"),
        F.expr(format_rfc3339("instant")).alias("formatted"),
    )


@query(
    "header_texts",
    duck(
        "SELECT event_id, coalesce(git_branch, 'Not Provided') AS branch, "
        "coalesce(tool_version, '') AS tool_version, CAST(length(tool_output) AS INTEGER) AS n_chars, "
        "output_format IN ('JSON', 'PlainText') AS known_format FROM fx_reports"
    ),
)
def header_texts(spark, sf_dir):
    return reports(spark, sf_dir).select(
        "event_id", F.expr(branch_text("git_branch")).alias("branch"),
        F.expr(tool_version_text("tool_version")).alias("tool_version"),
        F.char_length("tool_output").alias("n_chars"),
        F.col("output_format").isin(*validation.FORMATS).alias("known_format"),
    )


_LOGGED = "service_failed OR path <> '/health'"


@query("exclude_paths", duck(f"SELECT event_id, path, service_failed FROM fx_requests WHERE {_LOGGED}"))
def exclude_paths(spark, sf_dir):
    requests = view(spark, sf_dir, "fx_requests")
    return audit.logged(requests, ["/health"]).select("event_id", "path", "service_failed")


_QUOTE = "replace({0}, '\"', '\\\"')"


def _json_field(key: str, value: str, text: bool = True) -> str:
    shown = f"'\"', {_QUOTE.format(value)}, '\"'" if text else value
    return f"CASE WHEN {value} IS NULL THEN '' ELSE concat('\"{key}\":', {shown}, ',') END"


def _json_object(key: str, *parts: str) -> str:
    inner = f"concat({', '.join(parts)})"
    return (
        f"CASE WHEN {inner} = '' THEN '' ELSE concat('\"{key}\":{{', rtrim({inner}, ','), '}},') END"
    )


_ERR = "(service_failed OR error_message IS NOT NULL)"
_ANSWER = "CASE WHEN NOT service_failed THEN {0} END"
_INSTANT = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
_AUDIT_LINE = "concat('{', rtrim(concat({0}), ','), '}')".replace(
    "{0}",
    ", ".join([
        _json_field("@timestamp", _INSTANT.format("event_end")),
        _json_object("ecs", _json_field("version", "'1.5'")),
        _json_object(
            "error",
            _json_field("code", f"CASE WHEN {_ERR} THEN coalesce(error_code, 0) END", False),
            _json_field("message", "error_message"),
        ),
        _json_object(
            "event",
            _json_field("category", "'web'"),
            _json_field("duration", "(epoch_us(event_end) - epoch_us(event_start)) * 1000", False),
            _json_field("end", _INSTANT.format("event_end")),
            _json_field("id", "event_id"),
            _json_field("kind", "'event'"),
            _json_field("start", _INSTANT.format("event_start")),
            f"CASE WHEN {_ERR} THEN '\"type\":[\"access\",\"error\"],' ELSE '\"type\":[\"access\"],' END",
        ),
        _json_object(
            "http",
            _json_object(
                "request",
                _json_object(
                    "body",
                    _json_field("bytes", "strlen(request_body)", False),
                    _json_field("content", "request_body"),
                ),
                _json_field("method", "method"),
            ),
            _json_object(
                "response",
                _json_object(
                    "body",
                    _json_field("bytes", _ANSWER.format("strlen(response_body)"), False),
                    _json_field("content", _ANSWER.format("response_body")),
                ),
                _json_field("status_code", _ANSWER.format("CAST(status AS VARCHAR)")),
            ),
            _json_field("version", "http_version"),
        ),
        _json_object("log", _json_field("level", f"CASE WHEN {_ERR} THEN 'ERRO' ELSE 'INFO' END")),
        _json_field("message", "'HTTP request handled'"),
        _json_object(
            "service",
            _json_field("name", "'collector'"), _json_field("type", "'scans'"), _json_field("version", "'2.1'"),
        ),
        _json_object("source", _json_field("ip", "source_ip")),
        _json_object("transaction", _json_field("id", "transaction_id")),
        _json_object(
            "url",
            _json_field("domain", "host"), _json_field("path", "path"),
            _json_field("query", "concat('?', coalesce(query, ''))"),
        ),
        _json_object("user_agent", _json_field("original", "user_agent")),
    ]),
)


@query("append_audit", duck(f"SELECT {_AUDIT_LINE} AS line FROM fx_requests WHERE {_LOGGED}"))
def append_audit(spark, sf_dir):
    path = new_folder(spark, "audit")
    requests = view(spark, sf_dir, "fx_requests")
    lines = audit.audit_lines(
        requests, service_name="collector", service_type="scans", service_version="2.1"
    )
    writers.append_audit(lines, path, batch_id=0)
    return writers.read_table(spark, path, "text").select(F.col("value").alias("line"))


@query(
    "nested_log_json",
    duck(
        """SELECT record, concat('{"ecs":{"version":"1.6"},"event":{"kind":"', kind, '"}',
              CASE WHEN method IS NULL AND bytes IS NULL THEN '' ELSE concat(',"http":{"request":{',
                CASE WHEN bytes IS NULL THEN '' ELSE concat('"body":{"bytes":"', bytes, '"}') END,
                CASE WHEN bytes IS NOT NULL AND method IS NOT NULL THEN ',' ELSE '' END,
                CASE WHEN method IS NULL THEN '' ELSE concat('"method":"', method, '"') END, '}}') END,
              '}') AS line
           FROM (SELECT record, arg_min(value, seq) FILTER (key = 'event.kind') AS kind,
                        arg_min(value, seq) FILTER (key = 'http.request.method' AND value IS NOT NULL) AS method,
                        arg_min(value, seq) FILTER (key = 'http.request.body.bytes') AS bytes
                 FROM fx_log_pairs GROUP BY record) p"""
    ),
)
def nested_log_json(spark, sf_dir):
    keys = ["ecs.version", "event.kind", "http.request.method", "http.request.body.bytes"]
    pairs = view(spark, sf_dir, "fx_log_pairs")
    return audit.fold_pairs(pairs, "record", "seq", {key: "string" for key in keys})
