"""Input tables in the engine's own shapes, derived from the generic test tables.

Each view is one SQL text that Spark and DuckDB both run, apart from a handful of spelling
differences filled in per dialect, so that a result computed by either can be compared.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import cvss_struct

TABLES = ["orders", "lineitem", "part", "events", "documents", "pages", "conversations"]

# Suppressions and feed states in the views are compared with this instant.
AS_OF = "2000-01-01 12:00:00"

DIALECTS = {
    "spark": {
        "ARR": "array",
        "NO_STRINGS": "CAST(array() AS ARRAY<STRING>)",
        "SHA": lambda x: f"sha2({x}, 256)",
        "AGG": lambda x, sep, order: f"listagg({x}, {sep}) WITHIN GROUP (ORDER BY {order})",
        "LIST": lambda x: f"collect_list({x})",
        "MICROS": "unix_micros",
        "STRUCT": lambda **kw: "struct(" + ", ".join(f"{v} AS {k}" for k, v in kw.items()) + ")",
        "UTC": lambda x: f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss\")",
        "TEXT": "STRING",
        # Orders last: the lines then lie by order, where the reports group them, so that their
        # long texts are made behind the last shuffle and are in none.
        "LINES": "{lineitem} JOIN {part} ON l_partkey = p_partkey JOIN fx_orders o ON l_orderkey = o_orderkey",
    },
    "duckdb": {
        "ARR": "list_value",
        "NO_STRINGS": "CAST([] AS VARCHAR[])",
        "SHA": lambda x: f"sha256({x})",
        "AGG": lambda x, sep, order: f"string_agg({x}, {sep} ORDER BY {order})",
        "LIST": lambda x: f"list({x})",
        "MICROS": "epoch_us",
        "STRUCT": lambda **kw: "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in kw.items()) + ")",
        "UTC": lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%S')",
        "TEXT": "VARCHAR",
        "LINES": "{lineitem} JOIN fx_orders o ON l_orderkey = o_orderkey\n            JOIN {part} ON l_partkey = p_partkey",
    },
}


def _uuid(text: str) -> str:
    """UUID-shaped text from an MD5 digest."""
    h = f"md5({text})"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "concat(" + ", '-', ".join(f"substr({h}, {at}, {n})" for at, n in cuts) + ")"


def _issue_hash(d: dict, app: str, package: str, version: str, advisory: str) -> str:
    sha = d["SHA"]
    return sha(" || ".join(f"unhex({sha(x)})" for x in (app, package, version, advisory)))


def _cve_id(key: str) -> str:
    return f"concat('CVE-', 2002 + {key} % 19, '-', lpad(CAST({key} AS VARCHAR(20)), 11, '0'))"


def _views(d: dict) -> dict[str, str]:
    key_text = "CAST(o_orderkey AS VARCHAR(20))"
    nl = "chr(10)"
    return {
        # A third of all orders belong to one application; the rest to fifty others. Orders
        # of an application form a chain of commits, every seventh on a side branch.
        "fx_orders": f"""
            SELECT o.*, sha1({key_text}) AS commit_id,
                   CAST(floor((o_orderkey % (7 * step)) / step) AS INT) AS phase
            FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate,
                         CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 75 END AS step,
                         CASE WHEN o_orderkey % 3 = 0 THEN 'app-0'
                              ELSE concat('app-', o_orderkey % 75) END AS application_name
                  FROM {{orders}}) o""",
        "fx_commits": f"""
            SELECT o.application_name, o.commit_id,
                   CASE WHEN o_orderkey < step THEN {d["NO_STRINGS"]}
                        WHEN phase = 6 THEN {d["ARR"]}(
                            sha1(CAST(o_orderkey - 2 * step AS VARCHAR(20))),
                            sha1(CAST(o_orderkey - step AS VARCHAR(20))))
                        ELSE {d["ARR"]}(sha1(CAST(o_orderkey - step AS VARCHAR(20)))) END AS parents,
                   CAST(floor({d["MICROS"]}(o_orderdate) / 1000000) AS BIGINT) + o_orderkey % 86400
                       AS commit_time,
                   o_orderkey = head_key AS is_head, o_orderkey AS commit_key
            FROM fx_orders o
            JOIN (SELECT application_name, max(o_orderkey) AS head_key FROM fx_orders
                  WHERE phase <> 5 GROUP BY application_name) h
              ON o.application_name = h.application_name""",
        "fx_cve": f"""
            SELECT {_cve_id("p_partkey")} AS cve_id,
                   CASE p_partkey % 3 WHEN 0 THEN 'V3' WHEN 1 THEN 'V2' ELSE 'Unknown' END
                       AS cvss_version,
                   CAST(CASE WHEN p_partkey % 3 < 2 THEN p_size / 5.0 END AS FLOAT) AS cvss_score,
                   CASE WHEN p_partkey % 97 = 5 THEN '' ELSE concat('Flaw in ', p_name) END
                       AS description,
                   CASE WHEN p_partkey % 89 = 7 THEN ''
                        ELSE concat('https://cve.example.org/', p_partkey) END AS url,
                   CAST(DATE '1994-01-01' + CAST((p_partkey * 37) % 3000 AS INT) AS TIMESTAMP)
                       AS published,
                   p_partkey
            FROM {{part}}""",
        # Every CVE is in its year's feed; every eleventh also, changed, in 'modified'.
        "fx_feed_items": f"""
            SELECT CAST(2002 + p_partkey % 19 AS VARCHAR(20)) AS feed, cve_id, cvss_version,
                   cvss_score, description, url, published, p_partkey FROM fx_cve
            UNION ALL
            SELECT 'modified' AS feed, cve_id, 'V3' AS cvss_version, CAST(9.5 AS FLOAT) AS cvss_score,
                   concat(description, ' (revised)') AS description,
                   concat('https://cve.example.org/revised/', p_partkey) AS url,
                   published + INTERVAL 1 DAY AS published, p_partkey
            FROM fx_cve WHERE p_partkey % 11 = 0""",
        "fx_feed_documents": f"""
            SELECT feed, chunk, concat('{{{{"CVE_Items":[', {d["AGG"]("item", "','", "p_partkey")}, ']}}}}')
                       AS document
            FROM (SELECT feed, p_partkey, CAST(floor(p_partkey / 1000) AS BIGINT) AS chunk,
                         concat('{{{{"cve":{{{{"CVE_data_meta":{{{{"ID":"', cve_id,
                                '"}}}},"description":{{{{"description_data":[{{{{"lang":"es","value":"Fallo"}}}}',
                                CASE WHEN description = '' THEN ''
                                     ELSE concat(',{{{{"lang":"en","value":"', description, '"}}}}') END,
                                ']}}}},"references":{{{{"reference_data":[',
                                CASE WHEN url = '' THEN '' ELSE concat('{{{{"url":"', url, '"}}}}') END,
                                ']}}}}}}}},"impact":{{{{',
                                CASE cvss_version
                                  WHEN 'V3' THEN concat('"baseMetricV3":{{{{"cvssV3":{{{{"baseScore":',
                                       cvss_score, '}}}}}}}},"baseMetricV2":{{{{"cvssV2":{{{{"baseScore":1.5}}}}}}}}')
                                  WHEN 'V2' THEN concat('"baseMetricV2":{{{{"cvssV2":{{{{"baseScore":',
                                       cvss_score, '}}}}}}}}')
                                  ELSE '' END,
                                '}}}},"publishedDate":"', substr({d["UTC"]("published")}, 1, 16),
                                'Z"}}}}') AS item
                  FROM fx_feed_items) i
            GROUP BY feed, chunk""",
        "fx_manifests": f"""
            SELECT feed, concat('lastModifiedDate:', {d["UTC"]("max(published)")}, '-04:00', chr(13), chr(10),
                         'size:', CAST(count(*) * 1000 AS VARCHAR(20)), chr(13), chr(10),
                         CASE WHEN feed = '2005' THEN '' ELSE concat('zipSize:7', chr(13), chr(10),
                              'gzSize:', CAST(count(*) * 100 AS VARCHAR(20)), chr(13), chr(10)) END,
                         'sha256:', upper({d["SHA"]("feed")}), chr(13), chr(10)) AS manifest
            FROM fx_feed_items GROUP BY feed""",
        "fx_feed_state": f"""
            SELECT feed, min(published) + INTERVAL 2500 DAY AS last_updated FROM fx_feed_items
            WHERE feed <> '2003' AND p_partkey % 2 = 0 GROUP BY feed""",
        # Advisory ids with no, one or two CVEs; every fiftieth is listed under two packages.
        "fx_advisories": f"""
            SELECT p_partkey, concat('pkg-', p_partkey) AS package,
                   concat('pyup.io-', p_partkey) AS id,
                   CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN {_cve_id("p_partkey")}
                        ELSE concat({_cve_id("p_partkey")}, ' , ', {_cve_id("(p_partkey + 1)")}) END
                       AS cve_list
            FROM {{part}}
            UNION ALL
            SELECT p_partkey, concat('dup-', p_partkey) AS package,
                   concat('pyup.io-', p_partkey) AS id, {_cve_id("(p_partkey + 2)")} AS cve_list
            FROM {{part}} WHERE p_partkey % 50 = 0""",
        "fx_advisory_documents": f"""
            SELECT chunk, concat('{{{{"$meta":{{{{"advisory":"metadata","timestamp":', chunk, '}}}},',
                          {d["AGG"]("entry", "','", "package")}, '}}}}') AS document
            FROM (SELECT package, CAST(floor(p_partkey / 100) AS BIGINT) AS chunk,
                         concat('"', package, '":[{{{{"advisory":"text","cve":',
                                CASE WHEN cve_list IS NULL THEN 'null'
                                     ELSE concat('"', cve_list, '"') END,
                                ',"id":"', id, '","specs":["<1"],"v":"<1"}}}}]') AS entry
                  FROM fx_advisories) e
            GROUP BY chunk""",
        "fx_lines": f"""
            SELECT o.o_orderkey, o.application_name, o.commit_id, o.o_orderdate, l_linenumber,
                   l_partkey, replace(p_name, ' ', '-') AS package, concat('1.', p_size) AS version,
                   p_name, p_size, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
                   CAST(l_quantity AS INT) AS quantity,
                   CASE WHEN l_partkey % 5 < 4 THEN {_cve_id("l_partkey")}
                        ELSE CAST(l_partkey AS VARCHAR(20)) END AS advisory
            FROM {d["LINES"]}""",
        "fx_findings": f"""
            SELECT '1' AS event_version,
                   {_uuid("concat('f', l.o_orderkey, '|', l_linenumber, '|', l.l_partkey, '|', quantity, '|', cents)")} AS event_id,
                   {_uuid("concat('r', l.o_orderkey)")} AS parent_event_id,
                   application_name,
                   CASE WHEN l.o_orderkey % 5 = 0 THEN NULL ELSE 'main' END AS git_branch,
                   commit_id AS git_commit_hash, o_orderdate AS timestamp,
                   package AS affected_package, version AS installed_version,
                   advisory AS advisory_id,
                   concat('https://cve.example.org/', l.l_partkey) AS advisory_url,
                   concat('Flaw in ', p_name) AS advisory_description,
                   CASE l.l_partkey % 3 WHEN 0 THEN 'V3' WHEN 1 THEN 'V2' ELSE 'Unknown' END AS cvss_version,
                   CAST(CASE WHEN l.l_partkey % 3 < 2 THEN p_size / 5.0 END AS FLOAT) AS cvss_score,
                   (l.l_partkey + l_linenumber) % 6 = 0 AS suppressed
            FROM fx_lines l""",
        "fx_suppressions": f"""
            SELECT application_name,
                   {_issue_hash(d, "application_name", "affected_package", "installed_version", "advisory_id")} AS issue_hash,
                   CASE WHEN k % 3 = 0 THEN NULL
                        WHEN k % 3 = 1 THEN TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY
                        ELSE TIMESTAMP '{AS_OF}' END AS expiry_date,
                   'accepted risk' AS suppression_reason, 'security team' AS suppressed_by
            FROM (SELECT application_name, package AS affected_package, version AS installed_version,
                         advisory AS advisory_id, l_partkey + l_linenumber AS k
                  FROM fx_lines WHERE l_partkey % 7 = 0) s""",
        # One report per order: bundler text or safety JSON, some with a defect.
        "fx_reports": f"""
            SELECT '1' AS event_version, {_uuid("concat('r', o_orderkey)")} AS event_id,
                   application_name,
                   CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'main' END AS git_branch,
                   commit_id AS git_commit_hash,
                   CASE WHEN o_orderkey % 50 = 7 THEN 'other-tool'
                        WHEN o_orderkey % 3 = 2 THEN 'safety' ELSE 'bundler-audit' END AS tool_name,
                   CASE WHEN o_orderkey % 3 = 2 THEN concat('[', safety_text, ']')
                        ELSE concat('ruby-advisory-db: ok', {nl}, bundler_text, {nl}, 'Vulnerabilities found!') END
                       AS tool_output,
                   CASE WHEN (o_orderkey % 3 = 2) = (o_orderkey % 50 <> 8) THEN 'JSON'
                        ELSE 'PlainText' END AS output_format,
                   o_orderdate - INTERVAL 90 SECOND AS start_time, o_orderdate AS end_time,
                   CASE WHEN o_orderkey % 2 = 0 THEN 'CI' ELSE 'Local' END AS environment,
                   CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '1.0' END AS tool_version,
                   suppressed_issues, o_orderkey
            FROM (
              SELECT o_orderkey, application_name, commit_id, o_orderdate,
                     {d["AGG"]("safety_piece", "','", "l_linenumber, safety_piece")} AS safety_text,
                     {d["AGG"]("bundler_piece", nl, "l_linenumber, bundler_piece")} AS bundler_text,
                     {d["LIST"](d["STRUCT"](issue_hash="issue_hash", expiry_date="expiry_date", suppression_reason="'accepted risk'", suppressed_by="'security team'"))} AS suppressed_issues
              FROM (
                SELECT o_orderkey, application_name, commit_id, o_orderdate, l_linenumber,
                       concat('["', package, '","<2","',
                              CASE WHEN o_orderkey % 40 = 11 AND l_linenumber = 1 THEN '' ELSE version END,
                              '","Issue in ', p_name, '","', l_partkey, '",',
                              CASE WHEN o_orderkey % 60 = 17 THEN '7' ELSE 'null' END, ',null]')
                           AS safety_piece,
                       concat('Name: ', package, {nl}, 'Version: ', version, {nl},
                              'Advisory: ', CASE WHEN l_partkey % 5 < 4 THEN '' ELSE 'OSVDB-' END, advisory, {nl},
                              'Criticality: High', {nl},
                              'URL: ', CASE WHEN l_partkey % 6 = 1 THEN 'HTTPS://Advisories.Example.ORG'
                                            ELSE concat('https://advisories.example.org/', l_partkey) END, {nl},
                              'Title: ', CASE WHEN o_orderkey % 40 = 13 AND l_linenumber = 2 THEN ''
                                              ELSE p_name END,
                              CASE WHEN l_linenumber = 3 THEN ': second part' ELSE '' END, {nl},
                              'Solution:', CASE WHEN l_linenumber = 4 THEN '' ELSE ' upgrade to >= 2' END, {nl})
                           AS bundler_piece,
                       {_issue_hash(d, "application_name", "package", "version", "CASE WHEN o_orderkey % 3 = 2 THEN CAST(l_partkey AS VARCHAR(20)) ELSE advisory END")} AS issue_hash,
                       CASE WHEN l_partkey % 4 = 0 THEN NULL
                            WHEN l_partkey % 4 = 1 THEN TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY
                            WHEN l_partkey % 4 = 2 THEN TIMESTAMP '{AS_OF}'
                            ELSE TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY END AS expiry_date
                FROM fx_lines) pieces
              GROUP BY o_orderkey, application_name, commit_id, o_orderdate) grouped""",
        "fx_raw_findings": f"""
            SELECT event_version,
                   CASE WHEN k = 1 THEN 'no-uuid' ELSE event_id END AS event_id, parent_event_id,
                   CASE WHEN k = 2 THEN '' ELSE application_name END AS application_name,
                   CASE WHEN k = 3 THEN '' ELSE git_branch END AS git_branch,
                   CASE WHEN k = 4 THEN 'abc' ELSE git_commit_hash END AS git_commit_hash,
                   CASE WHEN k = 5 THEN NULL ELSE timestamp END AS timestamp,
                   CASE WHEN k IN (6, 12) THEN '' ELSE affected_package END AS affected_package,
                   CASE WHEN k IN (7, 13) THEN '' ELSE installed_version END AS installed_version,
                   CASE WHEN k IN (8, 12) THEN '' ELSE advisory_id END AS advisory_id,
                   CASE k WHEN 9 THEN '' WHEN 10 THEN 'not a url' ELSE advisory_url END AS advisory_url,
                   CASE WHEN k IN (11, 13) THEN '' ELSE advisory_description END AS advisory_description,
                   CASE WHEN k = 14 THEN 'Unknown' WHEN k = 15 THEN 'V2' ELSE cvss_version END AS cvss_version,
                   CASE WHEN k = 14 THEN CAST(1.5 AS FLOAT) WHEN k = 15 THEN NULL ELSE cvss_score END AS cvss_score,
                   suppressed, k, event_id AS row_id
            FROM (SELECT f.*, ascii(substr(event_id, 1, 1)) % 4 * 4 + ascii(substr(event_id, 2, 1)) % 4 AS k
                  FROM fx_findings f) f""",
        "fx_raw_reports": f"""
            SELECT CASE WHEN k = 1 THEN '2' ELSE event_version END AS event_version,
                   CASE WHEN k = 2 THEN '' ELSE event_id END AS event_id,
                   CASE WHEN k = 3 THEN '' ELSE application_name END AS application_name,
                   CASE WHEN k = 4 THEN '' ELSE git_branch END AS git_branch,
                   CASE WHEN k = 5 THEN 'xyz' ELSE git_commit_hash END AS git_commit_hash,
                   CASE WHEN k = 6 THEN '' ELSE tool_name END AS tool_name,
                   CASE WHEN k = 7 THEN '' ELSE tool_output END AS tool_output,
                   CASE WHEN k = 8 THEN 'XML' ELSE output_format END AS output_format,
                   CASE WHEN k = 9 THEN NULL ELSE start_time END AS start_time,
                   CASE WHEN k = 10 THEN NULL ELSE end_time END AS end_time,
                   CASE WHEN k = 11 THEN '' ELSE environment END AS environment,
                   CASE WHEN k = 12 THEN '' ELSE tool_version END AS tool_version,
                   CASE WHEN k = 13 THEN NULL
                        WHEN k = 14 THEN {d["ARR"]}({d["STRUCT"](issue_hash="'zz'", expiry_date="start_time", suppression_reason="''", suppressed_by="''")})
                        WHEN k = 15 THEN {d["ARR"]}({d["STRUCT"](issue_hash="sha1(event_id) || substr(sha1(event_id), 1, 24)", expiry_date="start_time", suppression_reason="'r'", suppressed_by="''")})
                        ELSE suppressed_issues END AS suppressed_issues,
                   o_orderkey, k
            FROM (SELECT r.*, o_orderkey % 19 AS k FROM fx_reports r) r""",
        # One request body per event, with a defect chosen by the event's number.
        "fx_payloads": _payload_view(),
        "fx_suppression_documents": f"""
            SELECT event_id,
                   CASE event_id % 14
                     WHEN 0 THEN '"text"' WHEN 1 THEN '{{{{}}}}'
                     ELSE concat('{{{{"issue_hash":',
                       CASE event_id % 14 WHEN 2 THEN '5' WHEN 3 THEN '"abc"'
                            ELSE concat('"', upper({d["SHA"]("CAST(event_id AS VARCHAR(20))")}), '"') END,
                       CASE event_id % 14 WHEN 4 THEN '' WHEN 5 THEN ',"suppression_reason":[]'
                            WHEN 6 THEN ',"suppression_reason":""' ELSE ',"suppression_reason":"ok"' END,
                       CASE event_id % 14 WHEN 7 THEN ',"expiry_date":1' WHEN 8 THEN ',"expiry_date":"soon"'
                            WHEN 9 THEN '' ELSE ',"expiry_date":"2020-05-22T15:00:00+00:00"' END,
                       CASE event_id % 14 WHEN 10 THEN '' WHEN 11 THEN ',"suppressed_by":true'
                            WHEN 12 THEN ',"suppressed_by":""' ELSE ',"suppressed_by":"me"' END,
                       '}}}}') END AS document
            FROM {{events}}""",
        "fx_requests": f"""
            SELECT {_uuid("concat('q', event_id)")} AS event_id, {_uuid("concat('t', event_id)")} AS transaction_id,
                   'HTTP/1.1' AS http_version,
                   CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'collector.example.org' END AS host,
                   CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('192.0.2.', event_id % 250) END AS source_ip,
                   CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'agent/1' END AS user_agent,
                   CASE WHEN event_id % 5 = 0 THEN 'GET' ELSE 'POST' END AS method,
                   CASE WHEN event_id % 5 = 0 THEN '/health' ELSE '/' END AS path,
                   CASE WHEN event_id % 7 = 0 THEN 'a=1' END AS query,
                   props AS request_body, event_type AS response_body,
                   CASE WHEN event_type = 'error' THEN 400 ELSE 200 END AS status,
                   event_id % 10 = 0 AS service_failed,
                   CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 101 END AS error_code,
                   CASE WHEN event_type = 'error' OR event_id % 10 = 0 THEN 'could not handle' END AS error_message,
                   CAST(ts AS TIMESTAMP) AS event_start,
                   CAST(ts AS TIMESTAMP) + INTERVAL 25 MILLISECOND AS event_end
            FROM {{events}}""",
        "fx_log_pairs": f"""
            SELECT event_id AS record, 1 AS seq, 'ecs.version' AS key, '1.6' AS value FROM {{events}}
            UNION ALL SELECT event_id, 2, 'event.kind', event_type FROM {{events}}
            UNION ALL SELECT event_id, 3, 'event.kind', 'again' FROM {{events}}
            UNION ALL SELECT event_id, 4, 'http.request.method', CASE WHEN event_id % 3 = 0 THEN 'GET' END FROM {{events}}
            UNION ALL SELECT event_id, 5, 'http.request.body.bytes', CAST(user_id AS VARCHAR(20)) FROM {{events}}
                      WHERE event_id % 2 = 0""",
    }


# Defects of fx_payloads by number: (key, JSON text that replaces the good value, or None
# to leave the key out). Number 0 and those not listed are good.
PAYLOAD_DEFECTS: dict[int, tuple[str, str | None]] = {
    1: ("event_version", None), 2: ("event_version", "null"), 3: ("event_version", "1"),
    4: ("event_version", '""'), 5: ("event_version", '"2"'),
    6: ("event_id", None), 7: ("event_id", "{}"), 8: ("event_id", '""'), 9: ("event_id", '"no-uuid"'),
    10: ("application_name", None), 11: ("application_name", '""'), 12: ("application_name", "[]"),
    13: ("git_branch", '""'), 14: ("git_branch", "false"), 15: ("git_branch", None),
    16: ("git_commit_hash", None), 17: ("git_commit_hash", '""'), 18: ("git_commit_hash", '"zz"'),
    19: ("git_commit_hash", "7"),
    20: ("tool_name", None), 21: ("tool_name", '""'), 22: ("tool_name", "1.5"),
    23: ("tool_output", "null"), 24: ("tool_output", '""'), 25: ("tool_output", '{"a":1}'),
    26: ("output_format", None), 27: ("output_format", '""'), 28: ("output_format", "0"),
    29: ("output_format", '"XML"'),
    30: ("start_time", None), 31: ("start_time", '"2019-09-13"'), 32: ("start_time", "12"),
    33: ("end_time", None), 34: ("end_time", '"2019-09-13 19:37:14"'), 35: ("end_time", "[]"),
    36: ("environment", None), 37: ("environment", '""'), 38: ("environment", "true"),
    39: ("environment", '"Moon"'),
    40: ("tool_version", '""'), 41: ("tool_version", "3"), 42: ("tool_version", "null"),
    43: ("suppressed_issues", None), 44: ("suppressed_issues", "{}"), 45: ("suppressed_issues", "[]"),
    46: ("suppressed_issues", "[1]"), 47: ("suppressed_issues", '[{"issue_hash":4}]'),
    48: ("suppressed_issues", '[{"issue_hash":"ab"}]'),
    49: ("suppressed_issues", '[{"issue_hash":"@","expiry_date":4}]'),
    50: ("suppressed_issues", '[{"issue_hash":"@","expiry_date":"never"}]'),
    51: ("suppressed_issues", '[{"issue_hash":"@"}]'),
    52: ("suppressed_issues", '[{"issue_hash":"@","suppression_reason":[]}]'),
    53: ("suppressed_issues", '[{"issue_hash":"@","suppression_reason":""}]'),
    54: ("suppressed_issues", '[{"issue_hash":"@","suppression_reason":"r"}]'),
    55: ("suppressed_issues", '[{"issue_hash":"@","suppression_reason":"r","suppressed_by":0}]'),
    56: ("suppressed_issues", '[{"issue_hash":"@","suppression_reason":"r","suppressed_by":""}]'),
    57: ("suppressed_issues",
         '[{"issue_hash":"@","expiry_date":null,"suppression_reason":"r","suppressed_by":"b"}]'),
}
PAYLOAD_KINDS = 61
PAYLOAD_BODIES = {58: "", 59: "not json", 60: "[1, 2]"}

SAMPLE_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _payload_view() -> str:
    n = f"(event_id % {PAYLOAD_KINDS})"
    good = {
        "event_version": "'\"1\"'",
        "event_id": f"concat('\"', {_uuid("concat('p', event_id)")}, '\"')",
        "application_name": "concat('\"app-', user_id, '\"')",
        "git_branch": "'\"main\"'",
        "git_commit_hash": "concat('\"', sha1(CAST(event_id AS VARCHAR(20))), '\"')",
        "tool_name": "'\"bundler-audit\"'",
        "tool_output": "concat('\"', event_type, '\"')",
        "output_format": "'\"PlainText\"'",
        "start_time": "'\"2019-09-13T19:35:38+00:00\"'",
        "end_time": "'\"2019-09-13T21:37:14+02:00\"'",
        "environment": "'\"CI\"'",
        "tool_version": "'\"1.0\"'",
        "suppressed_issues": "'[]'",
    }
    fields = []
    for name, text in good.items():
        cases = ""
        for number, (key, value) in PAYLOAD_DEFECTS.items():
            if key == name:
                if value is None:
                    cases += f" WHEN {number} THEN ''"
                else:
                    body = value.replace("@", SAMPLE_HASH).replace("{", "{{").replace("}", "}}")
                    cases += f" WHEN {number} THEN '\"{name}\":{body},'"
        usual = f"concat('\"{name}\":', {text}, ',')"
        fields.append(f"CASE {n}{cases} ELSE {usual} END")
    bodies = "".join(f" WHEN {k} THEN '{v}'" for k, v in PAYLOAD_BODIES.items())
    return f"""
        SELECT event_id AS payload_id, {n} AS defect,
               CASE {n}{bodies} ELSE concat('{{{{', {", ".join(fields)}, '"sent":0}}}}') END AS body
        FROM {{events}}"""


def _closure(name: str, views: dict[str, str], seen: list[str]) -> list[str]:
    for other in re.findall(r"\bfx_\w+", views[name]):
        if other not in seen:
            _closure(other, views, seen)
    if name not in seen:
        seen.append(name)
    return seen


def with_views(
    dialect: str,
    names: list[str],
    body: str,
    tables: dict[str, str],
    more: dict[str, str] | None = None,
) -> str:
    """``body`` behind a WITH clause that defines the named views and all they need.

    ``more`` holds further definitions, which may be recursive, to follow them.
    """
    views = _views(DIALECTS[dialect])
    order: list[str] = []
    for name in names:
        _closure(name, views, order)
    texts = []
    for name in order:
        text = views[name]
        for table, source in tables.items():
            text = text.replace("{" + table + "}", source)
        text = text.replace("{{", "{").replace("}}", "}")
        texts.append(f"{name} AS ({text})")
    texts += [f"{name} AS ({text})" for name, text in (more or {}).items()]
    head = "WITH RECURSIVE " if dialect == "duckdb" else "WITH "
    return (head + ",\n".join(texts) + "\n" if texts else "") + body


def duck(body: str, **more: str) -> str:
    """DuckDB query over the fixture views that ``body`` and ``more`` mention."""
    names = list(dict.fromkeys(re.findall(r"\bfx_\w+", " ".join([*more.values(), body]))))
    return with_views("duckdb", names, body, {t: t for t in TABLES}, more)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the parquet tables in ``sf_dir``."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(with_views("spark", [name], f"SELECT * FROM {name}", tables))


def with_cvss(df: DataFrame) -> DataFrame:
    """Fold the flat score columns into the ``cvss`` struct."""
    folded = df.withColumn("cvss", F.expr(cvss_struct("cvss_version", "cvss_score")))
    return folded.drop("cvss_version", "cvss_score")
