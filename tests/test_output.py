import json

from samples import utc

from vulntide.operators import audit, notification
from vulntide.schemas import FINDING

# The message's text and the issue's hash belong to this row.
ROW = (
    "1", "e", "p", "Test application", None, "e99f", utc(2019, 9, 13), "BadPkg", "1.0", "CVE-2017-5638",
    "https://example.org/x", "Text", ("V3", 10.0), False,
)


def test_message(spark):
    rows = spark.createDataFrame([ROW, ROW[:-1] + (True,)], FINDING)
    (message,) = notification.outbox(rows, "security").collect()
    assert message.channel == "security" and message.event_id == "e"
    assert message.text == (
        "Vulnerable package found in: Test application\n"
        "What package is affected? BadPkg 1.0\n"
        "Where was this found? Commit e99f on branch Not Provided\n"
        "What is the problem? Text\n"
        "How serious is it? CVSS V3(10)\n"
        "Where can I find out more? https://example.org/x\n"
        "Issue hash if this should be suppressed: "
        "6f3ce2ac0e5695942ff0bc53ba195a3c2e8d3b1a2278d1c17ca5c49ce71c8765"
    )


KEYS = ["ecs.version", "event.kind", "http.request.method", "http.request.body.bytes", "source.ip"]


def fold(spark, *pairs):
    rows = [(1, i, key, value) for i, (key, value) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "record int, seq int, key string, value string")
    return audit.fold_pairs(frame, "record", "seq", {k: "string" for k in KEYS}).first().line


def test_nested_json(spark):
    base = ("ecs.version", "1.6")
    assert fold(spark, base) == '{"ecs":{"version":"1.6"}}'
    assert fold(spark, base, ("event.kind", "event"), ("event.kind", "error")) == (
        '{"ecs":{"version":"1.6"},"event":{"kind":"event"}}'
    )
    line = fold(spark, base, ("event.kind", "event"), ("http.request.method", "GET"),
                ("http.request.body.bytes", "12345"), ("source.ip", None))
    assert line == (
        '{"ecs":{"version":"1.6"},"event":{"kind":"event"},'
        '"http":{"request":{"body":{"bytes":"12345"},"method":"GET"}}}'
    )
    assert fold(spark, ("source.ip", None)) == "null"


REQUEST = (
    "http_version string, host string, source_ip string, user_agent string, method string, path string, "
    "query string, request_body string, response_body string, status int, service_failed boolean, "
    "error_code int, error_message string, transaction_id string, event_id string, "
    "event_start timestamp, event_end timestamp"
)


def request(path="/", failed=False, code=None, message=None):
    return ("HTTP/1.1", None, None, "agent", "POST", path, "", "{}", "ok", 200, failed, code, message, "t", "e",
            utc(2020, 1, 1), utc(2020, 1, 1, 0, 0, 0, 1500))


def test_audit_lines(spark):
    rows = [request(), request("/health"), request("/health", True, None, "broken"), request("/", False, 101, "bad")]
    frame = spark.createDataFrame(rows, REQUEST)
    lines = [json.loads(r.line) for r in audit.audit_lines(frame).collect()]
    assert len(lines) == 3
    plain, broken, bad = lines
    assert plain["event"]["type"] == ["access"] and "error" not in plain and "domain" not in plain["url"]
    assert plain["url"]["query"] == "?" and plain["event"]["duration"] == 1_500_000
    assert plain["http"]["response"]["status_code"] == "200" and "source" not in plain
    assert broken["error"] == {"code": 0, "message": "broken"} and "response" not in broken["http"]
    assert bad["error"]["code"] == 101 and bad["event"]["type"] == ["access", "error"]
