import hashlib

import pytest
from samples import utc

from vulntide.functions import hashing, text, times


def test_issue_hash_golden(evaluate):
    parts = ["Test application", "BadPkg", "1.0", "CVE-2017-5638"]
    expected = hashlib.sha256(b"".join(hashlib.sha256(p.encode()).digest() for p in parts)).hexdigest()
    assert expected == "6f3ce2ac0e5695942ff0bc53ba195a3c2e8d3b1a2278d1c17ca5c49ce71c8765"
    assert evaluate(hashing.issue_hash("a", "b", "c", "d"), **dict(zip("abcd", parts))) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2019-09-13T19:35:38Z", utc(2019, 9, 13, 19, 35, 38)),
        ("2019-09-13t19:35:38z", utc(2019, 9, 13, 19, 35, 38)),
        ("2019-09-13T19:35:38+02:30", utc(2019, 9, 13, 17, 5, 38)),
        ("2019-09-13T19:35:38-23:59", utc(2019, 9, 14, 19, 34, 38)),
        ("2019-09-13T19:35:38.1234567899Z", utc(2019, 9, 13, 19, 35, 38, 123456)),
        ("2019-12-31T23:59:60Z", utc(2020, 1, 1)),
        ("2019-09-13T19:35:61Z", None), ("2019-13-13T19:35:38Z", None),
        ("2019-09-13T19:35:38", None), ("2019-09-13 19:35:38Z", None), ("2019-09-13", None),
        ("2019-09-13T19:35:38+24:00", None), ("2019-09-13T19:35:38+0200", None),
        ("2019-09-13T19:35:38Z\n", None), ("", None), (" 2019-09-13T19:35:38Z", None),
    ],
)
def test_rfc3339(evaluate, value, expected):
    assert evaluate(times.parse_rfc3339("t"), t=value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2019-09-13T19:35:38Z", "2019-09-13T19:35:38+00:00"),
        ("2019-09-13T19:35:38.120Z", "2019-09-13T19:35:38.120+00:00"),
        ("2019-09-13T19:35:38.120001Z", "2019-09-13T19:35:38.120001+00:00"),
    ],
)
def test_rfc3339_text(evaluate, value, expected):
    assert evaluate(times.format_rfc3339(f"({times.parse_rfc3339('t')})"), t=value) == expected


def test_published(evaluate):
    assert evaluate(times.parse_published("t"), t="2019-09-13T19:35Z") == utc(2019, 9, 13, 19, 35)


@pytest.mark.parametrize(
    "version, score, expected",
    [("Unknown", None, "Unknown"), ("V3", 7.5, "V3(7.5)"), ("V2", 10.0, "V2(10)")],
)
def test_cvss_text(spark, version, score, expected):
    rows = spark.createDataFrame([((version, score),)], "cvss struct<version string, score float>")
    assert rows.selectExpr(text.cvss_text("cvss")).first()[0] == expected


def test_white_space(evaluate):
    assert evaluate(text.trim_end("t"), t=" a \t\r\n ") == " a"
    assert evaluate(text.split_trimmed("t"), t=" a ,\tb,") == ["a", "b", ""]


def test_derived_ids_repeat(evaluate):
    one = evaluate(hashing.derived_uuid("a", "b"), a="x", b="1")
    assert one == evaluate(hashing.derived_uuid("a", "b"), a="x", b="1")
    assert evaluate(hashing.canonical_uuid("t"), t=one.upper().replace("-", "")) == one
    assert evaluate(hashing.canonical_uuid("t"), t="urn:uuid:" + one) == one
    assert evaluate(hashing.canonical_uuid("t"), t="urn:uuid:" + one.replace("-", "")) is None
