import json

from pyspark.sql import functions as F
from samples import block, report, utc

from vulntide.operators import extraction
from vulntide.operators.errors import UNREADABLE
from vulntide.operators.extraction import ADVISORY_DB_URL
from vulntide.plans.pipelines import findings_of
from vulntide.schemas import REPORT

CVE = "cve_id string, cvss struct<version string, score float>, description string, url string, published timestamp"


def flow(spark, reports, cve=(), advisories=()):
    return findings_of(
        spark.createDataFrame(reports, REPORT),
        spark.createDataFrame(list(cve), CVE),
        spark.createDataFrame(list(advisories), "id string, cve_list string"),
        F.lit("2020-05-18 12:00:00").cast("timestamp"),
    )


def ordered(df):
    return df.orderBy("parent_event_id", "position", "cve_position").collect()


def bundler(spark, output):
    rows = extraction.extract_bundler_findings(spark.createDataFrame([report(output=output)], REPORT))
    return rows.orderBy("position").collect()


def test_blocks_in_order_with_text_between(spark):
    rows = bundler(spark, "head\n" + block() + "between\nName: half\n" + block("rails", "2"))
    assert [(r.position, r.affected_package, r.installed_version) for r in rows] == [
        (0, "rack", "1.0"), (1, "rails", "2"),
    ]
    assert rows[0].parent_event_id == report()[1] and rows[0].timestamp == utc(2030, 6, 7, 8, 10, 11)
    assert rows[0].event_id != rows[1].event_id and rows[0].event_version == "1"


def test_value_ends_at_second_separator_and_solution_may_be_empty(spark):
    (row,) = bundler(spark, block(title="Danger: do: not", solution=""))
    assert row.advisory_description == "Danger"


def test_carriage_returns_stay_but_not_in_urls(spark):
    (row,) = bundler(spark, block(end="\r\n"))
    assert row.affected_package == "rack\r" and row.advisory_id == "CVE-2019-1\r"
    assert row.advisory_url == "https://example.org/a"


def test_last_block_needs_its_line_end(spark):
    assert len(bundler(spark, block() + block().rstrip("\n"))) == 1
    assert bundler(spark, "nothing here") == []


def test_name_may_start_inside_a_line(spark):
    assert bundler(spark, "x Name: a\n" + block())[0].affected_package == "rack"
    assert bundler(spark, "x " + block())[0].affected_package == "rack"


def test_bad_block_fails_its_report_only(spark):
    good = report(output=block(), event_id="00000000-0000-0000-0000-000000000001")
    bad = report(output=block() + block(title=""), event_id="00000000-0000-0000-0000-000000000002")
    split = flow(spark, [good, bad])
    assert [r.parent_event_id[-1] for r in split.good.collect()] == ["1"]
    (refused,) = split.bad.collect()
    assert refused.parent_event_id[-1] == "2" and refused.error.error_code == 140


TUPLES = [
    ["quillmark", "<2.6", "2.5.1", "Reads past the end of a quill", "901", None, None],
    ["tinroof", "<0.9", "0.8", "Leaks when it rains", "902", None, None],
]
CVES = [
    ("CVE-2031-1001", ("V2", 6.1), "Text one", "http://one.example.org/", None),
    ("CVE-2031-1002", ("V2", 4.4), "Text two", "http://two.example.org/", None),
]
ADVISORIES = [("pyup.io-901", "CVE-2031-1001 , CVE-2031-1002")]


def safety(output):
    return report("safety", output if isinstance(output, str) else json.dumps(output), "JSON")


def test_safety_fan_out(spark):
    rows = ordered(flow(spark, [safety(TUPLES)], CVES, ADVISORIES).good)
    assert [(r.affected_package, r.advisory_id, r.advisory_url, r.advisory_description) for r in rows] == [
        ("quillmark", "901", "http://one.example.org/", "Text one"),
        ("quillmark", "901", "http://two.example.org/", "Text two"),
        ("tinroof", "902", ADVISORY_DB_URL, "Leaks when it rains"),
    ]
    assert rows[0].event_id == rows[1].event_id != rows[2].event_id
    assert rows[0].issue_hash == rows[1].issue_hash
    assert [r.cvss.version for r in rows] == ["V2", "V2", "Unknown"]


def test_safety_unknown_cve_keeps_the_tools_text(spark):
    rows = ordered(flow(spark, [safety(TUPLES[:1])], CVES[:1], [("pyup.io-901", "CVE-9,CVE-2031-1001")]).good)
    assert [(r.advisory_description, r.advisory_url) for r in rows] == [
        ("Reads past the end of a quill", ADVISORY_DB_URL), ("Text one", "http://one.example.org/"),
    ]


def test_safety_objects_and_malformed_output(spark):
    names = ["affected_package", "affected_versions", "installed_version", "advisory_description", "advisory_id"]
    as_object = [dict(zip(names, TUPLES[0]))]
    assert len(ordered(flow(spark, [safety(as_object)]).good)) == 1
    for bad in ["no json", "{}", [TUPLES[0][:6]], [TUPLES[0] + [1]], [[1, *TUPLES[0][1:]]], ["x"],
                [[*TUPLES[0][:5], 7, None]], TUPLES + [[]]]:
        split = flow(spark, [safety(bad)])
        assert split.good.count() == 0
        assert [r.error.error_message for r in split.bad.collect()] == [
            "Output is no JSON list of safety findings"
        ]
    assert flow(spark, [safety([])]).bad.count() == 0


def test_unusable_cve_text_fails_the_report(spark):
    empty = [("CVE-2031-1001", ("V2", 6.1), "", "http://one.example.org/", None)]
    split = flow(spark, [safety(TUPLES)], empty, ADVISORIES)
    assert split.good.count() == 0
    assert [r.error.error_code for r in split.bad.collect()] == [140]


def test_routes(spark):
    pairs = [("bundler-audit", "JSON"), ("safety", "PlainText"), ("other", "JSON")]
    reports = [report(tool, "x", kind) for tool, kind in pairs]
    messages = {r.error.error_message for r in flow(spark, reports).bad.collect()}
    assert messages == {UNREADABLE[k] for k in ("bundler_format", "safety_plain_text", "unknown_tool")}


def test_bundler_takes_only_the_score(spark):
    cve = [("CVE-2019-1", ("V3", 9.8), "Other text", "http://x.example.org/", None)]
    (row,) = flow(spark, [report(output=block())], cve).good.collect()
    assert (row.cvss.version, row.advisory_description) == ("V3", "Bad thing")
    assert row.advisory_url == "https://example.org/a"


def test_explode_batch(spark):
    rows = spark.createDataFrame([([(1, "a"), (2, "b")],), ([],)], "records array<struct<n int, t string>>")
    assert sorted(map(tuple, extraction.explode_batch(rows).collect())) == [(1, "a"), (2, "b")]
