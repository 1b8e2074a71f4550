import pytest
from pyspark.sql import functions as F
from samples import utc

from vulntide.operators import suppression

HASHES = ["ab" * 32, "cd" * 32]
NOW = utc(2020, 5, 18, 12)
CASES = [
    ([], False),
    ([(1, None)], False),
    ([(0, utc(2020, 5, 20))], True),
    ([(0, utc(2020, 5, 17))], False),
    ([(0, utc(2020, 5, 18, 10))], False),
    ([(0, NOW)], False),
    ([(0, None)], True),
    ([(0, utc(2020, 5, 20)), (0, utc(2020, 5, 21))], True),
    ([(0, utc(2020, 5, 17)), (0, utc(2020, 5, 21))], True),
]


@pytest.mark.parametrize("issues, expected", CASES)
def test_rule(spark, issues, expected):
    rows = [(HASHES[0], [(HASHES[i], expiry) for i, expiry in issues])]
    frame = spark.createDataFrame(
        rows, "h string, issues array<struct<issue_hash string, expiry_date timestamp>>"
    )
    flag = suppression.any_live_match(F.col("issues"), F.col("h"), F.lit(NOW))
    assert frame.select(flag).first()[0] is expected


def test_table_form_splits_everything(spark):
    columns = "application_name string, affected_package string, installed_version string, advisory_id string"
    findings = spark.createDataFrame([("a", "p", "1", "x"), ("a", "q", "1", "x"), ("b", "p", "1", "x")], columns)
    hashed = suppression.apply_suppressions(
        findings.withColumn("suppressed_issues", F.lit(None).cast("array<struct<issue_hash string, expiry_date timestamp>>"))
    )
    first = hashed.filter("application_name = 'a' AND affected_package = 'p'").first()
    assert first.suppressed is False
    table = spark.createDataFrame(
        [("a", first.issue_hash.upper(), None), ("b", first.issue_hash, None)],
        "application_name string, issue_hash string, expiry_date timestamp",
    )
    covered = suppression.suppressed_by_table(findings, table, F.lit(NOW)).collect()
    open_ = suppression.unsuppressed_by_table(findings, table, F.lit(NOW)).collect()
    assert [(r.application_name, r.affected_package) for r in covered] == [("a", "p")]
    assert len(open_) == 2
