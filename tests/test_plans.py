"""The plans Spark makes of the operators."""

import re

import pytest

from vulntide.catalog import ORACLES, QUERIES
from vulntide.operators import analytics, validation
from vulntide.operators.extraction import extract_bundler_findings
from vulntide.schemas import FINDING, REPORT
from vulntide.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    spark.createDataFrame([], FINDING).write.mode("overwrite").parquet(path)
    return readers.read_findings(spark, path)


def test_filters_and_columns_reach_the_scan(log):
    text = plan(analytics.cves_per_app(log))
    assert "StringStartsWith(advisory_id,CVE)" in text
    assert re.search(r"ReadSchema: struct<application_name:string,advisory_id:string>", text)
    assert "EqualTo(application_name,x)" in plan(analytics.one_application(log, "x"))


def test_aggregates_combine_before_the_shuffle(log):
    for df in (analytics.first_last_seen(log), analytics.riskiest_apps(log), analytics.events_per_app(log)):
        text = plan(df)
        assert "partial_" in text and text.index("Exchange") < text.index("partial_")
        assert "Window" not in text and "Sort [timestamp" not in text


def test_bodies_are_parsed_once(spark):
    bodies = spark.createDataFrame([("{}",)], "body string")
    good = validation.accepted(validation.validate_reports(bodies))
    assert plan(good).count("parse_json") + plan(good).count("parseJson") <= 1


def test_extraction_does_not_shuffle(spark):
    reports = spark.createDataFrame([], REPORT)
    assert "Exchange" not in plan(extract_bundler_findings(reports))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
