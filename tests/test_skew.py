"""Joins whose keys are a third one value, with broadcasts switched off."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from vulntide.operators import analytics, enrichment, suppression
from vulntide.operators.skew import heavy_keys, salted_join

N = 60_000


@contextmanager
def settings(spark, **values):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def shuffled(spark):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.shuffle.partitions": "40",
    }
    with settings(spark, **small):
        yield


def findings(spark):
    hot = F.col("id") % 3 == 0
    advisory = F.when(hot, F.lit("CVE-hot")).otherwise(F.concat(F.lit("CVE-"), F.col("id") % 5000))
    return spark.range(N).repartition(24).select(
        F.sha2(F.col("id").cast("string"), 256).alias("event_id"),  # does not compress
        F.when(hot, "report-hot").otherwise(F.concat(F.lit("r"), F.col("id") % 4000)).alias("parent_event_id"),
        F.when(hot, "app-hot").otherwise(F.concat(F.lit("app"), F.col("id") % 50)).alias("application_name"),
        advisory.alias("advisory_id"),
        F.lit("pkg").alias("affected_package"), F.lit("1").alias("installed_version"),
        F.expr("named_struct('version', 'Unknown', 'score', CAST(NULL AS FLOAT))").alias("cvss"),
    )


def run(df):
    """Rows, and the plan as it was carried out."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_hot_cve_is_split(spark, shuffled):
    cve = spark.createDataFrame([("CVE-hot", ("V3", 9.0)), ("CVE-1", ("V2", 1.0))],
                                "cve_id string, cvss struct<version string, score float>")
    rows, plan = run(enrichment.enrich_bundler(findings(spark), cve).select("event_id", "cvss"))
    assert "skew=true" in plan and "Broadcast" not in plan
    scores = {}
    for r in rows:
        scores[r.cvss.version] = scores.get(r.cvss.version, 0) + 1
    assert len(rows) == N and scores["V3"] == N // 3
    assert scores["V2"] == sum(1 for i in range(N) if i % 3 and i % 5000 == 1)


def test_hot_report_is_split(spark, shuffled):
    reports = spark.createDataFrame([("report-hot", "t", None, "CI"), ("r1", "t", None, "CI")],
                                    "event_id string, tool_name string, tool_version string, environment string")
    rows, plan = run(analytics.lineage(findings(spark), reports).select("event_id", "tool_name"))
    assert "skew=true" in plan
    assert len(rows) == N // 3 + sum(1 for i in range(N) if i % 3 and i % 4000 == 1)


def test_hot_suppressed_issue_is_split(spark, shuffled):
    hot = suppression.apply_suppressions(
        findings(spark).filter("advisory_id = 'CVE-hot'").limit(1).withColumn(
            "suppressed_issues", F.lit(None).cast("array<struct<issue_hash string, expiry_date timestamp>>"))
    ).first()
    table = spark.createDataFrame([("app-hot", hot.issue_hash, None)],
                                  "application_name string, issue_hash string, expiry_date timestamp")
    rows, plan = run(suppression.suppressed_by_table(findings(spark), table).select("event_id"))
    assert "skew=true" in plan and len(rows) == N // 3
    rows, plan = run(suppression.unsuppressed_by_table(findings(spark), table).select("event_id"))
    assert "skew=true" in plan and len(rows) == N - N // 3


def test_hot_advisory_is_split(spark, shuffled):
    hot = F.when(F.col("advisory_id") == "CVE-hot", "7").otherwise(F.substring("advisory_id", 5, 9))
    rows = findings(spark).withColumns({
        "position": F.lit(0), "advisory_url": F.lit("http://x/"), "advisory_description": F.lit("d"),
        "advisory_id": hot,
    })
    cve = spark.createDataFrame([("CVE-1", ("V2", 1.0), "e", "http://y/"), ("CVE-2", ("V2", 2.0), "", "http://y/")],
                                "cve_id string, cvss struct<version string, score float>, description string, url string")
    advisories = spark.createDataFrame([("pyup.io-7", "CVE-1, CVE-2"), ("pyup.io-8", None), ("pyup.io-9", "CVE-3")],
                                       "id string, cve_list string")
    checked = enrichment.checked_safety_fan_out(rows, advisories, cve)
    out, plan = run(checked.groupBy("advisory_known", "cve_id", "failed", "advisory_description").count())
    counts = {tuple(r)[:4]: r["count"] for r in out}
    sevens = N // 3 + sum(1 for i in range(N) if i % 3 and i % 5000 == 7)
    eights, nines = (sum(1 for i in range(N) if i % 3 and i % 5000 == k) for k in (8, 9))
    assert counts == {
        (True, "CVE-1", None, "e"): sevens, (True, "CVE-2", "advisory_description_empty", ""): sevens,
        (True, None, None, "d"): eights, (True, "CVE-3", None, "d"): nines,
        (False, None, None, "d"): N - sevens - eights - nines,
    }
    rows, plan = run(checked.select("event_id"))
    assert "skew=true" in plan


@pytest.fixture
def static(spark, shuffled):
    """No adaptive execution: what the plan says is what happens."""
    with settings(spark, **{"spark.sql.adaptive.enabled": "false"}):
        yield


def largest(df):
    """Most rows in one partition of a joined table, beside the mean of all 40."""
    rows = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    return max(r["count"] for r in rows) / (sum(r["count"] for r in rows) / 40)


def test_heavy_keys(spark):
    rows = findings(spark)
    assert heavy_keys(rows, "advisory_id") == ["CVE-hot"] and heavy_keys(rows, "parent_event_id") == ["report-hot"]
    assert len(heavy_keys(rows, "application_name")) == 51  # each of them holds a hundredth or more
    assert heavy_keys(rows.limit(0), "advisory_id") == []
    assert heavy_keys(rows.select(F.lit(None).cast("string").alias("k")), "k") == []
    tail = spark.range(200_000).select(F.when(F.col("id") % 100 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    assert heavy_keys(tail.repartition(24), "k") == [-1]


def test_heavy_keys_spread_without_adaptive_execution(spark, static):
    rows = findings(spark)
    cve = spark.createDataFrame([("CVE-hot", ("V3", 9.0)), ("CVE-1", ("V2", 1.0))],
                                "cve_id string, cvss struct<version string, score float>")
    plain = enrichment.enrich_bundler(rows, cve)
    spread = enrichment.enrich_bundler(rows, cve, heavy_keys(rows, "advisory_id"))
    assert largest(plain) > 10 and largest(spread) < 4
    assert "_salt" in spread._jdf.queryExecution().executedPlan().toString() and spread.columns == plain.columns
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()

    reports = spark.createDataFrame([("report-hot", "t", None, "CI"), ("r1", "t", None, "CI")],
                                    "event_id string, tool_name string, tool_version string, environment string")
    plain = analytics.lineage(rows, reports)
    spread = analytics.lineage(rows, reports, heavy_keys(rows, "parent_event_id"))
    assert largest(plain) > 10 and largest(spread) < 6
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()

    advisories = spark.createDataFrame([("pyup.io-7", "CVE-1, CVE-2"), ("pyup.io-8", None)], "id string, cve_list string")
    hot = F.when(F.col("advisory_id") == "CVE-hot", "7").otherwise(F.substring("advisory_id", 5, 9))
    rows = rows.withColumn("advisory_id", hot)
    plain = enrichment.lookup_advisory(rows, advisories)
    spread = enrichment.lookup_advisory(rows, advisories, heavy_keys(rows, "advisory_id"))
    assert largest(plain) > 10 and largest(spread) < 4
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_each_pair_meets_once(spark, how):
    left = spark.range(600).selectExpr("id", "IF(id % 2 = 0, 'hot', IF(id % 7 = 0, NULL, concat('k', id % 20))) AS k")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("k5", 4), (None, 5), ("hat", 6)], "r string, x int")
    keys = F.col("k"), F.col("r")
    plain = left.join(right, keys[0] == keys[1], how)
    got = salted_join(left, right, *keys, ["hat", "hot"], how, salts=5)
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
