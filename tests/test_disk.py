"""What lies on disk while a query runs: no text in a shuffle that can be made behind it, and
nothing that is not needed any more."""

import os
import re

import pytest
from pyspark.sql import functions as F
from samples import block, report
from test_skew import settings

from vulntide import session
from vulntide.fixtures import view
from vulntide.operators import commits as history
from vulntide.plans.pipelines import findings_of
from vulntide.schemas import REPORT
from vulntide.sinks import writers

CVE = "cve_id string, cvss struct<version string, score float>, description string, url string, published timestamp"


@pytest.fixture
def kept(spark, tmp_path):
    """The folder of the stored tables of one test."""
    with settings(spark, **{session.SCRATCH_DIR: str(tmp_path / "kept")}):
        yield tmp_path / "kept" / "vulntide"


@pytest.fixture
def tables(spark, tmp_path):
    made = {
        "orders": (50, ["id AS o_orderkey", "id AS o_custkey", "TIMESTAMP '1995-01-01 00:00:00' AS o_orderdate"]),
        "lineitem": (200, ["id div 4 AS l_orderkey", "id % 20 AS l_partkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber",
                           "2.0D AS l_quantity", "10.5D AS l_extendedprice"]),
        "part": (50, ["id AS p_partkey", "concat('ring ', id) AS p_name", "CAST(id % 50 AS INT) AS p_size"]),
    }
    for name, (n, columns) in made.items():
        spark.range(n).selectExpr(*columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_texts_of_reports_are_in_no_shuffle(spark, tables):
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        rows = view(spark, tables, "fx_reports")
        assert rows.count() == 50
        text = rows._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(shuffles) == 4  # lines and parts, and lines with their parts and orders
    assert not any("application_name" in keys for keys in shuffles)


def test_shuffle_files_go_with_their_query(spark, kept):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {block for block in found.split() if "huffle_" in block}

    before = files()
    rows = session.materialise(spark.range(10_000).repartition(4, "id"), "rows")
    assert rows.count() == 10_000 and not files() - before


def test_rounds_of_a_branch_are_dropped(spark, kept):
    rows = spark.range(300).selectExpr(
        "'a' AS application_name", "CAST(id AS string) AS commit_id",
        "if(id = 0, CAST(array() AS array<string>), array(CAST(id - 1 AS string))) AS parents",
        "id * 7919 % 300 AS commit_time", "id = 299 AS is_head",
    )
    assert history.first_parent_sequence(rows, 20).agg(F.sum("seq")).first()[0] == 299 * 150
    assert len([name for name in os.listdir(kept) if name.startswith("branch-")]) == 1


def test_lists_of_suppressed_issues_stay_with_the_reports(spark, kept):
    listed = '[["pkg", "<1", "0.1", "text", "7", null, null]]'
    rows = [report("safety", listed, "JSON", event_id="00000000-0000-4000-8000-000000000001"), report(output=block())]
    split = findings_of(
        spark.createDataFrame(rows, REPORT), spark.createDataFrame([], CVE),
        spark.createDataFrame([("pyup.io-7", None)], "id string, cve_list string"),
    )
    assert split.good.count() == 2
    (fan_out,) = [name for name in os.listdir(kept) if name.startswith("fan-out")]
    columns = spark.read.parquet(str(kept / fan_out)).columns
    assert "suppressed" in columns and not {"suppressed_issues", "issue_hash", "event_id"} & set(columns)


def test_settled_keeps_one_table(spark, kept):
    def build():
        return session.materialise(spark.range(5), "first").union(session.materialise(spark.range(3), "second"))

    rows = session.settled(spark, "both", build)
    assert rows.count() == 8 and [name.split("-")[0] for name in os.listdir(kept)] == ["both"]


def test_logs_and_stored_tables_are_compressed_well(spark, kept, tmp_path):
    rows = spark.createDataFrame([report(issues=[], event_id=f"00000000-0000-4000-8000-{n:012d}") for n in range(5)], REPORT)
    writers.append_reports(rows, str(tmp_path / "log"))
    session.materialise(rows, "rows")
    names = [*(tmp_path / "log").glob("part*"), *kept.glob("rows-*/part*")]
    assert names and all(".zstd." in name.name for name in names)
