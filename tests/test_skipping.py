"""Logs skip what a look-up does not need, and compaction changes no row."""

from pyspark.sql import functions as F

from vulntide.schemas import FINDING
from vulntide.sinks import manifests, writers

ROWS = 120_000


def findings_between(spark, low, high):
    made = {
        "event_id": F.expr("sha2(concat('e', id), 256)"),
        "parent_event_id": F.expr("sha2(concat('r', id div 2), 256)"),
        "application_name": F.expr("concat('app-', id % 4)"),
        "timestamp": F.expr("timestamp_seconds(1600000000 + id)"),
    }
    columns = [made.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in FINDING.fields]
    return spark.range(low, high, 1, 4).select(*columns)


def rows_read(df):
    """Rows that the scan of a query gives, once row groups are left out."""
    assert df.collect() is not None
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.finalPhysicalPlan().collectLeaves() if "Adaptive" in plan.nodeName() else plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_absent_ids_read_no_row_group(spark, tmp_path):
    path = str(tmp_path / "findings")
    writers.append_findings(findings_between(spark, 0, ROWS), path, 0)
    log = writers.read_table(spark, path)
    low, high = log.agg(F.min("event_id"), F.max("event_id")).first()
    absent = "8" + "0" * 63
    assert low < absent < high
    assert rows_read(log.where(F.col("event_id") == absent)) == 0
    assert rows_read(log.where(F.col("parent_event_id") == absent)) == 0


def test_one_application_reads_its_own_row_groups(spark, tmp_path):
    path = str(tmp_path / "findings")
    writers.append_findings(findings_between(spark, 0, ROWS), path, 0)
    log = writers.read_table(spark, path)
    assert ROWS // 4 <= rows_read(log.where("application_name = 'app-2'")) <= 3 * ROWS // 4


def test_compaction_changes_no_row(spark, tmp_path):
    path = str(tmp_path / "findings")
    for batch in range(4):
        writers.append_findings(findings_between(spark, batch * 500, batch * 500 + 500), path, batch)
    key = lambda: sorted((r.event_id, r.parent_event_id, r.application_name, r.timestamp) for r in writers.read_table(spark, path).collect())
    before = key()
    assert writers.compact_findings(spark, path)
    assert key() == before and len(before) == 2000
    assert len(manifests.entries(spark, path)) == 1
    assert not writers.compact_findings(spark, path)
    # A batch that is replayed after compaction is still known.
    assert writers.has_batch(spark, path, 2)
