"""What a micro-batch costs beside its rows."""

from pyspark.sql import functions as F
from test_skew import settings
from test_streaming import CVE, typed_reports

from vulntide.operators import enrichment
from vulntide.sinks import manifests, writers
from vulntide.sources import readers
from vulntide.streaming import jobs


def test_state_has_two_partitions_per_core(spark, tmp_path):
    root, rows = str(tmp_path), typed_reports(spark, 40)
    for _ in range(2):
        writers.append_reports(rows.coalesce(1), f"{root}/in")
    most = 2 * spark.sparkContext.defaultParallelism
    with settings(spark, **{"spark.sql.shuffle.partitions": str(4 * most)}):
        stream = readers.read_reports(spark, f"{root}/in", streaming=True, max_files=1)
        writer = jobs.deduplicated(stream).writeStream.option("checkpointLocation", f"{root}/c")
        with jobs.keeping_state(spark):
            running = writer.trigger(availableNow=True).start(f"{root}/out", format="parquet")
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(4 * most)
        running.awaitTermination()
    ids = [r.event_id for r in spark.read.parquet(f"{root}/out").collect()]
    assert len(ids) == len(set(ids)) == 40
    parts = [place for place in (tmp_path / "c" / "state" / "0").iterdir() if place.name.isdigit()]
    assert len(parts) == most


def test_enrichment_tables_meet_once_per_version(spark, tmp_path, monkeypatch):
    root, calls, whole = str(tmp_path), [], enrichment.cves_by_advisory

    def counted(*tables):
        calls.append(tables)
        return whole(*tables)

    monkeypatch.setattr(enrichment, "cves_by_advisory", counted)
    monkeypatch.setattr(jobs, "cves_by_advisory", counted, raising=False)
    jobs.publish_snapshot(spark.createDataFrame([], CVE), f"{root}/cve", 1)
    jobs.publish_snapshot(spark.createDataFrame([("a", None)], "id string, cve_list string"), f"{root}/adv", 1)
    for k in range(3):
        rows = typed_reports(spark, 4, event_id=F.format_string(f"0000000{k}-0000-4000-8000-%012d", "id"))
        writers.append_reports(rows, f"{root}/in", k)
    jobs.stream_findings(
        readers.read_reports(spark, f"{root}/in", streaming=True, max_files=1), jobs.overlaid_snapshots(f"{root}/cve", "cve_id"),
        jobs.newest_snapshot(f"{root}/adv"), f"{root}/out", f"{root}/bad", f"{root}/c", available_now=True,
    ).awaitTermination()
    assert len(manifests.entries(spark, f"{root}/out")) == 3 and len(calls) == 1
