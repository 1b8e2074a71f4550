import json
import os
import shutil

import pytest
from pyspark.sql import functions as F
from samples import PAYLOAD, block
from test_skew import settings

from vulntide.schemas import FINDING, REPORT
from vulntide.sinks import manifests, writers
from vulntide.sources import readers
from vulntide.streaming import jobs

CVE = "cve_id string, cvss struct<version string, score float>, description string, url string, published timestamp"


def write_bodies(spark, path, numbers):
    bodies = []
    for n in numbers:
        body = dict(PAYLOAD, event_id=f"00000000-0000-0000-0000-{n:012d}", tool_name="bundler-audit",
                    output_format="PlainText", tool_output=block(name=f"pkg{n}"), suppressed_issues=[])
        if n % 5 == 0:
            body["tool_name"] = ""
        bodies.append((json.dumps(body),))
    spark.createDataFrame(bodies, "body string").coalesce(1).write.mode("append").text(path)


def run_all(spark, root):
    payloads = readers.read_payloads(spark, f"{root}/in", streaming=True, max_files=1)
    jobs.stream_intake(payloads, f"{root}/reports", f"{root}/bad", f"{root}/c1", True).awaitTermination()
    reports = readers.read_reports(spark, f"{root}/reports", streaming=True, max_files=1)
    jobs.stream_findings(
        reports, jobs.overlaid_snapshots(f"{root}/cve", "cve_id"), jobs.newest_snapshot(f"{root}/advisories"),
        f"{root}/findings", f"{root}/unread", f"{root}/c2", available_now=True,
    ).awaitTermination()
    findings = readers.read_findings(spark, f"{root}/findings", streaming=True, max_files=1)
    jobs.stream_outbox(findings, "c", f"{root}/outbox", f"{root}/c3", True).awaitTermination()


def count(spark, path):
    return writers.read_table(spark, path).count()


def test_three_stages_restart_and_refresh(spark, tmp_path):
    root = str(tmp_path)
    snapshot = lambda score: spark.createDataFrame([("CVE-2019-1", ("V3", score), "t", "http://x", None)], CVE)
    jobs.publish_snapshot(snapshot(1.0), f"{root}/cve", 1)
    jobs.publish_snapshot(spark.createDataFrame([("a", None)], "id string, cve_list string"), f"{root}/advisories", 1)
    write_bodies(spark, f"{root}/in", range(1, 11))
    run_all(spark, root)
    assert count(spark, f"{root}/reports") == 8 and count(spark, f"{root}/bad") == 2
    assert count(spark, f"{root}/findings") == 8 and count(spark, f"{root}/outbox") == 8

    # Nothing new: a second run adds nothing.
    run_all(spark, root)
    assert count(spark, f"{root}/findings") == 8

    # New input after a new snapshot: old findings stay, new ones take the new score.
    jobs.publish_snapshot(snapshot(2.0), f"{root}/cve", 2)
    write_bodies(spark, f"{root}/in", range(11, 15))
    run_all(spark, root)
    table = writers.read_table(spark, f"{root}/findings")
    scores = {r.affected_package: r.cvss.score for r in table.collect()}
    assert len(scores) == 12 and scores["pkg1"] == 1.0 and scores["pkg14"] == 2.0
    assert count(spark, f"{root}/outbox") == 12

    # A batch whose commit was lost runs again and leaves what it wrote, for all to see once.
    commits = sorted((tmp_path / "c1" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    moved = tmp_path / "lost"
    moved.mkdir()
    shutil.move(str(commits[-1]), str(moved))
    crc = commits[-1].with_name(f".{commits[-1].name}.crc")
    if crc.exists():
        shutil.move(str(crc), str(moved))
    payloads = readers.read_payloads(spark, f"{root}/in", streaming=True, max_files=1)
    jobs.stream_intake(payloads, f"{root}/reports", f"{root}/bad", f"{root}/c1", True).awaitTermination()
    assert count(spark, f"{root}/reports") == 12
    run_all(spark, root)
    assert count(spark, f"{root}/findings") == 12


def typed_reports(spark, n, **columns):
    one = {
        "event_version": F.lit("1"), "event_id": F.format_string("00000000-0000-4000-8000-%012d", "id"),
        "application_name": F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 50)),
        "git_branch": F.lit("main"), "git_commit_hash": F.lit("ab" * 20), "tool_name": F.lit("bundler-audit"),
        "tool_output": F.lit(block(name="pkg")), "output_format": F.lit("PlainText"),
        "start_time": F.timestamp_seconds("id"), "end_time": F.timestamp_seconds("id"),
        "environment": F.lit("CI"), "tool_version": F.lit(None).cast("string"),
        "suppressed_issues": F.array().cast(REPORT["suppressed_issues"].dataType),
    } | columns
    return spark.range(n).select(*[v.alias(k) for k, v in one.items()])


def test_hot_application_is_written_in_order(spark, tmp_path):
    with settings(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        writers.append_reports(typed_reports(spark, 3000), str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    assert len(files) > 1
    rows = [r for f in files for r in spark.read.parquet(str(f)).collect()]
    order = [(r.application_name, r.end_time, r.event_id) for r in rows]
    assert len(order) == 3000 and order == sorted(order)
    hot = [f for f in files if spark.read.parquet(str(f)).filter("application_name = 'hot'").count()]
    assert len(hot) > 1  # the large application is cut


def test_no_report_is_late_for_deduplication(spark, tmp_path):
    root = str(tmp_path)
    # A log by application: each file starts at the first time again.
    for k in range(3):
        rows = typed_reports(spark, 50, application_name=F.lit(f"app{k}"), event_id=F.format_string(f"0000000{k}-0000-4000-8000-%012d", "id"),
                             end_time=F.expr(f"timestamp_seconds(id * 864000 + {k})"))
        writers.append_reports(rows.coalesce(1), f"{root}/in")
        writers.append_reports(rows.withColumn("end_time", F.expr("end_time + INTERVAL 1 HOUR")), f"{root}/in")
    stream = readers.read_reports(spark, f"{root}/in", streaming=True, max_files=1)
    writer = jobs.deduplicated(stream).writeStream.option("checkpointLocation", f"{root}/c")
    writer.trigger(availableNow=True).start(f"{root}/out", format="parquet").awaitTermination()
    ids = [r.event_id for r in spark.read.parquet(f"{root}/out").collect()]
    assert len(ids) == len(set(ids)) == 150


def test_replay_keeps_each_report_in_one_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    output = json.dumps([["pkg", "<1", "0.1", "text", "7"]])
    safety = typed_reports(spark, 6, tool_name=F.lit("safety"), output_format=F.lit("JSON"), tool_output=F.lit(output))
    writers.append_reports(safety, f"{root}/in", 0)
    cve = lambda text: spark.createDataFrame([("CVE-2020-7", ("V3", 1.0), text, "http://x", None)], CVE)
    jobs.publish_snapshot(cve(""), f"{root}/cve", 1)  # an empty text refuses the report
    jobs.publish_snapshot(spark.createDataFrame([("pyup.io-7", "CVE-2020-7")], "id string, cve_list string"), f"{root}/adv", 1)

    def run():
        jobs.stream_findings(
            readers.read_reports(spark, f"{root}/in", streaming=True), jobs.overlaid_snapshots(f"{root}/cve", "cve_id"),
            jobs.newest_snapshot(f"{root}/adv"), f"{root}/out", f"{root}/bad", f"{root}/c", available_now=True,
        ).awaitTermination()

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    whole = writers.append_rejected
    monkeypatch.setattr(writers, "append_rejected", stop)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(writers, "append_rejected", whole)
    jobs.publish_snapshot(cve("fine"), f"{root}/cve", 2)
    run()
    good = {r.parent_event_id for r in writers.read_table(spark, f"{root}/out").collect()}
    bad = {r.parent_event_id for r in writers.read_table(spark, f"{root}/bad").collect()}
    assert not good & bad and len(good | bad) == 6


def test_bad_typed_records_are_rejected_with_their_error(spark, tmp_path):
    root = str(tmp_path)
    bad_id = F.when(F.col("id") == 1, "no uuid").otherwise(F.format_string("00000000-0000-4000-8000-%012d", "id"))
    writers.append_reports(typed_reports(spark, 4, event_id=bad_id), f"{root}/in", 0)
    jobs.publish_snapshot(spark.createDataFrame([], CVE), f"{root}/cve", 1)
    jobs.publish_snapshot(spark.createDataFrame([("a", None)], "id string, cve_list string"), f"{root}/adv", 1)
    jobs.stream_findings(
        readers.read_reports(spark, f"{root}/in", streaming=True), jobs.overlaid_snapshots(f"{root}/cve", "cve_id"),
        jobs.newest_snapshot(f"{root}/adv"), f"{root}/out", f"{root}/bad", f"{root}/c", available_now=True,
    ).awaitTermination()
    (row,) = writers.read_table(spark, f"{root}/bad").collect()
    assert (row.parent_event_id, row.error.error_code) == ("no uuid", 139)
    assert count(spark, f"{root}/out") == 3


def test_enrichment_tables_outlive_a_batch(spark, tmp_path):
    root = str(tmp_path)
    jobs.publish_snapshot(spark.createDataFrame([], CVE), f"{root}/cve", 1)
    jobs.publish_snapshot(spark.createDataFrame([("a", None)], "id string, cve_list string"), f"{root}/adv", 1)
    for k in range(3):
        rows = typed_reports(spark, 4, event_id=F.format_string(f"0000000{k}-0000-4000-8000-%012d", "id"))
        writers.append_reports(rows, f"{root}/in", k)
    jobs.stream_findings(
        readers.read_reports(spark, f"{root}/in", streaming=True, max_files=1), jobs.overlaid_snapshots(f"{root}/cve", "cve_id"),
        jobs.newest_snapshot(f"{root}/adv"), f"{root}/out", f"{root}/bad", f"{root}/c", available_now=True,
    ).awaitTermination()
    assert count(spark, f"{root}/out") == 12 and len(manifests.entries(spark, f"{root}/out")) == 3


def test_unpublished_batch_is_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.append_reports(typed_reports(spark, 5), path, 0)

    def half(folder):
        typed_reports(spark, 5).write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writers.publish_batch(spark, path, 1, half)
    assert readers.read_reports(spark, path).count() == 5
    writers.append_reports(typed_reports(spark, 7), path, 1)
    assert readers.read_reports(spark, path).count() == 12


def cut(path, share=0.5, checksum=True):
    """Leave only the first part of a file, as a copy that was interrupted does."""
    whole = path.read_bytes()
    path.write_bytes(whole[: int(len(whole) * share)])
    if not checksum:
        shutil.move(path.with_name(f".{path.name}.crc"), path.with_name(f".{path.name}.lost"))


@pytest.mark.parametrize("checksum", [True, False])
def test_half_an_entry_counts_for_nothing(spark, tmp_path, checksum):
    path = str(tmp_path / "log")
    writers.append_reports(typed_reports(spark, 5), path, 0)
    writers.append_reports(typed_reports(spark, 7), path, 1)
    (entry,) = (tmp_path / "log" / "_manifests").glob("*-000000000001.000.json")
    cut(entry, checksum=checksum)
    manifests._known.clear()
    assert not writers.has_batch(spark, path, 1)
    assert readers.read_reports(spark, path).count() == 5
    # The batch runs again: its rows are there once, and the files of the lost attempt are not read.
    writers.append_reports(typed_reports(spark, 7), path, 1)
    assert readers.read_reports(spark, path).count() == 12
    writers.append_reports(typed_reports(spark, 7), path, 1)
    assert readers.read_reports(spark, path).count() == 12
    seen = []
    rows = readers.read_reports(spark, path, streaming=True, max_files=1)
    jobs._start(rows, lambda df, _: seen.append(df.count()), str(tmp_path / "c"), True, REPORT).awaitTermination()
    assert sorted(seen) == [0, 5, 7]


def test_a_second_writer_does_not_replace_an_entry(spark, tmp_path):
    path = str(tmp_path / "log")

    def other(folder):
        writers.append_reports(typed_reports(spark, 3), path, 0)
        typed_reports(spark, 9).write.parquet(folder)

    assert not manifests.publish(spark, path, writers.batch_name(0), other)
    assert readers.read_reports(spark, path).count() == 3


def test_compaction_changes_no_row(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(4):
        writers.append_reports(typed_reports(spark, 5 + k, event_version=F.lit(str(k))), path, k)
    before = readers.read_reports(spark, path)
    rows = sorted(map(str, before.collect()))
    assert manifests.compact(spark, path, lambda df, folder: df.coalesce(1).write.parquet(folder))
    assert len(manifests.entries(spark, path)) == 1
    assert sorted(map(str, readers.read_reports(spark, path).collect())) == rows
    assert sorted(map(str, before.collect())) == rows  # a reader that had begun
    assert not manifests.compact(spark, path, lambda df, folder: None)
    # Replaced batches stay published, and a stream has each row once.
    writers.append_reports(typed_reports(spark, 5), path, 0)
    assert readers.read_reports(spark, path).count() == len(rows)
    total = []
    stream = readers.read_reports(spark, path, streaming=True)
    jobs._start(stream, lambda df, _: total.append(df.count()), str(tmp_path / "c"), True, REPORT).awaitTermination()
    assert sum(total) == len(rows)


def test_copies_that_arrive_a_month_apart_count_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "KEY_BATCHES", 3)
    root = str(tmp_path)
    jobs.publish_snapshot(spark.createDataFrame([], CVE), f"{root}/cve", 1)
    jobs.publish_snapshot(spark.createDataFrame([("a", None)], "id string, cve_list string"), f"{root}/adv", 1)

    def arrive(days, *numbers):
        rows = typed_reports(spark, 40).filter(F.col("event_id").substr(-2, 2).cast("int").isin(list(numbers)))
        place = tmp_path / "in"
        old = set(place.glob("*")) if place.exists() else set()
        writers.append_reports(rows.unionByName(rows), f"{root}/in")
        for file in set(place.glob("part*")) - old:
            os.utime(file, (1_700_000_000 + days * 86_400,) * 2)
        jobs.stream_findings(
            readers.read_reports(spark, f"{root}/in", streaming=True), jobs.overlaid_snapshots(f"{root}/cve", "cve_id"),
            jobs.newest_snapshot(f"{root}/adv"), f"{root}/out", f"{root}/bad", f"{root}/c", available_now=True,
        ).awaitTermination()

    arrive(0, 1, 2, 3)
    arrive(31, 2, 4)
    arrive(62, 1, 4, 5)
    arrive(93, 1, 2, 3, 4, 5, 6)
    arrive(124, 3, 7)
    found = [int(r.parent_event_id[-2:]) for r in writers.read_table(spark, f"{root}/out").collect()]
    assert sorted(found) == [1, 2, 3, 4, 5, 6, 7]
    assert len(manifests.entries(spark, f"{root}/c-seen")) <= 3


def test_a_version_is_there_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "cve")
    table = lambda n: spark.range(n).selectExpr("CAST(id AS string) AS id", "'x' AS cve_list")
    jobs.publish_snapshot(table(5), root, 1)
    newest = jobs.newest_snapshot(root)
    seen = []

    def halfway(folder):
        table(20).repartition(3).write.parquet(folder)
        seen.append([entry.name for entry in manifests.entries(spark, root)])
        seen.append(newest(spark).count())

    manifests.publish(spark, root, f"version-{2:020d}", halfway)
    assert seen == [[f"version-{1:020d}"], 5]
    assert newest(spark).count() == 20
    jobs.publish_snapshot(table(9), root, 2)  # a version does not change
    assert jobs.newest_snapshot(root)(spark).count() == 20
    (entry,) = (tmp_path / "cve" / "_manifests").glob("*2.000.json")
    cut(entry, 0.9)
    manifests._known.clear()
    assert jobs.newest_snapshot(root)(spark).count() == 5
    with pytest.raises(LookupError):
        jobs.newest_snapshot(str(tmp_path / "none"))(spark)


def test_each_table_has_its_own_clock(spark, tmp_path):
    now = [0.0]
    table = lambda n: spark.range(n).selectExpr("CAST(id AS string) AS id", "'x' AS cve_list")
    often, seldom = (str(tmp_path / name) for name in ("often", "seldom"))
    for root in (often, seldom):
        jobs.publish_snapshot(table(1), root, 1)
    first = jobs.newest_snapshot(often, jobs.CVE_REFRESH, lambda: now[0])
    second = jobs.newest_snapshot(seldom, jobs.ADVISORY_REFRESH, lambda: now[0])
    counts = lambda: (first(spark).count(), second(spark).count())
    assert counts() == (1, 1)
    for root in (often, seldom):
        jobs.publish_snapshot(table(2), root, 2)
    now[0] = jobs.CVE_REFRESH - 1
    assert counts() == (1, 1)
    now[0] = jobs.CVE_REFRESH
    assert counts() == (2, 1)
    now[0] = jobs.ADVISORY_REFRESH
    assert counts() == (2, 2)


def test_trend_keeps_few_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "TREND_BATCHES", 3)
    root = str(tmp_path)
    for k in range(8):
        rows = spark.range(10).select(
            F.lit("a").alias("application_name"), F.timestamp_seconds(F.col("id") * 86_400 * (k + 1)).alias("timestamp"),
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in FINDING if f.name not in ("application_name", "timestamp")],
        )
        rows.select(*FINDING.fieldNames()).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = readers.read_findings(spark, f"{root}/in", streaming=True, max_files=1)
    jobs.stream_trend(stream, f"{root}/out", f"{root}/c", "10 days", available_now=True).awaitTermination()
    assert len(manifests.entries(spark, f"{root}/out")) <= 3
    got = {r.span_start.timestamp(): r.n_findings for r in jobs.read_trend(spark, f"{root}/out").collect()}
    want = {}
    for k in range(8):
        for i in range(10):
            start = i * (k + 1) // 10 * 864_000
            want[start] = want.get(start, 0) + 1
    assert got == want


def test_admission_by_bytes_changes_no_row(spark, tmp_path):
    root = str(tmp_path)
    write_bodies(spark, f"{root}/in", range(1, 4))
    write_bodies(spark, f"{root}/in", range(4, 10))
    write_bodies(spark, f"{root}/in", range(10, 16))
    sizes = []
    payloads = readers.read_payloads(spark, f"{root}/in", streaming=True, max_bytes=10)
    jobs._start(payloads, lambda df, _: sizes.append(df.count()), f"{root}/c", True).awaitTermination()
    assert sorted(sizes) == [3, 6, 6]


def test_snapshots(spark, tmp_path):
    table = lambda *rows: spark.createDataFrame(list(rows), "id string, cve_list string")
    root = str(tmp_path)
    jobs.publish_snapshot(table(("a", "1"), ("b", "1")), root, 9)
    jobs.publish_snapshot(table(("a", "2")), root, 10)
    overlaid = {r.id: r.cve_list for r in jobs.overlaid_snapshots(root, "id")(spark).collect()}
    newest = {r.id: r.cve_list for r in jobs.newest_snapshot(root)(spark).collect()}
    assert overlaid == {"a": "2", "b": "1"} and newest == {"a": "2"}
