"""Queries that run a flow as a stream over stored input and read back what it wrote."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import AS_OF, duck, view
from ..operators import dimensions
from ..session import materialise, new_folder, scratch, settled
from ..sinks import writers
from ..sources import readers
from ..streaming import jobs
from . import oracles as o
from .findings import CHANNEL, _ALL, _ALL_COLUMNS, _MESSAGE, _flow, _logged
from .intake import ERRORS, TYPED_REPORT_ERROR, _TYPED, _typed
from .registry import as_of, cve_table, findings, flat_error, micros, query, reports


def _finish(*streams) -> None:
    for stream in streams:
        stream.awaitTermination()


@query("stream_intake", duck(_TYPED, checked=o.CHECKED))
def stream_intake(spark, sf_dir):
    root = new_folder(spark, "stream-intake")
    view(spark, sf_dir, "fx_payloads").select("body").write.text(f"{root}/in")
    payloads = readers.read_payloads(spark, f"{root}/in", streaming=True, max_files=4)
    _finish(
        jobs.stream_intake(payloads, f"{root}/out", f"{root}/bad", f"{root}/checkpoint", True)
    )
    return _typed(writers.read_table(spark, f"{root}/out"))


@query(
    "stream_rejected",
    duck(
        "SELECT body, error_code, error_message, json_field_name FROM checked JOIN errors USING (name)",
        checked=o.CHECKED, **ERRORS,
    ),
)
def stream_rejected(spark, sf_dir):
    root = new_folder(spark, "stream-rejected")
    view(spark, sf_dir, "fx_payloads").select("body").write.text(f"{root}/in")
    payloads = readers.read_payloads(spark, f"{root}/in", streaming=True, max_files=4)
    _finish(
        jobs.stream_intake(payloads, f"{root}/out", f"{root}/bad", f"{root}/checkpoint", True)
    )
    return writers.read_table(spark, f"{root}/bad").select("body", *flat_error())


@query(
    "report_order",
    duck("SELECT application_name, CAST(count(*) AS BIGINT) AS n, TRUE AS in_order FROM fx_reports GROUP BY application_name"),
)
def report_order(spark, sf_dir):
    """Whether the log keeps each application's reports in the order of time, over its files."""
    path = new_folder(spark, "report-order")
    with scratch(spark):
        writers.append_reports(materialise(reports(spark, sf_dir), "reports"), path)
    rows = readers.read_reports(spark, path).select(
        "application_name", "end_time", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    after = rows.select(
        "file", (F.col("row") - 1).alias("row"), F.col("application_name").alias("next_name"), F.col("end_time").alias("next_time")
    )
    falls = (F.col("application_name") == F.col("next_name")) & (F.col("next_time") < F.col("end_time"))
    within = rows.join(after, ["file", "row"], "left").groupBy("application_name", "file").agg(
        F.count(F.lit(1)).alias("n"), F.min("end_time").alias("first"), F.max("end_time").alias("last"),
        F.count_if(falls).alias("falls"),
    )
    before = F.lag("last").over(Window.partitionBy("application_name").orderBy("file"))
    joined = within.withColumn("falls", F.col("falls") + F.when(before > F.col("first"), 1).otherwise(0))
    return joined.groupBy("application_name").agg(F.sum("n").alias("n"), (F.sum("falls") == 0).alias("in_order"))


@query("stream_findings", duck(f"SELECT {_ALL_COLUMNS} FROM flagged", **_ALL))
def stream_findings(spark, sf_dir):
    """The CVE table arrives as an old snapshot with a newer one laid over it."""
    root = new_folder(spark, "stream-findings")
    with scratch(spark):
        writers.append_reports(materialise(reports(spark, sf_dir), "reports"), f"{root}/in")
    cve = cve_table(spark, sf_dir)
    old = cve.withColumn("description", F.lit("outdated"))
    jobs.publish_snapshot(old, f"{root}/cve", 1)
    jobs.publish_snapshot(cve, f"{root}/cve", 2)
    advisories = view(spark, sf_dir, "fx_advisories").select("id", "cve_list")
    jobs.publish_snapshot(advisories.withColumn("cve_list", F.lit("CVE-0")), f"{root}/advisories", 1)
    jobs.publish_snapshot(advisories, f"{root}/advisories", 2)
    stream = readers.read_reports(spark, f"{root}/in", streaming=True, max_files=4)
    _finish(
        jobs.stream_findings(
            stream,
            jobs.overlaid_snapshots(f"{root}/cve", "cve_id"),
            jobs.newest_snapshot(f"{root}/advisories"),
            f"{root}/out", f"{root}/bad", f"{root}/checkpoint", as_of(), True,
        )
    )
    return _logged(writers.read_table(spark, f"{root}/out"))


@query(
    "stream_outbox",
    duck(f"SELECT '{CHANNEL}' AS channel, event_id, {_MESSAGE} AS text FROM fx_findings WHERE NOT suppressed"),
)
def stream_outbox(spark, sf_dir):
    root = new_folder(spark, "stream-outbox")
    with scratch(spark):
        writers.append_findings(materialise(findings(spark, sf_dir), "findings"), f"{root}/in")
    stream = readers.read_findings(spark, f"{root}/in", streaming=True, max_files=4)
    _finish(jobs.stream_outbox(stream, CHANNEL, f"{root}/out", f"{root}/checkpoint", True))
    return writers.read_table(spark, f"{root}/out").select("channel", "event_id", "text")


@query(
    "stream_refused_reports",
    duck(
        "SELECT event_id AS parent_event_id, error_code, error_message, json_field_name "
        f"FROM (SELECT *, {TYPED_REPORT_ERROR} AS name FROM fx_raw_reports) r JOIN errors USING (name)",
        **ERRORS,
    ),
)
def stream_refused_reports(spark, sf_dir):
    """Typed reports with faults, each delivered twice: the refused ones, once each."""
    root = new_folder(spark, "stream-refused")
    with scratch(spark):
        raw = materialise(view(spark, sf_dir, "fx_raw_reports"), "raw-reports")
        for batch in (0, 1):
            writers.append_reports(raw, f"{root}/in", batch)
    jobs.publish_snapshot(cve_table(spark, sf_dir), f"{root}/cve", 1)
    advisories = view(spark, sf_dir, "fx_advisories").select("id", "cve_list")
    jobs.publish_snapshot(advisories, f"{root}/advisories", 1)
    stream = readers.read_reports(spark, f"{root}/in", streaming=True, max_files=4)
    _finish(
        jobs.stream_findings(
            stream,
            jobs.overlaid_snapshots(f"{root}/cve", "cve_id"),
            jobs.newest_snapshot(f"{root}/advisories"),
            f"{root}/out", f"{root}/bad", f"{root}/checkpoint", as_of(), True,
        )
    )
    # Codes from 140 to 155 are of extracted findings, not of the typed report.
    refused = writers.read_table(spark, f"{root}/bad").filter("error.error_code NOT BETWEEN 140 AND 155")
    return refused.select("parent_event_id", *flat_error())


@query(
    "stream_deduplicated",
    duck("SELECT event_id, application_name FROM fx_reports"),
)
def stream_deduplicated(spark, sf_dir):
    """Every report is delivered twice, the second time later than the first."""
    root = new_folder(spark, "stream-dedup")
    with scratch(spark):
        rows = materialise(reports(spark, sf_dir), "reports")
        again = rows.withColumn("end_time", F.col("end_time") + F.expr("INTERVAL 1 HOUR"))
        writers.append_reports(rows.unionByName(again), f"{root}/in")
    stream = readers.read_reports(spark, f"{root}/in", streaming=True, max_files=1)
    once = jobs.deduplicated(stream).select("event_id", "application_name")
    writer = once.writeStream.option("checkpointLocation", f"{root}/checkpoint")
    with jobs.keeping_state(spark):
        running = writer.trigger(availableNow=True).start(f"{root}/out", format="parquet")
    _finish(running)
    return spark.read.parquet(f"{root}/out")


def _arrived(spark, path, days):
    """Set back the time at which the files of a folder arrived."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(place):
        fs.setTimes(status.getPath(), status.getModificationTime() - days * 86_400_000, -1)


@query("stream_unique_reports", duck("SELECT event_id, application_name FROM fx_reports"))
def stream_unique_reports(spark, sf_dir):
    """Copies that arrive within the batch, and a month and two months later."""
    root = new_folder(spark, "stream-unique")
    rows = materialise(reports(spark, sf_dir), "reports")
    part = F.pmod(F.xxhash64("event_id"), F.lit(4))
    for days, sent in ((62, rows.where(part < 2)), (31, rows.where(part.isin(1, 2))), (0, rows.unionByName(rows))):
        writers.append_reports(sent, f"{root}/in")
        if days:
            _arrived(spark, f"{root}/in", 31)
        stream = readers.read_reports(spark, f"{root}/in", streaming=True)
        _finish(jobs.stream_unique_reports(stream, f"{root}/out", f"{root}/checkpoint", True))
    return writers.read_table(spark, f"{root}/out").select("event_id", "application_name")


@query("replayed_batch", duck(f"SELECT {_ALL_COLUMNS} FROM flagged", **_ALL))
def replayed_batch(spark, sf_dir):
    """Findings in two batches, one lost half way and both sent again."""
    path = new_folder(spark, "replayed")
    rows = settled(spark, "findings", lambda: _flow(spark, sf_dir).good)
    first = F.pmod(F.xxhash64("parent_event_id"), F.lit(2)) == 0
    batches = [rows.where(first), rows.where(~first)]

    def lost(folder):
        batches[1].limit(100).write.parquet(folder)
        raise InterruptedError

    writers.append_findings(batches[0], path, 0)
    try:
        writers.publish_batch(spark, path, 1, lost)
    except InterruptedError:
        pass
    for _ in range(2):
        for batch_id, batch in enumerate(batches):
            writers.append_findings(batch, path, batch_id)
    return _logged(writers.read_table(spark, path))


@query("compacted_findings", duck(f"SELECT {_ALL_COLUMNS} FROM flagged", **_ALL))
def compacted_findings(spark, sf_dir):
    """Findings in three batches, compacted into one; a batch comes again after that."""
    path = new_folder(spark, "compacted")
    rows = settled(spark, "findings", lambda: _flow(spark, sf_dir).good)
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    batches = [rows.where(third == k) for k in range(3)]
    for batch_id, batch in enumerate(batches):
        writers.append_findings(batch, path, batch_id)
    writers.compact_findings(spark, path)
    writers.append_findings(batches[1], path, 1)
    return _logged(writers.read_table(spark, path))


@query("stream_intake_by_bytes", duck(_TYPED, checked=o.CHECKED))
def stream_intake_by_bytes(spark, sf_dir):
    """Micro-batches bounded by bytes, not by files."""
    root = new_folder(spark, "stream-bytes")
    view(spark, sf_dir, "fx_payloads").select("body").repartition(3).write.text(f"{root}/in")
    payloads = readers.read_payloads(spark, f"{root}/in", streaming=True, max_bytes=1 << 10)
    _finish(
        jobs.stream_intake(payloads, f"{root}/out", f"{root}/bad", f"{root}/checkpoint", True)
    )
    return _typed(writers.read_table(spark, f"{root}/out"))


_SPAN = 2592000000000


@query(
    "stream_trend",
    duck(
        f"""SELECT application_name, span_start, count(*) AS n_findings
            FROM (SELECT application_name,
                         CAST(floor(epoch_us(timestamp) / {_SPAN}) AS BIGINT) * {_SPAN} AS span_start
                  FROM fx_findings) f
            GROUP BY application_name, span_start"""
    ),
)
def stream_trend(spark, sf_dir):
    """One file per micro-batch of a log in the order of applications, not of time."""
    root = new_folder(spark, "stream-trend")
    writers.append_findings(findings(spark, sf_dir), f"{root}/in")
    stream = readers.read_findings(spark, f"{root}/in", streaming=True, max_files=1)
    _finish(jobs.stream_trend(stream, f"{root}/out", f"{root}/checkpoint", available_now=True))
    rows = jobs.read_trend(spark, f"{root}/out")
    return rows.select("application_name", micros("span_start"), "n_findings")


_PANE = 864000000000


@query(
    "stream_sliding_trend",
    duck(
        f"""SELECT application_name, (pane - shift) * {_PANE} AS span_start, CAST(sum(n) AS BIGINT) AS n_findings
            FROM (SELECT application_name, CAST(floor(epoch_us(timestamp) / {_PANE}) AS BIGINT) AS pane, count(*) AS n
                  FROM fx_findings GROUP BY ALL) p, (VALUES (0), (1), (2)) s (shift)
            GROUP BY application_name, pane - shift"""
    ),
)
def stream_sliding_trend(spark, sf_dir):
    """Windows of thirty days, one every ten, from panes of ten days."""
    root = new_folder(spark, "stream-sliding")
    writers.append_findings(findings(spark, sf_dir), f"{root}/in")
    stream = readers.read_findings(spark, f"{root}/in", streaming=True, max_files=1)
    _finish(jobs.stream_trend(stream, f"{root}/out", f"{root}/checkpoint", "10 days", available_now=True))
    rows = jobs.read_trend(spark, f"{root}/out", "30 days", "10 days")
    return rows.select("application_name", micros("span_start"), "n_findings")


@query(
    "refreshing_dims",
    duck(
        """SELECT cve_id, cvss_version, round(CAST(cvss_score AS DOUBLE), 4) AS cvss_score, description
           FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY feed = 'modified' DESC) AS r
                 FROM fx_feed_items) i WHERE r = 1"""
    ),
)
def refreshing_dims(spark, sf_dir):
    """The yearly feeds as one snapshot, ``modified`` as the next, read laid over each other."""
    root = new_folder(spark, "snapshots")
    documents = view(spark, sf_dir, "fx_feed_documents").select("feed", "document")
    items = dimensions.explode_cve_items(dimensions.parse_feed_documents(documents))
    for version, part in enumerate(("feed <> 'modified'", "feed = 'modified'"), 1):
        snapshot = items.filter(part).drop("feed", "feed_rank")
        jobs.publish_snapshot(snapshot, root, version)
    rows = jobs.overlaid_snapshots(root, "cve_id")(spark)
    return rows.select(
        "cve_id", F.col("cvss.version").alias("cvss_version"),
        F.round(F.col("cvss.score").cast("double"), 4).alias("cvss_score"), "description",
    )
