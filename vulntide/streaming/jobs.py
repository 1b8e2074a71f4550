"""The same flows on unbounded input.

Every sink publishes a micro-batch by one entry of its manifest, whole and once: an
interrupted attempt is never seen, a published one is kept. With the query's checkpoint each
row appears once, also to the next stream in line.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.hashing import is_uuid
from ..operators.analytics import trend
from ..operators.dimensions import dedup_advisories
from ..operators.enrichment import cves_by_advisory
from ..operators.notification import outbox
from ..operators.validation import accepted as accepted_reports
from ..operators.validation import rejected as rejected_reports
from ..operators.validation import revalidate_findings, revalidate_reports, validate_reports
from ..plans.pipelines import findings_of
from ..schemas import FINDING, REPORT
from ..session import drop_folder, materialise, new_folder, scratch, stored
from ..sinks import manifests, writers

Dimension = Callable[[SparkSession], DataFrame]

# Seconds between two looks for a new version of an enrichment table, fixed by the data's rhythm.
CVE_REFRESH = 2 * 60 * 60
ADVISORY_REFRESH = 24 * 60 * 60

# Buckets of the index of seen ids, and the batches after which parts are merged.
KEY_BUCKETS = 64
KEY_BATCHES = 32
TREND_BATCHES = 16


# How streams with state keep it.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _start(
    stream: DataFrame, batch: Callable, checkpoint: str, available_now: bool, schema: StructType | None = None
) -> StreamingQuery:
    """Run ``batch`` on each micro-batch; entries of a published log are turned into its rows."""

    def rows(df: DataFrame, batch_id: int) -> None:
        batch(manifests.entered_rows(df, schema) if "_manifest" in df.columns else df, batch_id)

    writer = stream.writeStream.foreachBatch(rows).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_intake(
    payloads: DataFrame, reports: str, rejected: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Payload stream to the report log and the rejected table."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if all(writers.has_batch(spark, path, batch_id) for path in (reports, rejected)):
            return
        with scratch(spark):
            checked = materialise(validate_reports(df), "checked")
            writers.append_reports(accepted_reports(checked), reports, batch_id)
            writers.append_rejected(rejected_reports(checked, "body"), rejected, batch_id)

    return _start(payloads, batch, checkpoint, available_now)


def report_key() -> Column:
    """What makes a report one: its id, or all it says if it has no proper one."""
    everything = F.sha2(F.to_json(F.struct("*")), 256)
    return F.when(F.expr(is_uuid("event_id")), F.col("event_id")).otherwise(everything)


def deduplicated(reports: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream's reports by event id, once within ``delay``: producers may send one again.

    Time is the arrival of a report's file, which a stream takes in that order, so no
    report is ever late, however few files a micro-batch takes and whatever order the log
    has. :func:`unseen` forgets nothing.
    """
    arrived = reports.withColumns({"_key": report_key(), "_arrived": F.col("_metadata.file_modification_time")})
    once = arrived.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["_key"])
    return once.drop("_key", "_arrived")


@contextmanager
def keeping_state(spark: SparkSession) -> Iterator[None]:
    """For starting a stream that keeps state, such as :func:`deduplicated`: it goes on as it began.

    Each micro-batch opens and commits every partition of the state, however few rows it has, so
    there are two per core and not as many as a large batch's shuffle needs. They lie in RocksDB,
    which writes a batch's changes, where Spark's own store copies all keys in memory per batch.
    A checkpoint that is there keeps the number and the store it began with.
    """
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = STATE_STORE | {"spark.sql.shuffle.partitions": min(most, 2 * spark.sparkContext.defaultParallelism)}
    before = {key: spark.conf.get(key, None) for key in chosen}
    for key, value in chosen.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def unseen(reports: DataFrame, index: str) -> DataFrame:
    """Reports of a batch that no batch before had, once each, with their ``_key`` and ``_bucket``.

    ``index`` holds every key seen so far, in buckets by hash, each bucket in files of its
    own. Only the buckets of the batch's own keys are read.
    """
    spark = reports.sparkSession
    bucket = F.pmod(F.xxhash64("_key"), F.lit(KEY_BUCKETS)).cast("int")
    once = reports.withColumn("_key", report_key()).withColumn("_bucket", bucket).dropDuplicates(["_key"])
    published = manifests.entries(spark, index)
    if not published:
        return once
    asked = {f"_bucket={r[0]}" for r in once.select("_bucket").distinct().collect()}
    files = manifests.paths(index, published, lambda file: not asked.isdisjoint(file.split("/")))
    return once.join(manifests.read_files(spark, files, "_key string"), "_key", "left_anti")


def _keep_keys(spark: SparkSession, keys: DataFrame, index: str, batch_id: int) -> None:
    """Add a batch's keys to the index, and merge the index now and then."""

    def write(rows: DataFrame, folder: str) -> None:
        bucket = F.pmod(F.xxhash64("_key"), F.lit(KEY_BUCKETS)).cast("int").alias("_bucket")
        rows.select("_key", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)

    writers.publish_batch(spark, index, batch_id, lambda folder: write(keys, folder))
    manifests.compact(spark, index, write, KEY_BATCHES)


def _joined_dimensions() -> Callable[[DataFrame, DataFrame], DataFrame]:
    """:func:`cves_by_advisory` of two enrichment tables, stored once for as long as both stay the same.

    The work and the table are as large as the enrichment tables, however few reports a batch
    has. The one before goes when the next is there.
    """
    kept: list = [None, None, None, None]  # the two tables, folder, their join

    def read(cve: DataFrame, advisories: DataFrame) -> DataFrame:
        if cve is not kept[0] or advisories is not kept[1]:
            spark = cve.sparkSession
            folder, before = new_folder(spark, "advisory-cves"), kept[2]
            kept[:] = cve, advisories, folder, stored(cves_by_advisory(advisories, cve), folder)
            if before:
                drop_folder(spark, before)
        return kept[3]

    return read


def stream_findings(
    reports: DataFrame,
    cve: Dimension,
    advisories: Dimension,
    findings: str,
    rejected: str,
    checkpoint: str,
    as_of: Column | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Report stream to the finding log.

    ``reports`` is the stream as read from the log. A report counts once, however much
    later it is sent again: an index of all ids lies beside the checkpoint. Each report is
    checked as a typed record first; one that fails, or that cannot be read, goes to the
    rejected table with its error and never stops the query.

    The enrichment tables are asked for in every micro-batch, so a snapshot published
    while the stream runs counts from a later batch on. Findings, rejected rows and ids of a
    batch are stored together before any table gets them: a batch that runs again after
    a new snapshot takes what it had found, so a report is in one of the tables.
    """
    outcomes, index = f"{checkpoint}-outcomes", f"{checkpoint}-seen"
    joined = _joined_dimensions()

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        name = writers.batch_name(batch_id)
        if all(writers.has_batch(spark, path, batch_id) for path in (findings, rejected, index)):
            return

        def write(folder: str) -> None:
            fresh = materialise(unseen(df, index), "fresh")
            fresh.select("_key").write.parquet(f"{folder}/keys")
            checked = materialise(revalidate_reports(fresh.drop("_key", "_bucket")), "checked")
            split = findings_of(checked.filter("error IS NULL").drop("error"), *tables, as_of, known)
            refused = checked.filter("error IS NOT NULL")
            refused = refused.select(F.col("event_id").alias("parent_event_id"), "error")
            split.good.write.parquet(f"{folder}/good")
            split.bad.unionByName(refused).write.parquet(f"{folder}/bad")

        if not writers.has_batch(spark, outcomes, batch_id):
            # Outside the batch's scratch: the tables outlive it.
            tables = cve(spark), advisories(spark)
            known = joined(*tables)
            with scratch(spark):
                writers.publish_batch(spark, outcomes, batch_id, write)
        (found,) = [entry for entry in manifests.entries(spark, outcomes) if entry.name == name]

        def part(kind: str) -> DataFrame:
            return manifests.read_files(spark, manifests.paths(outcomes, [found], lambda f: f"/{kind}/" in f))

        writers.append_findings(part("good"), findings, batch_id)
        writers.append_rejected(part("bad"), rejected, batch_id)
        _keep_keys(spark, part("keys"), index, batch_id)
        drop_folder(spark, f"{outcomes}/{found.files[0].rpartition('/')[0].rpartition('/')[0]}")

    return _start(reports, batch, checkpoint, available_now, REPORT)


def stream_unique_reports(
    reports: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Report stream to a log that has each report once, however much later it is sent again."""
    index = f"{checkpoint}-seen"

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if writers.has_batch(spark, index, batch_id):
            return
        if not writers.has_batch(spark, path, batch_id):
            with scratch(spark):
                fresh = materialise(unseen(df, index).drop("_key", "_bucket"), "fresh")
                writers.append_reports(fresh, path, batch_id)
        # The keys of what was published, so that both agree when a batch runs again.
        (found,) = [e for e in manifests.entries(spark, path) if e.name == writers.batch_name(batch_id)]
        rows = manifests.read_files(spark, manifests.paths(path, [found]), REPORT)
        _keep_keys(spark, rows.select(report_key().alias("_key")), index, batch_id)

    return _start(reports, batch, checkpoint, available_now, REPORT)


def stream_outbox(
    findings: DataFrame,
    channel: str,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    rejected: str | None = None,
) -> StreamingQuery:
    """Finding stream to the outbox.

    Findings that fail the check of a typed record are not announced; ``rejected`` names
    the table that gets them with their error.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        paths = [path, *([rejected] if rejected else [])]
        if all(writers.has_batch(spark, p, batch_id) for p in paths):
            return
        with scratch(spark):
            checked = materialise(revalidate_findings(df), "checked")
            good = checked.filter("error IS NULL").drop("error")
            writers.append_outbox(outbox(good, channel), path, batch_id)
            if rejected:
                writers.append_rejected(checked.filter("error IS NOT NULL"), rejected, batch_id)

    return _start(findings, batch, checkpoint, available_now, FINDING)


def stream_trend(
    findings: DataFrame,
    path: str,
    checkpoint: str,
    width: str = "30 days",
    available_now: bool = False,
) -> StreamingQuery:
    """Windowed counts of a finding stream, as partial counts per micro-batch.

    No watermark and no state: :func:`read_trend` adds the parts up, so a finding counts
    however late it comes, and windows that are still open are there as well. Parts are added
    up into one now and then, so their number stays bounded.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        counts = trend(df, width).select(
            "application_name", F.col("span.start").alias("span_start"), "n_findings"
        )
        writers.publish_batch(df.sparkSession, path, batch_id, counts.write.parquet)
        manifests.compact(df.sparkSession, path, _added_up, TREND_BATCHES)

    return _start(findings, batch, checkpoint, available_now, FINDING)


def _added_up(parts: DataFrame, folder: str) -> None:
    _summed(parts).write.parquet(folder)


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("application_name", "span_start").agg(F.sum("n_findings").alias("n_findings"))


def read_trend(spark: SparkSession, path: str, width: str | None = None, slide: str | None = None) -> DataFrame:
    """The counts that a trend stream has written so far.

    With ``width``, the stream's windows are panes, and windows of that width, one every
    ``slide``, are added up from them. The panes' width has to divide both.
    """
    panes = _summed(writers.read_table(spark, path))
    if width is None:
        return panes
    span = F.window("span_start", width, slide or width)
    return _summed(panes.withColumn("span_start", span["start"]))


def publish_snapshot(table: DataFrame, root: str, version: int) -> None:
    """Store a version of an enrichment table, shown whole by one entry of its manifest.

    A version that is there stays as it is: readers may have used it.
    """
    manifests.publish(table.sparkSession, root, f"version-{version:020d}", table.write.parquet)


def _version(entry: manifests.Entry) -> int:
    return int(entry.name.rpartition("-")[2])


def _refreshing(
    root: str,
    build: Callable[[DataFrame | None, list[DataFrame]], DataFrame],
    every: float = 0,
    clock: Callable[[], float] = time.monotonic,
) -> Dimension:
    """A table kept up to date with the versions published in ``root``.

    ``build`` gets the table as stored last and the versions published since, so a version
    is read once. Versions are looked for when ``every`` seconds have passed since the last
    look, by a clock of the table's own; a version that is still being written is not there
    yet. The table is stored, and each micro-batch joins a plain table of known size; the one
    before it goes when the next is there.
    """
    kept: list = [None, None, None, None]  # newest version, folder, table, time of the last look

    def read(spark: SparkSession) -> DataFrame:
        now = clock()
        if kept[2] is not None and now - kept[3] < every:
            return kept[2]
        found = manifests.entries(spark, root)
        if not found:
            raise LookupError(f"no version of the table in {root}")
        fresh = [entry for entry in found if kept[0] is None or _version(entry) > kept[0]]
        if fresh:
            added = [
                manifests.read_files(spark, manifests.paths(root, [entry])).withColumn("version", F.lit(_version(entry)))
                for entry in fresh
            ]
            folder, before = new_folder(spark, "dimension"), kept[1]
            build(kept[2], added).write.parquet(folder)
            kept[:3] = _version(found[-1]), folder, spark.read.parquet(folder)
            if before:
                drop_folder(spark, before)
        kept[3] = now
        return kept[2]

    return read


def overlaid_snapshots(root: str, key: str, every: float = 0, clock: Callable[[], float] = time.monotonic) -> Dimension:
    """All versions laid over each other: the newest row per key. For the CVE table."""

    def build(stored: DataFrame | None, added: list[DataFrame]) -> DataFrame:
        layers = [stored.withColumn("version", F.lit(-1))] if stored is not None else []
        rows = reduce(DataFrame.unionByName, layers + added)
        rest = [c for c in rows.columns if c not in (key, "version")]
        latest = F.max_by(F.struct(*rest), "version").alias("latest")
        return rows.groupBy(key).agg(latest).select(key, "latest.*")

    return _refreshing(root, build, every, clock)


def newest_snapshot(root: str, every: float = 0, clock: Callable[[], float] = time.monotonic) -> Dimension:
    """The newest version alone. For the advisory table, which is replaced as a whole."""

    def build(stored: DataFrame | None, added: list[DataFrame]) -> DataFrame:
        return dedup_advisories(added[-1].drop("version"))

    return _refreshing(root, build, every, clock)
