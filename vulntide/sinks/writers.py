"""Append-only tables. A batch id makes a repeated write come out once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..schemas import FINDING, REPORT
from . import manifests

APP = "application_name"
REPORT_KEYS = ["event_id"]
FINDING_KEYS = ["event_id", "parent_event_id", "advisory_id"]


def _clustered(df: DataFrame, *order: str) -> DataFrame:
    """Rows of an application together and in order, over the files as well.

    Ranges of application and order: small applications share a file, a large one is cut
    where its order allows, so its files follow each other by their number. The ranges are
    found by sampling, so pass stored rows.
    """
    keys = [APP, *order]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def batch_name(batch_id: int) -> str:
    return f"batch-{batch_id:012d}"


def has_batch(spark: SparkSession, path: str, batch_id: int) -> bool:
    """True once a batch has been published to a table."""
    return manifests.is_published(spark, path, batch_name(batch_id))


def publish_batch(spark: SparkSession, path: str, batch_id: int, write: Callable[[str], None]) -> None:
    """Write a batch aside, and show it whole by one entry; see :mod:`manifests`.

    A batch that runs again finds its entry and leaves it alone: a stream that reads the
    table has seen its rows.
    """
    manifests.publish(spark, path, batch_name(batch_id), write)


def _writer(df: DataFrame, kind: str = "parquet", looked_up: Iterable[str] = ()) -> DataFrameWriter:
    """Columns that are looked up by value get Bloom filters, of the size that their values need.

    Row groups whose range holds a value, but not the value, are then not read. Parquet writes
    none for columns that a dictionary covers, which tells as much.
    """
    writer = df.write.format(kind)
    if kind == "parquet":
        writer = writer.option("compression", "zstd")
    names = list(looked_up)
    if names:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", True)
    for name in names:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", True)
    return writer


def _write(
    df: DataFrame, path: str, batch_id: int | None, kind: str = "parquet", looked_up: Iterable[str] = ()
) -> None:
    """Append, or publish a batch."""
    writer = _writer(df, kind, looked_up)
    if batch_id is None:
        writer.mode("append").save(path)
    else:
        publish_batch(df.sparkSession, path, batch_id, writer.save)


def read_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Read back a table, published in batches or not."""
    if manifests.has_manifests(spark, path):
        return manifests.read(spark, path, kind=kind)
    return spark.read.format(kind).option("recursiveFileLookup", True).load(path)


def _ordered_reports(reports: DataFrame) -> DataFrame:
    return _clustered(reports.select(*REPORT.fieldNames()), "end_time", "event_id")


def append_reports(reports: DataFrame, path: str, batch_id: int | None = None) -> None:
    _write(_ordered_reports(reports), path, batch_id, looked_up=REPORT_KEYS)


def finding_columns(findings: DataFrame) -> list[str]:
    """Log columns, and the positions that key a finding within its report."""
    keys = [c for c in ("position", "cve_position", "cve_id", "issue_hash") if c in findings.columns]
    return FINDING.fieldNames() + keys


def _ordered_findings(findings: DataFrame) -> DataFrame:
    columns = finding_columns(findings)
    order = [c for c in ("timestamp", "event_id", "cve_position") if c in columns]
    return _clustered(findings.select(*columns), *order)


def append_findings(findings: DataFrame, path: str, batch_id: int | None = None) -> None:
    _write(_ordered_findings(findings), path, batch_id, looked_up=FINDING_KEYS)


def compact_reports(spark: SparkSession, path: str, least: int = 2) -> bool:
    """Rewrite a log's batches, if there are ``least`` or more, as one in the log's order.

    The batches stay as they are for readers that have begun; see :func:`manifests.compact`.
    """
    write = lambda rows, folder: _writer(_ordered_reports(rows), looked_up=REPORT_KEYS).save(folder)
    return manifests.compact(spark, path, write, least)


def compact_findings(spark: SparkSession, path: str, least: int = 2) -> bool:
    """As :func:`compact_reports`, for findings."""
    write = lambda rows, folder: _writer(_ordered_findings(rows), looked_up=FINDING_KEYS).save(folder)
    return manifests.compact(spark, path, write, least)


def append_outbox(messages: DataFrame, path: str, batch_id: int | None = None) -> None:
    _write(messages, path, batch_id)


def append_rejected(rejected: DataFrame, path: str, batch_id: int | None = None) -> None:
    _write(rejected, path, batch_id)


def append_audit(lines: DataFrame, path: str, batch_id: int | None = None) -> None:
    """One JSON text per line."""
    _write(lines.select(F.col("line").alias("value")), path, batch_id, "text")
