"""Readers. Each gives the columns the operators expect, from files or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dimensions import feed_name, parse_manifest
from ..schemas import COMMIT, CVE_FEED, FINDING, REPORT, SUPPRESSION
from ..sinks import manifests


def _source(spark: SparkSession, streaming: bool, max_files: int | None, max_bytes: int | None = None):
    if not streaming:
        return spark.read
    # A stream takes at most this many files, or about this many bytes, per micro-batch.
    limits = {"maxFilesPerTrigger": max_files, "maxBytesPerTrigger": max_bytes}
    return spark.readStream.options(**{k: v for k, v in limits.items() if v})


def _log(
    spark: SparkSession, path: str, schema: StructType, streaming: bool, max_files: int | None, max_bytes: int | None
) -> DataFrame:
    """A log's rows. Of a log that is published in batches, a stream gives the batches' entries,
    at most ``max_files`` at a time, which the jobs turn into rows."""
    if not manifests.has_manifests(spark, path):
        return _source(spark, streaming, max_files, max_bytes).option("recursiveFileLookup", True).schema(schema).parquet(path)
    if streaming:
        return manifests.stream_entries(spark, path, max_files)
    return manifests.read(spark, path, schema)


def read_payloads(
    spark: SparkSession,
    path: str,
    *,
    whole_files: bool = False,
    streaming: bool = False,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Request bodies, one JSON document per line or per file, as ``body``."""
    reader = _source(spark, streaming, max_files, max_bytes)
    return reader.text(path, wholetext=whole_files).withColumnRenamed("value", "body")


def read_reports(
    spark: SparkSession,
    path: str,
    *,
    streaming: bool = False,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    return _log(spark, path, REPORT, streaming, max_files, max_bytes)


def read_findings(
    spark: SparkSession,
    path: str,
    *,
    streaming: bool = False,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    return _log(spark, path, FINDING, streaming, max_files, max_bytes)


def read_cve_feed(
    spark: SparkSession, path: str | list[str], *, one_per_line: bool = False
) -> DataFrame:
    """Feed files, plain or gzipped: ``feed`` and ``CVE_Items``.

    A feed is published as one document per file, about a hundred megabytes per year; a
    task reads a file and explodes its items. Feeds stored again as one document per line
    are read in splits. The feed's name comes from the file or its folder.
    """
    files = spark.read.schema(CVE_FEED).option("multiLine", not one_per_line).json(path)
    return files.select(feed_name(F.col("_metadata.file_path")).alias("feed"), "CVE_Items")


def read_feed_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Uncompressed feed content by ``feed``, for the hash check."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        feed_name(F.col("_metadata.file_path")).alias("feed"), F.col("value").alias("content")
    )


def _part() -> Column:
    return F.regexp_extract("_metadata.file_path", r"part=(\d+)/", 1).cast("long").alias("part")


def read_feed_parts(spark: SparkSession, path: str) -> DataFrame:
    """Content of feeds that are kept in files of bounded size: ``feed, part, content``.

    The part's number is in its folder's name, ``part=<n>``.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(
        feed_name(F.col("_metadata.file_path")).alias("feed"), _part(), F.col("value").alias("content")
    )


def read_part_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries of the parts of feeds: ``feed, part`` and the manifest's fields."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(
        feed_name(F.col("_metadata.file_path")).alias("feed"), _part(), F.expr(parse_manifest("value")).alias("m")
    ).select("feed", "part", "m.*")


def read_feed_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return files.select(
        feed_name(F.col("_metadata.file_path")).alias("feed"),
        F.expr(parse_manifest("value")).alias("m"),
    ).select("feed", "m.*")


def read_advisory_db(spark: SparkSession, path: str, *, whole_files: bool = True) -> DataFrame:
    """Advisory database documents, one per file or per line, as ``document``."""
    documents = spark.read.text(path, wholetext=whole_files)
    return documents.withColumnRenamed("value", "document")


def read_suppressions(spark: SparkSession, path: str) -> DataFrame:
    """Typed suppressions, one JSON object per line."""
    return spark.read.schema(SUPPRESSION).json(path)


def read_suppression_documents(spark: SparkSession, path: str) -> DataFrame:
    """Suppressions as raw JSON lines, for ``validate_suppressions``."""
    return spark.read.text(path).withColumnRenamed("value", "document")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT).parquet(path)
