"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import AS_OF, view, with_cvss
from ..session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is the DuckDB text that must give the same rows."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(tune(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cvss(view(spark, sf_dir, "fx_findings"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_reports").drop("o_orderkey")


def cve_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cvss(view(spark, sf_dir, "fx_cve")).drop("p_partkey")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_commits").drop("commit_key")


def micros(name: str, alias: str | None = None) -> Column:
    return F.unix_micros(name).alias(alias or name.split(".")[-1])


def flat_cvss() -> list[Column]:
    return [
        F.col("cvss.version").alias("cvss_version"),
        F.round(F.col("cvss.score").cast("double"), 4).alias("cvss_score"),
    ]


def flat_error() -> list[Column]:
    return [F.col(f"error.{c}").alias(c) for c in ("error_code", "error_message", "json_field_name")]
