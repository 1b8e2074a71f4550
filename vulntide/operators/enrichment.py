"""Findings joined to the enrichment tables.

No join here carries a broadcast hint. Both sides' sizes are known to the optimiser: a
table below ``spark.sql.autoBroadcastJoinThreshold`` is broadcast, at planning or by AQE
from the measured shuffle size; beyond it the join sorts and merges, and AQE splits the
partitions of an advisory that a large share of all findings refer to. For the split, pass
stored tables: a table that comes straight from an aggregate has no shuffle of its own.
With ``heavy``, the keys that :func:`skew.heavy_keys` found, the plan itself spreads them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import with_computed
from ..functions.text import UNKNOWN_CVSS, split_trimmed
from ..functions.urls import normalise_url
from ..session import materialise
from .errors import error_struct, fails, first_of
from .skew import salted_join

ADVISORY_PREFIX = "pyup.io-"


def enrich_bundler(findings: DataFrame, cve: DataFrame, heavy: Iterable[str] = ()) -> DataFrame:
    """Take the score, and only the score, from the CVE with the advisory's id."""
    scores = cve.select(F.col("cve_id").alias("_cve"), F.col("cvss").alias("_cvss"))
    joined = salted_join(findings, scores, F.col("advisory_id"), F.col("_cve"), list(heavy))
    score = F.coalesce(F.col("_cvss"), F.expr(UNKNOWN_CVSS))
    return joined.withColumn("cvss", score).drop("_cve", "_cvss")


def _prefixed(heavy: Iterable[str]) -> list[str]:
    return [ADVISORY_PREFIX + key for key in heavy]


def lookup_advisory(findings: DataFrame, advisories: DataFrame, heavy: Iterable[str] = ()) -> DataFrame:
    """Add ``advisory_known`` and ``cve_list`` from the advisory database.

    Three outcomes: unknown advisory, known without CVEs, known with a CVE list.
    """
    listed = advisories.select(F.col("id").alias("_id"), "cve_list")
    key = F.concat(F.lit(ADVISORY_PREFIX), F.col("advisory_id"))
    joined = salted_join(findings, listed, key, F.col("_id"), _prefixed(heavy))
    return joined.withColumn("advisory_known", F.col("_id").isNotNull()).drop("_id")


def split_cves(looked_up: DataFrame) -> DataFrame:
    """One row per listed CVE; findings without a list stay one row with a null ``cve_id``."""
    cves = f"coalesce({split_trimmed('cve_list')}, array(CAST(NULL AS STRING)))"
    return looked_up.select("*", F.expr(f"posexplode({cves}) AS (cve_position, cve_id)"))


def _checked_cve(cve: DataFrame) -> DataFrame:
    """CVEs with what they replace in a finding, and the error of an unusable one.

    A CVE's URL is normalised and its fields are checked here, once, and not for every
    finding that refers to it.
    """
    failed = first_of(
        fails("url = ''", "advisory_url_empty"),
        fails("_url IS NULL", "advisory_url_invalid"),
        fails("description = ''", "advisory_description_empty"),
    )
    return with_computed(cve, _url=normalise_url("url")).select(
        F.col("cve_id").alias("_cve"),
        F.struct("cvss", "description", F.col("_url").alias("url")).alias("hit"),
        F.expr(failed).alias("failed"),
    )


def cves_by_advisory(advisories: DataFrame, cve: DataFrame) -> DataFrame:
    """``_id, cve_list, hits`` per advisory: its CVEs in order, each with its record.

    The two enrichment tables meet here, at their own size, so that the findings need one
    join. An advisory without a list has one entry without a CVE. The list is one
    advisory's own, which bounds the row.
    """
    split = split_cves(advisories.select(F.col("id").alias("_id"), "cve_list"))
    # Entries without a CVE match nothing, and each has a key of its own.
    key = F.coalesce("cve_id", F.concat(F.lit("none "), "_id"))
    joined = split.join(_checked_cve(cve), key == F.col("_cve"), "left")
    entry = F.struct("cve_position", "cve_id", "hit", "failed")
    return joined.groupBy("_id", "cve_list").agg(F.sort_array(F.collect_list(entry)).alias("hits"))


def checked_safety_fan_out(
    findings: DataFrame,
    advisories: DataFrame,
    cve: DataFrame,
    heavy: Iterable[str] = (),
    known: DataFrame | None = None,
) -> DataFrame:
    """Fan-out rows with ``failed`` set where the CVE's own text or URL is unusable.

    Score, text and URL are replaced together where the CVE is known. The advisories with
    their CVEs are stored, so their size is known to the join, and a hot advisory is split;
    ``known`` is this table from a call before, for the same advisories and CVEs.
    """
    if known is None:
        known = materialise(cves_by_advisory(advisories, cve), "advisory-cves")
    key = F.concat(F.lit(ADVISORY_PREFIX), F.col("advisory_id"))
    joined = salted_join(findings, known, key, F.col("_id"), _prefixed(heavy))
    kind = known.schema["hits"].dataType.elementType
    unknown = F.array(F.struct(*[
        (F.lit(0) if f.name == "cve_position" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind
    ]))
    rows = joined.select("*", F.explode(F.coalesce("hits", unknown)).alias("e")).withColumn(
        "advisory_known", F.col("_id").isNotNull()
    )
    taken = lambda new, old: F.when(F.col("e.hit").isNotNull(), F.col(f"e.hit.{new}")).otherwise(F.col(old))
    return rows.withColumns(
        {
            "cve_position": F.col("e.cve_position"),
            "cve_id": F.col("e.cve_id"),
            "failed": F.col("e.failed"),
            "cvss": taken("cvss", "cvss"),
            "advisory_url": taken("url", "advisory_url"),
            "advisory_description": taken("description", "advisory_description"),
        }
    ).drop("_id", "hits", "e")


def failed_reports(checked: DataFrame) -> DataFrame:
    """Reports with a failed row, and their first error in emission order.

    The list is stored, so that its size is known when the rows are filtered by it: a
    short one is broadcast and the rows stay where they are. Left to one plan, all rows
    would be shuffled before the list turns out short.
    """
    first = F.min(F.struct("position", "cve_position", "failed")).getField("failed")
    bad = checked.filter("failed IS NOT NULL").groupBy("parent_event_id")
    return materialise(bad.agg(first.alias("failed")), "failed")


def rejected_fan_out(failed: DataFrame) -> DataFrame:
    return failed.selectExpr("parent_event_id", f"{error_struct('failed')} AS error")


def without_failed_reports(checked: DataFrame, failed: DataFrame) -> DataFrame:
    """One bad row removes all rows of its report."""
    rows = checked.drop("failed")
    return rows.join(failed.select("parent_event_id"), "parent_event_id", "left_anti")


def enrich_safety(findings: DataFrame, advisories: DataFrame, cve: DataFrame) -> DataFrame:
    """One finding per CVE of the advisory. All rows of a fan-out share their event id."""
    checked = checked_safety_fan_out(findings, advisories, cve)
    return without_failed_reports(checked, failed_reports(checked))


def union_findings(*parts: DataFrame) -> DataFrame:
    """Findings of all tools in one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
