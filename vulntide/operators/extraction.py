"""From report rows to finding rows."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import derived_uuid
from ..functions.sql import first_match, let, struct, text, with_computed
from ..functions.text import UNKNOWN_CVSS, trim_end
from ..functions.urls import normalise_url
from ..functions.variants import as_string, elements_of, field, kind, parse_document, present
from .errors import error_struct, fails, first_of

# The advisory database's address, and one bundler-audit block. A dot would
# also stop at a carriage return, hence the character classes.
ADVISORY_DB_URL = (
    "https://raw.githubusercontent.com/pyupio/safety-db/master/data/insecure_full.json"
)
BLOCK_LINES = ["Name: ", "Version: ", "Advisory: ", "Criticality: ", "URL: ", "Title: ", "Solution:"]
BLOCK = "(" + "".join(f"{line}[^\\n]*\\n" for line in BLOCK_LINES) + ")"

# What a finding takes from its block.
BLOCK_FIELDS = ["affected_package", "installed_version", "advisory_id", "advisory_url", "advisory_description"]

SAFETY_FIELDS = [
    "affected_package", "affected_versions", "installed_version", "advisory_description",
    "advisory_id", "cvssv2", "cvssv3",
]
SAFETY_REQUIRED = SAFETY_FIELDS[:5]

# Columns a finding takes from its report, beside those renamed in ``carry_header``.
HEADER = ["application_name", "git_branch", "git_commit_hash"]


# ``bundler``, ``safety``, or the name of the reason why no extractor fits.
ROUTE = """
    CASE WHEN tool_name = 'bundler-audit'
         THEN if(output_format = 'PlainText', 'bundler', 'bundler_format')
         WHEN tool_name = 'safety'
         THEN CASE output_format WHEN 'JSON' THEN 'safety' WHEN 'PlainText' THEN 'safety_plain_text'
              ELSE 'safety_format' END
         ELSE 'unknown_tool' END
"""


def route_by_tool(reports: DataFrame) -> DataFrame:
    return reports.withColumn("route", F.expr(ROUTE))


def unroutable(routed: DataFrame) -> DataFrame:
    """Reports no extractor can read, with the reason."""
    bad = routed.filter(~F.col("route").isin("bundler", "safety"))
    return bad.selectExpr("event_id AS parent_event_id", f"{error_struct('route')} AS error")


def carry_header() -> list[Column]:
    """Finding columns that come from the report."""
    return [
        F.col("event_id").alias("parent_event_id"),
        *[F.col(name) for name in HEADER],
        F.col("end_time").alias("timestamp"),
        F.col("suppressed_issues"),
    ]


# A finding's id, from its report and position alone.
STAMPED_ID = derived_uuid("parent_event_id", "position")


def stamp() -> list[Column]:
    """Columns every new finding starts with."""
    return [
        F.lit("1").alias("event_version"),
        F.expr(STAMPED_ID).alias("event_id"),
        F.lit(False).alias("suppressed"),
    ]


def block_fields(block: str) -> str:
    """Values of a block by line. A value ends at its second ``": "``; none gives null.

    White space at the block's end belongs to no value, so the last line loses it.
    """
    value = lambda line: f"get(split({line}, ': '), 1)"

    def fields(lines: str) -> str:
        line = lambda i: f"get({lines}, {i})"
        return struct(
            affected_package=value(line(0)),
            installed_version=value(line(1)),
            advisory_id=value(line(2)),
            criticality=value(line(3)),
            advisory_url=value(line(4)),
            advisory_description=value(line(5)),
            solution=value(trim_end(line(6))),
        )

    return let("l", f"split({block}, '\\n')", fields)


def _empty(item: str, name: str) -> str:
    return fails(f"coalesce({item}.{name}, '') = ''", f"{name}_empty")


def _block_error(block: str) -> str:
    return first_of(
        _empty(block, "advisory_id"),
        _empty(block, "affected_package"),
        _empty(block, "installed_version"),
        _empty(block, "advisory_url"),
        fails(f"{block}.url IS NULL", "advisory_url_invalid"),
        _empty(block, "advisory_description"),
    )


def _item_error(item: str) -> str:
    return first_of(
        _empty(item, "advisory_id"),
        _empty(item, "affected_package"),
        _empty(item, "installed_version"),
        _empty(item, "advisory_description"),
    )


def bundler_blocks(reports: DataFrame) -> DataFrame:
    """Header columns and ``blocks``, the parsed blocks of each report."""
    found = f"regexp_extract_all(tool_output, {text(BLOCK)}, 1)"
    rows = reports.select(*carry_header(), "tool_output")
    parsed = with_computed(rows, blocks=f"transform({found}, b -> {block_fields('b')})")
    return parsed.drop("tool_output")


def checked_bundler_blocks(reports: DataFrame) -> DataFrame:
    """Blocks per report with ``failed``, the first error; one bad block fails the report.

    The check stays inside the report's own row, so it needs no shuffle. Each block has its
    URL's normal form beside it, computed here once.
    """
    fields = struct(**{name: f"b.{name}" for name in BLOCK_FIELDS}, url=normalise_url("b.advisory_url"))
    parsed = bundler_blocks(reports)
    others = [c for c in parsed.columns if c != "blocks"]
    with_url = with_computed(parsed.withColumnRenamed("blocks", "_raw"), blocks=f"transform(_raw, b -> {fields})")
    return with_computed(with_url.select(*others, "blocks"), failed=first_match("blocks", "b", _block_error))


def _safety_item(item: str) -> str:
    """Typed finding, written as a list of seven or as an object; null when malformed."""
    full = (
        f"({kind(item)} = 'object' OR {kind(item)} = 'array' AND {present(field(item, '$[6]'))} "
        f"AND NOT ({present(field(item, '$[7]'))}))"
    )
    values = {
        name: f"coalesce({field(item, f'$[{i}]')}, {field(item, f'$.{name}')})"
        for i, name in enumerate(SAFETY_FIELDS)
    }

    def typed(v: str) -> str:
        checks = [full]
        for name in SAFETY_FIELDS:
            allowed = "('string')" if name in SAFETY_REQUIRED else "('string', 'missing')"
            checks.append(f"{kind(f'{v}.{name}')} IN {allowed}")
        texts = struct(**{name: as_string(f"{v}.{name}") for name in SAFETY_FIELDS})
        return f"if({' AND '.join(checks)}, {texts}, NULL)"

    return let("f", struct(**values), typed)


def safety_items(reports: DataFrame) -> DataFrame:
    """Header columns and ``items``; ``items`` is null when the output cannot be read."""
    rows = reports.select(*carry_header(), "tool_output")
    listed = with_computed(
        rows,
        _doc=parse_document("tool_output"),
        _items=f"transform({elements_of('_doc')}, i -> {_safety_item('i')})",
    )
    readable = f"{kind('_doc')} = 'array' AND NOT exists(_items, i -> i IS NULL)"
    opened = listed.withColumn("items", F.expr(f"if({readable}, _items, NULL)"))
    return opened.drop("_doc", "_items", "tool_output")


def checked_safety_items(reports: DataFrame) -> DataFrame:
    """Items per report with ``failed``, the first error; one bad item fails the report."""
    failed = f"if(items IS NULL, 'safety_output', {first_match('items', 'i', _item_error)})"
    return with_computed(safety_items(reports), failed=failed)


def _explode(checked: DataFrame, items: str, url: str) -> DataFrame:
    """One row per item of the reports without an error, numbered in order."""
    good = checked.filter("failed IS NULL").drop("failed")
    rows = good.select("*", F.posexplode(items).alias("position", "item")).drop(items)
    return rows.select(
        *stamp(),
        *[F.col(c) for c in rows.columns if c != "item"],
        "item.affected_package",
        "item.installed_version",
        "item.advisory_id",
        F.expr(url).alias("advisory_url"),
        "item.advisory_description",
        F.expr(UNKNOWN_CVSS).alias("cvss"),
    )


def bundler_findings(checked: DataFrame) -> DataFrame:
    """One row per block of checked reports, in block order."""
    return _explode(checked, "blocks", "item.url")


def safety_findings(checked: DataFrame) -> DataFrame:
    """One row per item of checked reports, before the CVE fan-out."""
    return _explode(checked, "items", text(ADVISORY_DB_URL))


def refused(checked: DataFrame) -> DataFrame:
    """Checked reports with an error."""
    bad = checked.filter("failed IS NOT NULL")
    return bad.selectExpr("parent_event_id", f"{error_struct('failed')} AS error")


def extract_bundler_findings(reports: DataFrame) -> DataFrame:
    """One row per block of the reports routed to ``bundler``, in block order."""
    return bundler_findings(checked_bundler_blocks(reports))


def extract_safety_findings(reports: DataFrame) -> DataFrame:
    """One row per finding of the reports routed to ``safety``, before the CVE fan-out."""
    return safety_findings(checked_safety_items(reports))


def rejected_bundler_reports(reports: DataFrame) -> DataFrame:
    return refused(checked_bundler_blocks(reports))


def rejected_safety_reports(reports: DataFrame) -> DataFrame:
    return refused(checked_safety_items(reports))


def explode_batch(messages: DataFrame, records: str = "records") -> DataFrame:
    """Messages that hold several records, as one row per record."""
    return messages.select(F.explode(records).alias("record")).select("record.*")
