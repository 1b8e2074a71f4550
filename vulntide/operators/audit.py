"""Structured log records of handled requests, as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import text
from ..functions.times import nanos_between


def nested(fields: dict[str, str]) -> str:
    """Struct tree of dotted keys. A branch without any value is null, so it prints nothing.

    ``{"a.b": x}`` becomes ``{"a": {"b": x}}``, its keys in order.
    """
    tree: dict = {}
    for key, value in fields.items():
        *path, leaf = key.split(".")
        here = tree
        for name in path:
            here = here.setdefault(name, {})
        here[leaf] = value

    def build(node: dict) -> tuple[str, list[str]]:
        columns, filled = [], []
        for name in sorted(node):
            child = node[name]
            column, values = build(child) if isinstance(child, dict) else (child, [child])
            columns.append(f"'{name}', {column}")
            filled += values
        some = f"coalesce({', '.join(f'({v}) IS NOT NULL OR NULL' for v in filled)}, false)"
        return f"if({some}, named_struct({', '.join(columns)}), NULL)", filled

    return build(tree)[0]


def nested_json(fields: dict[str, str]) -> str:
    """JSON text of :func:`nested`; null values are left out."""
    return f"to_json({nested(fields)})"


def fold_pairs(pairs: DataFrame, record: str, order: str, columns: dict[str, str]) -> DataFrame:
    """Long (record, key, value) rows to one nested JSON per record.

    ``columns`` names the known keys and their types. On a repeated key the first value by
    ``order`` counts; the aggregate combines on the map side.
    """
    picked = [
        F.min(
            F.when(
                (F.col("key") == key) & F.col("value").isNotNull(),
                F.struct(F.col(order), F.col("value")),
            )
        )
        .getField("value")
        .cast(kind)
        .alias(key.replace(".", "__"))
        for key, kind in columns.items()
    ]
    flat = pairs.groupBy(record).agg(*picked)
    fields = {key: key.replace(".", "__") for key in columns}
    return flat.selectExpr(record, f"coalesce({nested_json(fields)}, 'null') AS line")


def logged(requests: DataFrame, excluded: list[str]) -> DataFrame:
    """Requests to log. An excluded path is logged only when its service call failed."""
    return requests.filter(F.col("service_failed") | ~F.col("path").isin(*excluded))


_FAILED = "(service_failed OR error_message IS NOT NULL)"


def _answered(value: str) -> str:
    return f"if(service_failed, NULL, {value})"


def _second(instant: str) -> str:
    return f"date_format({instant}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


# The log record's keys, with where each comes from.
AUDIT_FIELDS = {
    "http.version": "http_version",
    "url.domain": "host",
    "source.ip": "source_ip",
    "user_agent.original": "user_agent",
    "http.request.method": "method",
    "http.request.body.bytes": "octet_length(request_body)",
    "http.request.body.content": "request_body",
    "http.response.body.bytes": _answered("octet_length(response_body)"),
    "http.response.body.content": _answered("response_body"),
    "http.response.status_code": _answered("CAST(status AS STRING)"),
    "url.path": "path",
    "url.query": "concat('?', coalesce(query, ''))",
    "event.start": _second("event_start"),
    "event.end": _second("event_end"),
    "event.duration": nanos_between("event_start", "event_end"),
    "event.type": f"if({_FAILED}, array('access', 'error'), array('access'))",
    "error.code": f"if({_FAILED}, coalesce(error_code, 0), NULL)",
    "error.message": f"if({_FAILED}, error_message, NULL)",
    "transaction.id": "transaction_id",
    "event.id": "event_id",
}


# The part of each record that is the same for all.
AUDIT_CONSTANTS = {
    "@timestamp": _second("event_end"),
    "log.level": f"if({_FAILED}, 'ERRO', 'INFO')",
    "message": text("HTTP request handled"),
    "ecs.version": text("1.5"),
    "event.kind": text("event"),
    "event.category": text("web"),
}


def audit_lines(
    requests: DataFrame,
    excluded: tuple[str, ...] = ("/health",),
    service_name: str = "intake",
    service_type: str = "vulntide",
    service_version: str = "0.1.0",
) -> DataFrame:
    """One JSON line per request, under the name, type and version of the service.

    A failed service call has no response part; a request with an error has an error part,
    code 0 when the error carries none.
    """
    service = {"name": service_name, "type": service_type, "version": service_version}
    named = {f"service.{key}": text(value) for key, value in service.items()}
    line = f"{nested_json(AUDIT_FIELDS | AUDIT_CONSTANTS | named)} AS line"
    return logged(requests, list(excluded)).selectExpr("event_id", line)
