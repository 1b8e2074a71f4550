"""Pieces every SQL expression builder uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text(value: str | None) -> str:
    """A string literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def let(name: str, value: str, use: Callable[[str], str]) -> str:
    """``use(name)`` with ``value`` computed once, however often ``use`` refers to it."""
    return f"get(transform(array({value}), {name} -> {use(name)}), 0)"


def cases(*arms: tuple[str, str], other: str = "NULL") -> str:
    """``CASE`` over (condition, result) pairs."""
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in arms) + f" ELSE {other} END"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def mapping(pairs: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{text(k)}, {v}" for k, v in pairs.items()) + ")"


def first_match(items: str, name: str, rule: Callable[[str], str]) -> str:
    """The first result of ``rule`` over an array that is not null."""
    return f"get(filter(transform({items}, {name} -> {rule(name)}), r -> r IS NOT NULL), 0)"


def with_computed(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with columns that are computed exactly once per row.

    A filter on a projected column is pushed below the projection, which repeats the
    column's whole expression at every mention. It is not pushed below a generator, so an
    explode of one element keeps parsing and matching from running again.
    """
    for name, value in columns.items():
        df = df.select("*", F.expr(f"explode(array({value}))").alias(name))
    return df
