"""Runnable queries over the test tables, one or more per operator, with SQL twins."""

from . import analysis, findings, intake, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
