"""Text forms of single values."""

from __future__ import annotations

from .sql import struct, text

# White space of every kind, where ``trim`` cuts blanks only.
_END = r"[\p{IsWhite_Space}]+\z"
_BOTH = r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+\z"


def trim_end(t: str) -> str:
    return f"regexp_replace({t}, {text(_END)}, '')"


def trim_both(t: str) -> str:
    return f"regexp_replace({t}, {text(_BOTH)}, '')"


def split_trimmed(t: str, separator: str = ",") -> str:
    return f"transform(split({t}, {text(separator)}), s -> {trim_both('s')})"


def branch_text(branch: str) -> str:
    return f"coalesce({branch}, 'Not Provided')"


def tool_version_text(version: str) -> str:
    return f"coalesce({version}, '')"


def cvss_text(cvss: str) -> str:
    """``Unknown`` or ``V3(7.5)``; a whole score prints without a fraction."""
    whole = text(r"\.0\z")
    digits = f"regexp_replace(CAST({cvss}.score AS STRING), {whole}, '')"
    return (
        f"if({cvss}.version = 'Unknown', 'Unknown', concat({cvss}.version, '(', {digits}, ')'))"
    )


def cvss_struct(version: str, score: str) -> str:
    return struct(version=version, score=f"CAST({score} AS FLOAT)")


UNKNOWN_CVSS = cvss_struct("'Unknown'", "NULL")


def choose_cvss(v3_score: str, v2_score: str) -> str:
    """Version 3 score if there is one, else version 2, else unknown."""
    version = (
        f"CASE WHEN {v3_score} IS NOT NULL THEN 'V3' WHEN {v2_score} IS NOT NULL THEN 'V2' "
        "ELSE 'Unknown' END"
    )
    return cvss_struct(version, f"coalesce({v3_score}, {v2_score})")
