"""Timestamps: strict RFC 3339 in, RFC 3339 out, feed dates, durations."""

from __future__ import annotations

from .sql import text

# Fixed value: the accepted wire form of an instant. Any number of fraction digits, offset
# hours 00-23 and minutes 00-59, second 60 allowed as a leap second.
RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?"
    r"([Zz]|[Uu][Tt][Cc]|[+-]([01]\d|2[0-3]):[0-5]\d)\z"
)


def parse_rfc3339(t: str) -> str:
    """UTC instant of an RFC 3339 text, or null when it is not one.

    Spark's own parser also takes texts without an offset and rejects offsets beyond 18
    hours, so the form is matched first and the offset is applied as an interval. Digits
    beyond microseconds are cut. Second 60 is the instant one second after 59.
    """
    leap = f"substr({t}, 18, 2) = '60'"
    local = (
        f"concat(substr({t}, 1, 10), 'T', substr({t}, 12, 6), if({leap}, '59', substr({t}, 18, 2)), "
        f"substr(regexp_extract({t}, {text(chr(92) + '.' + chr(92) + 'd+')}, 0), 1, 7), 'Z')"
    )
    offset = (
        f"if(substr({t}, -6, 1) IN ('+', '-'), "
        f"if(substr({t}, -6, 1) = '-', -1, 1) * (try_cast(substr({t}, -5, 2) AS INT) * 60 "
        f"+ try_cast(substr({t}, -2, 2) AS INT)), 0)"
    )
    shift = f"make_dt_interval(0, 0, -({offset}), if({leap}, 1, 0))"
    return f"if({t} RLIKE {text(RFC3339)}, try_to_timestamp({local}) + {shift}, NULL)"


def format_rfc3339(instant: str) -> str:
    """``2019-09-13T19:35:38+00:00``; 3 or 6 fraction digits only when they are needed."""
    micros = f"pmod(unix_micros({instant}), 1000000)"
    return (
        f"concat(date_format({instant}, \"yyyy-MM-dd'T'HH:mm:ss\"), "
        f"CASE WHEN {micros} = 0 THEN '' WHEN {micros} % 1000 = 0 THEN date_format({instant}, '.SSS') "
        f"ELSE date_format({instant}, '.SSSSSS') END, '+00:00')"
    )


def parse_published(t: str) -> str:
    """Feed publication dates: minutes and an offset but no seconds (``2019-09-13T19:35Z``)."""
    return f"coalesce(try_to_timestamp({t}, \"yyyy-MM-dd'T'HH:mmX\"), {parse_rfc3339(t)})"


def seconds_between(start: str, end: str) -> str:
    """Signed seconds from ``start`` to ``end`` with microsecond precision."""
    return f"(unix_micros({end}) - unix_micros({start})) / 1000000"


def nanos_between(start: str, end: str) -> str:
    return f"(unix_micros({end}) - unix_micros({start})) * 1000"
