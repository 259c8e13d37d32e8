"""Millisecond and microsecond axes, durations, and instants as text. Naive instants are UTC."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}
#: Texts that stand for no limit.
_NONE = {"", "none", "off", "0", "false", "all"}


def to_ms(ts: Column) -> Column:
    """Milliseconds since the epoch, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))


def to_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def iso_ms(ts: Column) -> Column:
    """2024-01-31T23:59:59.123Z (session time zone UTC)."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def duration_text(us: Column) -> Column:
    """Days and clock time: 3d 04:05:06."""
    s = F.floor(us / 1_000_000)
    return F.format_string("%dd %02d:%02d:%02d", F.floor(s / 86_400), F.floor(s / 3_600) % 24, F.floor(s / 60) % 60, s % 60)


def parse_duration(text: str | None) -> timedelta | None:
    """``90s``, ``15m``, ``1.5h``, ``2d``; None for texts that mean no limit."""
    text = (text or "").strip().lower()
    if text in _NONE:
        return None
    found = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([dhms])", text)
    if not found or float(found[1]) <= 0:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(**{_UNITS[found[2]]: float(found[1])})


def format_duration(delta: timedelta) -> str:
    """The largest unit that divides a duration: 2d, 36h, 90s."""
    seconds = int(delta.total_seconds())
    for unit, size in (("d", 86_400), ("h", 3_600), ("m", 60)):
        if seconds and seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"


def parse_instant(text: str) -> datetime:
    """ISO text to an aware UTC instant in milliseconds; text without a zone is UTC."""
    value = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    value = value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)
    return value.replace(microsecond=value.microsecond // 1000 * 1000)


def parse_list(text: str | None) -> list[str]:
    """Comma-separated names, blanks dropped."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]
