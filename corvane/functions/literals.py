"""Search literals: implicit precision of numbers, ranges of partial dates, approximate bounds."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from functools import lru_cache

UTC = dt.timezone.utc
EPOCH = dt.datetime(1970, 1, 1, tzinfo=UTC)
APPROXIMATION = Decimal("0.1")
PREFIXES = ("eq", "ne", "gt", "ge", "lt", "le", "sa", "eb", "ap")
_DATE = re.compile(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?")
_TIME = re.compile(r"(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?")


def half_step(value: Decimal) -> Decimal:
    """Half a unit in the last written place; 5 for numbers written in tens or more (``1E+2``)."""
    exponent = value.as_tuple().exponent
    return Decimal(5) if exponent > 0 else Decimal("0.5").scaleb(exponent)


def number_bounds(literal: str | int | Decimal) -> tuple[float, float]:
    """``[low, high)`` that an unprefixed number stands for: ``100.00`` is [99.995, 100.005)."""
    value = Decimal(str(literal))
    step = half_step(value)
    return float(value - step), float(value + step)


def near_bounds(literal: str | int | Decimal) -> tuple[float, float]:
    """``[low, high]`` within a tenth of the value on either side."""
    value = Decimal(str(literal))
    room = abs(value * APPROXIMATION)
    return float(value - room), float(value + room)


def is_integer(literal: str | int | Decimal) -> bool:
    return Decimal(str(literal)).as_tuple().exponent >= 0


def _next_month(year: int, month: int) -> dt.date:
    return dt.date(year + month // 12, month % 12 + 1, 1)


@lru_cache(maxsize=1 << 14)  # documents repeat their dates
def day_range(literal: str) -> tuple[int, int]:
    """Inclusive epoch days of ``yyyy``, ``yyyy-MM`` or ``yyyy-MM-dd``; a time of day narrows to its day."""
    start, end = _day_bounds(literal)
    return (start - dt.date(1970, 1, 1)).days, (end - dt.date(1970, 1, 1)).days - 1


def _day_bounds(literal: str) -> tuple[dt.date, dt.date]:
    m = _DATE.fullmatch(literal)
    if not m:
        t = _TIME.fullmatch(literal)
        if not t:
            raise ValueError(f"not a date: {literal!r}")
        m = _DATE.fullmatch(t[1])
    year, month, day = int(m[1]), int(m[2] or 1), int(m[3] or 1)
    start = dt.date(year, month, day)
    end = start + dt.timedelta(days=1) if m[3] else _next_month(year, month) if m[2] else dt.date(year + 1, 1, 1)
    return start, end


@lru_cache(maxsize=1 << 14)
def milli_range(literal: str) -> tuple[int, int]:
    """Inclusive epoch milliseconds that a date or time literal covers at its own precision; no offset is UTC."""
    if _DATE.fullmatch(literal):
        start, end = day_range(literal)
        return start * 86_400_000, (end + 1) * 86_400_000 - 1
    t = _TIME.fullmatch(literal)
    if not t:
        raise ValueError(f"not a time: {literal!r}")
    zone = UTC
    if t[6] and t[6] != "Z":
        sign = 1 if t[6][0] == "+" else -1
        zone = dt.timezone(sign * dt.timedelta(hours=int(t[6][1:3]), minutes=int(t[6][4:6])))
    at = dt.datetime.fromisoformat(f"{t[1]}T{t[2]}:{t[3]}:{t[4] or '00'}").replace(tzinfo=zone)
    ms = (at - EPOCH) // dt.timedelta(milliseconds=1)
    if t[5]:
        ms += int(Decimal(t[5]) * 1000)
        return ms, ms
    return ms, ms + (999 if t[4] else 59_999)


def widened(start: int, end: int, now: int) -> tuple[int, int]:
    """A range made larger on both sides by a tenth of its distance from ``now`` (same unit), rounded half up."""
    by = lambda x: int((abs(Decimal(now - x)) * APPROXIMATION + Decimal("0.5")) // 1)
    return start - by(start), end + by(end)


def parse_token(text: str) -> tuple[str | None, str]:
    """``system|code`` or ``code``."""
    system, bar, code = text.partition("|")
    return (system, code) if bar else (None, text)


def parse_quantity(text: str) -> tuple[str, str | None, str | None]:
    """``value|system|unit``, ``value|unit`` or ``value``."""
    parts = text.split("|")
    if len(parts) == 1:
        return parts[0], None, None
    return (parts[0], None, parts[1]) if len(parts) == 2 else (parts[0], parts[1] or None, parts[2] or None)
