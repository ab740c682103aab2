"""Filter criteria and their compilation to Spark predicates."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.folding import fold, fold_text
from corvane.functions.literals import PREFIXES, day_range, is_integer, milli_range, near_bounds, number_bounds, widened
from corvane.functions.units import UNIT_SYSTEM, canonical
from corvane.operators.catalogue import Kind


class Modifier(Enum):
    STARTS_WITH = "starts_with"
    EXACT = "exact"
    CONTAINS = "contains"


@dataclass(frozen=True)
class Text:
    value: str
    modifier: Modifier = Modifier.STARTS_WITH


@dataclass(frozen=True)
class Token:
    code: str
    system: str | None = None


@dataclass(frozen=True)
class Reference:
    value: str


@dataclass(frozen=True)
class Uri:
    value: str


@dataclass(frozen=True)
class Number:
    literal: str
    prefix: str = "eq"


@dataclass(frozen=True)
class Quantity:
    literal: str
    prefix: str = "eq"
    system: str | None = None
    unit: str | None = None


@dataclass(frozen=True)
class Date:
    """A date or time literal at any precision; ``now`` (ISO) is the clock of ``ap``."""

    literal: str
    prefix: str = "eq"
    now: str | None = None


Criterion = Text | Token | Reference | Uri | Number | Quantity | Date


def token_of(value: object) -> list[Token]:
    """Tokens of a plain value or of a coding, concept or identifier given as a dict."""
    if isinstance(value, Token):
        return [value]
    if isinstance(value, bool):
        return [Token("true" if value else "false")]
    if isinstance(value, str):
        return [Token(value)]
    if isinstance(value, dict):
        if "coding" in value:
            return [t for c in value["coding"] for t in token_of(c)]
        if "code" in value:
            return [Token(value["code"], value.get("system"))]
        if "value" in value:
            return [Token(value["value"], value.get("system"))]
    raise ValueError(f"no token in {value!r}")


def contact_token(value: str, use: str | None = None) -> Token:
    """A contact point is indexed under its use, not its system."""
    return Token(value, use)


@dataclass(frozen=True)
class Cells:
    """Columns of an index row. ``point`` is a date column itself, ``raw`` an id of type ``target``: predicates on them reach the scan."""

    value: Column | None = None
    system: Column | None = None
    code: Column | None = None
    low: Column | None = None
    high: Column | None = None
    point: Column | None = None
    target: str | None = None
    raw: Column | None = None


def _known(prefix: str) -> str:
    if prefix not in PREFIXES:
        raise ValueError(f"unknown prefix {prefix!r}")
    return prefix


def number_predicate(value: Column, literal: str | Decimal, prefix: str) -> Column:
    at = float(Decimal(str(literal)))
    if _known(prefix) in ("sa", "eb") and is_integer(literal):
        raise ValueError(f"{prefix} is not defined for the integer {literal}")
    if prefix in ("gt", "sa"):
        return value > at
    if prefix in ("lt", "eb"):
        return value < at
    if prefix == "ge":
        return value >= at
    if prefix == "le":
        return value <= at
    if prefix == "ap":
        low, high = near_bounds(literal)
        return (value >= low) & (value <= high)
    low, high = number_bounds(literal)
    return (value >= low) & (value < high) if prefix == "eq" else (value < low) | (value >= high)


def range_predicate(low: Column, high: Column, start: int, end: int, prefix: str) -> Column:
    """An indexed inclusive range against a literal's inclusive range."""
    inside = low.between(start, end) & high.between(start, end)
    return {
        "eq": inside, "ap": inside, "ne": ~inside, "gt": high > end, "ge": high >= start,
        "lt": low < start, "le": low <= end, "sa": low > end, "eb": high < start,
    }[_known(prefix)]


def point_predicate(at: Column, start: dt.datetime, stop: dt.datetime, prefix: str) -> Column:
    """A column of instants against ``[start, stop)``; plain comparisons, so that they are pushed to the scan."""
    a, b = (F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") for x in (start, stop))
    return {
        "eq": (at >= a) & (at < b), "ap": (at >= a) & (at < b), "ne": (at < a) | (at >= b), "gt": at >= b,
        "ge": at >= a, "lt": at < a, "le": at < b, "sa": at >= b, "eb": at < a,
    }[_known(prefix)]


def _instant(days: int = 0, millis: int = 0) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(days=days, milliseconds=millis)


def date_bounds(c: Date, kind: Kind) -> tuple[int, int]:
    """The literal's inclusive range in the unit of the indexed kind, widened for ``ap``."""
    unit = day_range if kind is Kind.DATE else milli_range
    start, end = unit(c.literal)
    if c.prefix != "ap":
        return start, end
    now = c.now or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return widened(start, end, unit(now)[0])


def predicate(kind: Kind, cells: Cells, c: Criterion) -> Column:
    """The predicate of one criterion over an index row of the given kind."""
    if isinstance(c, Text) and kind is Kind.STRING:
        if c.modifier is Modifier.EXACT:
            return cells.value == c.value
        folded = fold(cells.value)
        return folded.startswith(fold_text(c.value)) if c.modifier is Modifier.STARTS_WITH else folded.contains(fold_text(c.value))
    if isinstance(c, Token) and kind is Kind.TOKEN:
        hit = cells.value == c.code
        return hit & (F.coalesce(cells.system, F.lit("")) == c.system) if c.system and c.system.strip() else hit
    if isinstance(c, Reference) and kind is Kind.REFERENCE and cells.raw is not None:
        to, _, key = c.value.rpartition("/")
        if to != cells.target:
            return F.lit(False) & cells.raw.isNotNull()
        return cells.raw == int(key) if key.isdigit() else cells.raw.cast("string") == key
    if (isinstance(c, Reference) and kind is Kind.REFERENCE) or (isinstance(c, Uri) and kind is Kind.URI):
        return cells.value == c.value
    if isinstance(c, Number) and kind is Kind.NUMBER:
        return number_predicate(cells.value, c.literal, c.prefix)
    if isinstance(c, Quantity) and kind is Kind.QUANTITY:
        literal, unit = (canonical(c.literal, c.unit) if c.system == UNIT_SYSTEM and c.unit else (Decimal(c.literal), c.unit))
        hit = number_predicate(cells.value, literal, c.prefix)
        if c.system:
            hit = (cells.system == c.system) & hit
        return (cells.code == unit) & hit if unit else hit
    if isinstance(c, Date) and kind in (Kind.DATE, Kind.DATETIME):
        start, end = date_bounds(c, kind)
        if cells.point is not None:
            a, b = (_instant(days=start), _instant(days=end + 1)) if kind is Kind.DATE else (_instant(millis=start), _instant(millis=end + 1))
            return point_predicate(cells.point, a, b, c.prefix)
        return range_predicate(cells.low, cells.high, start, end, c.prefix)
    raise ValueError(f"{type(c).__name__} does not apply to a {kind.value} parameter")
