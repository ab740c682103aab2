"""Canonical units: a table of prefixes and base units; unknown units stay as they are."""

from __future__ import annotations

from decimal import Decimal

UNIT_SYSTEM = "http://unitsofmeasure.org"
CURRENCY_SYSTEM = "urn:iso:std:iso:4217"
_PREFIX = {"k": 3, "h": 2, "da": 1, "d": -1, "c": -2, "m": -3, "u": -6, "n": -9, "p": -12, "M": 6, "G": 9}
_BASE = ("g", "m", "L", "l", "s", "mol", "Pa", "J", "W", "V", "K", "A", "Hz", "N")
_OTHER = {"min": ("s", Decimal(60)), "h": ("s", Decimal(3600)), "d": ("s", Decimal(86400)), "t": ("g", Decimal(10**6)), "[lb_av]": ("g", Decimal("453.59237")), "[in_i]": ("m", Decimal("0.0254"))}


def _build() -> dict[str, tuple[str, Decimal]]:
    table = {b: (b, Decimal(1)) for b in _BASE}
    for p, e in _PREFIX.items():
        for b in _BASE:
            table.setdefault(p + b, (b, Decimal(1).scaleb(e)))
    return table | _OTHER


UNITS = _build()


def canonical(value: Decimal | str | float, unit: str | None) -> tuple[Decimal, str | None]:
    """Value and code in base units: 100 mg is 0.100 g."""
    value = Decimal(str(value))
    if unit not in UNITS:
        return value, unit
    code, factor = UNITS[unit]
    return value * factor, code
