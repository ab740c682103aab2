from decimal import Decimal

import pytest

from corvane.functions.literals import day_range, milli_range, near_bounds, number_bounds, parse_quantity, parse_token, widened
from corvane.functions.units import canonical


@pytest.mark.parametrize(("literal", "low", "high"), [("100.00", 99.995, 100.005), ("100.0", 99.95, 100.05), ("0.1", 0.05, 0.15), ("100", 99.5, 100.5), ("1E+2", 95, 105), ("5.403", 5.4025, 5.4035)])
def test_number_bounds(literal, low, high):
    assert number_bounds(literal) == (low, high)


def test_near_bounds_of_negative_numbers_are_not_empty():
    assert near_bounds("-100") == (-110.0, -90.0)


def test_ranges():
    assert day_range("1970") == (0, 364) and day_range("1970-02") == (31, 58) and day_range("1970-01-02") == (1, 1)
    assert milli_range("2013-03-14") == (1363219200000, 1363305599999)
    assert milli_range("1970-01-01T00:00:01Z") == (1000, 1999)
    assert milli_range("1970-01-01T00:00:01.5Z") == (1500, 1500)
    assert milli_range("1970-01-01T02:00+02:00") == (0, 59999)
    assert day_range("1970-01-03T10:00:00Z") == (2, 2)
    for bad in ("70", "1970-13", "1970-01-01T", "x"):
        with pytest.raises(ValueError):
            milli_range(bad)


def test_widened_rounds_half_up():
    assert widened(0, 10, 105) == (-11, 20)


def test_parsing_and_units():
    assert parse_token("s|c") == ("s", "c") and parse_token("c") == (None, "c") and parse_token("|c") == ("", "c")
    assert parse_quantity("5.4|sys|g") == ("5.4", "sys", "g") and parse_quantity("5|g") == ("5", None, "g") and parse_quantity("5") == ("5", None, None)
    assert canonical("100", "mg") == (Decimal("0.100"), "g") and canonical("7", "randomUnit") == (Decimal(7), "randomUnit")
