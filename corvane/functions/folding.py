"""Case folding of ASCII letters only, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = str.maketrans(UPPER, LOWER)


def fold(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def fold_text(text: str) -> str:
    return text.translate(_TABLE)
