"""Numeric column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as a number, as a coercing numeric parser accepts it: optional
# sign, digits with an optional fraction, optional exponent, or inf/infinity/nan,
# with surrounding blanks. Anything else (e.g. '1d', '1,000', '0x10', '') is missing.
NUMERIC_TEXT = (r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
                r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$")

# Money is summed as decimals: each line is rounded half up to MONEY_DIGITS decimals,
# so totals do not depend on summation order.
MONEY_DIGITS = 4


def nan_to_null(c: Column) -> Column:
    """NaN becomes NULL so that every later filter and aggregate sees one missing marker.
    (``nanvl`` names the input once, so a pushed-down filter does not repeat it.)"""
    return F.nanvl(c, F.lit(None).cast("double"))


def coerce_double(c: Column, dtype: str = "string") -> Column:
    """Text or number to double; text that is not a number, and NaN, become NULL. A ``dtype`` that is a
    number already is not parsed (and so can be pushed into a scan)."""
    if dtype in ("double", "float"):
        return c.cast("double")  # NaN is told apart by the filters that follow
    if dtype in ("tinyint", "smallint", "int", "bigint") or dtype.startswith("decimal"):
        return c.cast("double")
    as_text = c.cast("string")
    parsed = F.when(as_text.rlike(NUMERIC_TEXT), as_text.try_cast("double"))
    return nan_to_null(parsed)


def money_sum(c: Column, digits: int = MONEY_DIGITS) -> Column:
    """Order-independent exact sum of a money column, each value rounded half up to ``digits`` decimals; returned as
    double. Infinity, NaN and amounts of 10^(18 - digits) or more fail the query instead of being clamped."""
    return money_total(c, digits).cast("double")


def money_total(c: Column, digits: int = MONEY_DIGITS) -> Column:
    """The decimal behind ``money_sum``, to be added up further."""
    kind = f"decimal(18,{digits})"
    exact = c.try_cast(kind)
    amount = F.when(c.isNull() | exact.isNotNull(), exact).otherwise(
        F.raise_error(F.concat(F.lit(f"not a money amount ({kind}): "), c.cast("string"))))
    return F.sum(amount)


def round_stat(c: Column, digits: int = 6) -> Column:
    """Presentation rounding of floating statistics (means, deviations)."""
    return F.round(c, digits)
