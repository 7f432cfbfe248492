"""IEEE rules on columns: NaN compares false, undefined quotients are NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def nan() -> Column:
    return F.lit(float("nan"))


def gt(a: Column, b: Column) -> Column:
    """a > b, false where either is NaN (Spark alone takes NaN for the largest)."""
    return (a > b) & ~F.isnan(a)


def eq(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a)


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or the quotient is undefined."""
    return F.try_divide(a, b)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")
