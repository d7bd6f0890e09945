"""Column expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL when the whole is empty."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when the whole is empty."""
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def half_even(column: Column, digits: int = 0) -> Column:
    return F.bround(column, digits)


def percent_text(column: Column) -> Column:
    return F.format_string("%.2f%%", column * 100.0)


def count_if(condition: Column) -> Column:
    """Rows where the condition holds, 0 for an empty group."""
    return F.coalesce(F.sum(condition.cast("int").cast("long")), F.lit(0).cast("long"))


def mean_if(value: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, value))
