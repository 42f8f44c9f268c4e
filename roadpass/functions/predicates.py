"""Optional predicates: an absent parameter never filters, an absent field never matches.

They are plain comparisons of columns, so a filter made of them reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(field: Column, start: int | None, end: int | None, text: bool = False) -> Column:
    """``text`` says that the field is text, whose numbers are read first."""
    if start is None or end is None:
        return F.lit(True)
    if text:
        field = field.try_cast("bigint")
    return (field >= start) & (field <= end)


def one_of(field: Column, wanted: str | None) -> Column:
    """True when the field is a value of a comma list."""
    if wanted is None:
        return F.lit(True)
    return field.isin(wanted.split(","))


def overlaps(field: Column, wanted: str | None) -> Column:
    """True when two comma lists share a value; for fields that hold lists."""
    if wanted is None:
        return F.lit(True)
    values = [F.lit(v) for v in wanted.split(",")]
    return F.arrays_overlap(F.split(field, ","), F.array(*values))


def equals(field: Column, wanted: str | None) -> Column:
    if wanted is None:
        return F.lit(True)
    return field == F.lit(wanted)
