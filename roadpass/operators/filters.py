"""Row filters over passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpass.functions import predicates as P
from roadpass.operators.skew import bounded_broadcast

IN_LIST_LIMIT = 200


def date_range(passes: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Inclusive range on ``date``; reaches the scan as a partition or pushed filter."""
    if start is not None:
        passes = passes.where(F.col("date") >= start)
    if end is not None:
        passes = passes.where(F.col("date") <= end)
    return passes


# Texts that cameras log when they could not read a plate.
UNREAD_PLATES = ("", "-", "0", "00000000", "unknown", "UNKNOWN", "null", "NULL")


def readable_plates(passes: DataFrame) -> DataFrame:
    """Passes whose plate was read. All unread ones would look like a single car that is
    everywhere, and would meet in one group; ``unread_passes`` counts them."""
    return passes.where(F.col("car").isNotNull() & ~F.trim("car").isin(*UNREAD_PLATES))


def unread_passes(passes: DataFrame) -> DataFrame:
    """(date, unread): passes without a readable plate per day, days without one left out."""
    unread = F.col("car").isNull() | F.trim("car").isin(*UNREAD_PLATES)
    return passes.where(unread).groupBy("date").agg(F.count("*").alias("unread"))


def for_cars(passes: DataFrame, cars: Sequence[str]) -> DataFrame:
    """Passes of the listed cars. Short lists become a pushed IN filter, longer ones a semi join."""
    if len(cars) <= IN_LIST_LIMIT:
        return passes.where(F.col("car").isin(list(cars)))
    wanted = passes.sparkSession.createDataFrame([(c,) for c in set(cars)], "car string")
    return passes.join(bounded_broadcast(wanted, len(cars)), "car", "left_semi")


def at_monitors(passes: DataFrame, monitors: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Passes at the given monitors; ``max_rows`` is the proven size of the list, if any."""
    wanted = bounded_broadcast(monitors.select("monitor_id"), max_rows)
    return passes.join(wanted, "monitor_id", "left_semi")


def search(
    passes: DataFrame,
    start: str | None = None,
    end: str | None = None,
    ranges: Mapping[str, tuple[int | None, int | None]] | None = None,
    any_of: Mapping[str, str | None] | None = None,
    equal: Mapping[str, str | None] | None = None,
    shared: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Multi-attribute search: optional range, list and equality conditions, all of
    which must hold. A condition whose parameter is None does not filter. ``any_of`` is
    for single values, ``shared`` for columns that hold comma lists themselves."""
    kinds = dict(passes.dtypes)
    conds = [P.in_range(F.col(c), lo, hi, kinds[c] == "string") for c, (lo, hi) in (ranges or {}).items()]
    conds += [P.one_of(F.col(c), wanted) for c, wanted in (any_of or {}).items()]
    conds += [P.overlaps(F.col(c), wanted) for c, wanted in (shared or {}).items()]
    conds += [P.equals(F.col(c), wanted) for c, wanted in (equal or {}).items()]
    return date_range(passes, start, end).where(reduce(and_, conds, F.lit(True)))


def cars_in_range(passes: DataFrame, start: str | None, end: str | None, cars: Sequence[str]) -> DataFrame:
    """Passes of the listed cars in a date range; both conditions reach the scan."""
    return for_cars(date_range(passes, start, end), cars)
