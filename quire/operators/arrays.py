"""Arrays of one row: values made once, places, parts and medians as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used.

    It is a fold over nothing, as a fold hands on its value as it is; transform would copy what comes out, deeply.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


def median(values: Column) -> Column:
    """The exact median of an array's values; null if there are none."""

    def middle(v: Column) -> Column:
        return F.when(F.size(v) > 0, (F.get(v, F.shiftright(F.size(v) - 1, 1)) + F.get(v, F.shiftright(F.size(v), 1))) / 2)

    return let(F.sort_array(F.filter(values, lambda v: v.isNotNull())), middle)


def places(whole: Column, where: Callable[[Column], Column]) -> Column:
    """Places in an array, from 0, for which `where` holds; null if it is empty."""
    return F.filter(F.when(F.size(whole) > 0, F.sequence(F.lit(0), F.size(whole) - 1)), where)


def parts(whole: Column, starts: Column) -> Column:
    """An array cut at these places."""
    return F.transform(starts, lambda s, i: F.slice(whole, s + 1, F.coalesce(F.get(starts, i + 1), F.size(whole)) - s))
