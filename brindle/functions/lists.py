"""List functions: null lists stay null, indexes may be negative, out of bounds is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.numeric import is_integer


def length(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(c)).cast("bigint")


def get(c: Column, index: int) -> Column:
    return F.get(c, F.lit(index)) if index >= 0 else F.try_element_at(c, F.lit(index))


def contains(c: Column, value: object) -> Column:
    return F.when(c.isNotNull(), F.coalesce(F.array_contains(c, value), F.lit(False)))


def join(c: Column, separator: str) -> Column:
    return F.array_join(c, separator)


def total(c: Column, dtype: T.DataType | None = None) -> Column:
    """Sum of what isn't null, 0 for an empty list; integers add up as long, in which overflow raises."""
    kind = "bigint" if dtype is not None and is_integer(dtype.elementType) else "double"
    zero = F.lit(0).cast(kind)
    return F.aggregate(c, zero, lambda a, x: a + F.coalesce(x.cast(kind), zero))


def mean(c: Column, dtype: T.DataType | None = None) -> Column:
    known = F.filter(c, lambda x: x.isNotNull())
    n = F.size(known)
    return F.when(n > 0, total(F.transform(known, lambda x: x.cast("double"))) / n)


def smallest(c: Column) -> Column:
    return F.array_min(c)


def largest(c: Column) -> Column:
    return F.array_max(c)
