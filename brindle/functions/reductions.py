"""Reductions: aggregates with defined results for nothing, null and NaN.

Each function takes the columns of the rows and returns a Column. ``w`` is put around every
aggregate in it: nothing in a group, ``over(partition)`` in a window, so one form serves
whole tables, groups and windows. ``order`` is a column that gives the rows' order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.numeric import NAN, is_float, is_integer

Wrap = Callable[[Column], Column]


def plain(aggregate: Column) -> Column:
    return aggregate


def total(c: Column, dtype: T.DataType, min_count: int = 0, w: Wrap = plain) -> Column:
    """0 for nothing; exact for integers in any order, with overflow checked at the end."""
    if isinstance(dtype, T.BooleanType):
        s = F.coalesce(w(F.count_if(c)), F.lit(0))
    elif is_integer(dtype):
        s = F.coalesce(_exact_sum(c, dtype, w), F.lit(0)).cast("int" if isinstance(dtype, T.IntegerType) else "bigint")
    else:
        s = F.coalesce(w(F.sum(c)), F.lit(0).cast(dtype))
    return F.when(w(F.count(c)) >= min_count, s) if min_count else s


def _exact_sum(c: Column, dtype: T.DataType, w: Wrap) -> Column:
    """Sums of the low, middle and high bits, put together at the end: long sums that no order of up to 2^41 rows overflows."""
    x = c.cast("bigint")
    if isinstance(dtype, (T.ByteType, T.ShortType)):
        return w(F.sum(x))
    cuts = [0, 16] if isinstance(dtype, T.IntegerType) else [0, 21, 42]
    out = None
    for at, end in zip(cuts, [*cuts[1:], None], strict=True):
        part = F.shiftright(x, at) if at else x
        part = part if end is None else part.bitwiseAND(F.lit((1 << (end - at)) - 1))
        scaled = w(F.sum(part)).cast("decimal(38,0)") * F.lit(1 << at).cast("decimal(16,0)") if at else w(F.sum(part)).cast("decimal(38,0)")
        scaled = scaled.cast("decimal(38,0)")
        out = scaled if out is None else (out + scaled).cast("decimal(38,0)")
    return out


def product(c: Column, dtype: T.DataType, w: Wrap = plain) -> Column:
    """1 for nothing; integers exactly, overflow raises.

    Only factors other than 0, 1 and -1 are held: 64 of them overflow.
    """
    if is_integer(dtype):
        x = c.cast("bigint")
        sign = F.when(w(F.count_if(x == -1)) % 2 == 1, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
        held = F.aggregate(w(F.collect_list(F.when((x > 1) | (x < -1), x))), sign, lambda x, y: x * y)
        return F.when(w(F.count_if(x == 0)) > 0, F.lit(0).cast("bigint")).otherwise(held)
    return F.coalesce(w(F.product(c.cast("double"))), F.lit(1.0))


def smallest(c: Column, dtype: T.DataType, w: Wrap = plain) -> Column:
    """Skips NaN unless only NaN is there."""
    return F.coalesce(w(F.min(F.when(~F.isnan(c), c))), w(F.min(c))) if is_float(dtype) else w(F.min(c))


def largest(c: Column, dtype: T.DataType, w: Wrap = plain) -> Column:
    return F.coalesce(w(F.max(F.when(~F.isnan(c), c))), w(F.max(c))) if is_float(dtype) else w(F.max(c))


def at_end(c: Column, order: Column, last: bool, ignore_nulls: bool = False, w: Wrap = plain) -> Column:
    """The first or last value in order, null ones too unless ignored."""
    place = F.when(c.isNotNull(), order) if ignore_nulls else order
    return w((F.max_by if last else F.min_by)(F.struct(c.alias("v")), place)).getField("v")


def n_unique(c: Column, ignore_nulls: bool = False, w: Wrap | None = None) -> Column:
    """Null counts once; windows have no distinct counts and use a set."""
    n = F.count_distinct(c) if w is None else F.size(w(F.collect_set(c))).cast("bigint")
    wrap = w or plain
    return n if ignore_nulls else n + F.coalesce(wrap(F.max(F.when(c.isNull(), 1))), F.lit(0))


def variance(c: Column, ddof: int = 1, root: bool = False, w: Wrap = plain) -> Column:
    x = c.cast("double")
    n = w(F.count(x))
    out = F.when(n > ddof, w(F.var_pop(x)) * n / (n - ddof))
    return F.sqrt(out) if root else out


#: Where between 0 and the last place an interpolation looks: one place, or two whose values' mean counts.
QUANTILE_PLACES = {"lower": [F.floor], "higher": [F.ceil], "nearest": [lambda at: F.floor(at + 0.5)], "midpoint": [F.floor, F.ceil]}


def quantile(c: Column, q: float, interpolation: str = "nearest", w: Wrap = plain) -> Column:
    """Exact, over values that aren't null; NaN counts as largest. Other than linear ones sort a list of the values."""
    x = c.cast("double")
    if interpolation == "linear":
        return w(F.percentile(x, F.lit(float(q))))
    if interpolation not in QUANTILE_PLACES:
        raise ValueError(f"no interpolation {interpolation!r}")
    values = F.sort_array(w(F.collect_list(x)))
    found = [F.get(values, f((F.size(values) - 1) * F.lit(float(q))).cast("int")) for f in QUANTILE_PLACES[interpolation]]
    return F.when(F.size(values) > 0, found[0] if len(found) == 1 else (found[0] + found[1]) / 2)


def any_true(c: Column, ignore_nulls: bool = True, w: Wrap = plain) -> Column:
    out = F.coalesce(w(F.bool_or(c)), F.lit(False))
    return out if ignore_nulls else F.when(out, True).when(w(F.count_if(c.isNull())) > 0, None).otherwise(False)


def all_true(c: Column, ignore_nulls: bool = True, w: Wrap = plain) -> Column:
    out = F.coalesce(w(F.bool_and(c)), F.lit(True))
    return out if ignore_nulls else F.when(~out, False).when(w(F.count_if(c.isNull())) > 0, None).otherwise(True)


def ordered_list(c: Column, order: Column, keep: Column | None = None, w: Wrap = plain) -> Column:
    """All values in order, nulls too."""
    held = F.struct(order.alias("o"), c.alias("v"))
    return F.transform(F.sort_array(w(F.collect_list(F.when(keep, held) if keep is not None else held))), lambda x: x["v"])


def value_runs(values: Column) -> Column:
    """Per distinct value of a list, null among them: v, its count n and its first place i, by value.

    Equal values are neighbours once sorted; a run ends where the next one begins. n log n.
    """
    placed = F.sort_array(F.transform(values, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))
    count = F.size(placed)
    shifted = F.concat(F.array(F.lit(None).cast("int")), F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))))
    before = F.concat(F.slice(placed, F.lit(1), F.least(count, F.lit(1))), F.slice(placed, F.lit(1), F.greatest(count - 1, F.lit(0))))
    zipped = F.arrays_zip(placed.alias("x"), before.alias("b"), F.slice(shifted, F.lit(1), count).alias("k"))
    starts = F.filter(zipped, lambda z: z["k"].isNull() | ~z["x"]["v"].eqNullSafe(z["b"]["v"]))
    starts = F.transform(starts, lambda z: F.struct(F.coalesce(z["k"], F.lit(0)).alias("at"), z["x"]["v"].alias("v"), z["x"]["i"].alias("i")))
    ends = F.concat(F.transform(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), lambda z: z["at"]), F.array(count))
    runs = F.zip_with(starts, ends, lambda z, end: F.struct((end - z["at"]).alias("n"), z["v"].alias("v"), z["i"].alias("i")))
    return F.when(count > 0, runs).otherwise(F.slice(runs, F.lit(1), F.lit(0)))


def mode(runs: Column) -> Column:
    """All most frequent values of runs (n, v), ascending, null among them."""
    # Runs and the largest count are put in a struct first: a lambda computes what it names anew for every element.
    most = F.transform(F.array(F.struct(runs.alias("r"), F.array_max(F.transform(runs, lambda r: r["n"])).alias("n"))), lambda s: F.transform(F.filter(s["r"], lambda r: r["n"] == s["n"]), lambda r: r["v"]))
    return F.sort_array(most[0])


def skewness(c: Column, bias: bool = True, w: Wrap = plain) -> Column:
    x, n = c.cast("double"), w(F.count(c))
    g = F.coalesce(w(F.skewness(x)), F.when(n > 0, F.lit(NAN)))
    return g if bias else F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: Column, fisher: bool = True, bias: bool = True, w: Wrap = plain) -> Column:
    x, n = c.cast("double"), w(F.count(c))
    g = F.coalesce(w(F.kurtosis(x)), F.when(n > 0, F.lit(NAN)))
    if not bias:
        g = F.when(n > 3, ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return g if fisher else g + 3


def correlation(a: Column, b: Column, w: Wrap = plain) -> Column:
    """Of the pairs without null; NaN for fewer than two."""
    return F.coalesce(w(F.corr(a.cast("double"), b.cast("double"))), F.lit(NAN))


def covariance(a: Column, b: Column, ddof: int = 1, w: Wrap = plain) -> Column:
    """Null without pairs, 0 where there are no more than ``ddof``."""
    n = w(F.count_if(a.isNotNull() & b.isNotNull()))
    return F.when(n > ddof, w(F.covar_pop(a.cast("double"), b.cast("double"))) * n / (n - ddof)).when(n > 0, F.lit(0.0))


def value_at_extreme(c: Column, keys: list[Column], order: Column, largest_key: bool, w: Wrap = plain) -> Column:
    """The value in the row with the extreme key; the first row wins ties, null keys don't count."""
    valid = keys[0].isNotNull()
    for k in keys[1:]:
        valid = valid & k.isNotNull()
    rank = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], (-order if largest_key else order).alias("o"))
    return w((F.max_by if largest_key else F.min_by)(F.struct(c.alias("v")), F.when(valid, rank))).getField("v")


def position_of_extreme(c: Column, order: Column, largest_value: bool, dtype: T.DataType, w: Wrap = plain) -> Column:
    """The 0-based place of the first extreme value among all rows of the group."""
    values = ordered_list(c, order, w=w)
    real = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)) if is_float(dtype) else F.filter(values, lambda x: x.isNotNull())
    at = F.array_position(values, F.array_max(real) if largest_value else F.array_min(real))
    return F.when(at > 0, at - 1)


def place_of_extreme(c: Column, place: Column, largest_value: bool, dtype: T.DataType, w: Wrap = plain) -> Column:
    """position_of_extreme() where rows know their places: no list of the values."""
    known = c.isNotNull() & ~F.isnan(c) if is_float(dtype) else c.isNotNull()
    rank = F.when(known, F.struct(c.alias("v"), (-place if largest_value else place).alias("o")))
    return w((F.max_by if largest_value else F.min_by)(place, rank))


def join_strings(c: Column, separator: str, order: Column, ignore_nulls: bool = True, w: Wrap = plain) -> Column:
    out = F.array_join(ordered_list(c.cast("string"), order, w=w), separator)
    return out if ignore_nulls else F.when(w(F.count_if(c.isNull())) == 0, out)
