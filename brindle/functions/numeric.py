"""Arithmetic, comparison and conditional rules where Spark's defaults differ.

Comparisons follow IEEE for NaN, x / 0 is an infinity or NaN, integer division floors, null
is never confused with NaN, and logarithms of numbers that have none give -inf or NaN.
Everything is a composition of built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN = float("nan")
INF = float("inf")


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def compare(op: str, a: Column, b: Column, floats: bool) -> Column:
    """``a op b``; with floats a NaN on either side is unequal to everything."""
    plain = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if not floats:
        return plain
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.isnan(a) | F.isnan(b), F.lit(op == "!=")).otherwise(plain)


def compare_to_number(op: str, a: Column, b: Column, floats: bool) -> Column:
    """compare() with a number that isn't NaN on the right, in a form that scans can test.

    NaN is Spark's largest value, so only ``>`` and ``>=`` need a word about it.
    """
    plain = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return plain & ~F.isnan(a) if floats and op in (">", ">=") else plain


def true_divide(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    zero = F.when((x == 0) | F.isnan(x), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(y == 0, zero).otherwise(F.try_divide(x, y))


def floor_divide(a: Column, b: Column, dtype: T.DataType) -> Column:
    """Towards minus infinity; an integer over 0 is null."""
    if is_float(dtype):
        return _float_floor(true_divide(a, b))
    if is_integer(dtype):
        x, y = a.cast("bigint"), F.when(b != 0, b.cast("bigint"))
        # Towards zero, and one less where something of the other sign is left.
        rest = x % y
        return (F.call_function("div", x, y) - F.when((rest != 0) & ((rest < 0) != (y < 0)), F.lit(1)).otherwise(F.lit(0))).cast(dtype)
    d = F.when(b != 0, b).cast("decimal(20,0)")
    return ((a.cast("decimal(20,0)") - modulo(a, b, dtype)) / d).cast(dtype)


def _float_floor(x: Column) -> Column:
    """Floor that keeps infinities, NaN and values past the integers."""
    big = F.isnan(x) | (F.abs(x) >= 2.0**52)
    return F.when(big, x).otherwise(F.floor(F.when(~big, x)).cast("double"))


def modulo(a: Column, b: Column, dtype: T.DataType) -> Column:
    """With the sign of the divisor; an integer modulo 0 is null, a float NaN."""
    if is_float(dtype):
        d = F.when(b != 0, b)
        r = F.try_mod(a, d)
        return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, F.lit(NAN)).when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r).cast(dtype)


def log(x: Column, base: float | None = None) -> Column:
    v = x.cast("double")
    out = F.when(v == 0, F.lit(-INF)).when((v < 0) | F.isnan(v), F.lit(NAN)).otherwise(F.ln(v))
    return out if base is None else out / F.ln(F.lit(float(base)))


def log10(x: Column) -> Column:
    v = x.cast("double")
    return F.when(v == 0, F.lit(-INF)).when((v < 0) | F.isnan(v), F.lit(NAN)).otherwise(F.log10(v))


def log1p(x: Column) -> Column:
    v = x.cast("double")
    return F.when(v == -1, F.lit(-INF)).when((v < -1) | F.isnan(v), F.lit(NAN)).otherwise(F.log1p(v))


def cot(x: Column) -> Column:
    return true_divide(F.lit(1.0), F.tan(x.cast("double")))


def power(a: Column, b: Column, dtype: T.DataType) -> Column:
    """Integers stay integers: a negative exponent or an overflow raises."""
    if is_integer(dtype):
        exact = F.when(b < 0, F.raise_error(F.lit("integer to a negative power"))).otherwise(F.pow(a.cast("double"), b.cast("double")))
        return exact.cast("decimal(38,0)").cast(dtype)
    return F.pow(a.cast("double"), b.cast("double"))


def round_half_away(x: Column, decimals: int, dtype: T.DataType) -> Column:
    """Half away from zero; floats by scaling, so what counts is the product and not the shortest decimal."""
    if not is_float(dtype):
        return F.round(x, decimals).cast(dtype)
    v, scale = x.cast("double"), 10.0 ** abs(decimals)
    if decimals <= 0:
        return (F.round(v / scale) * scale if decimals else F.round(v)).cast(dtype)
    # A half is a half in a double's shortest decimal too, so the product is rounded as it is. Where it is none, there are no fractions.
    return F.when(F.abs(v) < 1e308 / scale, F.round(v * scale) / scale).otherwise(v).cast(dtype)


def truncate(x: Column, decimals: int = 0) -> Column:
    scale = 10.0**decimals
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def clip(x: Column, low: Column | None, high: Column | None, floats: bool) -> Column:
    """A null bound gives null, a NaN bound or value leaves the value."""
    out, null = x, F.lit(False)
    for bound, above in ((low, False), (high, True)):
        if bound is not None:
            beyond = compare(">" if above else "<", x, bound, floats)
            out = F.when(beyond, bound).otherwise(out)
            null = null | bound.isNull()
    return F.when(~null, out)


def is_between(x: Column, low: Column, high: Column, closed: str, floats: bool) -> Column:
    a = compare(">=" if closed in ("both", "left") else ">", x, low, floats)
    b = compare("<=" if closed in ("both", "right") else "<", x, high, floats)
    return a & b


def is_in(x: Column, values: list) -> Column:
    """A null input is null; null candidates never match."""
    known = [v for v in values if v is not None]
    return x.isin(known) if known else F.when(x.isNotNull(), F.lit(False))


def nan_test(x: Column, test: Column) -> Column:
    return F.when(x.isNotNull(), test)


def replace_values(x: Column, mapping: dict, default: Column | None = None, strict: bool = False) -> Column:
    """Values mapped; ``strict``: an unmapped value raises unless there is a default."""
    out = None
    for old, new in mapping.items():
        test = x.isNull() if old is None else F.isnan(x) if isinstance(old, float) and old != old else x == F.lit(old)
        out = F.when(test, F.lit(new)) if out is None else out.when(test, F.lit(new))
    rest = default if default is not None else F.raise_error(F.concat(F.lit("no mapping for "), x.cast("string"))) if strict else x
    return rest if out is None else out.otherwise(rest)


def sum_horizontal(columns: list[Column], ignore_nulls: bool = True) -> Column:
    parts = [F.coalesce(c, F.lit(0)) if ignore_nulls else c for c in columns]
    return reduce(lambda a, b: a + b, parts)


def mean_horizontal(columns: list[Column], ignore_nulls: bool = True) -> Column:
    total = sum_horizontal([c.cast("double") for c in columns], ignore_nulls)
    n = sum_horizontal([c.isNotNull().cast("int") for c in columns])
    return F.when(n > 0, total / n)


def min_horizontal(columns: list[Column]) -> Column:
    return _extreme(columns, F.least)


def max_horizontal(columns: list[Column]) -> Column:
    return _extreme(columns, F.greatest)


def _extreme(columns: list[Column], pick) -> Column:
    """Of the values that are neither null nor NaN; NaN if only NaN is left."""
    if len(columns) == 1:
        return columns[0]
    return F.coalesce(pick(*[F.when(~F.isnan(c.cast("double")), c) for c in columns]), pick(*columns))


def any_horizontal(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def all_horizontal(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
