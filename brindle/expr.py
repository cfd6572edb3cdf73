"""Expressions: what a table's methods take.

An ``Expr`` is a function from a context (the table, its row order, the partition that
reductions see) to a Spark Column. The same expression means a projection in ``select``, an
aggregate in ``agg`` and a window in ``over``; nothing runs before an action.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import lists, numeric, reductions, strings, temporal

#: The hidden column of the row order; made when an expression needs it.
ORDER = "__row"

ROW, REDUCED, SEQUENCE = "row", "reduced", "sequence"

#: Elements of a partition's list that windows pick one by one; of more, they hold the list.
MOST_PICKED = 64


#: Hidden columns of a table that is cut into blocks of rows: a row's place, its block, whether it is a copy from a neighbour.
PLACE, BLOCK, COPY = "__place", "__block", "__copy"
#: Of one that is cut into steps of a number: the number by which rows of a step meet, whether a row counts as one of its step or as one of the step before.
AT, OWN, EARLIER = "__at", "__own", "__earlier"


class Mixed(Exception):
    """Columns that need different orders, or windows within aggregates: one window over all rows has to do."""


class Needs:
    """What columns ask of a whole table, so that no window needs all its rows in one task.

    Reductions of all rows are subqueries. ``carried``: per block of rows in
    order, what the blocks before (or after) sum up to. ``before``, ``after``: how many rows
    of the neighbouring blocks a row looks at. ``range``: a number, and how far from its own the
    numbers of the rows are that a row looks at; blocks are then steps of that number, as wide
    as what a row looks at: the end of one step and the beginning of the next.
    """

    def __init__(self, df: DataFrame):
        self.df = df.withColumns({PLACE: F.lit(0).cast("bigint"), BLOCK: F.lit(0).cast("bigint"), COPY: F.lit(False), AT: F.lit(0).cast("bigint"), OWN: F.lit(True), EARLIER: F.lit(False)})
        self.given = df
        self.carried: dict[str, tuple[Column, Callable[[Column], Column], bool]] = {}
        self.before = self.after = 0
        self.order: tuple[Column, ...] | None = None
        self.range: tuple[Column, int, int] | None = None

    def _named(self, name: str, aggregate: Column) -> Column:
        kind = self.df.agg(aggregate.alias("x")).schema[0].dataType
        self.df = self.df.withColumn(name, F.lit(None).cast(kind))
        return F.col(name)

    def reduced(self, aggregate: Column) -> Column:
        """A reduction of all rows, as a subquery: made once and sent along; the rows stay as they are."""
        try:
            return self.given.agg(aggregate.alias("x")).scalar()
        except AnalysisException:
            raise Mixed from None

    def blocks(self, order: tuple[Column, ...]) -> None:
        if self.range is not None or self.order is not None and [str(c) for c in self.order] != [str(c) for c in order]:
            raise Mixed
        self.order = order

    def around(self, t: Column, low: int, high: int) -> None:
        if self.order is not None or self.range is not None and (str(self.range[0]), *self.range[1:]) != (str(t), low, high):
            raise Mixed
        self.range = (t, low, high)

    def carry(self, aggregate: Column, combine: Callable[[Column], Column], back: bool) -> Column:
        """``combine`` over the blocks' aggregates before (``back``: after) a row's block."""
        name = f"__carried{len(self.carried)}"
        try:
            out = self._named(name, aggregate)
        except AnalysisException:
            raise Mixed from None
        self.carried[name] = (aggregate, combine, back)
        return out


class Ranks:
    """Columns that a grouping adds to its rows first: the places of values in their group, which sorts that spill find."""

    def __init__(self, df: DataFrame, keys: list[Column]):
        self.df, self.keys = df, keys
        self.made: dict[str, tuple[Column, Column]] = {}

    def of(self, x: Column) -> tuple[Column, Column]:
        """The place of a value among its group's known ones, from 0, and their number."""
        if str(x) not in self.made:
            at, n = f"__at{len(self.made)}", f"__n{len(self.made)}"
            place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(x.asc_nulls_last())) - 1
            self.df = self.df.withColumns({at: F.when(x.isNotNull(), place), n: F.count(x).over(Window.partitionBy(*self.keys))})
            self.made[str(x)] = F.col(at), F.col(n)
        return self.made[str(x)]

    def runs(self, c: Column, keep: Column | None) -> Column:
        """Per distinct value of a group, null among them: v, its count n and i, which orders them by first appearance.

        The first row of each value carries its count, so a group's list has distinct values only.
        """
        name = f"{c} {keep}"
        if name not in self.made:
            k = len(self.made)
            same = Window.partitionBy(*self.keys, *([c] if keep is None else [F.coalesce(keep, F.lit(False)), c]))
            n, first = f"__n{k}", f"__first{k}"
            self.df = self.df.withColumns({n: F.count(F.lit(1)).over(same).cast("int"), first: F.min(ORDER).over(same)})
            self.made[name] = F.col(n), F.col(first)
        n, first = self.made[name]
        there = first == F.col(ORDER) if keep is None else (first == F.col(ORDER)) & keep
        return F.collect_list(F.when(there, F.struct(n.alias("n"), c.alias("v"), first.alias("i"))))

    def place(self) -> Column:
        """The row's place in its group, from 0."""
        if "__in" not in self.df.columns:
            self.df = self.df.withColumn("__in", (F.row_number().over(Window.partitionBy(*self.keys).orderBy(ORDER)) - 1).cast("bigint"))
        return F.col("__in")


@dataclass(frozen=True)
class Context:
    """Where an expression is evaluated.

    ``grouped``: inside agg(), where reductions are plain aggregates. Otherwise they are
    windows over ``partition``, whole unless the function has a frame of its own. ``needs``:
    gathers what windows over the whole table ask for; without it they are plain windows.
    ``ranks``: places of values that a grouping finds first. ``made``: what reductions of a
    whole table (``grouped`` without ``ranks``) have counted already; None where groups are
    others than those of the rows.
    """

    df: DataFrame
    partition: tuple[Column, ...] = ()
    order: tuple[Column, ...] = ()
    back: tuple[Column, ...] = ()
    grouped: bool = False
    keep: Column | None = None
    known: dict = field(default_factory=dict, compare=False)
    needs: Needs | None = field(default=None, compare=False)
    ranks: Ranks | None = field(default=None, compare=False)
    made: dict | None = field(default=None, compare=False)

    def dtype(self, c: Column) -> T.DataType:
        return (self.needs.df if self.needs else self.ranks.df if self.ranks else self.df).select(c.alias("x")).schema[0].dataType

    def row(self) -> Column:
        return F.col(ORDER)

    @property
    def spread(self) -> bool:
        """Whether windows are over blocks of rows."""
        return self.needs is not None and not self.partition and not self.grouped

    def ordered(self, back: bool = False) -> Window:
        """One window over a partition in its order, or against it."""
        if self.spread:
            raise Mixed
        order = (self.back if back else self.order) or (self.row().desc() if back else self.row(),)
        return Window.partitionBy(*self.partition).orderBy(*order)

    def nearby(self, before: int, after: int = 0) -> Window:
        """As ordered(), for functions that look at so many rows before and after."""
        if not self.spread:
            return self.ordered()
        self.needs.blocks(self.order)
        self.needs.before, self.needs.after = max(self.needs.before, before), max(self.needs.after, after)
        return Window.partitionBy(BLOCK).orderBy(PLACE)

    def around(self, t: Column, low: int, high: int) -> Around:
        """The rows whose ``t`` is within [t + low, t + high] of a row's."""
        if not self.spread or high - low < 0:
            return Around(Window.partitionBy(*self.partition).orderBy(t).rangeBetween(low, high))
        self.needs.around(t, low, high)
        step = Window.partitionBy(BLOCK)
        first = Window.unboundedPreceding
        return Around(step.orderBy(AT).rangeBetween(first, high), step.orderBy(F.col(AT).desc()).rangeBetween(first, -high - 1))

    def place(self) -> Column:
        """The row's number in its partition, from 1."""
        if not self.spread:
            return F.row_number().over(self.ordered())
        self.needs.blocks(self.order)
        return F.col(PLACE) + 1

    def cumulate(self, c: Column, aggregate: Callable[[Column], Column], merge: Callable[[Column, Column], Column], reverse: bool = False, over: Callable[[Column], Column] | None = None, strict: bool = False) -> Column:
        """``aggregate`` of the rows so far (``strict``: before; ``reverse``: from the row on); ``over``: of the blocks' aggregates, where that is another one."""
        last = -1 if strict else 0
        if not self.spread:
            return aggregate(c).over(self.ordered(reverse).rowsBetween(Window.unboundedPreceding, last))
        self.needs.blocks(self.order)
        own = F.when(~F.col(COPY), c)
        here = aggregate(own).over(Window.partitionBy(BLOCK).orderBy(F.col(PLACE).desc() if reverse else F.col(PLACE)).rowsBetween(Window.unboundedPreceding, last))
        carried = self.needs.carry(aggregate(c), over or aggregate, reverse)
        return F.when(carried.isNull(), here).when(here.isNull(), carried).otherwise(merge(carried, here))

    def known_value(self, c: Column, ahead: bool = False, strict: bool = False) -> Column:
        """The last value so far that isn't null (``ahead``: the next one)."""
        if not self.spread:
            return F.last(c, True).over(self.ordered(ahead).rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
        place = F.col(PLACE)
        self.needs.blocks(self.order)
        here = F.last(F.when(~F.col(COPY), c), True).over(Window.partitionBy(BLOCK).orderBy(place.desc() if ahead else place).rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
        carried = self.needs.carry((F.min_by if ahead else F.max_by)(c, F.when(c.isNotNull(), place)), lambda x: F.last(x, True), ahead)
        return F.coalesce(here, carried)

    def quantile(self, c: Column, q: float, interpolation: str) -> Column:
        """An exact quantile that is one of the values (or between two) without a list of them, where there is a way."""
        x = c.cast("double")
        kinds = reductions.QUANTILE_PLACES
        if interpolation not in kinds:
            raise ValueError(f"no interpolation {interpolation!r}")
        if self.ranks is not None:
            place, n = self.ranks.of(x)
            picks = [F.max(F.when(place == f((n - 1) * F.lit(float(q))), x)) for f in kinds[interpolation]]
        elif self.spread or self.grouped and self.made is not None:
            made = {} if self.made is None else self.made
            try:
                if str(x) not in made:
                    made[str(x)] = _counted_values(self.needs.given if self.spread else self.df, x)
                counts = made[str(x)]
            except AnalysisException:
                return reductions.quantile(c, q, interpolation, self.reduce)
            last = counts.agg(F.max("upto") - 1).scalar()
            picks = []
            for f in kinds[interpolation]:
                at = f(last * F.lit(float(q)))
                picks.append(counts.where((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).agg(F.max("v")).scalar())
        else:
            return reductions.quantile(c, q, interpolation, self.reduce)
        return picks[0] if len(picks) == 1 else (picks[0] + picks[1]) / 2

    def position_of_extreme(self, c: Column, largest: bool) -> Column:
        """The place of the first extreme value; groups find places by sorts, not in lists."""
        if self.ranks is None:
            return reductions.position_of_extreme(c, self.row(), largest, self.dtype(c), self.reduce)
        return reductions.place_of_extreme(c, self.ranks.place(), largest, self.dtype(c), self.reduce)

    def picked(self, c: Column, key: Column, keep: Column | None, n: int, which: str) -> Column:
        """The list of the n first, last, smallest or largest values of a partition, in that order (the last ones as they come); null keys last."""
        row = self.row()
        order = {"first": [row], "last": [row.desc()], "smallest": [key.asc_nulls_last(), row], "largest": [key.desc_nulls_last(), row]}[which]
        w = Window.partitionBy(*self.partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        held = F.struct(c.alias("v"))
        held = held if keep is None else F.when(keep, held)
        found = [F.nth_value(held, k, keep is not None).over(w) for k in range(1, n + 1)]
        return F.transform(F.filter(F.array(*(reversed(found) if which == "last" else found)), lambda x: x.isNotNull()), lambda x: x["v"])

    def reduce(self, aggregate: Column) -> Column:
        if self.grouped:
            return aggregate
        return self.needs.reduced(aggregate) if self.spread else aggregate.over(Window.partitionBy(*self.partition))


@dataclass(frozen=True)
class Around:
    """What reductions of the rows around a row see: one window, or a beginning of its step and an end of the one before.

    Both of those are running values, so a row costs no more the more rows there are around it.
    """

    own: Window
    earlier: Window | None = None

    def both(self, aggregate: Callable[[Column], Column], c: Column) -> tuple[Column, Column | None]:
        if self.earlier is None:
            return aggregate(c).over(self.own), None
        return aggregate(F.when(F.col(OWN), c)).over(self.own), aggregate(F.when(F.col(EARLIER), c)).over(self.earlier)

    def reduce(self, aggregate: Callable[[Column], Column], c: Column, merge: Callable[[Column, Column], Column]) -> Column:
        """``merge``: of two values, null ones among them."""
        a, z = self.both(aggregate, c)
        return a if z is None else merge(a, z)

    def count(self, c: Column) -> Column:
        return self.reduce(F.count, c, lambda a, z: a + F.coalesce(z, F.lit(0)))

    def sum(self, c: Column) -> Column:
        return self.reduce(F.sum, c, lambda a, z: F.coalesce(a + z, a, z))

    def mean(self, c: Column) -> Column:
        x = c.cast("double")
        return F.avg(x).over(self.own) if self.earlier is None else self.sum(x) / F.nullif(self.count(x), F.lit(0))

    def variance(self, c: Column, ddof: int, root: bool) -> Column:
        x = c.cast("double")
        if self.earlier is None:
            return _spread(x, self.own, ddof, root)
        (n, k), (m, o), (v, u) = (self.both(f, x) for f in (F.count, F.avg, F.var_pop))
        apart = F.when((n > 0) & (k > 0), (m - o) * (m - o) * (n * k) / (n + k)).otherwise(F.lit(0.0))
        out = F.when(n + k > ddof, (F.coalesce(v * n, F.lit(0.0)) + F.coalesce(u * k, F.lit(0.0)) + apart) / (n + k - ddof))
        return F.sqrt(out) if root else out


class Expr:
    """A named, composable column function."""

    def __init__(self, build: Callable[[Context], Column], name: str | None = None, shape: str = ROW, ordered: bool = False, expand: Callable[[DataFrame], list[str]] | None = None):
        self.build, self.name, self.shape, self.ordered, self.expand = build, name, shape, ordered, expand
        #: Rows that reductions see; whether the value is a constant; how a name is changed.
        self.keep: Expr | None = None
        self.literal = False
        #: Whether the value looks at other rows than its own.
        self.windowed = shape != ROW or ordered
        self.renamer: Callable[[str], str] | None = None
        #: Partition keys and the list whose elements become rows.
        self.exploding: tuple[list[Expr], Expr] | None = None

    # -- making expressions -------------------------------------------------

    def _map(self, f: Callable[..., Column], *others: object, typed: bool = False) -> Expr:
        """Elementwise: ``f(column, *columns)``, with the context first if ``typed``."""
        rest = [as_expr(o) for o in others]

        def build(ctx: Context) -> Column:
            columns = [self.build(ctx), *[o.build(ctx) for o in rest]]
            return f(ctx, *columns) if typed else f(*columns)

        shapes = {self.shape, *[o.shape for o in rest if not o.literal]}
        shape = ROW if ROW in shapes else SEQUENCE if SEQUENCE in shapes else REDUCED
        out = Expr(build, self.name if not self.literal else next((o.name for o in rest if o.name), None), shape, self.ordered or any(o.ordered for o in rest), self.expand or next((o.expand for o in rest if o.expand), None))
        out.windowed = any(o.windowed and not o.literal for o in [self, *rest])
        return out

    def _reduce(self, f: Callable[[Context, Column, Callable], Column], ordered: bool = False) -> Expr:
        """An aggregate of the rows' values, filtered if filter() came before."""
        return Expr(lambda ctx: f(ctx, self._kept(ctx), ctx.reduce), self.name, REDUCED, ordered or self.ordered, self.expand)

    def _keep(self, ctx: Context) -> Column | None:
        return None if self.keep is None else self.keep.build(ctx)

    def _kept(self, ctx: Context) -> Column:
        keep = self._keep(ctx)
        return self.build(ctx) if keep is None else F.when(keep, self.build(ctx))

    def _place(self, ctx: Context) -> Column:
        """The row's place in order; null for rows that filter() took out."""
        keep = self._keep(ctx)
        return ctx.row() if keep is None else F.when(keep, ctx.row())

    def _window(self, f: Callable[[Context, Column], Column]) -> Expr:
        def build(ctx: Context) -> Column:
            if ctx.grouped:
                raise ValueError("an order-dependent column has no single value in a group; reduce it or use over()")
            return f(ctx, self.build(ctx))

        return Expr(build, self.name, ROW, True, self.expand)

    def _sequence(self, f: Callable[[Column], Column], key: Expr | None = None, few: tuple[int, str] | None = None) -> Expr:
        """From the ordered list of a group's (or the table's) values to another list.

        ``few``: how many elements of the list ``f`` looks at, and which: the ``first``, the ``last``, or the
        ``smallest`` or ``largest`` by value or key. Windows hold no others.
        """

        def build(ctx: Context) -> Column:
            c = self.build(ctx)
            if self.shape == SEQUENCE:
                return f(c)
            held = c if key is None else F.struct(key.build(ctx).alias("key"), c.alias("v"))
            if few is not None and 0 < few[0] <= MOST_PICKED and ctx.partition and not ctx.grouped:
                return f(ctx.picked(held, c if key is None else key.build(ctx), self._keep(ctx), *few))
            return f(reductions.ordered_list(held, ctx.row(), self._keep(ctx), ctx.reduce))

        return Expr(build, self.name, SEQUENCE, True, self.expand)

    def alias(self, name: str) -> Expr:
        out = Expr(self.build, name, self.shape, self.ordered, self.expand)
        out.keep, out.literal, out.windowed, out.exploding = self.keep, self.literal, self.windowed, self.exploding
        return out

    def name_prefix(self, prefix: str) -> Expr:
        return self._renamed(lambda n: prefix + n)

    def name_suffix(self, suffix: str) -> Expr:
        return self._renamed(lambda n: n + suffix)

    def _renamed(self, f: Callable[[str], str]) -> Expr:
        out = self.alias(f(self.name) if self.name else None)
        out.renamer = f
        return out

    # -- arithmetic -----------------------------------------------------------

    def _arithmetic(self, f: Callable[[Column, Column, T.DataType], Column], other: object) -> Expr:
        """Operands of one type; a literal takes the other side's. Mixed columns raise: cast one."""
        o = as_expr(other)

        def run(ctx: Context, a: Column, b: Column) -> Column:
            x, y = ctx.dtype(a), ctx.dtype(b)
            if isinstance(x, T.NumericType) and isinstance(y, T.NumericType):
                if o.literal and not self.literal and _adopts(x, y):
                    b, y = b.cast(x), x
                elif self.literal and not o.literal and _adopts(y, x):
                    a, x = a.cast(y), y
                elif type(x) is not type(y) and not (self.literal or o.literal):
                    raise TypeError(f"{x.simpleString()} and {y.simpleString()} don't mix; cast one")
            out = f(a, b, x)
            if isinstance(x, T.DecimalType) and isinstance(y, T.DecimalType):
                scale = max(x.scale, y.scale)
                return F.bround(out, scale).cast(T.DecimalType(38, scale))
            return out

        return self._map(run, o, typed=True)

    def __add__(self, o): return self._arithmetic(lambda a, b, t: a + b, o)  # noqa: E704
    def __radd__(self, o): return as_expr(o)._arithmetic(lambda a, b, t: a + b, self)  # noqa: E704
    def __sub__(self, o): return self._arithmetic(lambda a, b, t: a - b, o)  # noqa: E704
    def __rsub__(self, o): return as_expr(o)._arithmetic(lambda a, b, t: a - b, self)  # noqa: E704
    def __mul__(self, o): return self._arithmetic(lambda a, b, t: a * b, o)  # noqa: E704
    def __rmul__(self, o): return as_expr(o)._arithmetic(lambda a, b, t: a * b, self)  # noqa: E704
    def __truediv__(self, o): return self._arithmetic(lambda a, b, t: numeric.true_divide(a, b), o)  # noqa: E704
    def __rtruediv__(self, o): return as_expr(o)._arithmetic(lambda a, b, t: numeric.true_divide(a, b), self)  # noqa: E704
    def __floordiv__(self, o): return self._arithmetic(numeric.floor_divide, o)  # noqa: E704
    def __mod__(self, o): return self._arithmetic(numeric.modulo, o)  # noqa: E704
    def __pow__(self, o): return self._map(lambda ctx, a, b: numeric.power(a, b, ctx.dtype(a)), o, typed=True)  # noqa: E704
    def __neg__(self): return self._map(lambda a: -a)  # noqa: E704

    def pow(self, o): return self ** o  # noqa: E704
    def abs(self): return self._map(F.abs)  # noqa: E704
    def sign(self): return self._map(lambda ctx, a: F.signum(a).cast(ctx.dtype(a)), typed=True)  # noqa: E704
    def log(self, base: float | None = None): return self._map(lambda a: numeric.log(a, base))  # noqa: E704
    def log10(self): return self._map(numeric.log10)  # noqa: E704
    def log1p(self): return self._map(numeric.log1p)  # noqa: E704
    def cot(self): return self._map(numeric.cot)  # noqa: E704
    def floor(self): return self._map(lambda ctx, a: F.floor(a).cast(ctx.dtype(a)) if not numeric.is_float(ctx.dtype(a)) else numeric._float_floor(a).cast(ctx.dtype(a)), typed=True)  # noqa: E704
    def ceil(self): return self._map(lambda ctx, a: F.ceil(a).cast(ctx.dtype(a)) if not numeric.is_float(ctx.dtype(a)) else (-numeric._float_floor(-a)).cast(ctx.dtype(a)), typed=True)  # noqa: E704
    def round(self, decimals: int = 0): return self._map(lambda ctx, a: numeric.round_half_away(a, decimals, ctx.dtype(a)), typed=True)  # noqa: E704
    def truncate(self, decimals: int = 0): return self._map(lambda ctx, a: numeric.truncate(a, decimals).cast(ctx.dtype(a)), typed=True)  # noqa: E704

    def clip(self, low=None, high=None):
        bounds = [x for x in (low, high) if x is not None]

        def run(ctx, a, *b):
            b = list(b)
            lo = b.pop(0) if low is not None else None
            hi = b.pop(0) if high is not None else None
            return numeric.clip(a, lo, hi, numeric.is_float(ctx.dtype(a)))

        return self._map(run, *bounds, typed=True)

    def clip_min(self, low): return self.clip(low=low)  # noqa: E704
    def clip_max(self, high): return self.clip(high=high)  # noqa: E704

    # -- comparison, boolean, null ---------------------------------------------

    def _compare(self, op: str, o: object) -> Expr:
        if _is_number(o):
            return self._map(lambda ctx, a, b: numeric.compare_to_number(op, a, b, numeric.is_float(ctx.dtype(a))), o, typed=True)
        return self._map(lambda ctx, a, b: numeric.compare(op, a, b, numeric.is_float(ctx.dtype(a)) or numeric.is_float(ctx.dtype(b))), o, typed=True)

    def __lt__(self, o): return self._compare("<", o)  # noqa: E704
    def __le__(self, o): return self._compare("<=", o)  # noqa: E704
    def __gt__(self, o): return self._compare(">", o)  # noqa: E704
    def __ge__(self, o): return self._compare(">=", o)  # noqa: E704
    def __eq__(self, o): return self._compare("==", o)  # noqa: E704
    def __ne__(self, o): return self._compare("!=", o)  # noqa: E704
    __hash__ = None

    def eq(self, o): return self == o  # noqa: E704
    def ne(self, o): return self != o  # noqa: E704
    def eq_missing(self, o): return self._map(lambda a, b: a.eqNullSafe(b), o)  # noqa: E704
    def ne_missing(self, o): return self._map(lambda a, b: ~a.eqNullSafe(b), o)  # noqa: E704
    def __and__(self, o): return self._map(lambda a, b: a & b, o)  # noqa: E704
    def __or__(self, o): return self._map(lambda a, b: a | b, o)  # noqa: E704
    def __xor__(self, o): return self._map(lambda a, b: a != b, o)  # noqa: E704
    def __invert__(self): return self._map(lambda a: ~a)  # noqa: E704
    def and_(self, o): return self & o  # noqa: E704
    def or_(self, o): return self | o  # noqa: E704
    def xor(self, o): return self ^ o  # noqa: E704
    def not_(self): return ~self  # noqa: E704
    def is_between(self, low, high, closed: str = "both"):
        if _is_number(low) and _is_number(high):
            return self._compare(">=" if closed in ("both", "left") else ">", low) & self._compare("<=" if closed in ("both", "right") else "<", high)
        return self._map(lambda ctx, a, b, c: numeric.is_between(a, b, c, closed, numeric.is_float(ctx.dtype(a))), low, high, typed=True)
    def is_in(self, values: Iterable): return self._map(lambda a: numeric.is_in(a, list(values)))  # noqa: E704
    def is_null(self): return self._map(lambda a: a.isNull())  # noqa: E704
    def is_not_null(self): return self._map(lambda a: a.isNotNull())  # noqa: E704
    def is_nan(self): return self._map(lambda a: numeric.nan_test(a, F.isnan(a)))  # noqa: E704
    def is_not_nan(self): return self._map(lambda a: numeric.nan_test(a, ~F.isnan(a)))  # noqa: E704
    def is_infinite(self): return self._map(lambda a: numeric.nan_test(a, F.abs(a.cast("double")) == numeric.INF))  # noqa: E704
    def is_finite(self): return self._map(lambda a: numeric.nan_test(a, ~F.isnan(a.cast("double")) & (F.abs(a.cast("double")) != numeric.INF)))  # noqa: E704
    def fill_null(self, value): return self._map(lambda a, b: F.coalesce(a, b), value)  # noqa: E704
    def fill_nan(self, value): return self._map(lambda a, b: F.nanvl(a, b.cast("double")), value)  # noqa: E704
    def replace(self, mapping: dict, default=None): return self._map(lambda a: numeric.replace_values(a, mapping, None if default is None else F.lit(default)))  # noqa: E704
    def replace_strict(self, mapping: dict, default=None): return self._map(lambda a: numeric.replace_values(a, mapping, None if default is None else F.lit(default), strict=True))  # noqa: E704

    def cast(self, dtype, strict: bool = True):
        t = as_type(dtype)

        def run(ctx, a):
            if isinstance(ctx.dtype(a), T.DecimalType) and (numeric.is_integer(t) or isinstance(t, T.DecimalType)):
                a = F.bround(a, t.scale) if isinstance(t, T.DecimalType) else a
            return a.cast(t) if strict else a.try_cast(t)

        return self._map(run, typed=True)

    # -- reductions -------------------------------------------------------------

    def filter(self, predicate: Expr) -> Expr:
        """Rows that later reductions of this expression see."""
        out = Expr(self.build, self.name, self.shape, self.ordered or predicate.ordered, self.expand)
        out.keep = predicate if self.keep is None else self.keep & predicate
        return out

    def sum(self, min_count: int = 0): return self._reduce(lambda ctx, c, w: reductions.total(c, ctx.dtype(c), min_count, w))  # noqa: E704
    def product(self): return self._reduce(lambda ctx, c, w: reductions.product(c, ctx.dtype(c), w))  # noqa: E704
    def count(self): return self._reduce(lambda ctx, c, w: w(F.count(c)))  # noqa: E704
    def null_count(self): return self._reduce(lambda ctx, c, w: w(F.count_if(c.isNull())))  # noqa: E704
    def has_nulls(self): return self._reduce(lambda ctx, c, w: F.coalesce(w(F.bool_or(c.isNull())), F.lit(False)))  # noqa: E704
    def mean(self): return self._reduce(lambda ctx, c, w: w(F.avg(c.cast("int").cast("double") if isinstance(ctx.dtype(c), T.BooleanType) else c.cast("double"))))  # noqa: E704
    def min(self): return self._reduce(lambda ctx, c, w: reductions.smallest(c, ctx.dtype(c), w))  # noqa: E704
    def max(self): return self._reduce(lambda ctx, c, w: reductions.largest(c, ctx.dtype(c), w))  # noqa: E704
    def n_unique(self, ignore_nulls: bool = False): return self._reduce(lambda ctx, c, w: reductions.n_unique(c, ignore_nulls, None if ctx.grouped else w))  # noqa: E704
    def approx_n_unique(self): return self._reduce(lambda ctx, c, w: w(F.approx_count_distinct(c, 0.065)))  # noqa: E704
    def std(self, ddof: int = 1): return self._reduce(lambda ctx, c, w: reductions.variance(c, ddof, True, w))  # noqa: E704
    def var(self, ddof: int = 1): return self._reduce(lambda ctx, c, w: reductions.variance(c, ddof, False, w))  # noqa: E704
    def median(self): return self.quantile(0.5, "linear")  # noqa: E704
    def quantile(self, q: float, interpolation: str = "nearest"): return self._reduce(lambda ctx, c, w: reductions.quantile(c, q, "linear", w) if interpolation == "linear" else ctx.quantile(c, q, interpolation))  # noqa: E704
    def any(self, ignore_nulls: bool = True): return self._reduce(lambda ctx, c, w: reductions.any_true(c, ignore_nulls, w))  # noqa: E704
    def all(self, ignore_nulls: bool = True): return self._reduce(lambda ctx, c, w: reductions.all_true(c, ignore_nulls, w))  # noqa: E704
    def skew(self, bias: bool = True): return self._reduce(lambda ctx, c, w: reductions.skewness(c, bias, w))  # noqa: E704
    def kurtosis(self, fisher: bool = True, bias: bool = True): return self._reduce(lambda ctx, c, w: reductions.kurtosis(c, fisher, bias, w))  # noqa: E704
    def first(self, ignore_nulls: bool = False): return self._reduce(lambda ctx, c, w: reductions.at_end(c, self._place(ctx), False, ignore_nulls, w), True)  # noqa: E704
    def last(self, ignore_nulls: bool = False): return self._reduce(lambda ctx, c, w: reductions.at_end(c, self._place(ctx), True, ignore_nulls, w), True)  # noqa: E704
    def arg_min(self): return self._reduce(lambda ctx, c, w: ctx.position_of_extreme(c, False), True)  # noqa: E704
    def arg_max(self): return self._reduce(lambda ctx, c, w: ctx.position_of_extreme(c, True), True)  # noqa: E704
    def implode(self): return self._reduce(lambda ctx, c, w: reductions.ordered_list(c, ctx.row(), self._keep(ctx), w), True)  # noqa: E704
    def max_by(self, *keys): return self._extreme_by(keys, True)  # noqa: E704
    def min_by(self, *keys): return self._extreme_by(keys, False)  # noqa: E704

    def len(self):
        def build(ctx: Context) -> Column:
            keep = self._keep(ctx)
            return ctx.reduce(F.count(F.lit(1)) if keep is None else F.count_if(keep))

        return Expr(build, self.name, REDUCED, False, self.expand)

    def mode(self):
        return self._runs(reductions.mode)

    def _runs(self, f: Callable[[Column], Column]) -> Expr:
        """A list made of the distinct values (n, v, i) of a group's, or a list's, values; see value_runs()."""

        def build(ctx: Context) -> Column:
            c = self.build(ctx)
            if self.shape == SEQUENCE:
                return f(reductions.value_runs(c))
            if ctx.ranks is not None:
                return f(ctx.ranks.runs(c, self._keep(ctx)))
            return f(reductions.value_runs(reductions.ordered_list(c, ctx.row(), self._keep(ctx), ctx.reduce)))

        return Expr(build, self.name, SEQUENCE, True, self.expand)

    def _extreme_by(self, keys: tuple, largest: bool) -> Expr:
        ks = [_named_column(k) for k in keys]
        return self._reduce(lambda ctx, c, w: reductions.value_at_extreme(c, [k.build(ctx) for k in ks], ctx.row(), largest, w), True)

    # -- windows -------------------------------------------------------------------

    def over(self, partition_by=(), order_by=None, descending: bool = False, nulls_last: bool = False, mapping_strategy: str = "group_to_rows") -> Expr:
        """The expression within partitions. A reduction reads the whole partition, ordered or not.

        ``mapping_strategy``: a list stays one in every row (``join``), or its elements become the
        rows of the result (``explode``, in select only).
        """
        keys = [as_expr(col(k) if isinstance(k, str) else k) for k in ([partition_by] if isinstance(partition_by, (str, Expr)) else partition_by)]
        orders = [] if order_by is None else [as_expr(col(k) if isinstance(k, str) else k) for k in ([order_by] if isinstance(order_by, (str, Expr)) else order_by)]

        def build(ctx: Context) -> Column:
            by = tuple(k.build(ctx) for k in keys)
            way = tuple(_sort_key(o.build(ctx), descending, nulls_last) for o in orders)
            back = tuple(_sort_key(o.build(ctx), not descending, not nulls_last) for o in orders)
            return self.build(replace(ctx, partition=by, order=(*way, ctx.row()) if way else (), back=(*back, ctx.row().desc()) if way else (), grouped=False))

        out = self._looking(Expr(build, self.name, ROW, self.ordered or bool(orders), self.expand))
        if mapping_strategy == "explode":
            if self.shape != SEQUENCE or orders:
                raise ValueError("only a list of a partition's values can be exploded")
            out.exploding = (keys, self)
        return out

    @staticmethod
    def _looking(e: Expr) -> Expr:
        e.windowed = True
        return e

    def rank(self, method: str = "average", descending: bool = False) -> Expr:
        def run(ctx, c):
            key = c.desc_nulls_last() if descending else c.asc_nulls_last()
            if ctx.spread and method != "dense":
                # In order of the values, equal ones are neighbours: their places are their ranks.
                own = replace(ctx, order=(key, ctx.row()))
                place = own.place()
                if method == "ordinal":
                    return F.when(c.isNotNull(), place)
                equal = Window.partitionBy(c, COPY)
                low, high = F.min(place).over(equal), F.max(place).over(equal)
                return F.when(c.isNotNull(), low if method == "min" else high if method == "max" else (low + high) / 2)
            if ctx.spread:
                raise Mixed
            w = Window.partitionBy(*ctx.partition, c.isNull())
            if method == "ordinal":
                out = F.row_number().over(w.orderBy(key, ctx.row()))
            elif method == "dense":
                out = F.dense_rank().over(w.orderBy(key))
            else:
                low = F.rank().over(w.orderBy(key))
                peers = F.count(F.lit(1)).over(Window.partitionBy(*ctx.partition, c))
                out = low if method == "min" else low + peers - 1 if method == "max" else low + (peers - 1) / 2
            return F.when(c.isNotNull(), out)

        return self._window(run)

    def shift(self, n: int = 1, fill_value=None, ignore_nulls: bool = False) -> Expr:
        def run(ctx, c):
            fill = None if fill_value is None else as_expr(fill_value).build(ctx)
            if ignore_nulls:
                if abs(n) == 1:
                    out = ctx.known_value(F.when(c.isNotNull(), F.struct(c.alias("v"))), n < 0, True)["v"]
                else:
                    out = _known_before(c, n).over(ctx.ordered())
                return out if fill is None else F.coalesce(out, fill)
            out = _beside(c, n, ctx)
            if fill is None:
                return out
            place, rows = ctx.place(), ctx.reduce(F.count(F.lit(1)))
            return F.when(place <= n if n >= 0 else place > rows + n, fill).otherwise(out)

        return self._window(run)

    def diff(self, n: int = 1): return self._window(lambda ctx, c: c - _beside(c, n, ctx))  # noqa: E704
    def pct_change(self, n: int = 1): return self._window(lambda ctx, c: numeric.true_divide(c, _beside(c, n, ctx)) - 1)  # noqa: E704

    def _cumulative(self, f, merge, reverse: bool, masked: bool = True, typed=lambda ctx, c: c, over=None) -> Expr:
        def run(ctx, c):
            x = ctx.cumulate(typed(ctx, c), f, merge, reverse, over)
            return F.when(c.isNotNull(), x) if masked else x

        return self._window(run)

    def cum_sum(self, reverse: bool = False): return self._cumulative(F.sum, lambda a, b: a + b, reverse)  # noqa: E704
    def cum_prod(self, reverse: bool = False): return self._cumulative(F.product, lambda a, b: a * b, reverse, typed=lambda ctx, c: c.cast("double"))  # noqa: E704
    def cum_min(self, reverse: bool = False): return self._cumulative(F.min, F.least, reverse, typed=_without_nan)  # noqa: E704
    def cum_max(self, reverse: bool = False): return self._cumulative(F.max, F.greatest, reverse, typed=_without_nan)  # noqa: E704
    def cum_count(self, reverse: bool = False): return self._cumulative(F.count, lambda a, b: a + b, reverse, masked=False, over=F.sum)  # noqa: E704

    def _rolling(self, f, window: int, min_samples: int | None) -> Expr:
        least = window if min_samples is None else min_samples

        def run(ctx, c):
            w = ctx.nearby(window - 1).rowsBetween(-(window - 1), 0)
            return F.when(F.count(c).over(w) >= least, f(ctx, c, w))

        return self._window(run)

    def rolling_sum(self, window: int, min_samples: int | None = None): return self._rolling(lambda ctx, c, w: F.sum(c).over(w), window, min_samples)  # noqa: E704
    def rolling_mean(self, window: int, min_samples: int | None = None): return self._rolling(lambda ctx, c, w: F.avg(c.cast("double")).over(w), window, min_samples)  # noqa: E704
    def rolling_min(self, window: int, min_samples: int | None = None): return self._rolling(lambda ctx, c, w: _with_nan(F.min(c).over(w), c, w, ctx), window, min_samples)  # noqa: E704
    def rolling_max(self, window: int, min_samples: int | None = None): return self._rolling(lambda ctx, c, w: _with_nan(F.max(c).over(w), c, w, ctx), window, min_samples)  # noqa: E704
    def rolling_var(self, window: int, min_samples: int | None = None, ddof: int = 1): return self._rolling(lambda ctx, c, w: _spread(c, w, ddof, False), window, min_samples)  # noqa: E704
    def rolling_std(self, window: int, min_samples: int | None = None, ddof: int = 1): return self._rolling(lambda ctx, c, w: _spread(c, w, ddof, True), window, min_samples)  # noqa: E704

    def _rolling_by(self, f, by, window: str, closed: str, min_samples: int) -> Expr:
        index = as_expr(col(by) if isinstance(by, str) else by)
        size = temporal.interval(window)
        if size.months:
            raise ValueError("a rolling window is a fixed duration")

        def run(ctx, c):
            at = index.build(ctx)
            t = temporal.micros(at, ctx.dtype(at).simpleString())
            low = -size.micros + (0 if closed in ("left", "both") else 1)
            high = 0 if closed in ("right", "both") else -1
            w = ctx.around(t, low, high)
            return F.when(w.count(c) >= min_samples, f(c, w))

        return Expr(lambda ctx: run(ctx, self.build(ctx)), self.name, ROW, True, self.expand)

    def rolling_sum_by(self, by, window: str, closed: str = "right", min_samples: int = 1): return self._rolling_by(lambda c, w: w.sum(c), by, window, closed, min_samples)  # noqa: E704
    def rolling_mean_by(self, by, window: str, closed: str = "right", min_samples: int = 1): return self._rolling_by(lambda c, w: w.mean(c), by, window, closed, min_samples)  # noqa: E704
    def rolling_min_by(self, by, window: str, closed: str = "right", min_samples: int = 1): return self._rolling_by(lambda c, w: w.reduce(F.min, c, F.least), by, window, closed, min_samples)  # noqa: E704
    def rolling_max_by(self, by, window: str, closed: str = "right", min_samples: int = 1): return self._rolling_by(lambda c, w: w.reduce(F.max, c, F.greatest), by, window, closed, min_samples)  # noqa: E704
    def rolling_var_by(self, by, window: str, closed: str = "right", min_samples: int = 1, ddof: int = 1): return self._rolling_by(lambda c, w: w.variance(c, ddof, False), by, window, closed, min_samples)  # noqa: E704
    def rolling_std_by(self, by, window: str, closed: str = "right", min_samples: int = 1, ddof: int = 1): return self._rolling_by(lambda c, w: w.variance(c, ddof, True), by, window, closed, min_samples)  # noqa: E704

    def forward_fill(self, limit: int | None = None): return self._window(lambda ctx, c: ctx.known_value(c) if limit is None else F.last(c, True).over(ctx.nearby(limit).rowsBetween(-limit, 0)))  # noqa: E704
    def backward_fill(self, limit: int | None = None): return self._window(lambda ctx, c: ctx.known_value(c, True) if limit is None else F.first(c, True).over(ctx.nearby(0, limit).rowsBetween(0, limit)))  # noqa: E704

    def interpolate(self, method: str = "linear") -> Expr:
        return self._interpolated(method, None)

    def interpolate_by(self, by) -> Expr:
        return self._interpolated("linear", as_expr(col(by) if isinstance(by, str) else by))

    def _interpolated(self, method: str, by: Expr | None) -> Expr:
        def run(ctx, c):
            if by is None:
                place = ctx.place().cast("double")
            else:
                place = by.build(ctx).cast("double")
                ctx = replace(ctx, order=(place.asc_nulls_first(), ctx.row()), back=(place.desc_nulls_last(), ctx.row().desc()))
            known = F.when(c.isNotNull(), F.struct(place.alias("x"), c.alias("v")))
            a, b = ctx.known_value(known), ctx.known_value(known, True)
            return _between(c, place, a, b, method)

        return self._window(run)

    def cut(self, breaks: list[float], labels: list[str] | None = None, left_closed: bool = False, include_breaks: bool = False) -> Expr:
        edges = [-numeric.INF, *map(float, breaks), numeric.INF]
        names = labels or [_bin_name(a, b, left_closed) for a, b in zip(edges, edges[1:], strict=False)]

        def run(c):
            out = None
            for top, name in zip(edges[1:], names, strict=True):
                inside = (c < top if left_closed else c <= top) | F.lit(top == numeric.INF)
                value = F.struct(F.lit(top).alias("breakpoint"), F.lit(name).alias("category")) if include_breaks else F.lit(name)
                out = F.when(inside, value) if out is None else out.when(inside, value)
            return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), out)

        return self._map(run)

    def qcut(self, quantiles: list[float] | int, labels: list[str] | None = None, left_closed: bool = False) -> Expr:
        """Bins between linear quantiles of the partition; without labels, the bin's number from 0."""
        shares = [k / quantiles for k in range(1, quantiles)] if isinstance(quantiles, int) else list(quantiles)

        def build(ctx):
            c = self.build(ctx)
            edges = ctx.reduce(F.percentile(c.cast("double"), F.array(*[F.lit(float(q)) for q in shares])))
            n = F.lit(0)
            for k in range(len(shares)):
                edge = F.get(edges, F.lit(k))
                n = n + F.when((edge <= c) if left_closed else (edge < c), F.lit(1)).otherwise(F.lit(0))
            out = n if labels is None else F.get(F.array(*[F.lit(x) for x in labels]), n)
            return F.when(c.isNotNull(), out)

        return self._looking(Expr(build, self.name, ROW, self.ordered, self.expand))

    def is_duplicated(self): return self._window_free(lambda ctx, c: F.count(F.lit(1)).over(Window.partitionBy(*ctx.partition, c)) > 1)  # noqa: E704
    def is_unique(self): return self._window_free(lambda ctx, c: F.count(F.lit(1)).over(Window.partitionBy(*ctx.partition, c)) == 1)  # noqa: E704
    def is_first_distinct(self): return self._window(lambda ctx, c: F.row_number().over(Window.partitionBy(*ctx.partition, c).orderBy(ctx.row())) == 1)  # noqa: E704
    def is_last_distinct(self): return self._window(lambda ctx, c: F.row_number().over(Window.partitionBy(*ctx.partition, c).orderBy(ctx.row().desc())) == 1)  # noqa: E704

    def _window_free(self, f):
        return self._looking(Expr(lambda ctx: f(ctx, self.build(ctx)), self.name, ROW, self.ordered, self.expand))

    # -- sequences: lists per group ---------------------------------------------------

    def head(self, n: int = 10): return self._sequence(lambda a: F.slice(a, F.lit(1), F.lit(n)), few=(n, "first"))  # noqa: E704
    def tail(self, n: int = 10): return self._sequence(lambda a: F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, F.lit(n)), few=(n, "last"))  # noqa: E704
    def slice(self, offset: int, length: int | None = None): return self._sequence(lambda a: F.slice(a, (F.lit(offset) if offset >= 0 else F.greatest(F.size(a) + offset, F.lit(0))) + 1, F.size(a) if length is None else F.lit(length)), few=(offset + length, "first") if offset >= 0 and length is not None else None)  # noqa: E704
    def gather(self, indices: list[int]): return self._sequence(lambda a: F.array(*[F.element_at(a, k + 1 if k >= 0 else k) for k in indices]))  # noqa: E704
    def get(self, index: int):
        out = self._sequence(lambda a: F.element_at(a, index + 1 if index >= 0 else index), few=(index + 1, "first") if index >= 0 else (-index, "last"))
        out.shape = REDUCED
        return out

    def sort(self, descending: bool = False, nulls_last: bool = False): return self._sequence(lambda a: _sorted(a, descending, nulls_last))  # noqa: E704
    def sort_by(self, by, descending: bool = False): return self._sequence(lambda a: F.transform(_sorted_stable(a, descending), lambda x: x["v"]), as_expr(col(by) if isinstance(by, str) else by))  # noqa: E704
    def arg_sort(self, descending: bool = False): return self._sequence(lambda a: F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i"))), _by_value(descending)), lambda x: x["i"].cast("bigint")))  # noqa: E704
    def reverse(self): return self._sequence(F.reverse)  # noqa: E704
    def unique(self): return self._sequence(F.array_distinct)  # noqa: E704
    def drop_nulls(self): return self._sequence(lambda a: F.filter(a, lambda x: x.isNotNull()))  # noqa: E704
    def drop_nans(self): return self._sequence(lambda a: F.filter(a, lambda x: x.isNull() | ~F.isnan(x)))  # noqa: E704
    def top_k(self, k: int): return self._sequence(lambda a: F.slice(_sorted(a, True, True), F.lit(1), F.lit(k)), few=(k, "largest"))  # noqa: E704
    def bottom_k(self, k: int): return self._sequence(lambda a: F.slice(_sorted(a, False, True), F.lit(1), F.lit(k)), few=(k, "smallest"))  # noqa: E704
    def top_k_by(self, by, k: int): return self._sequence(lambda a: F.transform(F.slice(_sorted_stable(a, True), F.lit(1), F.lit(k)), lambda x: x["v"]), as_expr(col(by) if isinstance(by, str) else by), (k, "largest"))  # noqa: E704
    def bottom_k_by(self, by, k: int): return self._sequence(lambda a: F.transform(F.slice(_sorted_stable(a, False), F.lit(1), F.lit(k)), lambda x: x["v"]), as_expr(col(by) if isinstance(by, str) else by), (k, "smallest"))  # noqa: E704

    def value_counts(self, sort: bool = False, normalize: bool = False) -> Expr:
        """Structs value, count (or proportion) in order of first appearance, or most frequent first."""

        sign = lambda x: F.signum(x.cast("double")).cast("int")
        by_place = lambda x, y: sign(x["i"] - y["i"])

        def f(runs):
            held = F.array_sort(runs, (lambda x, y: F.when(y["n"] != x["n"], y["n"] - x["n"]).otherwise(by_place(x, y))) if sort else by_place)
            if not normalize:
                return F.transform(held, lambda x: F.struct(x["v"].alias("value"), x["n"].alias("count")))
            total = F.aggregate(held, F.lit(0).cast("bigint"), lambda n, x: n + x["n"])
            return F.transform(F.array(F.struct(held.alias("r"), total.alias("n"))), lambda s: F.transform(s["r"], lambda x: F.struct(x["v"].alias("value"), (x["n"] / s["n"]).alias("proportion"))))[0]

        return self._runs(f)

    def unique_counts(self): return self._runs(lambda runs: F.transform(F.array_sort(runs, lambda x, y: F.signum((x["i"] - y["i"]).cast("double")).cast("int")), lambda x: x["n"]))  # noqa: E704

    # -- namespaces ----------------------------------------------------------------------

    @property
    def str(self): return Str(self)  # noqa: E704
    @property
    def dt(self): return Dt(self)  # noqa: E704
    @property
    def list(self): return Lst(self)  # noqa: E704
    def field(self, name: str): return self._map(lambda c: c.getField(name)).alias(name)  # noqa: E704


def _counted_values(df: DataFrame, x: Column) -> DataFrame:
    """Distinct known values v of a table in order, their numbers n, and how many rows there are upto each; written."""
    from brindle.frame import Frame, _written

    counts = df.select(x.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return _written(Frame(counts).sort("v").select("v", "n", col("n").cum_sum().alias("upto")).df)


def _beside(c: Column, n: int, ctx: Context) -> Column:
    """The value ``n`` rows before (after, if negative)."""
    return F.lag(c, n).over(ctx.nearby(n)) if n >= 0 else F.lead(c, -n).over(ctx.nearby(0, -n))


def _without_nan(ctx: Context, c: Column) -> Column:
    return F.nanvl(c, F.lit(None)) if numeric.is_float(ctx.dtype(c)) else c


def _between(c: Column, place: Column, a: Column, b: Column, method: str) -> Column:
    """A value at ``place`` between the known ones (x, v) before and after it."""
    if method == "nearest":
        return F.when(place - a["x"] < b["x"] - place, a["v"]).otherwise(F.when(a.isNotNull(), b["v"]))
    step = (place - a["x"]) / F.when(b["x"] != a["x"], b["x"] - a["x"])
    return F.coalesce(c.cast("double"), a["v"] + step * (b["v"] - a["v"]))


def _known_before(c: Column, n: int) -> Column:
    """lag(c, n) IGNORE NULLS, which PySpark has no function for; ``n`` < 0 looks ahead."""
    scala = _scala_functions()
    return Column((scala.lag if n >= 0 else scala.lead)(c._jc, abs(n), None, True))


def _scala_functions():
    from pyspark import SparkContext

    return SparkContext._active_spark_context._jvm.org.apache.spark.sql.functions


def _with_nan(x: Column, c: Column, w, ctx: Context) -> Column:
    return F.when(F.count_if(F.isnan(c)).over(w) > 0, F.lit(numeric.NAN)).otherwise(x) if numeric.is_float(ctx.dtype(c)) else x


def _spread(c: Column, w, ddof: int, root: bool) -> Column:
    x = c.cast("double")
    n = F.count(x).over(w)
    out = F.when(n > ddof, F.var_pop(x).over(w) * n / (n - ddof))
    return F.sqrt(out) if root else out


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and x == x


def _adopts(column: T.DataType, literal: T.DataType) -> bool:
    """Whether a literal may take a column's type: a fraction never becomes an integer."""
    return numeric.is_float(column) or isinstance(column, T.DecimalType) and not numeric.is_float(literal) or numeric.is_integer(column) and numeric.is_integer(literal)


def _bin_name(a: float, b: float, left_closed: bool) -> str:
    show = lambda v: "inf" if v == numeric.INF else "-inf" if v == -numeric.INF else f"{v:g}"
    return f"[{show(a)}, {show(b)})" if left_closed else f"({show(a)}, {show(b)}]"


def _sort_key(c: Column, descending: bool, nulls_last: bool) -> Column:
    return (c.desc_nulls_last() if nulls_last else c.desc_nulls_first()) if descending else (c.asc_nulls_last() if nulls_last else c.asc_nulls_first())


def _sorted(a: Column, descending: bool, nulls_last: bool) -> Column:
    known, gone = F.filter(a, lambda x: x.isNotNull()), F.filter(a, lambda x: x.isNull())
    ordered = F.sort_array(known, not descending)
    return F.concat(ordered, gone) if nulls_last else F.concat(gone, ordered)


def _by_value(descending: bool):
    def compare(x, y):
        a, b = x["v"], y["v"]
        less = F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, 1 if descending else -1).when(a > b, -1 if descending else 1).otherwise(0)
        return F.when(less != 0, less).otherwise(x["i"] - y["i"])

    return compare


def _sorted_stable(a: Column, descending: bool) -> Column:
    """Structs key, v by key, null keys last, equal keys as they come."""
    placed = F.transform(a, lambda x, i: F.struct(x["key"].alias("k"), i.alias("i"), x["v"].alias("v")))

    def compare(x, y):
        p, q = x["k"], y["k"]
        less = F.when(p.isNull() & q.isNull(), 0).when(p.isNull(), 1).when(q.isNull(), -1).when(p < q, 1 if descending else -1).when(p > q, -1 if descending else 1).otherwise(0)
        return F.when(less != 0, less).otherwise(x["i"] - y["i"])

    return F.array_sort(placed, compare)


class Str:
    """String methods of an expression."""

    def __init__(self, e: Expr):
        self.e = e

    def join(self, separator: str = "", ignore_nulls: bool = True):
        return self.e._reduce(lambda ctx, c, w: reductions.join_strings(c, separator, ctx.row(), ignore_nulls, w), True)

    def json_decode(self, dtype):
        return self.e._map(lambda c: strings.json_decode(c, as_type(dtype)))

    def strptime(self, fmt: str, kind: str = "timestamp_ntz", strict: bool = True):
        return self.e._map(lambda c: temporal.strptime(c, fmt, kind, strict))

    def to_date(self, fmt: str = "%Y-%m-%d", strict: bool = True):
        return self.strptime(fmt, "date", strict)

    def to_datetime(self, fmt: str = "%Y-%m-%d %H:%M:%S", strict: bool = True):
        return self.strptime(fmt, "timestamp_ntz", strict)


class Dt:
    """Temporal methods of an expression."""

    def __init__(self, e: Expr):
        self.e = e

    def _kind(self, ctx: Context, c: Column) -> str:
        return ctx.dtype(c).simpleString()

    def _typed(self, f, *args):
        return self.e._map(lambda ctx, c: f(c, *args, self._kind(ctx, c)), typed=True)

    def truncate(self, every: str): return self._typed(temporal.truncate, every)  # noqa: E704
    def round(self, every: str): return self._typed(temporal.round_to, every)  # noqa: E704
    def offset_by(self, by: str): return self._typed(temporal.offset_by, by)  # noqa: E704
    def month_start(self): return self._typed(temporal.month_start)  # noqa: E704
    def month_end(self): return self._typed(temporal.month_end)  # noqa: E704
    def days_in_month(self): return self.e._map(lambda c: F.dayofmonth(F.last_day(c)))  # noqa: E704
    def date(self): return self.e._map(lambda c: c.cast("date"))  # noqa: E704
    def time(self): return self._typed(temporal.time_of_day)  # noqa: E704
    def millisecond(self): return self._typed(temporal.millisecond)  # noqa: E704
    def microsecond(self): return self._typed(temporal.microsecond)  # noqa: E704
    def nanosecond(self): return self._typed(temporal.nanosecond)  # noqa: E704
    def epoch(self, unit: str = "us"): return self._typed(temporal.epoch, unit)  # noqa: E704
    def timestamp(self, unit: str = "us"): return self.epoch(unit)  # noqa: E704
    def convert_time_zone(self, zone: str): return self._typed(temporal.convert_time_zone, zone)  # noqa: E704

    def replace_time_zone(self, zone: str, ambiguous: str = "raise", non_existent: str = "raise"):
        return self._typed(temporal.replace_time_zone, zone, ambiguous, non_existent)

    def with_time_unit(self, unit: str):
        """The same values: the unit is a label, and Spark holds whole microseconds under each."""
        if unit not in ("ns", "us", "ms"):
            raise ValueError(f"no time unit {unit!r}")
        return self.e._map(lambda c: c)

    def total(self, unit: str): return self.e._map(lambda c: temporal.total(c, unit))  # noqa: E704
    def combine(self, time): return self.e._map(lambda d, t: temporal.from_micros(temporal.micros(d.cast("date"), "date") + F.floor(t / 1000), temporal.NAIVE), time)  # noqa: E704

    def replace(self, year=None, month=None, day=None, hour=None, minute=None, second=None):
        def run(ctx, c):
            pick = lambda v, f: F.lit(v) if v is not None else f(c)
            if self._kind(ctx, c) == "date":
                return F.make_date(pick(year, F.year), pick(month, F.month), pick(day, F.dayofmonth))
            kind = self._kind(ctx, c)
            seconds = (F.lit(second) if second is not None else F.second(c)).cast("decimal(16,6)") + (temporal.microsecond(c, kind) / 1_000_000).cast("decimal(16,6)")
            return (F.make_timestamp if kind == "timestamp" else F.make_timestamp_ntz)(pick(year, F.year), pick(month, F.month), pick(day, F.dayofmonth), pick(hour, F.hour), pick(minute, F.minute), seconds)

        return self.e._map(run, typed=True)


class Lst:
    """List methods of an expression."""

    def __init__(self, e: Expr):
        self.e = e

    def first(self): return self.get(0)  # noqa: E704
    def last(self): return self.get(-1)  # noqa: E704
    def contains(self, value): return self.e._map(lambda c: lists.contains(c, value))  # noqa: E704
    def sum(self): return self.e._map(lambda ctx, c: lists.total(c, ctx.dtype(c)), typed=True)  # noqa: E704


def _method(f: Callable[..., Column]):
    def call(self, *args, **kwargs):
        return self.e._map(lambda c: f(c, *args, **kwargs))

    call.__doc__ = f.__doc__
    return call


for _name, _f in {
    "len_chars": lambda c: F.char_length(c).cast("bigint"), "len_bytes": lambda c: F.octet_length(c).cast("bigint"), "to_uppercase": F.upper, "to_lowercase": F.lower, "to_titlecase": strings.titlecase,
    "strip_chars": strings.strip_chars, "strip_chars_start": lambda c, chars=None: strings.strip_chars(c, chars, "start"), "strip_chars_end": lambda c, chars=None: strings.strip_chars(c, chars, "end"),
    "strip_prefix": strings.strip_prefix, "strip_suffix": strings.strip_suffix, "starts_with": lambda c, p: F.startswith(c, F.lit(p)), "ends_with": lambda c, p: F.endswith(c, F.lit(p)),
    "contains": strings.contains, "like": strings.like, "contains_any": strings.contains_any, "find": strings.find, "count_matches": strings.count_matches, "extract": strings.extract, "extract_all": strings.extract_all, "extract_groups": strings.extract_groups,
    "escape_regex": strings.escape_regex, "replace": strings.replace_first, "replace_all": strings.replace_all, "replace_many": strings.replace_many, "slice": strings.slice_chars, "head": strings.head, "tail": strings.tail, "reverse": F.reverse,
    "pad_start": lambda c, width, fill=" ": strings.pad(c, width, fill, True), "pad_end": lambda c, width, fill=" ": strings.pad(c, width, fill, False), "zfill": strings.zfill, "split": strings.split,
    "split_exact": lambda c, by, n: strings.split_fields(c, by, n, False), "splitn": lambda c, by, n: strings.split_fields(c, by, n, True), "encode": strings.encode, "decode": strings.decode, "normalize": strings.normalize, "to_integer": strings.to_integer, "json_path_match": strings.json_path_match,
}.items():
    setattr(Str, _name, _method(_f))
for _name, _f in {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "ordinal_day": F.dayofyear, "week": F.weekofyear, "weekday": temporal.weekday, "iso_year": temporal.iso_year,
    "century": temporal.century, "millennium": temporal.millennium, "is_leap_year": temporal.is_leap_year, "strftime": temporal.strftime, "is_business_day": temporal.is_business_day, "add_business_days": temporal.add_business_days,
    **{f"total_{u}": (lambda c, _u=u: temporal.total(c, _u)) for u in ("days", "hours", "minutes", "seconds", "milliseconds")},
}.items():
    setattr(Dt, _name, _method(_f))
for _name, _f in {"len": lists.length, "get": lists.get, "join": lists.join, "min": lists.smallest, "max": lists.largest, "mean": lists.mean}.items():
    setattr(Lst, _name, _method(_f))
for _name in ("sqrt", "exp", "cbrt", "sin", "cos", "tan", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "arcsinh", "arccosh", "arctanh", "degrees", "radians"):
    _spark = getattr(F, {"arcsin": "asin", "arccos": "acos", "arctan": "atan", "arcsinh": "asinh", "arccosh": "acosh", "arctanh": "atanh"}.get(_name, _name))
    setattr(Expr, _name, lambda self, _g=_spark: self._map(lambda c: _g(c.cast("double"))))


# -- constructors ------------------------------------------------------------------------

_TYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "bool": "boolean", "string": "string", "str": "string", "categorical": "string", "binary": "binary", "date": "date", "datetime": "timestamp_ntz", "null": "void", "time": "bigint", "duration": "interval day to second"}


def as_type(t: object) -> T.DataType:
    """A Spark type from one or from a name such as int64, decimal[10,2], list[int64] or datetime[us, UTC]."""
    if isinstance(t, T.DataType):
        return t
    text = str(t).strip().lower()
    if m := re.fullmatch(r"list[\[(](.*)[\])]", text):
        return T.ArrayType(as_type(m[1]))
    if m := re.fullmatch(r"decimal[\[(](\d+),\s*(\d+)[\])]", text):
        return T.DecimalType(int(m[1]), int(m[2]))
    if text.startswith("datetime["):
        return T.TimestampType() if "," in text else T.TimestampNTZType()
    if text.startswith("duration["):
        return T.DayTimeIntervalType()
    return T._parse_datatype_string(_TYPES.get(text, text)) if text not in _TYPES else _named(_TYPES[text])


def _named(text: str) -> T.DataType:
    simple = {"tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "void": T.NullType(), "decimal(20,0)": T.DecimalType(20, 0), "interval day to second": T.DayTimeIntervalType()}
    return simple[text]


def col(name: str | list[str], *more: str) -> Expr:
    """A column by name; ``^...$`` is a pattern, a list several columns."""
    names = [name, *more] if isinstance(name, str) else list(name)
    if len(names) == 1 and not (names[0].startswith("^") and names[0].endswith("$")):
        only = names[0]
        return Expr(lambda ctx: F.col(f"`{only}`"), only)
    if len(names) == 1:
        return selector(lambda df: [c for c in df.columns if re.search(names[0], c)])
    return selector(lambda df: names)


def selector(pick: Callable[[DataFrame], list[str]]) -> Expr:
    """One expression for each column that ``pick`` names."""

    def build(ctx: Context) -> Column:
        return F.col(f"`{ctx.known['selected']}`")

    return Expr(build, None, ROW, False, pick)


def columns(pattern: str) -> Expr:
    return selector(lambda df: [c for c in df.columns if re.search(pattern, c)])


def all_() -> Expr:
    return selector(lambda df: list(df.columns))


def exclude(*names: str) -> Expr:
    return selector(lambda df: [c for c in df.columns if c not in names])


def by_dtype(*dtypes: object) -> Expr:
    types = [as_type(t) for t in dtypes]
    return selector(lambda df: [f.name for f in df.schema.fields if f.dataType in types])


def nth(*positions: int) -> Expr:
    return selector(lambda df: [df.columns[k] for k in positions])


def first_() -> Expr:
    return nth(0)


def last_() -> Expr:
    return nth(-1)


def lit(value: object, dtype: object | None = None) -> Expr:
    def build(ctx: Context) -> Column:
        c = F.lit(value)
        return c if dtype is None else c.cast(as_type(dtype))

    out = Expr(build, "literal", REDUCED)
    out.literal = True
    return out


def null(dtype: object | None = None) -> Expr:
    return lit(None, dtype)


def as_expr(x: object) -> Expr:
    if isinstance(x, Expr):
        return x
    if x is None or isinstance(x, (bool, int, float, str, bytes, decimal.Decimal, dt.date, dt.datetime, dt.timedelta)):
        return lit(x)
    if isinstance(x, Column):
        return Expr(lambda ctx: x, None)
    raise TypeError(f"not an expression: {x!r}")


def _named_column(x: object) -> Expr:
    return col(x) if isinstance(x, str) else as_expr(x)


def _combine(f: Callable[[list[Column]], Column], exprs: Iterable, name: str | None = None) -> Expr:
    es = [_named_column(e) for e in exprs]
    shape = ROW if any(e.shape == ROW for e in es) else REDUCED
    return Expr(lambda ctx: f([e.build(ctx) for e in es]), name or (es[0].name if es else None), shape, any(e.ordered for e in es))


def len_() -> Expr:
    return Expr(lambda ctx: ctx.reduce(F.count(F.lit(1))), "len", REDUCED)


def int_range(stop: Expr | int | None = None) -> Expr:
    """0, 1, .. within the partition."""
    return Expr(lambda ctx: (ctx.place() - 1).cast("bigint"), "int_range", ROW, True)


def coalesce(*exprs) -> Expr: return _combine(lambda cs: F.coalesce(*cs), exprs)  # noqa: E704
def concat_str(*exprs, separator: str = "", ignore_nulls: bool = False) -> Expr: return _combine(lambda cs: strings.concat_columns(cs, separator, ignore_nulls), exprs)  # noqa: E704
def as_struct(*exprs) -> Expr:  # noqa: E704
    es = [_named_column(e) for e in exprs]
    return _combine(lambda cs: F.struct(*[c.alias(e.name) for c, e in zip(cs, es, strict=True)]), es)


def sum_horizontal(*exprs, ignore_nulls: bool = True) -> Expr: return _combine(lambda cs: numeric.sum_horizontal(cs, ignore_nulls), exprs)  # noqa: E704
def mean_horizontal(*exprs, ignore_nulls: bool = True) -> Expr: return _combine(lambda cs: numeric.mean_horizontal(cs, ignore_nulls), exprs)  # noqa: E704
def min_horizontal(*exprs) -> Expr: return _combine(numeric.min_horizontal, exprs)  # noqa: E704
def max_horizontal(*exprs) -> Expr: return _combine(numeric.max_horizontal, exprs)  # noqa: E704
def any_horizontal(*exprs) -> Expr: return _combine(numeric.any_horizontal, exprs)  # noqa: E704
def all_horizontal(*exprs) -> Expr: return _combine(numeric.all_horizontal, exprs)  # noqa: E704
def arctan2(y, x) -> Expr: return _combine(lambda cs: F.atan2(*cs), [y, x])  # noqa: E704
def date_(year, month, day) -> Expr: return _combine(lambda cs: F.make_date(*cs), [year, month, day], "date")  # noqa: E704
def datetime_(year, month, day, hour=0, minute=0, second=0) -> Expr: return _combine(lambda cs: F.make_timestamp_ntz(*cs), [year, month, day, as_expr(hour), as_expr(minute), as_expr(second)], "datetime")  # noqa: E704
def time_(hour=0, minute=0, second=0) -> Expr: return _combine(lambda cs: (cs[0] * 3600 + cs[1] * 60 + cs[2]).cast("bigint") * 1_000_000_000, [as_expr(hour), as_expr(minute), as_expr(second)], "time")  # noqa: E704
def duration(days=0, hours=0, minutes=0, seconds=0) -> Expr: return _combine(lambda cs: F.make_dt_interval(*cs), [as_expr(days), as_expr(hours), as_expr(minutes), as_expr(seconds)], "duration")  # noqa: E704
def business_day_count(start, end, week_mask=temporal.WEEKDAYS, holidays=()) -> Expr: return _combine(lambda cs: temporal.business_day_count(cs[0], cs[1], week_mask, list(holidays)), [start, end])  # noqa: E704


def _pair(f, a, b) -> Expr:
    x, y = _named_column(a), _named_column(b)
    return Expr(lambda ctx: f(x.build(ctx), y.build(ctx), ctx.reduce), x.name, REDUCED, x.ordered or y.ordered)


def corr(a, b) -> Expr: return _pair(lambda x, y, w: reductions.correlation(x, y, w), a, b)  # noqa: E704
def cov(a, b, ddof: int = 1) -> Expr: return _pair(lambda x, y, w: reductions.covariance(x, y, ddof, w), a, b)  # noqa: E704
def grouping(name: str) -> Expr: return Expr(lambda ctx: F.grouping(name).cast("bigint"), f"grouping_{name}", REDUCED)  # noqa: E704
def grouping_id(*names: str) -> Expr:
    def build(ctx: Context) -> Column:
        out = F.lit(0).cast("bigint")
        for n in names:
            out = out * 2 + F.grouping(n).cast("bigint")
        return out

    return Expr(build, "grouping_id", REDUCED)


class When:
    """when(p).then(a).when(q).then(b).otherwise(c): the first true branch; null is false."""

    def __init__(self, branches: list[tuple[Expr, Expr]], predicate: Expr):
        self.branches, self.predicate = branches, predicate

    def then(self, value) -> Then:
        return Then([*self.branches, (self.predicate, as_expr(value))])


class Then(Expr):
    def __init__(self, branches: list[tuple[Expr, Expr]], other: Expr | None = None):
        self.branches, self.other = branches, other
        parts = [e for b in branches for e in b] + ([other] if other is not None else [])
        shape = ROW if any(e.shape == ROW for e in parts if not e.literal) else REDUCED
        super().__init__(self._build, branches[0][1].name, shape, any(e.ordered for e in parts))

    def _build(self, ctx: Context) -> Column:
        out = None
        for p, v in self.branches:
            test, value = p.build(ctx), v.build(ctx)
            out = F.when(test, value) if out is None else out.when(test, value)
        return out if self.other is None else out.otherwise(self.other.build(ctx))

    def when(self, predicate: Expr) -> When:
        return When(self.branches, predicate)

    def otherwise(self, value) -> Expr:
        return Then(self.branches, as_expr(value))

    def end(self) -> Expr:
        return self


def when(predicate: Expr) -> When:
    return When([], predicate)
