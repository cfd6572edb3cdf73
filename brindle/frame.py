"""Tables: a Spark DataFrame with a row order, strict names and grouping.

Nothing runs before an action. The row order is that of Spark's partitions; a column for it
is added only when an operation looks at the order, so filters and projections reach the scan.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle import expr as ex
from brindle.expr import ORDER, REDUCED, ROW, SEQUENCE, Context, Expr, as_type, col
from brindle.functions import numeric, temporal

#: Rows of a block of a table whose windows need its rows in order.
BLOCK_ROWS = 1 << 18


def _listed(x: object) -> list:
    return [] if x is None else [x] if isinstance(x, (str, Expr)) else list(x)


class Frame:
    """A table. Methods return new tables."""

    def __init__(self, df: DataFrame):
        self.df = df

    # -- inspection ----------------------------------------------------------

    @property
    def columns(self) -> list[str]: return self.df.columns  # noqa: E704
    @property
    def schema(self) -> dict[str, T.DataType]: return {f.name: f.dataType for f in self.df.schema.fields}  # noqa: E704
    @property
    def dtypes(self) -> list[T.DataType]: return [f.dataType for f in self.df.schema.fields]  # noqa: E704
    @property
    def width(self) -> int: return len(self.df.columns)  # noqa: E704
    @property
    def height(self) -> int: return self.df.count()  # noqa: E704
    @property
    def shape(self) -> tuple[int, int]: return self.height, self.width  # noqa: E704

    def is_empty(self) -> bool: return self.df.isEmpty()  # noqa: E704
    def lazy(self) -> Frame: return self  # noqa: E704
    def collect_schema(self) -> dict[str, T.DataType]: return self.schema  # noqa: E704
    def collect(self) -> pa.Table: return self.df.toArrow()  # noqa: E704
    def fetch(self, n: int) -> pa.Table: return self.df.limit(n).toArrow()  # noqa: E704
    def sink_csv(self, path: str, **options) -> None: _writers().write_csv(self, path, **options)  # noqa: E704
    def sink_parquet(self, path: str, **options) -> None: _writers().write_parquet(self, path, **options)  # noqa: E704
    def explain(self, mode: str = "formatted") -> str: return self.df._sc._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), mode)  # noqa: E704
    def rechunk(self) -> Frame: return self  # noqa: E704

    def profile(self) -> tuple[pa.Table, dict[str, int]]:
        """The rows, and their number as observed while they were made."""
        from pyspark.sql import Observation

        seen = Observation()
        table = self.df.observe(seen, F.count(F.lit(1)).alias("rows")).toArrow()
        return table, dict(seen.get)

    def get_column(self, name: str) -> Series: return Series(self.select(name))  # noqa: E704
    def column(self, k: int) -> Series: return self.get_column(self.columns[k])  # noqa: E704
    def rows(self) -> list[tuple]: return [tuple(r) for r in self.df.collect()]  # noqa: E704
    def row(self, k: int) -> tuple: return self.slice(k, 1).rows()[0]  # noqa: E704
    def item(self, row: int = 0, column: int | str = 0) -> object: return self.row(row)[column if isinstance(column, int) else self.columns.index(column)]  # noqa: E704
    def to_dicts(self) -> list[dict]: return [r.asDict(recursive=True) for r in self.df.collect()]  # noqa: E704
    def to_dict(self) -> dict[str, list]: return self.collect().to_pydict()  # noqa: E704
    def iter_rows(self) -> Iterator[tuple]: return (tuple(r) for r in self.df.toLocalIterator())  # noqa: E704
    def iter_columns(self) -> Iterator[Series]: return (self.get_column(c) for c in self.columns)  # noqa: E704
    def iter_slices(self, n: int = 10_000) -> Iterator[pa.Table]: return (pa.Table.from_batches([b]) for b in self.collect().to_batches(n))  # noqa: E704
    def estimated_size(self) -> int: return int(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())  # noqa: E704

    def to_string(self, n: int = 10) -> str:
        return self.df._show_string(n, 32, False)

    def glimpse(self, n: int = 5) -> str:
        found = self.df.limit(n).collect()
        return "\n".join(f"{f.name} <{f.dataType.simpleString()}> {', '.join(str(r[f.name]) for r in found)}" for f in self.df.schema.fields)

    def write_to(self, out) -> None:
        out.write(self.to_string())

    def equals(self, other: Frame) -> bool:
        """Same names, types and rows in order; null equals null and NaN NaN."""
        if [(f.name, f.dataType) for f in self.df.schema.fields] != [(f.name, f.dataType) for f in other.df.schema.fields]:
            return False
        a, b = (f.with_row_index("__n").df.withColumn("__s", F.struct(*f.columns)).select("__n", "__s") if f.columns else f.with_row_index("__n").df.withColumn("__s", F.lit(0)) for f in (self, other))
        b = b.select(F.col("__n").alias("__m"), F.col("__s").alias("__t"))
        return a.join(b, F.col("__n") == F.col("__m"), "full").where(~(F.col("__n").eqNullSafe(F.col("__m")) & F.col("__s").eqNullSafe(F.col("__t")))).isEmpty()

    # -- evaluating expressions -----------------------------------------------

    def _with_order(self) -> DataFrame:
        return self.df.withColumn(ORDER, F.monotonically_increasing_id())

    def _expanded(self, exprs: Iterable) -> list[tuple[str, Expr, dict]]:
        out = []
        for e in exprs:
            e = ex._named_column(e)
            if e.expand is None:
                out.append((e.name or "literal", e, {}))
                continue
            for name in e.expand(self.df):
                shown = e.renamer(name) if e.renamer else e.name or name
                out.append((shown, e, {"selected": name}))
        return out

    def _built(self, es: list[tuple[str, Expr, dict]], order: bool = False) -> tuple[DataFrame, dict[str, Column]]:
        """The columns of expressions, by name, and the table that has what they read.

        Reductions and windows over the whole table never are windows without a key: totals are
        subqueries, and rows in order are cut into blocks that get the sums of the blocks before
        them and copies of the neighbouring rows that they look at.
        """
        df = self._with_order() if order or self._needs_order(es) else self.df
        if any(e.windowed and not e.literal for _, e, _ in es):
            needs = ex.Needs(df)
            try:
                built = {n: e.build(Context(df, known=k, needs=needs)) for n, e, k in es}
                return self._met(df, needs), built
            except ex.Mixed:
                pass
        return df, {n: e.build(Context(df, known=k)) for n, e, k in es}

    def _met(self, df: DataFrame, needs: ex.Needs) -> DataFrame:
        """The table with the columns that ``needs`` asks for."""
        if needs.order is not None:
            sorted_rows = df.orderBy(*needs.order) if needs.order else df.drop(ORDER)
            df = Frame(sorted_rows).with_row_index(ex.PLACE).df
            if not needs.order:
                df = df.withColumn(ORDER, F.col(ex.PLACE))
        if needs.range is not None:
            t, low, high = needs.range
            step = F.lit(high - low + 1).cast("bigint")
            number = lambda x: F.call_function("div", x - F.pmod(x, step), step)
            # A row looks at its step up to itself, and at the step before from so far behind itself: there rows go by a number that is one step more.
            here = number(t + high).eqNullSafe(number(t))
            row = lambda of, at, copy, own, earlier: F.struct(of.alias("b"), at.alias("at"), F.lit(copy).alias("c"), own.alias("o"), F.lit(earlier).alias("e"))
            copies = [row(number(t + high), t, False, here, False), F.when(t.isNotNull(), row(number(t) + 1, t + step, True, F.lit(False), True))]
            if high:  # at the first number of a step, where what a row looks at ends in the step before
                copies.append(F.when(~here, row(number(t), t, True, F.lit(True), False)))
            df = df.withColumn("__into", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())))
            return df.withColumns({ex.BLOCK: F.col("__into.b"), ex.COPY: F.col("__into.c"), ex.AT: F.col("__into.at"), ex.OWN: F.col("__into.o"), ex.EARLIER: F.col("__into.e")}).drop("__into")
        if needs.order is None:
            return df
        size = max(BLOCK_ROWS, 8 * (needs.before + needs.after))
        place, block = F.col(ex.PLACE), F.floor(F.col(ex.PLACE) / size).cast("bigint")
        if needs.carried:
            sums = df.groupBy(block.alias("__of")).agg(*[a.alias(n) for n, (a, _, _) in needs.carried.items()])
            w = {back: Window.orderBy(F.desc("__of") if back else F.col("__of")).rowsBetween(Window.unboundedPreceding, -1) for back in (False, True)}
            # One row per block.
            sums = sums.select("__of", *[over(F.col(n)).over(w[back]).alias(n) for n, (_, over, back) in needs.carried.items()])
            df = df.join(F.broadcast(sums), block == F.col("__of")).drop("__of")
        copies = [F.struct(block.alias("b"), F.lit(False).alias("c"))]
        if needs.before:
            copies.append(F.when(place % size >= size - needs.before, F.struct((block + 1).alias("b"), F.lit(True).alias("c"))))
        if needs.after:
            copies.append(F.when((place % size < needs.after) & (block > 0), F.struct((block - 1).alias("b"), F.lit(True).alias("c"))))
        df = df.withColumn("__into", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull()))) if len(copies) > 1 else df.withColumn("__into", copies[0])
        return df.withColumns({ex.BLOCK: F.col("__into.b"), ex.COPY: F.col("__into.c")}).drop("__into").repartitionByRange(ex.BLOCK)

    def _own(self, df: DataFrame, names: list[str]) -> Frame:
        """The columns ``names`` of the rows that aren't copies, in order where blocks were cut from it."""
        if ex.COPY in df.columns:
            df = df.where(~F.col(ex.COPY))
            if ex.PLACE in df.columns:
                df = df.sortWithinPartitions(ex.BLOCK, ex.PLACE)
        return Frame(df.select(*[F.col(f"`{n}`") for n in names]))

    def _needs_order(self, exprs: list[tuple[str, Expr, dict]]) -> bool:
        return any(e.ordered for _, e, _ in exprs)

    @staticmethod
    def _checked(names: list[str]) -> None:
        if len(set(names)) != len(names):
            raise ValueError(f"repeated column names: {sorted({n for n in names if names.count(n) > 1})}")

    def _known(self, names: Iterable[str]) -> list[str]:
        names = list(names)
        for n in names:
            if n not in self.columns:
                raise KeyError(f"no column {n!r}; there are {self.columns}")
        return names

    # -- projection ---------------------------------------------------------------

    def select(self, *exprs) -> Frame:
        """Columns and expressions; only reductions give one row."""
        es = self._expanded(_flat(exprs))
        self._checked([n for n, _, _ in es])
        if any(e.exploding for _, e, _ in es):
            return self._exploded(es)
        df = self._with_order() if self._needs_order(es) else self.df
        if es and all(e.shape == REDUCED and not e.literal or e.literal for _, e, _ in es) and not all(e.literal for _, e, _ in es):
            made: dict = {}
            return Frame(df.agg(*[e.build(Context(df, grouped=True, known=k, made=made)).alias(n) for n, e, k in es]))
        if es and all(e.shape == SEQUENCE for _, e, _ in es):
            lists = df.agg(*[e.build(Context(df, grouped=True, known=k)).alias(n) for n, e, k in es])
            some = [F.size(F.col(f"`{n}`")) > 0 for n, _, _ in es]
            return Frame(lists.where(functools.reduce(lambda x, y: x | y, some))).explode([n for n, _, _ in es])
        if not any(e.windowed for _, e, _ in es):
            return Frame(df.select(*[e.build(Context(df, known=k)).alias(n) for n, e, k in es]))
        df, built = self._built(es)
        hidden = {f"__out{i}": c for i, c in enumerate(built.values())}
        own = self._own(df.withColumns(hidden), list(hidden))
        return Frame(own.df.toDF(*built))

    def _exploded(self, es: list[tuple[str, Expr, dict]]) -> Frame:
        """over(.., mapping_strategy='explode'): each partition's lists as rows, partitions as they first appear."""
        keys = es[0][1].exploding
        if any(e.exploding is None or [k.name for k in e.exploding[0]] != [k.name for k in keys[0]] for _, e, _ in es):
            raise ValueError("exploded columns need the same partitions")
        df = self._with_order()
        by = [k.build(Context(df)).alias(f"__k{i}") for i, k in enumerate(keys[0])]
        lists = df.groupBy(*by).agg(*[e.exploding[1].build(Context(df, grouped=True, known=k)).alias(n) for n, e, k in es], F.min(ORDER).alias(ORDER)).orderBy(ORDER)
        names = [n for n, _, _ in es]
        return Frame(lists.select(*names)).explode(names)

    def select_exprs(self, *exprs) -> Frame: return self.select(*exprs)  # noqa: E704

    def with_columns(self, *exprs, **named) -> Frame:
        """Columns added or replaced; all see the original table."""
        es = self._expanded([*_flat(exprs), *[ex.as_expr(v).alias(k) for k, v in named.items()]])
        self._checked([n for n, _, _ in es])
        df, built = self._built(es)
        hidden = {n: f"__out{i}" for i, n in enumerate(built)}
        names = list(dict.fromkeys([*self.columns, *built]))
        out = self._own(df.withColumns({hidden[n]: c for n, c in built.items()}), [hidden.get(n, n) for n in names])
        return Frame(out.df.toDF(*names))

    def with_column(self, series: Series) -> Frame: return self.hstack(series.frame)  # noqa: E704

    def insert_column(self, at: int, column) -> Frame:
        before = self.columns
        out = self.hstack(column.frame) if isinstance(column, Series) else self.with_columns(column)
        new = [c for c in out.columns if c not in before]
        return out.select(*[*before[:at], *new, *before[at:]])

    def drop(self, *names) -> Frame:
        return Frame(self.df.drop(*self._known(_flat(names))))

    def rename(self, mapping: dict[str, str] | Callable[[str], str], strict: bool = True) -> Frame:
        m = {c: mapping(c) for c in self.columns} if callable(mapping) else dict(mapping)
        if strict:
            self._known(m)
        names = [m.get(c, c) for c in self.columns]
        self._checked(names)
        return Frame(self.df.toDF(*names))

    def cast(self, dtypes: dict, strict: bool = True) -> Frame:
        self._known(dtypes)
        return self.with_columns(*[col(c).cast(t, strict) for c, t in dtypes.items()])

    def with_row_index(self, name: str = "index", offset: int = 0) -> Frame:
        """A number per row. Rows before each partition are counted once, so no task sees all rows.

        Rows that a shuffle deals out are written first, so that both looks at them see the same partitions.
        """
        df = Frame(_fixed(self.df))._with_order()
        part = F.shiftrightunsigned(ORDER, 33)
        sizes = df.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
        starts = sizes.select("__p", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
        # One row per partition.
        out = df.join(F.broadcast(starts), part == F.col("__p"))
        inside = F.col(ORDER).bitwiseAND(F.lit((1 << 33) - 1))
        return Frame(out.select((F.col("__s") + inside + offset).alias(name), *[F.col(f"`{c}`") for c in self.columns]))

    def pack_struct(self, name: str, columns: list[str]) -> Frame:
        self._known(columns)
        rest = [c for c in self.columns if c not in columns]
        return Frame(self.df.select(*rest, F.struct(*columns).alias(name)))

    def unnest(self, *names) -> Frame:
        names = _flat(names)
        out = [c for n in self.columns for c in ([F.col(f"`{n}`.`{f}`").alias(f) for f in self.schema[n].names] if n in names else [F.col(f"`{n}`")])]
        return Frame(self.df.select(*out))

    # -- rows -------------------------------------------------------------------------

    def filter(self, *predicates) -> Frame:
        """Rows where all are true. Windows and reductions in a predicate are columns first."""
        for p in _flat(predicates):
            if not isinstance(p, Expr):
                raise TypeError("a filter is an expression")
        ps = [("__f%d" % k, p, {}) for k, p in enumerate(_flat(predicates))]
        plain = [p for p in ps if p[1].shape == ROW and not p[1].ordered and not p[1].windowed]
        df = self.df
        for _, p, k in plain:
            df = df.where(p.build(Context(df, known=k)))
        rest = [p for p in ps if p not in plain]
        if rest:
            names = df.columns
            df, built = Frame(df)._built(rest, True)
            df = df.withColumns(built)
            for n in built:
                df = df.where(F.col(n))
            return self._own(df, names)
        return Frame(df)

    def slice(self, offset: int, length: int | None = None) -> Frame:
        if offset >= 0:
            out = self.df.offset(offset) if offset else self.df
            return Frame(out if length is None else out.limit(length))
        numbered = self.with_row_index("__n").df
        n = numbered.agg(F.count(F.lit(1))).first()[0]
        low = max(0, n + offset)
        high = n if length is None else min(n, n + offset + length)
        return Frame(numbered.where((F.col("__n") >= low) & (F.col("__n") < high)).drop("__n"))

    def head(self, n: int = 5) -> Frame: return Frame(self.df.limit(n)) if n >= 0 else self.slice(0, max(0, self.height + n))  # noqa: E704
    def limit(self, n: int = 5) -> Frame: return self.head(n)  # noqa: E704
    def tail(self, n: int = 5) -> Frame: return self.slice(-n) if n > 0 else self.slice(-n) if n else self.clear()  # noqa: E704
    def reverse(self) -> Frame: return Frame(self._with_order().orderBy(F.desc(ORDER)).drop(ORDER))  # noqa: E704
    def shift(self, n: int = 1, fill_value=None) -> Frame: return self.select(*[col(c).shift(n, fill_value) for c in self.columns])  # noqa: E704

    def gather(self, indices: list[int], null_on_oob: bool = False) -> Frame:
        """Rows by position, repeats and all; a negative one counts from the end."""
        n = self.height if any(k < 0 for k in indices) or not null_on_oob else None
        places = [k + n if k < 0 else k for k in indices]
        if not null_on_oob and any(k < 0 or k >= n for k in places):
            raise IndexError("a row index is out of bounds")
        spark = self.df.sparkSession
        want = spark.createDataFrame(list(enumerate(places)), "__o long, __k long").coalesce(1)
        found = want.join(self.with_row_index("__n").df, F.col("__k") == F.col("__n"), "left" if null_on_oob else "inner")
        return Frame(found.orderBy("__o").select(*[f"`{c}`" for c in self.columns]))

    def take(self, indices: list[int]) -> Frame: return self.gather(indices)  # noqa: E704
    def gather_every(self, n: int, offset: int = 0) -> Frame: return Frame(self.with_row_index("__n").df.where((F.col("__n") >= offset) & ((F.col("__n") - offset) % n == 0)).drop("__n"))  # noqa: E704

    def sample(self, n: int | None = None, fraction: float | None = None, with_replacement: bool = False, shuffle: bool = False, seed: int = 0) -> Frame:
        """Exactly n rows (or floor(fraction * height)): those with the smallest seeded hashes of their places."""
        numbered = self.with_row_index("__n").df
        height = numbered.count()
        k = int(fraction * height) if n is None else n
        if with_replacement:
            draws = self.df.sparkSession.range(k).select((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(height, 1)))).alias("__k"), F.col("id").alias("__o"))
            out = draws.join(numbered, F.col("__k") == F.col("__n"))
            return Frame(out.orderBy("__o").drop("__o", "__k", "__n"))
        if k > height:
            raise ValueError("more rows than there are")
        out = numbered.orderBy(F.xxhash64("__n", F.lit(seed)), "__n").limit(k)
        return Frame((out if shuffle else out.orderBy("__n")).drop("__n"))

    def clear(self, n: int = 0) -> Frame:
        rows = self.df.sparkSession.range(n)
        return Frame(rows.select(*[F.lit(None).cast(t).alias(c) for c, t in self.schema.items()]))

    def drop_nulls(self, subset=None) -> Frame:
        df = self.df
        for c in _listed(subset) or self.columns:
            df = df.where(F.col(f"`{c}`").isNotNull())
        return Frame(df)

    def drop_nans(self, subset=None) -> Frame:
        df = self.df
        for c in _listed(subset) or [c for c, t in self.schema.items() if numeric.is_float(t)]:
            df = df.where(F.col(f"`{c}`").isNull() | ~F.isnan(F.col(f"`{c}`")))
        return Frame(df)

    def fill_null(self, value=None, strategy: str | None = None, limit: int | None = None, subset=None) -> Frame:
        names = _listed(subset) or self.columns
        if strategy is None:
            kind = self.df.sparkSession.range(1).select(F.lit(value).alias("v")).schema[0].dataType
            fits = [c for c in names if self.schema[c] == kind or numeric.is_integer(kind) and numeric.is_integer(self.schema[c])]
            return self.with_columns(*[col(c).fill_null(ex.lit(value, self.schema[c])) for c in fits])
        numbers = [c for c in names if isinstance(self.schema[c], T.NumericType)]
        if strategy == "forward":
            return self.with_columns(*[col(c).forward_fill(limit) for c in names])
        if strategy == "backward":
            return self.with_columns(*[col(c).backward_fill(limit) for c in names])
        if strategy in ("zero", "one"):
            return self.with_columns(*[col(c).fill_null(ex.lit(int(strategy == "one"), self.schema[c])) for c in numbers])
        kinds = {"min": Expr.min, "max": Expr.max, "mean": Expr.mean}
        # One row of values, computed once and sent along.
        row = self.select(*[kinds[strategy](col(c)).alias(c) for c in numbers]).df.first()
        return self.with_columns(*[col(c).fill_null(ex.lit(row[c], None if strategy == "mean" else self.schema[c])) for c in numbers if row[c] is not None])

    def fill_nan(self, value: float) -> Frame:
        return self.with_columns(*[col(c).fill_nan(value) for c, t in self.schema.items() if numeric.is_float(t)])

    # -- order ------------------------------------------------------------------------

    def _keys(self, by: Iterable, descending, nulls_last) -> tuple[DataFrame, list[Column]]:
        es = self._expanded(by)
        df = self._with_order()
        down = [descending] * len(es) if isinstance(descending, bool) else list(descending)
        last = [nulls_last] * len(es) if isinstance(nulls_last, bool) else list(nulls_last)
        return df, [ex._sort_key(e.build(Context(df, known=k)), d, n) for (_, e, k), d, n in zip(es, down, last, strict=True)]

    def sort(self, *by, descending=False, nulls_last=True, maintain_order: bool = False) -> Frame:
        """Sorted; nulls last unless asked otherwise, NaN largest."""
        df, keys = self._keys(_flat(by), descending, nulls_last)
        return Frame(df.orderBy(*keys, *([ORDER] if maintain_order else [])).drop(ORDER))

    def arg_sort(self, *by, descending=False, nulls_last=True) -> Frame:
        return Frame(self.with_row_index("__n").sort(*_flat(by), "__n", descending=[*([descending] * len(_flat(by)) if isinstance(descending, bool) else descending), False], nulls_last=nulls_last).df.select(F.col("__n").alias("index")))

    def top_k(self, k: int, by, descending=False) -> Frame:
        """The largest k by the keys; nulls last. A bounded heap per task."""
        names = _listed(by)
        flip = [not d for d in ([descending] * len(names) if isinstance(descending, bool) else descending)]
        return Frame(self.sort(*names, descending=flip).df.limit(k))

    def bottom_k(self, k: int, by, descending=False) -> Frame:
        return Frame(self.sort(*_listed(by), descending=descending).df.limit(k))

    # -- joins ------------------------------------------------------------------------

    def join(self, other: Frame, on=None, how: str = "inner", left_on=None, right_on=None, suffix: str = "_right", coalesce: bool | None = None) -> Frame:
        """Equi-join. Null keys never match, NaN equals NaN. Shared names of the right side get the suffix."""
        if how == "cross":
            renamed = other.rename({c: c + suffix for c in other.columns if c in self.columns})
            return Frame(self.df.crossJoin(renamed.df))
        lk, rk = (_listed(on), _listed(on)) if on is not None else (_listed(left_on), _listed(right_on))
        self._known(lk)
        other._known(rk)
        for a, b in zip(lk, rk, strict=True):
            if self.schema[a] != other.schema[b]:
                raise TypeError(f"join keys differ in type: {a} {self.schema[a]}, {b} {other.schema[b]}")
            if isinstance(self.schema[a], T.ArrayType):
                raise TypeError("a list is no join key")
        left = self.df.toDF(*[f"l{k}" for k in range(self.width)])
        right = other.df.toDF(*[f"r{k}" for k in range(other.width)])
        at = lambda names, n, side: F.col(f"{side}{names.index(n)}")
        test = [at(self.columns, a, "l") == at(other.columns, b, "r") for a, b in zip(lk, rk, strict=True)]
        if how in ("semi", "anti"):
            return Frame(left.join(right, test, f"left_{how}").toDF(*self.columns))
        joined = left.join(right, test, how)
        merged = coalesce if coalesce is not None else how != "full"
        # A right join is the mirror image of a left one.
        main, far, main_keys, far_keys, a, b = (other, self, rk, lk, "r", "l") if how == "right" else (self, other, lk, rk, "l", "r")
        out, names = [], set()
        for c in main.columns:
            v = at(main.columns, c, a)
            if merged and how == "full" and c in main_keys:
                v = F.coalesce(v, at(far.columns, far_keys[main_keys.index(c)], b))
            if how == "right":
                continue
            out.append(v.alias(c))
            names.add(c)
        if how == "right":
            for c in self.columns:
                if merged and c in lk:
                    continue
                out.append(at(self.columns, c, "l").alias(c))
                names.add(c)
            rest = list(other.columns)
        else:
            rest = [c for c in far.columns if not (merged and c in far_keys)]
        for c in rest:
            shown = c + suffix if c in names else c
            out.append(at(other.columns, c, "r").alias(shown))
        frame = Frame(joined.select(*out))
        self._checked(frame.columns)
        return frame

    def join_asof(self, other: Frame, on: str | None = None, left_on: str | None = None, right_on: str | None = None, by=None, strategy: str = "backward", tolerance=None, allow_exact_matches: bool = True, suffix: str = "_right", spread: bool = False) -> Frame:
        """For each left row the nearest right row by key, within groups ``by``.

        Both sides are put in one sequence by key; the last right row so far is the match. One
        exchange by the group's keys, no pairs. Without ``by``, and with ``spread`` (for groups
        that hold much of the table), keys are cut into ranges at quantiles, and each range
        inherits its group's last right row of those before it, so no task needs all rows of a
        group. Ties of ``nearest`` prefer the later key; of equal keys the last row counts.
        """
        lo, ro = (on, on) if on else (left_on, right_on)
        groups = _listed(by)
        if self.schema[lo] != other.schema[ro]:
            raise TypeError("as-of keys differ in type")
        payload = [c for c in other.columns if c not in groups and not (on and c == ro)]
        shown = {c: c + suffix if c in self.columns else c for c in payload}
        cut = spread or not groups
        mine, far_rows = (Frame(_fixed(f.df)) if cut else f for f in (self, other))
        held = F.struct(*dict.fromkeys([ro, *payload]))
        left = mine._with_order().select(F.struct(*self.columns).alias("__l"), F.lit(None).cast(other.df.select(held).schema[0].dataType).alias("__r"), F.col(lo).alias("__k"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(ORDER))
        right = far_rows._with_order().where(F.col(ro).isNotNull()).select(F.lit(None).cast(left.schema["__l"].dataType).alias("__l"), held.alias("__r"), F.col(ro).alias("__k"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(ORDER))
        both = left.unionByName(right).withColumn("__t", F.col("__r").isNotNull())
        parts = [f"__g{i}" for i in range(len(groups))]
        ways = {"backward": ["backward"], "forward": ["forward"], "nearest": ["backward", "forward"]}[strategy]
        if cut:
            both = both.withColumn("__p", _ranges(both, F.col("__k")))
        for way in ways:
            # With exact matches a right row comes before the left rows of its key, in the direction of the search.
            first = F.col("__t") != F.lit(allow_exact_matches)
            order = [F.col("__k").asc_nulls_first() if way == "backward" else F.col("__k").desc_nulls_last(), first.asc(), F.col(ORDER).asc()]
            if not cut:
                both = both.withColumn(f"__{way}", F.last("__r", True).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
            else:
                both = self._asof_ranges(both, parts, order, way)
        found = both.where("not __t")
        pick = F.col(f"__{ways[0]}")
        if len(ways) == 2:
            b, f, k = F.col("__backward"), F.col("__forward"), F.col("__k")
            far = lambda x, y: _distance(x, y, self.schema[lo])
            pick = F.when(b.isNull(), f).when(f.isNull(), b).when(far(k, b[ro]) < far(f[ro], k), b).otherwise(f)
        if tolerance is not None:
            wide = temporal.interval(tolerance).micros if isinstance(tolerance, str) else tolerance
            pick = F.when(F.abs(_distance(F.col("__k"), pick[ro], self.schema[lo])) <= wide, pick)
        pick = F.when(F.col("__k").isNotNull(), pick)
        for i, _ in enumerate(groups):
            pick = F.when(F.col(f"__g{i}").isNotNull(), pick)
        out = found.withColumn("__m", pick)
        return Frame(out.select(*[F.col("__l")[c].alias(c) for c in self.columns], *[F.col("__m")[c].alias(shown[c]) for c in payload]))

    @staticmethod
    def _asof_ranges(df: DataFrame, parts: list[str], order: list[Column], way: str) -> DataFrame:
        """The match within each group's rows of a range __p of keys; where there is no right row yet, the group's last one of the ranges before."""
        down = way == "forward"
        inside = Window.partitionBy("__p", *parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        held = F.struct(F.col("__k"), (-F.col(ORDER) if down else F.col(ORDER)).alias("o"), F.col("__r"))
        # One row per range and group.
        ends = df.groupBy("__p", *parts).agg((F.min if down else F.max)(F.when(F.col("__t"), held)).alias("e"))
        before = Window.partitionBy(*parts).orderBy(F.desc("__p") if down else F.col("__p")).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col("__p").alias("__q"), *[F.col(g).alias(f"{g}_") for g in parts], F.last("e", True).over(before)["__r"].alias("__c"))
        same = functools.reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in parts], F.col("__p") == F.col("__q"))
        out = df.withColumn("__m", F.last("__r", True).over(inside)).join(carried if parts else F.broadcast(carried), same, "left")
        return out.withColumn(f"__{way}", F.coalesce("__m", "__c")).drop("__q", "__c", "__m", *[f"{g}_" for g in parts])

    # -- grouping ---------------------------------------------------------------------

    def group_by(self, *keys, maintain_order: bool = False) -> GroupBy: return GroupBy(self, _flat(keys), maintain_order)  # noqa: E704
    def group_by_rollup(self, *keys) -> GroupingSets:  # noqa: E704
        names = _flat(keys)
        return GroupingSets(self, names, [names[:k] for k in range(len(names), -1, -1)])

    def group_by_cube(self, *keys) -> GroupingSets:
        names = _flat(keys)
        return GroupingSets(self, names, [[n for i, n in enumerate(names) if not m >> (len(names) - 1 - i) & 1] for m in range(1 << len(names))])

    def group_by_grouping_sets(self, sets: list[list[str]]) -> GroupingSets:
        return GroupingSets(self, list(dict.fromkeys(n for s in sets for n in s)), [list(dict.fromkeys(s)) for s in sets])

    def group_by_dynamic(self, index: str, every: str, period: str | None = None, offset: str = "0s", closed: str = "left", label: str = "left", by=None) -> TimeGroupBy:
        return TimeGroupBy(self, index, every, period or every, offset, closed, label, _listed(by))

    def rolling(self, index: str, period: str, offset: str | None = None, closed: str = "right", by=None) -> RollingGroupBy:
        return RollingGroupBy(self, index, period, offset, closed, _listed(by))

    def group_indices(self, *keys) -> Frame:
        """Per row its group's number, groups in order of appearance, and the group's first row."""
        names = _flat(keys)
        numbered = self.with_row_index("__n").df
        firsts = numbered.groupBy(*names).agg(F.min("__n").alias("first"))
        ranked = Frame(firsts.orderBy("first")).with_row_index("group").df.select(*[F.col(n).alias(f"__{n}") for n in names], "group", "first")
        out = numbered.join(ranked, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names])
        return Frame(out.orderBy("__n").select(F.col("__n").alias("row"), "group", "first"))

    def pivot(self, on: str, index, values: str, aggregate_function: str | None = None, on_columns: list | None = None) -> Frame:
        """Long to wide. Without an aggregate a cell with several rows raises."""
        df = self._with_order()
        v, o = F.col(f"`{values}`"), F.col(ORDER)
        kinds = {"first": F.min_by(F.struct(v.alias("v")), o)["v"], "last": F.max_by(F.struct(v.alias("v")), o)["v"], "sum": F.sum(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.count(v), "len": F.count(F.lit(1)), "median": F.percentile(v.cast("double"), F.lit(0.5))}
        once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several rows in a cell")).cast(self.schema[values])).otherwise(F.first(v))
        grouped = df.groupBy(*_listed(index)).pivot(on, on_columns) if on_columns else df.groupBy(*_listed(index)).pivot(on)
        return Frame(grouped.agg(kinds[aggregate_function] if aggregate_function else once))

    def unpivot(self, on, index=None, variable_name: str = "variable", value_name: str = "value") -> Frame:
        """Wide to long: by column of ``on``, then row."""
        names, ids = _listed(on), _listed(index)
        kinds = {self.schema[n] for n in names}
        if len(kinds) > 1:
            raise TypeError("unpivoted columns differ in type")
        df = self._with_order().select(*ids, ORDER, F.posexplode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("v")) for n in names])))
        return Frame(df.orderBy("pos", ORDER).select(*ids, F.col("col.n").alias(variable_name), F.col("col.v").alias(value_name)))

    # -- sets -------------------------------------------------------------------------

    def unique(self, subset=None, keep: str = "any", maintain_order: bool = False) -> Frame:
        names = _listed(subset) or self.columns
        if keep == "any" and not maintain_order:
            return Frame(self.df.dropDuplicates(names))
        df = self._with_order()
        if keep == "none":
            out = df.withColumn("__c", F.count(F.lit(1)).over(Window.partitionBy(*names))).where("__c = 1")
        else:
            # The first or last row of each key by partial aggregation, not by sorting groups.
            pick = F.max_by if keep == "last" else F.min_by
            out = df.groupBy(*names).agg(pick(F.struct(*self.columns), ORDER).alias("__s"), (F.max if keep == "last" else F.min)(ORDER).alias("__o")).select("__s.*", F.col("__o").alias(ORDER))
        return Frame((out.orderBy(ORDER) if maintain_order else out).select(*self.columns))

    def is_duplicated(self, subset=None) -> Frame: return self._flag(subset, lambda n: n > 1)  # noqa: E704
    def is_unique(self, subset=None) -> Frame: return self._flag(subset, lambda n: n == 1)  # noqa: E704

    def _flag(self, subset, test) -> Frame:
        df = self._with_order()
        n = F.count(F.lit(1)).over(Window.partitionBy(*(_listed(subset) or self.columns)))
        return Frame(df.withColumn("__v", test(n)).orderBy(ORDER).select(F.col("__v").alias("value")))

    def explode(self, columns) -> Frame:
        """A row per element; empty and null lists give one null row; several lists are of one length."""
        names = _listed(columns)
        if len(names) == 1:
            return Frame(self.df.select(*[F.explode_outer(c).alias(c) if c == names[0] else F.col(f"`{c}`") for c in self.columns]))
        sizes = [F.coalesce(F.size(c), F.lit(-1)) for c in names]
        same = sizes[0] == sizes[1]
        for s in sizes[2:]:
            same = same & (sizes[0] == s)
        zipped = F.when(same, F.arrays_zip(*names)).otherwise(F.raise_error(F.lit("lists differ in length")))
        df = self.df.withColumn("__z", F.explode_outer(zipped))
        return Frame(df.select(*[F.col("__z")[c].alias(c) if c in names else F.col(f"`{c}`") for c in self.columns]))

    def vstack(self, other: Frame) -> Frame: return concat([self, other])  # noqa: E704
    def concat(self, other: Frame, how: str = "vertical") -> Frame: return concat([self, other], how)  # noqa: E704
    def hstack(self, other: Frame) -> Frame: return concat([self, other], "horizontal")  # noqa: E704
    def union_distinct(self, other: Frame) -> Frame: return concat([self, other]).unique()  # noqa: E704
    def intersect(self, other: Frame) -> Frame: return Frame(self.df.intersect(other.df))  # noqa: E704
    def except_(self, other: Frame) -> Frame: return Frame(self.df.subtract(other.df))  # noqa: E704

    # -- whole-table reductions -----------------------------------------------------------

    def _whole(self, f: Callable[[Expr], Expr], fits: Callable[[T.DataType], bool] = lambda t: isinstance(t, (T.NumericType, T.BooleanType))) -> Frame:
        out = [f(col(c)).alias(c) if fits(t) else ex.lit(None, t).alias(c) for c, t in self.schema.items()]
        return self.select(*out)

    def sum(self) -> Frame: return self._whole(Expr.sum)  # noqa: E704
    def mean(self) -> Frame: return self._whole(Expr.mean)  # noqa: E704
    def median(self) -> Frame: return self._whole(Expr.median)  # noqa: E704
    def product(self) -> Frame: return self._whole(Expr.product, lambda t: isinstance(t, T.NumericType))  # noqa: E704
    def std(self, ddof: int = 1) -> Frame: return self._whole(lambda e: e.std(ddof))  # noqa: E704
    def var(self, ddof: int = 1) -> Frame: return self._whole(lambda e: e.var(ddof))  # noqa: E704
    def quantile(self, q: float, interpolation: str = "nearest") -> Frame: return self._whole(lambda e: e.quantile(q, interpolation))  # noqa: E704
    def min(self) -> Frame: return self._whole(Expr.min, lambda t: True)  # noqa: E704
    def max(self) -> Frame: return self._whole(Expr.max, lambda t: True)  # noqa: E704
    def count(self) -> Frame: return self._whole(Expr.count, lambda t: True)  # noqa: E704
    def null_count(self) -> Frame: return self._whole(Expr.null_count, lambda t: True)  # noqa: E704
    def n_unique(self, subset=None) -> int: return self.df.select(*(_listed(subset) or self.columns)).distinct().count()  # noqa: E704

    def describe(self, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> Frame:
        """count, null_count, mean, std, min, percentiles, max: a row per statistic, all from one pass."""
        stats: list[tuple[str, Callable[[Expr], Expr], bool]] = [("count", Expr.count, False), ("null_count", Expr.null_count, False), ("mean", Expr.mean, True), ("std", Expr.std, True), ("min", Expr.min, False)]
        stats += [(f"{100 * p:g}%", lambda e, p=p: e.quantile(p), True) for p in percentiles]
        stats += [("max", Expr.max, False)]
        number = {c: isinstance(t, (T.NumericType, T.BooleanType)) for c, t in self.schema.items()}
        wide = {}
        for k, (_, f, numbers) in enumerate(stats):
            for c in self.columns:
                if not numbers or number[c]:
                    wide[f"{k}\x00{c}"] = f(col(c))
        row = self.select(*[e.alias(n) for n, e in wide.items()]).df
        kind = lambda c: "double" if number[c] else "string"
        rows = [F.struct(F.lit(s).alias("statistic"), *[(F.col(f"`{k}\x00{c}`").cast(kind(c)) if f"{k}\x00{c}" in wide else F.lit(None).cast(kind(c))).alias(c) for c in self.columns]) for k, (s, _, _) in enumerate(stats)]
        return Frame(row.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))


def _flat(items: Iterable) -> list:
    out = []
    for x in items:
        out += list(x) if isinstance(x, (list, tuple)) else [x]
    return out


def _geo():
    from brindle.functions import geo

    return geo


def _writers():
    from brindle.sources import writers

    return writers


def _written(df: DataFrame) -> DataFrame:
    """Fix which rows are in which partition, where executors share a folder (a local one only where none is set)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given:
            import atexit
            import shutil
            import tempfile

            given = tempfile.mkdtemp(prefix="brindle-")
            atexit.register(shutil.rmtree, given, True)
        context.setCheckpointDir(given)
    return df.checkpoint()


#: Operators that leave rows where a scan has put them.
_IN_PLACE = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "Generate", "SubqueryAlias", "Relation", "RelationV2", "DataSourceV2ScanRelation", "ResolvedHint", "OneRowRelation"}


def _fixed(df: DataFrame) -> DataFrame:
    """The rows such that every look at them sees the same partitions: as they are if only scans feed them, else written."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        if plan.getClass().getSimpleName() not in _IN_PLACE:
            return _written(df)
        children = plan.children()
        plans += [children.apply(k) for k in range(children.size())]
    return df


def _ranges(df: DataFrame, key: Column, most: int = 256) -> Column:
    """The number of a row's range of keys, of about equal ranges as there are shuffle partitions; equal keys share one."""
    n = min(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = df.select(key.alias("k")).schema[0].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        key = temporal.micros(key, kind.simpleString())
    found = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 1000)).first()[0] if n > 1 else []
    cuts = [F.lit(x) for x in sorted(set(found or []))]

    def number(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < cuts[mid], number(low, mid)).otherwise(number(mid + 1, high))

    return number(0, len(cuts))


def _distance(a: Column, b: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return temporal.micros(a, t.simpleString()) - temporal.micros(b, t.simpleString())
    if isinstance(t, T.DateType):
        return F.datediff(a, b).cast("bigint") * 86_400_000_000
    return a - b


def concat(frames: list[Frame], how: str = "vertical") -> Frame:
    """vertical: same names and types. diagonal: union of names. horizontal: same height, side by side."""
    if how == "horizontal":
        numbered = [f.with_row_index("__n").df for f in frames]
        Frame._checked([c for f in frames for c in f.columns])
        out = numbered[0]
        for k, other in enumerate(numbered[1:]):
            out = out.join(other.withColumnRenamed("__n", f"__n{k}"), F.col("__n") == F.col(f"__n{k}"), "full")
            lost = F.col("__n").isNull() | F.col(f"__n{k}").isNull()
            out = out.withColumn("__n", F.when(lost, F.raise_error(F.lit("heights differ")).cast("bigint")).otherwise(F.col("__n"))).drop(f"__n{k}")
        return Frame(out.orderBy("__n").drop("__n"))
    out = frames[0].df
    for f in frames[1:]:
        if how == "diagonal":
            out = out.unionByName(f.df, allowMissingColumns=True)
            continue
        if [(x.name, x.dataType) for x in f.df.schema.fields] != [(x.name, x.dataType) for x in out.schema.fields]:
            raise TypeError("tables differ in names or types")
        out = out.union(f.df)
    return Frame(out)


class GroupBy:
    """Groups by keys: null is a group, NaN one group, -0.0 equals 0.0."""

    def __init__(self, frame: Frame, keys: list, maintain_order: bool = False):
        self.frame, self.keys, self.maintain_order = frame, keys, maintain_order

    def _prepared(self, ordered: bool) -> tuple[DataFrame, list[Column]]:
        es = self.frame._expanded(self.keys)
        df = self.frame._with_order() if ordered or self.maintain_order or self.frame._needs_order(es) else self.frame.df
        return df, [e.build(Context(df, known=k)) for _, e, k in es]

    def agg(self, *exprs, **named) -> Frame:
        es = self.frame._expanded([*_flat(exprs), *[v.alias(k) for k, v in named.items()]])
        df, keys = self._prepared(any(e.ordered or e.shape != REDUCED for _, e, _ in es))
        Frame._checked([*[n for n, _, _ in self.frame._expanded(self.keys)], *[n for n, _, _ in es]])
        if not es:
            return Frame(df.select(*[k.alias(n) for k, (n, _, _) in zip(keys, self.frame._expanded(self.keys), strict=True)]).distinct())
        ranks = ex.Ranks(df, keys)
        ctx = lambda k: Context(df, grouped=True, known=k, ranks=ranks)
        # A bare column in a group is the list of its values.
        out = [(e.build(ctx(k)) if e.shape != ROW or e.literal else e.implode().build(ctx(k))).alias(n) for n, e, k in es]
        # Keys go by other names meanwhile: a value may have a key's name.
        named = [n for n, _, _ in self.frame._expanded(self.keys)]
        grouped = ranks.df.groupBy(*[k.alias(f"__key{i}") for i, k in enumerate(keys)]).agg(*out, *([F.min(ORDER).alias(ORDER)] if self.maintain_order else []))
        grouped = grouped.orderBy(ORDER).drop(ORDER) if self.maintain_order else grouped
        return Frame(grouped.toDF(*named, *[n for n, _, _ in es]))

    def _each(self, f: Callable[[Expr], Expr]) -> Frame:
        names = {n for n, _, _ in self.frame._expanded(self.keys)}
        return self.agg(*[f(col(c)).alias(c) for c in self.frame.columns if c not in names])

    def len(self, name: str = "len") -> Frame: return self.agg(ex.len_().alias(name))  # noqa: E704
    def sum(self) -> Frame: return self._each(Expr.sum)  # noqa: E704
    def mean(self) -> Frame: return self._each(Expr.mean)  # noqa: E704
    def min(self) -> Frame: return self._each(Expr.min)  # noqa: E704
    def max(self) -> Frame: return self._each(Expr.max)  # noqa: E704
    def median(self) -> Frame: return self._each(Expr.median)  # noqa: E704
    def first(self) -> Frame: return self._each(Expr.first)  # noqa: E704
    def last(self) -> Frame: return self._each(Expr.last)  # noqa: E704
    def n_unique(self) -> Frame: return self._each(Expr.n_unique)  # noqa: E704
    def quantile(self, q: float, interpolation: str = "nearest") -> Frame: return self._each(lambda e: e.quantile(q, interpolation))  # noqa: E704
    def head(self, n: int = 5) -> Frame: return self._ends(n, False)  # noqa: E704
    def tail(self, n: int = 5) -> Frame: return self._ends(n, True)  # noqa: E704

    def _ends(self, n: int, tail: bool) -> Frame:
        df, keys = self._prepared(True)
        w = Window.partitionBy(*keys)
        out = df.withColumn("__k", F.row_number().over(w.orderBy(F.desc(ORDER) if tail else F.col(ORDER)))).where(F.col("__k") <= n)
        out = out.withColumn("__g", F.min(ORDER).over(w))
        return Frame(out.orderBy("__g", ORDER).select(*self.frame.columns))


class GroupingSets:
    """Several groupings at once; a set listed twice gives its rows twice."""

    def __init__(self, frame: Frame, keys: list[str], sets: list[list[str]]):
        self.frame, self.keys, self.sets = frame, keys, sets

    def agg(self, *exprs) -> Frame:
        es = self.frame._expanded(_flat(exprs))
        df = self.frame._with_order() if any(e.ordered for _, e, _ in es) else self.frame.df
        out = [e.build(Context(df, grouped=True, known=k)).alias(n) for n, e, k in es]
        grouped = df.groupingSets([[F.col(c) for c in s] for s in self.sets], *[F.col(c) for c in self.keys]).agg(*out)
        totals = sum(not s for s in self.sets)
        if totals and df.isEmpty():  # Spark gives no row for the grand total of nothing
            plain = [(n, e, k) for n, e, k in es if not n.startswith("grouping")]
            one = df.agg(*[e.build(Context(df, grouped=True, known=k)).alias(n) for n, e, k in plain]) if plain else df.sparkSession.range(1).select()
            mask = (1 << len(self.keys)) - 1
            full = one.select(*[F.lit(None).cast(self.frame.schema[c]).alias(c) for c in self.keys], *[F.col(n) if (n, e, k) in plain else F.lit(mask if n == "grouping_id" else 1).cast("bigint").alias(n) for n, e, k in es])
            for _ in range(totals):
                grouped = grouped.unionByName(full)
        return Frame(grouped)


class TimeGroupBy:
    """Windows of a length ``period`` that start every ``every``; empty ones are left out."""

    def __init__(self, frame: Frame, index: str, every: str, period: str, offset: str, closed: str, label: str, by: list[str]):
        self.frame, self.index, self.every, self.period, self.offset, self.closed, self.label, self.by = frame, index, every, period, offset, closed, label, by

    def agg(self, *exprs) -> Frame:
        es = self.frame._expanded(_flat(exprs))
        df = self.frame._with_order()
        kind = df.schema[self.index].dataType.simpleString()
        own = temporal.NAIVE if kind == "date" else kind
        at = F.col(f"`{self.index}`").cast(own)
        every, period, offset = map(temporal.interval, (self.every, self.period, self.offset))
        back = temporal.Interval(-offset.months, -offset.micros)
        low = temporal.offset_by(temporal.truncate(temporal.offset_by(at, back, own), self.every, own), offset, own)
        # Windows that may hold the row: so many starts before its own one, one more for an end that is closed.
        unit = every.months * 30 * temporal._MICROS["d"] + every.micros
        reach = period.months * 31 * temporal._MICROS["d"] + period.micros
        count = -(-reach // unit) + 1
        starts = F.array(*[temporal.offset_by(low, temporal.Interval(-k * every.months, -k * every.micros), own) for k in range(count)])
        df = df.withColumn("__start", F.explode(starts)).withColumn("__end", temporal.offset_by(F.col("__start"), period, own))
        after = at >= F.col("__start") if self.closed in ("left", "both") else at > F.col("__start")
        before = at <= F.col("__end") if self.closed in ("right", "both") else at < F.col("__end")
        df = df.where(after & before)
        out = [e.build(Context(df, grouped=True, known=k)).alias(n) for n, e, k in es]
        shown = {"left": F.col("__start"), "right": F.col("__end"), "datapoint": F.col("__first")}[self.label]
        grouped = df.groupBy(*self.by, "__start", "__end").agg(*out, F.min(at).alias("__first"))
        return Frame(grouped.orderBy(*self.by, "__start").select(*self.by, shown.cast(kind).alias(self.index), *[n for n, _, _ in es]))


class RollingGroupBy:
    """One window per row: (t + offset, t + offset + period], by default the period that ends at the row."""

    def __init__(self, frame: Frame, index: str, period: str, offset: str | None, closed: str, by: list[str]):
        self.frame, self.index, self.closed, self.by = frame, index, closed, by
        self.period = temporal.interval(period)
        self.offset = -self.period if offset is None else temporal.interval(offset)
        if self.period.months or self.offset.months:
            raise ValueError("a rolling window is a fixed duration")

    def agg(self, *exprs) -> Frame:
        es = self.frame._expanded(_flat(exprs))
        df = self.frame._with_order().withColumn("__t", temporal.micros(F.col(f"`{self.index}`"), self.frame.schema[self.index].simpleString()))
        low = self.offset.micros + (0 if self.closed in ("left", "both") else 1)
        high = self.offset.micros + self.period.micros - (0 if self.closed in ("right", "both") else 1)
        w = Window.partitionBy(*self.by).orderBy("__t").rangeBetween(low, high)

        class Framed(Context):
            def reduce(self, aggregate: Column) -> Column:
                return aggregate.over(w)

        out = {n: e.build(Framed(df, known=k)) for n, e, k in es}
        df = df.withColumns({f"__{n}": c for n, c in out.items()})
        return Frame(df.orderBy(ORDER).select(*self.by, self.index, *[F.col(f"`__{n}`").alias(n) for n in out]))


class Series:
    """One column as a table of its own; methods evaluate the matching expression."""

    def __init__(self, frame: Frame):
        self.frame = frame

    @property
    def name(self) -> str: return self.frame.columns[0]  # noqa: E704
    @property
    def dtype(self) -> T.DataType: return self.frame.dtypes[0]  # noqa: E704

    def _scalar(self, e: Expr) -> object: return self.frame.select(e.alias("v")).df.first()[0]  # noqa: E704
    def _like(self, e: Expr) -> Series: return Series(self.frame.select(e.alias(self.name)))  # noqa: E704
    def renamed(self, name: str) -> Series: return Series(self.frame.rename({self.name: name}))  # noqa: E704
    def with_dtype(self, dtype) -> Series: return self.cast(dtype)  # noqa: E704
    def eq(self, value) -> Series: return self._like(col(self.name) == value)  # noqa: E704
    def ne(self, value) -> Series: return self._like(col(self.name) != value)  # noqa: E704
    def apply(self, f: Callable[[Expr], Expr]) -> Series: return self._like(f(col(self.name)))  # noqa: E704
    def value_counts(self, sort: bool = False) -> Frame:  # noqa: E704
        out = self.frame.df.groupBy(self.name).agg(F.count(F.lit(1)).alias("count"))
        return Frame(out.orderBy(F.desc("count")) if sort else out)

    def sort(self, descending: bool = False, nulls_last: bool = True) -> Series: return Series(self.frame.sort(self.name, descending=descending, nulls_last=nulls_last))  # noqa: E704
    def unique(self) -> Series: return Series(self.frame.unique())  # noqa: E704
    def take(self, indices: list[int]) -> Series: return Series(self.frame.gather(indices))  # noqa: E704
    def take_or_null(self, indices: list[int]) -> Series: return Series(self.frame.gather(indices, null_on_oob=True))  # noqa: E704
    def argsort(self, descending: bool = False) -> Series: return Series(self.frame.arg_sort(self.name, descending=descending))  # noqa: E704
    def append(self, other: Series) -> Series: return Series(concat([self.frame, other.renamed(self.name).frame]))  # noqa: E704
    def full_null(self, n: int) -> Series: return Series(self.frame.clear(n))  # noqa: E704
    def equals(self, other: Series) -> bool: return self.frame.equals(other.frame)  # noqa: E704
    def get(self, k: int) -> object: return self.frame.item(k)  # noqa: E704
    def to_values(self) -> list: return [r[0] for r in self.frame.rows()]  # noqa: E704
    def to_string(self) -> str: return self.frame.to_string()  # noqa: E704
    def write_to(self, out) -> None: self.frame.write_to(out)  # noqa: E704
    def is_constant(self) -> bool: return self.frame.n_unique() <= 1  # noqa: E704


def _typed(name: str):
    def values(self) -> pa.Array:
        """The values as an Arrow array of the type."""
        column = self.frame.collect().column(0).combine_chunks()
        return column.cast({"float32": pa.float32(), "float64": pa.float64(), "bool": pa.bool_(), "string": pa.string()}.get(name) or getattr(pa, name)())

    return values


for _n in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "bool", "string", "binary"):
    setattr(Series, f"to_{_n}", _typed(_n))
    setattr(Series, _n, _typed(_n))
for _n in ("list_column", "struct_column", "numeric"):
    setattr(Series, _n, lambda self: self.frame.collect().column(0).combine_chunks())
Series.chunks = lambda self: self.frame.collect().column(0).chunks
Series.n_chunks = lambda self: self.frame.df.rdd.getNumPartitions()
Series.is_chunked = lambda self: self.n_chunks() > 1
Series.rechunk = lambda self: Series(Frame(self.frame.df.coalesce(1)))
Series.geometry_type = lambda self: Series(Frame(self.frame.df.select(_geo().geometry_type(F.col(self.name)).alias(self.name))))
Series.bounding_box = lambda self: Series(Frame(self.frame.df.select(_geo().bounding_box(F.col(self.name)).alias(self.name))))
Series.total_bounds = lambda self: _geo().bounds(self.frame.df, self.name)
Series.crs = lambda self: _geo().crs(self.frame.df, self.name)
for _n in ("head", "tail", "sample", "slice", "reverse"):
    setattr(Series, _n, lambda self, *a, _m=_n, **k: Series(getattr(self.frame, _m)(*a, **k)))
for _n in ("cast", "is_null", "is_not_null", "fill_null", "abs", "round"):
    setattr(Series, _n, lambda self, *a, _m=_n, **k: self._like(getattr(col(self.name), _m)(*a, **k)))
for _n in ("sum", "mean", "min", "max", "median", "quantile", "std", "var", "count", "n_unique", "first", "last", "any", "all", "null_count"):
    setattr(Series, _n, lambda self, *a, _m=_n, **k: self._scalar(getattr(col(self.name), _m)(*a, **k)))


def from_arrow(spark: SparkSession, table: pa.Table) -> Frame:
    return Frame(spark.createDataFrame(table))


def date_range(spark: SparkSession, start: str, end: str, interval: str = "1d", name: str = "date") -> Frame:
    """Dates from start to end, both in; months count from the start."""
    return _range(spark, start, end, interval, name, "date")


def datetime_range(spark: SparkSession, start: str, end: str, interval: str = "1h", name: str = "datetime") -> Frame:
    return _range(spark, start, end, interval, name, "timestamp_ntz")


def _range(spark: SparkSession, start: str, end: str, every: str, name: str, kind: str) -> Frame:
    i = temporal.interval(every)
    a, b = F.lit(start).cast(kind), F.lit(end).cast(kind)
    step = i.micros if not i.months else i.months * 28 * temporal._MICROS["d"] + i.micros
    row = spark.range(1).select(F.floor((temporal.micros(b, kind) - temporal.micros(a, kind)) / step).alias("n")).first()
    df = spark.range(max(0, row["n"] + 1))
    moved = F.add_months(a.cast("date"), F.col("id").cast("int") * i.months) if i.months else a.cast("date")
    rest = temporal.micros(moved, "date") + temporal.clock(a, kind) + F.col("id") * i.micros
    return Frame(df.select(temporal.from_micros(rest, kind).alias(name)).where(F.col(name) <= b))


__all__ = ["Frame", "GroupBy", "GroupingSets", "RollingGroupBy", "Series", "TimeGroupBy", "as_type", "concat", "date_range", "datetime_range", "from_arrow"]
