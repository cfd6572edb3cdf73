"""Windows over a whole table: blocks of rows against plain Python, and plans without a single task."""

import math
import random

import brindle as b
import pytest
from brindle import Frame, col
from brindle import frame as module
from pyspark.sql import functions as F

N = 137
RNG = random.Random(4)
ROWS = [(k, RNG.choice([None, 1.5, 2.0, -3.0, 7.25, 0.5]), RNG.choice("abc"), RNG.randrange(1, 40)) for k in range(N)]
X = [r[1] for r in ROWS]


@pytest.fixture
def f(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", 20)
    return Frame(spark.createDataFrame(ROWS, "k int, x double, g string, t int").repartition(5, "g")).sort("k")


def got(f, *es):
    rows = f.select("k", *[e.alias(f"e{i}") for i, e in enumerate(es)]).rows()
    assert [r[0] for r in rows] == list(range(N))
    return [list(c) for c in zip(*[r[1:] for r in rows], strict=True)]


def running(values, op):
    out, held = [], None
    for v in values:
        held = held if v is None else v if held is None else op(held, v)
        out.append(None if v is None else held)
    return out


def filled(values, limit=10**9):
    return [next((values[j] for j in range(k, max(-1, k - limit - 1), -1) if values[j] is not None), None) for k in range(len(values))]


def test_running_values(f):
    x = col("x")
    add, rest, low, high, product, count, from_end = got(f, x.cum_sum(), x.cum_sum(reverse=True), x.cum_min(), x.cum_max(), x.cum_prod(), x.cum_count(), x.cum_count(reverse=True))
    assert add == pytest.approx(running(X, lambda a, c: a + c)) and rest == pytest.approx(running(X[::-1], lambda a, c: a + c)[::-1])
    assert low == running(X, min) and high == running(X, max)
    assert all(u is None and v is None or math.isclose(u, v, rel_tol=1e-9) for u, v in zip(product, running(X, lambda a, c: a * c), strict=True))
    assert count == [sum(v is not None for v in X[: k + 1]) for k in range(N)] and from_end == [sum(v is not None for v in X[k:]) for k in range(N)]


def test_neighbours(f):
    x, at = col("x"), lambda k: X[k] if 0 <= k < N else None
    two, ahead, filler, change, three, known, known_ahead = got(f, x.shift(2), x.shift(-3), x.shift(25, fill_value=9.0), x.diff(), x.rolling_sum(3, min_samples=2), x.shift(1, ignore_nulls=True), x.shift(-1, ignore_nulls=True))
    assert two == [at(k - 2) for k in range(N)] and ahead == [at(k + 3) for k in range(N)] and filler == [9.0 if k < 25 else at(k - 25) for k in range(N)]
    assert change == [None if at(k - 1) is None or X[k] is None else X[k] - at(k - 1) for k in range(N)]
    windows = [[v for v in X[max(0, k - 2) : k + 1] if v is not None] for k in range(N)]
    assert three == pytest.approx([sum(w) if len(w) >= 2 else None for w in windows])
    assert known == [filled([None, *X])[k] for k in range(N)] and known_ahead == [filled([None, *X[::-1]])[N - 1 - k] for k in range(N)]


def test_fills(f):
    x = col("x")
    ahead, back, limited, near, straight = got(f, x.forward_fill(), x.backward_fill(), x.forward_fill(1), x.interpolate("nearest"), x.interpolate())
    assert ahead == filled(X) and back == filled(X[::-1])[::-1] and limited == filled(X, 1)
    for k in range(N):
        low = next((j for j in range(k, -1, -1) if X[j] is not None), None)
        high = next((j for j in range(k, N) if X[j] is not None), None)
        if low is None or high is None:
            assert straight[k] is None and near[k] is None
        else:
            assert straight[k] == pytest.approx(X[low] if low == high else X[low] + (k - low) / (high - low) * (X[high] - X[low]))
            assert near[k] == (X[low] if k - low < high - k else X[high])


def test_places_and_ranks(f):
    place, low, high, mean, ordinal, dense = (got(f, e)[0] if i == 0 else None for i, e in enumerate([b.int_range()] * 6))
    assert place == list(range(N))
    for method in ("min", "max", "average", "ordinal", "dense"):
        for down in (False, True):
            rows = f.select("k", col("x").rank(method, descending=down).alias("r")).sort("k").rows()
            order = sorted((v for v in X if v is not None), reverse=down)
            spots = {v: [i + 1 for i, w in enumerate(order) if w == v] for v in set(order)}
            for k, r in rows:
                if X[k] is None:
                    assert r is None
                elif method == "ordinal":
                    assert r == spots[X[k]][sum(X[j] == X[k] for j in range(k))]
                else:
                    s = spots[X[k]]
                    assert r == {"min": s[0], "max": s[-1], "average": (s[0] + s[-1]) / 2, "dense": sorted(set(order), reverse=down).index(X[k]) + 1}[method]


def test_totals_in_rows_and_filters(f):
    x, known = col("x"), [v for v in X if v is not None]
    mean = sum(known) / len(known)
    centred, n, share = got(f, x - x.mean(), b.len_().over([]), x.cum_sum() / x.sum())
    assert centred == pytest.approx([None if v is None else v - mean for v in X]) and n == [N] * N
    assert share == pytest.approx([None if v is None else v / sum(known) for v in running(X, lambda a, c: a + c)])
    kept = f.filter(x > x.mean(), b.int_range() > 9).select("k").rows()
    assert [r[0] for r in kept] == [k for k in range(N) if X[k] is not None and X[k] > mean and k > 9]
    assert got(f, x.last()) == [[X[-1]] * N]
    # Two orders in one column: one window over all rows, whose order the result has.
    mixed = dict(f.select("k", (x.cum_sum() + x.rank("dense").cast("float64")).alias("m")).rows())
    places = {v: i + 1 for i, v in enumerate(sorted(set(known)))}
    assert all(mixed[k] is None if v is None else mixed[k] == pytest.approx(s + places[v]) for k, (v, s) in enumerate(zip(X, running(X, lambda a, c: a + c), strict=True)))


def test_other_orders(f):
    order = sorted(range(N), key=lambda k: (ROWS[k][3], k))
    rows = f.select("k", col("x").cum_sum().over(order_by="t").alias("s"), col("x").shift(1).over(order_by="t").alias("p")).rows()
    sums = dict(zip(order, running([X[k] for k in order], lambda a, c: a + c), strict=True))
    before = dict(zip(order, [None, *[X[k] for k in order]], strict=False))
    assert len(rows) == N
    for k, s, p in rows:
        assert (s is None and sums[k] is None) or s == pytest.approx(sums[k])
        assert p == before[k]


def test_ranges_of_time(f, spark):
    e = f.with_columns((b.lit("2024-01-01", "datetime")).alias("a")).df.withColumn("at", F.expr("a + make_dt_interval(0, t)")).withColumn("at", F.expr("CASE WHEN k = 7 THEN NULL ELSE at END"))
    rows = Frame(e).select("k", col("x").rolling_sum_by("at", "3h").alias("s"), col("x").rolling_max_by("at", "70h", closed="both").alias("m")).rows()
    by_size = {k: s for k, s, _ in Frame(e).select("k", col("x").rolling_sum_by("at", "3h").alias("s"), "x").rows()}
    for k, s, _ in rows:
        if k != 7:
            want = [ROWS[j][1] for j in range(N) if j != 7 and ROWS[k][3] - 3 < ROWS[j][3] <= ROWS[k][3] and ROWS[j][1] is not None]
            assert (s is None and not want) or s == pytest.approx(sum(want)), k
            assert by_size[k] is None or by_size[k] == pytest.approx(s)
    rolled = {r[0]: r[1] for r in Frame(e.where("k != 7")).rolling("at", "3h").agg(col("k").max().alias("k"), col("x").sum().alias("s")).select("k", "s").rows()}
    assert rolled


def test_no_window_sees_all_rows(f):
    x = col("x")
    for e in (x.cum_sum(), x.shift(1), x.rolling_mean(4), x.rank(), x.forward_fill(), x.interpolate(), x - x.mean(), x.cum_max().over(order_by="t"), b.int_range(), x.diff()):
        plan = f.select("k", e.alias("e")).df._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            # What one task sorts or reduces is one row per block, partition or table.
            if "SinglePartition" in line:
                below = " ".join(lines[i : i + 3])
                assert "Aggregate" in below, below


def quantile_of(values, q, kind):
    held = sorted(values)
    at = (len(held) - 1) * q
    low, high = held[math.floor(at)], held[math.ceil(at)]
    return {"lower": low, "higher": high, "nearest": held[math.floor(at + 0.5)], "midpoint": (low + high) / 2}[kind]


@pytest.mark.parametrize("kind", ["lower", "higher", "nearest", "midpoint"])
def test_quantiles_without_lists(f, kind):
    x, known = col("x"), [v for v in X if v is not None]
    for q in (0.0, 0.3, 0.5, 0.99, 1.0):
        whole = f.select(x.quantile(q, kind).alias("a"), (x * 2).quantile(q, kind).alias("c"), x.filter(col("g") == "a").quantile(q, kind).alias("d"))
        assert whole.rows()[0] == pytest.approx((quantile_of(known, q, kind), 2 * quantile_of(known, q, kind), quantile_of([r[1] for r in ROWS if r[2] == "a" and r[1] is not None], q, kind)))
    groups = f.group_by("g").agg(x.quantile(0.3, kind).alias("a"), col("t").quantile(0.8, kind).alias("t"), x.filter(col("t") > 20).quantile(0.5, kind).round(1).alias("late"))
    for g, a, t, late in groups.rows():
        own = [r for r in ROWS if r[2] == g]
        assert a == quantile_of([r[1] for r in own if r[1] is not None], 0.3, kind) and t == quantile_of([r[3] for r in own], 0.8, kind)
        assert late == pytest.approx(round(quantile_of([r[1] for r in own if r[1] is not None and r[3] > 20], 0.5, kind) + 1e-12, 1), abs=0.051)
    assert "collect_list" not in groups.explain() + f.select(x.quantile(0.5, kind).alias("a")).explain()
    assert [r[0] for r in f.select((x - x.quantile(0.5, kind)).alias("d")).rows()] == pytest.approx([None if v is None else v - quantile_of(known, 0.5, kind) for v in X])
    assert f.filter(col("k") < 0).select(x.quantile(0.5, kind).alias("a")).rows() == [(None,)] and f.select(b.lit(None, "float64").quantile(0.5, kind).alias("n")).rows() == [(None,)]
