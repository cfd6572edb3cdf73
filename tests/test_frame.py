import datetime as dt
import math

import brindle as b
import pytest
from brindle import Frame, col

NAN, INF = float("nan"), float("inf")


@pytest.fixture()
def small(spark):
    rows = [(3, 1.5, "b", True), (1, NAN, None, False), (None, None, "a", None), (3, -0.0, "b", True), (2, 0.0, "c", False)]
    return Frame(spark.createDataFrame(rows, "i long, f double, s string, b boolean").coalesce(1))


def values(frame, name=None):
    return [r[0] for r in (frame.select(name) if name else frame).rows()]


def test_division_and_modulo(spark):
    f = Frame(spark.createDataFrame([(7, -3), (-7, 3), (-7, -3), (1, 0), (None, 2)], "a long, z long").coalesce(1))
    got = f.select((col("a") // col("z")).alias("d"), (col("a") % col("z")).alias("m"), (col("a") / col("z")).alias("t")).rows()
    assert got[:3] == [(-3, -2, -7 / 3), (-3, 2, -7 / 3), (2, -1, 7 / 3)] and got[3][:2] == (None, None) and got[3][2] == INF and got[4] == (None, None, None)


def test_nan_compares_as_ieee(small):
    assert values(small.select((col("f") == col("f")).alias("x"))) == [True, False, None, True, True]
    assert values(small.select((col("f") > 1.0).alias("x"))) == [True, False, None, False, False]
    assert small.filter(col("f") != col("f")).height == 1


def test_reductions_of_nothing(spark):
    f = Frame(spark.createDataFrame([], "i long, b boolean, f double"))
    got = f.select(col("i").sum().alias("s"), col("i").product().alias("p"), col("b").any().alias("a"), col("b").all().alias("l"), col("f").max().alias("m"), col("i").sum(min_count=1).alias("c"), col("i").n_unique().alias("n")).rows()
    assert got == [(0, 1, False, True, None, None, 0)]


def test_min_max_skip_nan(small, spark):
    assert small.select(col("f").max().alias("m"), col("f").min().alias("n")).rows()[0] == (1.5, 0.0)
    only = Frame(spark.createDataFrame([(NAN,), (None,)], "f double"))
    assert math.isnan(only.select(col("f").max()).item())


def test_sum_is_exact_until_the_end(spark):
    top = 2**63 - 1
    f = Frame(spark.createDataFrame([(top,), (1,), (-1,)], "i long"))
    assert f.select(col("i").sum()).item() == top


def test_sort_puts_nulls_last(small):
    assert values(small.sort("i"), "i") == [1, 2, 3, 3, None]
    assert values(small.sort("i", descending=True), "i") == [3, 3, 2, 1, None]
    assert values(small.sort("i", nulls_last=False), "i")[0] is None
    assert math.isnan(values(small.sort("f"), "f")[-2])


def test_order_is_observable(small):
    assert values(small.reverse(), "s") == ["c", "b", "a", None, "b"]
    assert values(small.select(col("i").shift(1, fill_value=9))) == [9, 3, 1, None, 3]
    assert values(small.tail(2), "s") == ["b", "c"] and values(small.slice(-3, 2), "s") == ["a", "b"]
    assert values(small.gather([4, -5, 0]), "i") == [2, 3, 3] and values(small.gather([9, 0], null_on_oob=True), "i") == [None, 3]
    with pytest.raises(IndexError):
        small.gather([9])
    assert small.with_row_index("k", 5).rows()[2][0] == 7


def test_row_index_over_many_partitions(spark):
    f = Frame(spark.range(1000).repartition(7).sortWithinPartitions("id"))
    assert sorted(values(f.with_row_index("k"), "k")) == list(range(1000))


def test_strict_names(small):
    for bad in (lambda: small.drop("zz"), lambda: small.rename({"zz": "y"}), lambda: small.select("i", "i"), lambda: small.rename({"i": "f"})):
        with pytest.raises((KeyError, ValueError)):
            bad()


def test_selectors(small):
    assert small.select(b.by_dtype("float64", "bool")).columns == ["f", "b"]
    assert small.select(b.exclude("f").name_suffix("_x")).columns == ["i_x", "s_x", "b_x"]
    assert small.select(col("^[is]$")).columns == ["i", "s"] and small.select(b.nth(-1)).columns == ["b"] and small.select(b.columns("b|f")).columns == ["f", "b"]
    assert small.select(b.all_().null_count()).rows() == [(1, 1, 1, 1)]


def test_null_handling(small):
    assert small.drop_nulls().height == 3 and small.drop_nulls("i").height == 4 and small.drop_nans().height == 4
    assert values(small.fill_null(0), "i") == [3, 1, 0, 3, 2] and values(small.fill_null(strategy="forward"), "s") == ["b", "b", "a", "b", "c"]
    assert values(small.fill_null(strategy="max", subset=["i"]), "i")[2] == 3 and values(small.fill_nan(7.0), "f")[1] == 7.0
    assert small.null_count().rows() == [(1, 1, 1, 1)]


def test_joins_match_nested_loops(spark):
    left = [(1, "a"), (1, "b"), (None, "c"), (2, "d"), (4, "e")]
    right = [(1, "x"), (None, "y"), (2, "z"), (2, "w"), (3, "v")]
    l, r = Frame(spark.createDataFrame(left, "k long, p string")), Frame(spark.createDataFrame(right, "k long, p string"))  # noqa: E741
    pairs = [(a[0], a[1], z[1]) for a in left for z in right if a[0] is not None and a[0] == z[0]]
    key = lambda t: tuple(map(str, t))
    assert sorted(l.join(r, on="k").rows(), key=key) == sorted(pairs, key=key)
    lost = [(a[0], a[1], None) for a in left if a[0] not in (1, 2)]
    assert sorted(l.join(r, on="k", how="left").rows(), key=key) == sorted(pairs + lost, key=key)
    extra = [(z[0], None, z[1]) for z in right if z[0] not in (1, 2)]
    full = l.join(r, on="k", how="full", coalesce=True)
    assert full.columns == ["k", "p", "p_right"] and sorted(full.rows(), key=key) == sorted(pairs + lost + extra, key=key)
    assert l.join(r, on="k", how="full").columns == ["k", "p", "k_right", "p_right"]
    mirror = l.join(r, on="k", how="right")
    assert mirror.columns == ["p", "k", "p_right"] and mirror.height == len(pairs) + len(extra)
    assert l.join(r, on="k", how="semi").height == 3 and l.join(r, on="k", how="anti").height == 2 and l.join(r, how="cross").height == 25
    with pytest.raises(TypeError):
        l.join(Frame(spark.createDataFrame([(1,)], "k int")), on="k")


@pytest.mark.parametrize("strategy", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("by", [None, "g"])
def test_asof_matches_nested_loops(spark, strategy, exact, by):
    import random

    rng = random.Random(7)
    left = [(rng.choice([None, *range(20)]), rng.choice("ab"), k) for k in range(40)]
    right = [(rng.choice([None, *range(0, 20, 3)]), rng.choice("ab"), k) for k in range(15)]
    l, r = (Frame(spark.createDataFrame(x, "t long, g string, p long").coalesce(1)) for x in (left, right))  # noqa: E741

    def match(t, g):
        fits = [(z[0], k, z[2]) for k, z in enumerate(right) if t is not None and z[0] is not None and (by is None or z[1] == g) and (exact or z[0] != t)]
        back = max((f for f in fits if f[0] <= t), default=None)
        ahead = min(((f[0], -f[1], f[2]) for f in fits if f[0] >= t), default=None)
        if strategy == "backward":
            return back and back[2]
        if strategy == "forward":
            return ahead and ahead[2]
        if back is None or ahead is None:
            return (back or ahead) and (back or ahead)[2]
        return back[2] if t - back[0] < ahead[0] - t else ahead[2]

    got = l.join_asof(r, on="t", by=by, strategy=strategy, allow_exact_matches=exact)
    name = "p_right"
    assert {(row[2]): row[got.columns.index(name)] for row in got.rows()} == {p: match(t, g) for t, g, p in left}
    if by:
        cut = l.join_asof(r, on="t", by=by, strategy=strategy, allow_exact_matches=exact, spread=True)
        assert sorted(cut.rows(), key=str) == sorted(got.rows(), key=str)


def test_groups(small):
    got = small.group_by("s", maintain_order=True).agg(col("i").sum().alias("x"), col("i").alias("all"), b.len_().alias("n"))
    assert got.rows() == [("b", 6, [3, 3], 2), (None, 1, [1], 1), ("a", 0, [None], 1), ("c", 2, [2], 1)]
    assert small.group_by("f").len().height == 4  # -0.0 is 0.0, NaN and null are groups
    assert small.group_by("s").head(1).height == 4 and small.group_by("s").agg().height == 4


def test_rollup_of_nothing(spark):
    empty = Frame(spark.createDataFrame([], "a string, z string, m long"))
    got = empty.group_by_rollup("a", "z").agg(col("m").sum().alias("s"), b.grouping_id("a", "z").alias("grouping_id"))
    assert got.rows() == [(None, None, 0, 3)]


def test_sequences(small):
    one = small.select(col("i").sort(descending=True).alias("i"))
    assert values(one) == [None, 3, 3, 2, 1]
    g = small.group_by("b", maintain_order=True).agg(col("i").top_k(1).alias("t"), col("s").sort_by("i").alias("z"), col("i").arg_max().alias("m"), col("s").first(ignore_nulls=True).alias("f"), col("i").mode().alias("o"))
    assert g.rows() == [(True, [3], ["b", "b"], 0, "b", [3]), (False, [2], [None, "c"], 1, "c", [1, 2]), (None, [], ["a"], None, "a", [None])] or g.rows()[0] == (True, [3], ["b", "b"], 0, "b", [3])


def test_windows(spark):
    rows = [("a", 1, 4.0), ("a", 2, None), ("a", 3, 6.0), ("b", 1, 1.0), ("b", 2, 1.0)]
    f = Frame(spark.createDataFrame(rows, "g string, t long, x double").coalesce(1))
    o = {"partition_by": "g", "order_by": "t"}
    got = f.select("g", "t", col("x").cum_sum().over(**o).alias("c"), col("x").rank().over("g").alias("r"), col("x").interpolate().over(**o).alias("i"), col("x").sum().over(**o).alias("s"), col("x").forward_fill().over(**o).alias("f")).sort("g", "t").rows()
    assert got == [("a", 1, 4.0, 1.0, 4.0, 10.0, 4.0), ("a", 2, None, None, 5.0, 10.0, 4.0), ("a", 3, 10.0, 2.0, 6.0, 10.0, 6.0), ("b", 1, 1.0, 1.5, 1.0, 2.0, 1.0), ("b", 2, 2.0, 1.5, 1.0, 2.0, 1.0)]


def test_reshape(spark):
    f = Frame(spark.createDataFrame([("x", "p", 1), ("x", "q", 2), ("y", "p", 3)], "k string, o string, v long").coalesce(1))
    assert sorted(f.pivot("o", "k", "v").rows()) == [("x", 1, 2), ("y", 3, None)]
    assert f.pivot("o", "k", "v").unpivot(["p", "q"], "k").height == 4
    lists = Frame(spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [], []), (3, None, None)], "i long, a array<long>, z array<string>").coalesce(1))
    assert lists.explode(["a", "z"]).rows() == [(1, 1, "a"), (1, 2, "b"), (2, None, None), (3, None, None)]


def test_sets(spark):
    f = Frame(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string").coalesce(1))
    assert f.unique("k", keep="first", maintain_order=True).rows() == [(1, "a"), (2, "c")] and f.unique("k", keep="last", maintain_order=True).rows() == [(1, "b"), (2, "c")] and f.unique("k", keep="none").rows() == [(2, "c")]
    assert values(f.is_duplicated("k")) == [True, True, False]
    with pytest.raises(TypeError):
        b.concat([f, f.select("k")])
    side = b.concat([f, f.select(col("v").alias("w"))], "horizontal")
    assert side.rows()[1] == (1, "b", "b")


def test_time_windows(spark):
    day = dt.datetime(2024, 1, 31)
    f = Frame(spark.createDataFrame([(day + dt.timedelta(hours=6 * k), k) for k in range(8)], "t timestamp_ntz, v long").coalesce(1))
    got = f.group_by_dynamic("t", "1mo").agg(col("v").sum().alias("s")).rows()
    assert got == [(dt.datetime(2024, 1, 1), 6), (dt.datetime(2024, 2, 1), 22)]
    assert [r[1] for r in f.rolling("t", "12h").agg(col("v").sum().alias("s")).rows()] == [0, 1, 3, 5, 7, 9, 11, 13]
    assert f.select(col("t").dt.offset_by("1mo")).item() == dt.datetime(2024, 2, 29)
    assert b.date_range(spark, "2024-01-31", "2024-05-01", "1mo").rows() == [(dt.date(2024, 1, 31),), (dt.date(2024, 2, 29),), (dt.date(2024, 3, 31),), (dt.date(2024, 4, 30),)]


def test_describe_sample_equals(small):
    d = small.select("i").describe().to_dicts()
    assert [x["statistic"] for x in d][:2] == ["count", "null_count"] and d[0]["i"] == 4
    assert small.sample(3, seed=1).height == 3 and small.sample(n=9, with_replacement=True, seed=1).height == 9
    assert small.equals(small) and not small.equals(small.reverse())
    s = small.get_column("i")
    assert s.sum() == 9 and s.n_unique() == 4 and s.sort().to_values() == [1, 2, 3, 3, None] and s.name == "i"


def test_over_lists(small):
    one = small.select(col("i").sort(descending=True).over("b", mapping_strategy="explode"))
    assert values(one) == [3, 3, None, 2, 1] or sorted(map(str, values(one))) == ["1", "2", "3", "3", "None"]
    joined = small.select("s", col("i").sort().over("b", mapping_strategy="join").alias("l")).rows()
    assert sorted(map(str, joined)) == sorted(map(str, [("b", [3, 3]), (None, [1, 2]), ("a", [None]), ("b", [3, 3]), ("c", [1, 2])]))


def test_literals_adopt_and_types_do_not_mix(spark):
    f = Frame(spark.createDataFrame([(1, 2.0, 3)], "a int, x float, l long"))
    assert [t.simpleString() for t in f.select((col("a") + 1).alias("p"), (col("x") * 1.5).alias("q"), (2 - col("l")).alias("r")).dtypes] == ["int", "float", "bigint"]
    with pytest.raises(TypeError):
        f.select(col("a") + col("l")).rows()


def test_series_arrays(small, tmp_path):
    s = small.get_column("i")
    assert s.int32().to_pylist() == [3, 1, None, 3, 2] and s.n_chunks() == 1 and not s.is_chunked() and s.float64().to_pylist()[0] == 3.0
    small.sink_csv(str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_text().startswith("i,f,s,b")


def test_comparisons_with_numbers_reach_the_scan(spark, tmp_path):
    nan = float("nan")
    spark.createDataFrame([(x, x) for x in (None, nan, -1.0, 0.0, 5.0, float("inf"))], "x double, y double").coalesce(1).write.parquet(str(tmp_path / "t"))
    f = Frame(spark.read.parquet(str(tmp_path / "t")))
    x = col("x")
    got = {n: f.select(e.alias("e")).to_dict()["e"] for n, e in {"<": x < 5.0, "<=": x <= 5, ">": x > 0.0, ">=": x >= 5.0, "==": x == 5.0, "!=": x != 5.0, "in": x.is_between(0, 5.0), "out": x.is_between(0, 5, closed="none")}.items()}
    assert got == {"<": [None, False, True, True, False, False], "<=": [None, False, True, True, True, False], ">": [None, False, False, False, True, True], ">=": [None, False, False, False, True, True], "==": [None, False, False, False, True, False], "!=": [None, True, True, True, False, True], "in": [None, False, False, True, True, False], "out": [None, False, False, False, False, False]}
    plan = f.filter(x > 0.0, col("y").is_between(-3.0, 7.0)).explain()
    assert "GreaterThan(x,0.0)" in plan and "GreaterThanOrEqual(y,-3.0)" in plan and "LessThanOrEqual(y,7.0)" in plan
