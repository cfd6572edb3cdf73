"""What a review of larger tables found: lists of whole groups, ties, rounding, results in the driver."""

import pytest
from pyspark.sql import functions as F

from brindle import Frame, col


def plan_of(frame):
    return frame.explain("formatted")


def test_places_of_extremes_without_lists(spark):
    rows = [("a", 3.0), ("a", float("nan")), ("a", 1.0), ("a", None), ("a", 7.0), ("a", 1.0), ("a", 7.0), ("b", None), (None, 2.0)]
    f = Frame(spark.createDataFrame(rows, "g string, v double").coalesce(1)).group_by("g").agg(col("v").arg_min().alias("low"), col("v").arg_max().alias("high"), col("v").filter(col("v") > 1.0).arg_min().alias("some"))
    assert {r[0]: tuple(r[1:]) for r in f.rows()} == {"a": (2, 4, 0), "b": (None, None, None), None: (0, 0, 0)}
    assert "collect_list" not in plan_of(f)


def test_integer_products(spark):
    def product(*values):
        return Frame(spark.createDataFrame([(1, v) for v in values], "g int, v long")).group_by("g").agg(col("v").product().alias("p")).rows()[0][1]

    assert product(1, -1, 3, None, -1, 5, -1) == -15 and product(None) == 1
    # The exact product is 0 and -2^63, whatever comes first.
    assert product(2**62, 2**62, 0) == 0 and product(2**62, 2, -1) == -(2**63)
    with pytest.raises(Exception, match="overflow"):
        product(2**62, 2)


def test_whole_results_of_streams_stay_out_of_the_driver(spark, tmp_path):
    from brindle.plans import suites
    from brindle.streaming import windows

    before = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    assert suites.queries()["stream_sessions"](spark, "/root/testdata/sf0.001").count() > 0
    assert {r.tableName for r in spark.sql("SHOW TABLES").collect()} == before
    p, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = "SELECT timestamp_seconds({} * 60) AS t, id % 2 AS k FROM range({}, {})"
    spark.sql(rows.format("id", 0, 10)).write.parquet(p)
    run = lambda: windows.run_to_files(windows.sessions(windows.parquet_stream(spark, p), "t", "5 minutes", [F.count("*").alias("n")], by=("k",), late="10 days"), out, state, "complete")
    assert sorted(r.n for r in run().collect()) == [5, 5]
    spark.sql(rows.format("id + 100", 10, 14)).write.mode("append").parquet(p)
    # Sessions of the first run are still there, and a run without news leaves them.
    assert sorted(r.n for r in run().collect()) == [2, 2, 5, 5]
    assert sorted(r.n for r in run().collect()) == [2, 2, 5, 5]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None


def test_first_and_last_events_of_equal_times(spark, tmp_path):
    import duckdb

    from brindle.plans import suites

    rows = "SELECT id AS event_id, timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id % 5) AS ts, id % 3 AS user_id, concat('e', id % 7) AS event_type, CAST(id % 4 AS DOUBLE) AS value FROM range(1000)"
    spark.sql(rows).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect(config={"threads": 1})
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(suites.oracle_sql()["group_first_last"]).fetchall()
    got = suites.queries()["group_first_last"](spark, str(tmp_path)).select("user_id", "first_event", "last_event", "top_type", "low_type").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_rounding_as_sql_does(spark):
    import duckdb

    values = [57.63 / 6.4 - 1, 0.5, -0.5, 2.5, 0.49999999999999994, 1.0000005, 2.675, 1e300, -1e17, 4503599627370497.5, 123456.789, -0.0, float("inf"), float("-inf"), float("nan"), None]
    f = Frame(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double"))
    db = duckdb.connect()
    db.execute("CREATE TABLE t (k INT, v DOUBLE)")
    db.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    places = (0, 1, 2, 6, 9, -2)
    got = f.select("k", *[col("v").round(d).alias(f"r{i}") for i, d in enumerate(places)]).df.orderBy("k").collect()
    want = db.execute("SELECT k, " + ", ".join(f"round(v, {d})" for d in places) + " FROM t ORDER BY k").fetchall()
    shown = lambda rows: [tuple(None if x is None else str(x + 0.0) for x in r) for r in rows]
    assert shown(got) == shown(want)
    assert got[0].r3 == 8.004687


@pytest.mark.parametrize("closed", ["right", "left", "both", "none"])
def test_ranges_of_numbers_by_halves(spark, closed):
    import math
    import random
    import statistics

    from brindle.functions import temporal

    rng = random.Random(3)
    rows = [(k, None if k % 50 == 7 else rng.randrange(-3_000_000, 3_000_000) // 1000 * 1000, None if k % 9 == 4 else float(rng.randrange(100))) for k in range(600)]
    f = Frame(spark.createDataFrame(rows, "k long, m long, v double").repartition(3)).df
    f = Frame(f.withColumn("t", temporal.from_micros(F.col("m"), "timestamp_ntz")))
    v = col("v")
    by = {"by": "t", "window": "100ms", "closed": closed}
    out = f.select("k", v.rolling_sum_by(**by).alias("s"), v.rolling_mean_by(**by).alias("m"), v.rolling_min_by(**by).alias("l"), v.rolling_max_by(**by).alias("h"), v.rolling_var_by(**by, min_samples=2).alias("v"), v.rolling_std_by(**by, min_samples=2, ddof=0).alias("d"))
    assert out.height == len(rows)
    low, high = (-100_000 + (closed in ("right", "none"))), (0 if closed in ("right", "both") else -1)
    for k, *got in out.rows():
        t = rows[k][1]
        near = [r[2] for r in rows if r[2] is not None and (r[1] is None if t is None else r[1] is not None and t + low <= r[1] <= t + high)]
        want = [sum(near), sum(near) / len(near), min(near), max(near)] if near else [None] * 4
        want += [statistics.variance(near), statistics.pstdev(near)] if len(near) > 1 else [None] * 2
        assert all(g is None and w is None or g is not None and w is not None and math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want, strict=True)), (k, got, want)
    # Running values only: no window whose cost grows with the rows around a row.
    assert all("unboundedpreceding" in x for x in plan_of(out).split("specifiedwindowframe(RangeFrame")[1:])


def test_quantile_bins_take_no_window(spark):
    f = Frame(spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("v")))
    out = f.select("k", col("v").qcut(2).alias("bin"))
    assert "Window" not in plan_of(out)
    assert dict(out.rows()) == {k: int(k % 10 > 4.5) for k in range(100)}
    inside = f.with_columns((col("k") % 2).alias("g")).select("k", col("v").qcut([0.5]).over("g").alias("bin"))
    assert dict(inside.rows()) == {k: int(k % 10 > (4 if k % 2 == 0 else 5)) for k in range(100)}


def test_few_elements_over_partitions(spark):
    rows = [(k % 3, None if k % 7 == 2 else float(k * 37 % 50), k) for k in range(60)] + [(9, 1.0, 60)]
    f = Frame(spark.createDataFrame(rows, "g int, v double, k long").coalesce(1))
    v, k, late = col("v"), col("k"), col("k") > 20
    e = [k.head(2), k.tail(3), k.slice(1, 2), v.top_k(3), v.bottom_k(2), k.top_k_by("v", 2), k.bottom_k_by("v", 3), k.filter(late).head(2), v.filter(late).tail(2), k.get(0), k.get(-1)]
    names = [f"c{i}" for i in range(len(e))]
    over = f.select("g", *[x.over("g").alias(n) for x, n in zip(e, names, strict=True)])
    groups = {r[0]: r[1:] for r in f.group_by("g").agg(*[x.alias(n) for x, n in zip(e, names, strict=True)]).rows()}
    got = over.rows()
    assert len(got) == len(rows) and all(r[1:] == groups[r[0]] for r in got)
    assert "collect_list" not in plan_of(over)


def test_counts_of_values_in_groups_hold_distinct_values(spark):
    rows = [("a", v) for v in ["y", "x", None, "x", "y", "z", "x", None, "y"]] + [("b", None), (None, "q")]
    f = Frame(spark.createDataFrame(rows, "g string, v string").coalesce(1))
    v = col("v")
    out = f.group_by("g").agg(v.mode().alias("m"), v.value_counts(sort=True).alias("c"), v.value_counts(normalize=True).alias("p"), v.unique_counts().alias("u"), v.filter(v != "y").value_counts().alias("k"))
    got = {r[0]: r[1:] for r in out.rows()}
    m, c, p, u, k = got["a"]
    assert m == ["x", "y"] and [tuple(x) for x in c] == [("y", 3), ("x", 3), (None, 2), ("z", 1)] and u == [3, 3, 2, 1]
    assert [(x[0], round(x[1], 6)) for x in p] == [("y", 0.333333), ("x", 0.333333), (None, 0.222222), ("z", 0.111111)]
    assert [tuple(x) for x in k] == [("x", 3), ("z", 1)] and got["b"][0] == [None] and got[None][3] == [1]
    # What a group collects has one element per distinct value.
    assert plan_of(out).count("collect_list(CASE WHEN (__first") > 0
    whole = f.filter(col("g") == "a").select(v.mode().alias("m")).rows()
    assert [r[0] for r in whole] == ["x", "y"]
