"""Places of rows on input that shuffles have dealt out, with more rows than one partition holds."""

import pytest
from brindle import Frame, col
from pyspark.sql import functions as F

N = 50_000


@pytest.fixture(scope="module")
def tables(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    d = spark.range(N).select("id", (F.col("id") * 7919 % 50_021).alias("v"))
    yield {"scan": Frame(d), "group": Frame(d.groupBy("id").agg(F.max("v").alias("v"))), "sort": Frame(d).sort("v"), "join": Frame(d).join(Frame(d.select("id", F.lit(1).alias("z"))), on="id").drop("z")}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("kind", ["scan", "group", "sort", "join"])
def test_numbers_cover_all_rows(tables, kind):
    f = tables[kind]
    got = f.with_row_index("n").df.agg(F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("id")).first()
    assert tuple(got) == (N, 0, N - 1, N)
    assert f.tail(5).height == 5 and f.slice(-1000, 10).height == 10
    every = f.gather_every(1000)
    assert every.collect().num_rows == every.height == N // 1000
    assert f.gather([0, 5, N - 1]).height == 3 and f.hstack(Frame(f.df.sparkSession.range(N).toDF("q"))).height == N
    assert f.sample(77).height == 77


def test_places_follow_a_sort(tables):
    want = sorted(k * 7919 % 50_021 for k in range(N))
    f = tables["sort"]
    assert [r[1] for r in f.tail(5).rows()] == want[-5:] and [r[1] for r in f.slice(-1000, 10).rows()] == want[-1000:-990]
    assert [r[1] for r in f.gather([0, 5, -1]).rows()] == [want[0], want[5], want[-1]]
    assert [r[2] for r in f.with_row_index("n").gather_every(10_000).rows()] == want[::10_000]


def test_group_numbers_cover_all_rows(tables):
    got = Frame(tables["group"].df.withColumn("g", F.col("id") % 7)).group_indices("g").df.agg(F.count_distinct("row"), F.count_distinct("group"), F.max("group")).first()
    assert tuple(got) == (N, 7, 6)


def test_known_values_before(spark):
    f = Frame(spark.createDataFrame([(k, x) for k, x in enumerate([1, None, 3, None, None, 6, 7])], "k int, x int").coalesce(1))
    got = lambda n, **o: [r[0] for r in f.select(col("x").shift(n, ignore_nulls=True, **o).over(order_by="k")).rows()]
    assert got(1) == [None, 1, 1, 3, 3, 3, 6] and got(2) == [None, None, None, 1, 1, 1, 3] and got(-1) == [3, 3, 6, 6, 6, 7, None] and got(1, fill_value=0)[0] == 0
