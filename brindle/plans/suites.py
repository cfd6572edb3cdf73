"""Queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import brindle as b
from brindle import Frame, col

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """A function from a table's name to the table, with where the tables are and a folder for what a query writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> Frame:
        return Frame(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def scratch(self, name: str) -> str:
        """A new path in the folder that spark.checkpoint.dir names, or in a local one where none is set."""
        at = self.spark.conf.get("spark.checkpoint.dir", None) or f"file://{_local_folder()}"
        return f"{at.rstrip('/')}/brindle-queries/{name}-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    at = tempfile.mkdtemp(prefix="brindle-")
    atexit.register(shutil.rmtree, at, True)
    return at


def query(sql: str | None = None):
    """Register a query under its function's name; it gets the Tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir)).df

        run.__name__ = f.__name__
        _QUERIES[f.__name__] = (run, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}


def day(text: str) -> b.Expr:
    return b.lit(text, "datetime")


REVENUE = col("l_extendedprice") * (1 - col("l_discount"))


# -- decision-support queries ------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
    round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    return t("lineitem").filter(col("l_shipdate") <= day("1998-09-02")).group_by("l_returnflag", "l_linestatus").agg(
        col("l_quantity").sum().round(2).alias("sum_qty"), col("l_extendedprice").sum().round(2).alias("sum_base_price"), REVENUE.sum().round(2).alias("sum_disc_price"),
        (REVENUE * (1 + col("l_tax"))).sum().round(2).alias("sum_charge"), col("l_quantity").mean().round(4).alias("avg_qty"), col("l_discount").mean().round(6).alias("avg_disc"), b.len_().alias("count_order"))


@query("""SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def shipping_priority(t):
    c = t("customer").filter(col("c_mktsegment") == "BUILDING").select("c_custkey")
    joined = t("orders").join(c, left_on="o_custkey", right_on="c_custkey").join(t("lineitem"), left_on="o_orderkey", right_on="l_orderkey")
    return joined.group_by("o_orderkey", "o_orderdate").agg(REVENUE.sum().round(2).alias("revenue")).sort("revenue", "o_orderkey", descending=[True, False]).head(10)


@query("""SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1""")
def order_priority(t):
    return t("orders").join(t("lineitem").filter(col("l_quantity") > 45.0), left_on="o_orderkey", right_on="l_orderkey", how="semi").group_by("o_orderpriority").len("order_count")


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")
def local_supplier_volume(t):
    n = t("nation").join(t("region").filter(col("r_name") == "ASIA"), left_on="n_regionkey", right_on="r_regionkey")
    s = t("supplier").join(n, left_on="s_nationkey", right_on="n_nationkey").select("s_suppkey", "s_nationkey", "n_name")
    rows = t("customer").join(t("orders"), left_on="c_custkey", right_on="o_custkey").join(t("lineitem"), left_on="o_orderkey", right_on="l_orderkey")
    return rows.join(s, left_on=["l_suppkey", "c_nationkey"], right_on=["s_suppkey", "s_nationkey"]).group_by("n_name").agg(REVENUE.sum().round(2).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def revenue_change(t):
    return t("lineitem").filter(col("l_discount").is_between(0.05, 0.07), col("l_quantity") < 24.0).select((col("l_extendedprice") * col("l_discount")).sum().round(2).alias("revenue"))


@query("""SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY 1, 2, 4 ORDER BY revenue DESC, c_custkey LIMIT 20""")
def returned_items(t):
    rows = t("customer").join(t("nation"), left_on="c_nationkey", right_on="n_nationkey").join(t("orders"), left_on="c_custkey", right_on="o_custkey").join(t("lineitem").filter(col("l_returnflag") == "R"), left_on="o_orderkey", right_on="l_orderkey")
    return rows.group_by("c_custkey", "c_name", "n_name").agg(REVENUE.sum().round(2).alias("revenue")).sort("revenue", "c_custkey", descending=[True, False]).head(20)


@query("""SELECT l_returnflag, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def priority_lines(t):
    urgent = col("o_orderpriority").is_in(["1-URGENT", "2-HIGH"])
    return t("orders").join(t("lineitem"), left_on="o_orderkey", right_on="l_orderkey").group_by("l_returnflag").agg(b.len_().alias("n"), col("o_orderkey").filter(urgent).len().alias("high"), col("o_orderkey").filter(~urgent).len().alias("low")).drop("n")


@query("""SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey""")
def promotion_effect(t):
    rows = t("lineitem").join(t("part"), left_on="l_partkey", right_on="p_partkey")
    return rows.select((b.lit(100.0) * b.when(col("p_type").str.starts_with("PROMO")).then(REVENUE).otherwise(0.0).sum() / REVENUE.sum()).round(6).alias("promo"))


@query("""SELECT o_orderkey, c_name, round(sum(l_quantity), 2) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    GROUP BY 1, 2 HAVING sum(l_quantity) > 200""")
def large_orders(t):
    rows = t("orders").join(t("customer"), left_on="o_custkey", right_on="c_custkey").join(t("lineitem"), left_on="o_orderkey", right_on="l_orderkey")
    return rows.group_by("o_orderkey", "c_name").agg(col("l_quantity").sum().round(2).alias("qty")).filter(col("qty") > 200.0)


@query("""SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1""")
def idle_customers(t):
    c = t("customer")
    mean = c.filter(col("c_acctbal") > 0.0).select(col("c_acctbal").mean().alias("m"))
    return c.join(mean, how="cross").filter(col("c_acctbal") > col("m")).join(t("orders").filter(col("o_orderpriority") == "1-URGENT"), left_on="c_custkey", right_on="o_custkey", how="anti").group_by("c_nationkey").agg(b.len_().alias("n"), col("c_acctbal").sum().round(2).alias("bal"))


# -- joins -----------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(t):
    return t("nation").join(t("region"), left_on="n_regionkey", right_on="r_regionkey")


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_left(t):
    return t("customer").join(t("orders"), left_on="c_custkey", right_on="o_custkey", how="left").group_by("c_custkey").agg(col("o_orderkey").count().alias("orders"))


@query("SELECT s_name, n_nationkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(t):
    return t("supplier").filter(col("s_acctbal") > 5000.0).join(t("nation"), left_on="s_nationkey", right_on="n_nationkey", how="right").select("s_name", "n_nationkey", "n_name")


@query("""SELECT coalesce(a.k, c.k) AS k, x, y FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer WHERE c_nationkey < 15 GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier WHERE s_nationkey > 5 GROUP BY 1) c ON a.k = c.k""")
def join_full(t):
    a = t("customer").filter(col("c_nationkey") < 15).group_by("c_nationkey").len("x").rename({"c_nationkey": "k"})
    c = t("supplier").filter(col("s_nationkey") > 5).group_by("s_nationkey").len("y").rename({"s_nationkey": "k"})
    return a.join(c, on="k", how="full", coalesce=True)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def join_semi(t):
    return t("supplier").join(t("lineitem").filter(col("l_quantity") > 49.0), left_on="s_suppkey", right_on="l_suppkey", how="semi").select("s_suppkey", "s_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_anti(t):
    return t("customer").join(t("orders").filter(col("o_orderpriority") == "1-URGENT"), left_on="c_custkey", right_on="o_custkey", how="anti").select("c_custkey")


@query("SELECT a.r_name AS r_name, z.r_name AS r_name_right FROM region a, region z WHERE a.r_regionkey < z.r_regionkey")
def join_cross_filter(t):
    r = t("region")
    return r.join(r, how="cross").filter(col("r_regionkey") < col("r_regionkey_right")).select("r_name", "r_name_right")





def _asof_sides(t):
    # Of events of a user at one time, the one with the largest id is met.
    e = t("events")
    return e.select("event_id", "user_id", "ts"), e.group_by("user_id", "ts").agg(col("event_id").max().alias("seen"))


@query("""SELECT l.event_id, l.user_id, l.ts, r.seen FROM events l
    ASOF LEFT JOIN (SELECT max(event_id) AS seen, user_id, ts FROM events GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts > r.ts""")
def asof_backward_by(t):
    left, right = _asof_sides(t)
    return left.join_asof(right, on="ts", by="user_id", allow_exact_matches=False)


@query("""SELECT l.event_id, l.user_id, l.ts, r.seen FROM events l
    ASOF LEFT JOIN (SELECT max(event_id) AS seen, user_id, ts FROM events GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts < r.ts""")
def asof_forward_by(t):
    left, right = _asof_sides(t)
    return left.join_asof(right, on="ts", by="user_id", strategy="forward", allow_exact_matches=False)


@query("""SELECT l.event_id, l.ts, CASE WHEN date_diff('microsecond', r.rts, l.ts) <= 60000000 THEN r.seen END AS seen FROM events l
    ASOF LEFT JOIN (SELECT max(event_id) AS seen, ts AS rts FROM events GROUP BY ts) r ON l.ts > r.rts""")
def asof_tolerance(t):
    right = t("events").group_by("ts").agg(col("event_id").max().alias("seen"))
    return t("events").select("event_id", "ts").join_asof(right, on="ts", tolerance="1m", allow_exact_matches=False).select("event_id", "ts", "seen")


@query("""WITH r AS (SELECT max(event_id) AS seen, user_id, ts FROM events GROUP BY user_id, ts),
    b AS (SELECT l.event_id, l.user_id, l.ts, r.seen AS bs, r.ts AS bt FROM events l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.ts),
    f AS (SELECT l.event_id, r.seen AS fs, r.ts AS ft FROM events l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts < r.ts)
    SELECT event_id, user_id, ts, CASE WHEN bs IS NULL THEN fs WHEN fs IS NULL THEN bs WHEN date_diff('microsecond', bt, ts) < date_diff('microsecond', ts, ft) THEN bs ELSE fs END AS seen FROM b JOIN f USING (event_id)""")
def asof_nearest(t):
    left, right = _asof_sides(t)
    return left.join_asof(right, on="ts", by="user_id", strategy="nearest", allow_exact_matches=False)


# -- groups -------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, sum(l_linenumber)::BIGINT AS s, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def group_rollup(t):
    return t("lineitem").group_by_rollup("l_returnflag", "l_linestatus").agg(col("l_linenumber").cast("int64").sum().alias("s"), b.len_().alias("n"), b.grouping_id("l_returnflag", "l_linestatus").alias("g"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def group_cube(t):
    return t("lineitem").group_by_cube("l_returnflag", "l_linestatus").agg(b.len_().alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (), ())")
def group_sets(t):
    return t("orders").group_by_grouping_sets([["o_orderstatus"], ["o_orderpriority"], [], []]).agg(b.len_().alias("n"), b.grouping("o_orderstatus").alias("g"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(stddev_samp(value), 6) AS std, round(var_pop(value), 4) AS var0,
    round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90, bool_or(value > 99) AS over99, bool_and(value >= 0) AS positive FROM events GROUP BY 1""")
def group_statistics(t):
    v = col("value")
    return t("events").group_by("event_type").agg(b.len_().alias("n"), col("user_id").n_unique().alias("users"), v.mean().round(6).alias("mean"), v.min().alias("low"), v.max().alias("high"), v.std().round(6).alias("std"), v.var(0).round(4).alias("var0"), v.median().round(6).alias("med"), v.quantile(0.9, "linear").round(6).alias("p90"), (v > 99.0).any().alias("over99"), (v >= 0.0).all().alias("positive"))


@query("""SELECT event_type, v[floor((n - 1) * 0.3 + 0.5)::INT + 1] AS near, v[floor((n - 1) * 0.3)::INT + 1] AS low, v[ceil((n - 1) * 0.3)::INT + 1] AS high, round((v[floor((n - 1) * 0.3)::INT + 1] + v[ceil((n - 1) * 0.3)::INT + 1]) / 2, 6) AS mid
    FROM (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY 1)""")
def group_quantile_nearest(t):
    v = col("value")
    return t("events").group_by("event_type").agg(v.quantile(0.3, "nearest").alias("near"), v.quantile(0.3, "lower").alias("low"), v.quantile(0.3, "higher").alias("high"), v.quantile(0.3, "midpoint").round(6).alias("mid"))


@query("""SELECT user_id, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event, arg_max(event_type, value) AS top_type, arg_min(event_type, value) AS low_type FROM events GROUP BY 1""")
def group_first_last(t):
    # Of rows that share an extreme, the one with the smallest id counts, as in files in that order.
    e = t("events").sort("event_id")
    return e.group_by("user_id").agg(col("event_id").min_by("ts").alias("first_event"), col("event_id").max_by("ts").alias("last_event"), col("event_type").max_by("value").alias("top_type"), col("event_type").min_by("value").alias("low_type"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS path FROM events GROUP BY 1""")
def group_join_strings(t):
    return t("events").sort("ts", "event_id").group_by("user_id").agg(col("event_type").str.join(",").alias("path"))


@query("""SELECT user_id, list(value ORDER BY value DESC)[1:3] AS top FROM events GROUP BY 1""")
def group_top_k(t):
    return t("events").group_by("user_id").agg(col("value").top_k(3).alias("top"))


@query("SELECT event_type, round(corr(value, user_id), 6) AS c, round(covar_samp(value, user_id), 4) AS v FROM events GROUP BY 1")
def group_correlation(t):
    return t("events").group_by("event_type").agg(b.corr("value", "user_id").round(6).alias("c"), b.cov("value", "user_id").round(4).alias("v"))


@query("SELECT event_type, count(*) FILTER (value > 50) AS big, round(sum(value) FILTER (value <= 50), 2) AS small FROM events GROUP BY 1")
def group_filtered(t):
    return t("events").group_by("event_type").agg(col("value").filter(col("value") > 50.0).len().alias("big"), col("value").filter(col("value") <= 50.0).sum().round(2).alias("small"))


@query("SELECT p_size, mode(p_brand) IS NOT NULL AS has_mode, max(n) AS most FROM part JOIN (SELECT p_size AS z, p_brand AS br, count(*) AS n FROM part GROUP BY 1, 2) ON p_size = z GROUP BY 1")
def group_mode(t):
    rows = t("part").group_by("p_size").agg(col("p_brand").mode().alias("m"), col("p_brand").value_counts(sort=True).alias("v"))
    return rows.select("p_size", (col("m").list.len() > 0).alias("has_mode"), col("v").list.first().field("count").cast("int64").alias("most"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS len FROM orders GROUP BY 1, 2")
def group_len(t):
    return t("orders").group_by("o_orderstatus", "o_orderpriority").len()


@query("""SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 2""")
def group_head(t):
    return t("events").sort("ts", "event_id").group_by("user_id").head(2).select("event_id", "user_id", "ts")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (event_type = '{k}'), 2) AS {k}" for k in EVENT_TYPES) + " FROM events GROUP BY 1")
def pivot_sum(t):
    return t("events").pivot("event_type", "user_id", "value", "sum", EVENT_TYPES).with_columns(*[col(c).round(2) for c in EVENT_TYPES])


@query("SELECT s_suppkey, 'a' AS variable, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'b', round(s_acctbal * 2, 2) FROM supplier")
def unpivot_two(t):
    return t("supplier").select("s_suppkey", col("s_acctbal").alias("a"), (col("s_acctbal") * 2).round(2).alias("b")).unpivot(["a", "b"], "s_suppkey")


# -- windows ---------------------------------------------------------------------------------------


@query("""SELECT event_id, rank() OVER w AS lowest, dense_rank() OVER w AS dense, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AS ordinal,
    rank() OVER w + (count(*) OVER (PARTITION BY user_id, event_type) - 1) / 2 AS average FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)""")
def window_rank(t):
    e = t("events").sort("ts", "event_id")
    k = col("event_type")
    return e.select("event_id", k.rank("min").over("user_id").cast("int64").alias("lowest"), k.rank("dense").over("user_id").cast("int64").alias("dense"), k.rank("ordinal").over("user_id").cast("int64").alias("ordinal"), k.rank("average").over("user_id").alias("average"))


@query("""SELECT event_id, lag(value) OVER w AS before, lead(event_type, 2, 'none') OVER w AS after2, value - lag(value) OVER w AS change, round(sum(value) OVER w, 4) AS running, count(*) OVER (PARTITION BY user_id) AS n,
    max(value) OVER (PARTITION BY user_id) AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_sequence(t):
    o = {"partition_by": "user_id", "order_by": ["ts", "event_id"]}
    v = col("value")
    return t("events").select("event_id", v.shift(1).over(**o).alias("before"), col("event_type").shift(-2, fill_value="none").over(**o).alias("after2"), v.diff().over(**o).alias("change"), v.cum_sum().over(**o).round(4).alias("running"), b.len_().over("user_id").alias("n"), v.max().over(**o).alias("top"))


@query("""SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(sum(value) OVER w, 4) END AS s, CASE WHEN count(value) OVER w >= 2 THEN round(avg(value) OVER w, 6) END AS m, CASE WHEN count(value) OVER w >= 3 THEN max(value) OVER w END AS h
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def window_rolling_rows(t):
    o = {"partition_by": "user_id", "order_by": ["ts", "event_id"]}
    v = col("value")
    return t("events").select("event_id", v.rolling_sum(3).over(**o).round(4).alias("s"), v.rolling_mean(3, min_samples=2).over(**o).round(6).alias("m"), v.rolling_max(3).over(**o).alias("h"))


@query("""SELECT event_id, round(sum(value) OVER w, 4) AS s, min(value) OVER w AS low FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999 seconds' PRECEDING AND CURRENT ROW)""")
def window_rolling_time(t):
    v = col("value")
    return t("events").select("event_id", v.rolling_sum_by("ts", "6h").over("user_id").round(4).alias("s"), v.rolling_min_by("ts", "6h").over("user_id").alias("low"))


@query("""SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM (SELECT *, CASE WHEN value > 50 THEN value END AS x FROM events)""")
def window_forward_fill(t):
    e = t("events").with_columns(b.when(col("value") > 50.0).then(col("value")).alias("x"))
    return e.select("event_id", col("x").forward_fill().over("user_id", order_by=["ts", "event_id"]).alias("f"))


@query("SELECT event_id, ntile(4) OVER (ORDER BY event_id) - 1 AS q FROM events")
def window_quartile(t):
    e = t("events").sort("event_id").with_row_index("i")
    n = b.len_().over([])
    big, size = n % 4, n // 4
    cut = big * (size + 1)
    return e.select("event_id", b.when(col("i") < cut).then(col("i") // (size + 1)).otherwise(big + (col("i") - cut) // size).alias("q"))


@query("SELECT c_custkey, c_acctbal FROM customer QUALIFY c_acctbal > avg(c_acctbal) OVER (PARTITION BY c_nationkey) + 3000")
def filter_on_window(t):
    return t("customer").filter(col("c_acctbal") > col("c_acctbal").mean().over("c_nationkey") + 3000.0).select("c_custkey", "c_acctbal")


# -- rows, order, sets ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def sort_slice(t):
    return t("orders").sort("o_totalprice", "o_orderkey", descending=[True, False]).slice(5, 25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 7")
def top_rows(t):
    return t("orders").top_k(7, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 9")
def tail_rows(t):
    return t("orders").sort("o_orderkey").tail(9).select("o_orderkey")


@query("SELECT (row_number() OVER (ORDER BY c_custkey) + 9)::BIGINT AS index, c_custkey FROM customer")
def row_index(t):
    return t("customer").sort("c_custkey").with_row_index("index", 10).select("index", "c_custkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) WHERE k % 50 = 3")
def every_row(t):
    return t("customer").sort("c_custkey").gather_every(50, 3).select("c_custkey")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_rows(t):
    return t("part").select("p_brand", "p_size").unique()


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def unique_last(t):
    return t("events").sort("event_id").unique(["user_id", "event_type"], keep="last").select("user_id", "event_type", "event_id")


@query("SELECT p_brand, p_size, p_type FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_size) = 1")
def unique_none(t):
    return t("part").select("p_brand", "p_size", "p_type").unique(["p_brand", "p_size"], keep="none")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t("customer").select(col("c_nationkey").alias("k")).union_distinct(t("supplier").select(col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return t("customer").filter(col("c_acctbal") < 0.0).select(col("c_nationkey").alias("k")).intersect(t("supplier").select(col("s_nationkey").alias("k")))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set_except(t):
    return t("nation").select(col("n_nationkey").alias("k")).except_(t("supplier").filter(col("s_acctbal") > 8000.0).select(col("s_nationkey").alias("k")))


@query("SELECT s_suppkey AS k, s_name AS a, NULL::VARCHAR AS z FROM supplier UNION ALL BY NAME SELECT c_custkey AS k, c_name AS z FROM customer")
def concat_diagonal(t):
    return b.concat([t("supplier").select(col("s_suppkey").alias("k"), col("s_name").alias("a")), t("customer").select(col("c_custkey").alias("k"), col("c_name").alias("z"))], "diagonal")


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def explode_words(t):
    return t("part").select("p_partkey", col("p_type").str.split(" ").alias("word")).explode("word")


@query("SELECT count(*) AS height, count(DISTINCT doc_id) AS ids, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents")
def whole_table(t):
    return t("documents").select(b.len_().alias("height"), col("doc_id").n_unique().alias("ids"), col("n_chars").sum().alias("chars"), col("n_chars").max().alias("longest"))


@query("SELECT event_id, CASE WHEN value > 50 THEN value END AS x, coalesce(CASE WHEN value > 50 THEN value END, -1) AS y FROM events WHERE CASE WHEN event_id % 3 > 0 THEN 1 END IS NOT NULL")
def null_handling(t):
    x = b.when(col("value") > 50.0).then(col("value"))
    return t("events").with_columns(b.when(col("event_id") % 3 > 0).then(1).alias("keep")).drop_nulls("keep").select("event_id", x.alias("x"), x.fill_null(-1.0).alias("y"))


# -- expressions ------------------------------------------------------------------------------------------


@query("""SELECT event_id, event_id // 7 AS d, event_id % 7 AS m, -((-event_id + 6) // 7) + 0 AS unused, round(sqrt(value), 6) AS r, round(ln(value + 1), 6) AS l, CAST(floor(value) AS DOUBLE) AS f, CAST(ceil(value) AS DOUBLE) AS c,
    abs(value - 50) AS a, sign(value - 50)::DOUBLE AS s, greatest(least(value, 80), 20) AS clipped, round(exp(value / 100), 6) AS e, round(degrees(atan2(value, 10)), 6) AS angle FROM events""".replace("-((-event_id + 6) // 7) + 0 AS unused, ", ""))
def numeric_functions(t):
    v = col("value")
    return t("events").select("event_id", (col("event_id") // 7).alias("d"), (col("event_id") % 7).alias("m"), v.sqrt().round(6).alias("r"), (v + 1).log().round(6).alias("l"), v.floor().alias("f"), v.ceil().alias("c"), (v - 50.0).abs().alias("a"), (v - 50.0).sign().alias("s"), v.clip(20.0, 80.0).alias("clipped"), (v / 100).exp().round(6).alias("e"), b.arctan2("value", b.lit(10.0)).degrees().round(6).alias("angle"))


@query("""SELECT event_id, CASE WHEN value <= 25 THEN '(-inf, 25]' WHEN value <= 75 THEN '(25, 75]' ELSE '(75, inf]' END AS bin, value BETWEEN 10 AND 20 AS mid, event_type IN ('click', 'view') AS known, NOT (value > 30 AND user_id < 100) AS rest,
    CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE event_type END AS short FROM events""")
def conditional_functions(t):
    v = col("value")
    return t("events").select("event_id", v.cut([25, 75]).alias("bin"), v.is_between(10.0, 20.0).alias("mid"), col("event_type").is_in(["click", "view", None]).alias("known"), (~((v > 30.0) & (col("user_id") < 100))).alias("rest"), col("event_type").replace({"click": "c", "view": "v"}).alias("short"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, round(l_tax + l_discount, 4) AS s, round((l_tax + l_discount) / 2, 6) AS m, least(l_tax, l_discount) AS low, greatest(l_tax, l_discount) AS high, l_tax > 0.05 OR l_discount > 0.05 AS either, l_tax > 0.05 AND l_discount > 0.05 AS both FROM lineitem""")
def horizontal_functions(t):
    x, y = col("l_tax"), col("l_discount")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", b.sum_horizontal(x, y).round(4).alias("s"), b.mean_horizontal(x, y).round(6).alias("m"), b.min_horizontal(x, y).alias("low"), b.max_horizontal(x, y).alias("high"), b.any_horizontal(x > 0.05, y > 0.05).alias("either"), b.all_horizontal(x > 0.05, y > 0.05).alias("both"))


@query(r"""SELECT p_partkey, length(p_name)::BIGINT AS n, upper(p_name) AS up, lower(p_type) AS low, p_name[2:4] AS mid, right(p_name, 3) AS tail, reverse(p_brand) AS rev, replace(p_type, ' ', '_') AS joined, regexp_replace(p_type, '[AEIOU]', '*') AS one,
    contains(p_type, 'TIN') AS tin, starts_with(p_brand, 'Brand') AS brand, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, lpad(p_size::VARCHAR, 5, '0') AS z, trim(p_name, 'ap') AS stripped, lower(hex(p_brand)) AS hx, p_brand || '/' || p_type AS both,
    string_split(p_type, ' ')[1] AS first_word, length(regexp_replace(p_type, '[^A]', '', 'g'))::BIGINT AS as_count, p_type LIKE '%STEEL' AS steel FROM part""")
def string_functions(t):
    n, k, w = col("p_name"), col("p_type"), col("p_brand")
    return t("part").select(
        "p_partkey", n.str.len_chars().alias("n"), n.str.to_uppercase().alias("up"), k.str.to_lowercase().alias("low"), n.str.slice(1, 3).alias("mid"), n.str.tail(3).alias("tail"), w.str.reverse().alias("rev"), k.str.replace_all(" ", "_", literal=True).alias("joined"), k.str.replace("[AEIOU]", "*").alias("one"),
        k.str.contains("TIN", literal=True).alias("tin"), w.str.starts_with("Brand").alias("brand"), w.str.extract("([0-9]+)").alias("digits"), col("p_size").cast("string").str.zfill(5).alias("z"), n.str.strip_chars("ap").alias("stripped"), w.str.encode("hex").alias("hx"), b.concat_str("p_brand", "p_type", separator="/").alias("both"),
        k.str.split(" ").list.first().alias("first_word"), k.str.count_matches("A").alias("as_count"), k.str.like("%STEEL").alias("steel"))


@query("""SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, isodow(ts)::INT AS wd, weekofyear(ts)::INT AS wk, dayofyear(ts)::INT AS doy, quarter(ts)::INT AS q, date_trunc('week', ts)::TIMESTAMP AS week,
    date_trunc('month', ts)::TIMESTAMP AS mon, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS six, ts + INTERVAL 1 MONTH + INTERVAL 36 HOUR AS later, ts::DATE AS date, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y/%m/%d %H') AS text, last_day(ts::DATE) AS end_day FROM events""")
def temporal_functions(t):
    x = col("ts").dt
    return t("events").select(
        "event_id", x.year().alias("y"), x.month().alias("mo"), x.day().alias("d"), x.hour().alias("h"), x.minute().alias("mi"), x.weekday().alias("wd"), x.week().alias("wk"), x.ordinal_day().alias("doy"), x.quarter().alias("q"), x.truncate("1w").alias("week"),
        x.truncate("1mo").alias("mon"), x.truncate("6h").alias("six"), x.offset_by("1mo36h").alias("later"), x.date().alias("date"), x.epoch("ms").alias("ms"), x.strftime("%Y/%m/%d %H").alias("text"), x.date().dt.month_end().alias("end_day"))


@query("""SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS ts, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2""")
def time_windows(t):
    return t("events").group_by_dynamic("ts", "1d", by="event_type").agg(b.len_().alias("n"), col("value").sum().round(4).alias("s")).select("ts", "event_type", "n", "s")


@query("""SELECT w AS ts, count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY 1""")
def time_windows_sliding(t):
    return t("events").group_by_dynamic("ts", "12h", period="1d").agg(b.len_().alias("n"))


@query("SELECT vec_id, len(embedding) AS n, round(list_max(embedding)::DOUBLE, 6) AS high, embedding[1] AS first, embedding[-1] AS last, label FROM embeddings")
def list_functions(t):
    e = col("embedding").list
    return t("embeddings").select("vec_id", e.len().alias("n"), e.max().cast("float64").round(6).alias("high"), e.first().alias("first"), e.last().alias("last"), "label")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_functions(t):
    return t("events").select("event_id", col("props").str.json_path_match("$.k").cast("int64").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_decoding(t):
    return t("events").select("event_id", col("props").str.json_decode("struct<k:int>").field("k").alias("k"))


@query("SELECT user_id, struct_pack(n := count(*), top := max(value)) AS s FROM events GROUP BY 1")
def struct_functions(t):
    return t("events").group_by("user_id").agg(b.len_().alias("n"), col("value").max().alias("top")).pack_struct("s", ["n", "top"])


# -- more rules, one query each ---------------------------------------------------------------------------


@query("""SELECT event_id, round(value / lag(value) OVER w - 1, 6) AS pct, first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back,
    min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS low, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS high, count(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen,
    round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS rest
    FROM (SELECT *, CASE WHEN value > 50 THEN value END AS x FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_cumulative(t):
    o = {"partition_by": "user_id", "order_by": ["ts", "event_id"]}
    v, x = col("value"), col("x")
    e = t("events").with_columns(b.when(v > 50.0).then(v).alias("x"))
    return e.select("event_id", v.pct_change().over(**o).round(6).alias("pct"), x.backward_fill().over(**o).alias("back"), v.cum_min().over(**o).alias("low"), v.cum_max().over(**o).alias("high"), x.cum_count().over(**o).alias("seen"), v.cum_sum(reverse=True).over(**o).round(4).alias("rest"))


@query("""SELECT event_id, CASE WHEN count(value) OVER w > 1 THEN round(stddev_samp(value) OVER w, 6) END AS s, CASE WHEN count(value) OVER w >= 4 THEN round(var_pop(value) OVER w, 8) END AS v0
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def window_rolling_spread(t):
    o = {"partition_by": "user_id", "order_by": ["ts", "event_id"]}
    return t("events").select("event_id", col("value").rolling_std(4, min_samples=2).over(**o).round(6).alias("s"), col("value").rolling_var(4, ddof=0).over(**o).round(8).alias("v0"))


@query("""SELECT event_id, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)""")
def window_distribution(t):
    k = col("event_type")
    # Windows are columns first: what is written twice in an expression is a window twice.
    e = t("events").sort("ts", "event_id").with_columns(b.len_().over("user_id").alias("n"), k.rank("min").over("user_id").cast("float64").alias("low"), k.rank("max").over("user_id").cast("float64").alias("high"), col("event_id").head(2).over("user_id").alias("ids"))
    many, more = col("n").cast("float64"), col("n") > 1
    return e.select("event_id", b.when(more).then((col("low") - 1.0) / (many - 1.0)).otherwise(0.0).round(6).alias("pr"), (col("high") / many).round(6).alias("cd"), b.when(more).then(col("ids").list.get(1)).alias("second"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_size) > 1 AS twin, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1 AS first, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1 AS last FROM part")
def distinct_flags(t):
    return t("part").sort("p_partkey").select("p_partkey", (b.len_().over(["p_brand", "p_size"]) > 1).alias("twin"), col("p_brand").is_first_distinct().alias("first"), col("p_brand").is_last_distinct().alias("last"))


@query("""SELECT event_type, bool_or(value > 99.9) AS some, count(*) FILTER (value IS NULL) AS nulls, round(sum(value) FILTER (value < 10) / nullif(count(value) FILTER (value < 10), 0), 6) AS low_mean, max(value) - min(value) AS spread, (SELECT count(*) FROM events x WHERE x.event_type = e.event_type AND x.user_id < 10) AS early FROM events e GROUP BY 1""")
def group_arithmetic(t):
    v = col("value")
    return t("events").group_by("event_type").agg((v > 99.9).any().alias("some"), v.null_count().alias("nulls"), v.filter(v < 10.0).mean().round(6).alias("low_mean"), (v.max() - v.min()).alias("spread"), v.filter(col("user_id") < 10).len().alias("early"))


@query("""SELECT event_type, round(sum((value - m) ** 3) / count(*) / pow(sum((value - m) ** 2) / count(*), 1.5), 6) AS skew, round(sum((value - m) ** 4) / count(*) / pow(sum((value - m) ** 2) / count(*), 2) - 3, 6) AS kurt
    FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1""")
def group_moments(t):
    return t("events").group_by("event_type").agg(col("value").skew().round(6).alias("skew"), col("value").kurtosis().round(6).alias("kurt"))


@query("SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list(event_id ORDER BY value, ts, event_id) AS by_value, (list(event_id ORDER BY ts, event_id))[-2:] AS newest FROM events GROUP BY 1")
def group_lists(t):
    e = t("events").sort("ts", "event_id")
    return e.group_by("user_id").agg(col("event_id").implode().alias("ids"), col("event_id").sort_by("value").alias("by_value"), col("event_id").tail(2).alias("newest"))


@query("SELECT l_partkey % 100 AS k, l_suppkey % 10 AS s, sum(l_linenumber)::BIGINT AS v1, round(avg(l_quantity), 6) AS v2, max(l_tax) - min(l_discount) AS r, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_by_expressions(t):
    return t("lineitem").group_by((col("l_partkey") % 100).alias("k"), (col("l_suppkey") % 10).alias("s")).agg(col("l_linenumber").cast("int64").sum().alias("v1"), col("l_quantity").mean().round(6).alias("v2"), (col("l_tax").max() - col("l_discount").min()).alias("r"), b.len_().alias("n"))


@query("SELECT n_nationkey AS key, upper(n_name) AS name, n_regionkey::BIGINT AS region FROM nation")
def rename_and_cast(t):
    return t("nation").rename({"n_nationkey": "key", "n_name": "name", "n_regionkey": "region"}).cast({"region": "int64"}).with_columns(col("name").str.to_uppercase())


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def drop_and_unnest(t):
    return t("supplier").pack_struct("pair", ["s_name", "s_nationkey"]).unnest("pair").drop("s_acctbal")


@query("SELECT e.event_id, f.value AS after FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events) e JOIN (SELECT value, row_number() OVER (ORDER BY event_id DESC) AS k FROM events) f USING (k)")
def concat_horizontal(t):
    e = t("events").sort("event_id")
    return b.concat([e.select("event_id"), e.reverse().select(col("value").alias("after"))], "horizontal")


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, unnest([length(x) for x in string_split(p_type, ' ')]) AS size FROM part")
def explode_together(t):
    words = col("p_type").str.split(" ")
    f = t("part").select("p_partkey", words.alias("word"))
    sizes = f.explode("word").with_columns(col("word").str.len_chars().alias("size"))
    lists = sizes.group_by("p_partkey").agg(col("word"), col("size"))
    return lists.explode(["word", "size"])


@query("SELECT strptime(strftime(ts, '%d.%m.%Y %H:%M:%S'), '%d.%m.%Y %H:%M:%S') AS parsed, make_date(year(ts), month(ts), 1) AS first, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS days, event_id FROM events")
def temporal_parsing(t):
    x = col("ts")
    days = x.dt.epoch("d") - b.lit("2024-01-01", "date").dt.epoch("d")
    return t("events").select("event_id", x.dt.strftime("%d.%m.%Y %H:%M:%S").str.to_datetime("%d.%m.%Y %H:%M:%S").alias("parsed"), b.date_(x.dt.year(), x.dt.month(), 1).alias("first"), days.alias("days"))


@query("SELECT o_orderkey, (SELECT count(*) FROM range(DATE '2024-01-01', DATE '2024-01-01' + (o_orderkey % 60)::INT, INTERVAL 1 DAY) r(d) WHERE isodow(d) < 6) AS days FROM orders")
def business_days(t):
    start = b.lit("2024-01-01", "date")
    end = b.Expr(lambda ctx: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 60).cast("int")))
    return t("orders").select("o_orderkey", b.business_day_count(start, end).alias("days"))


@query("SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '*') AS padded, rpad(c_name, 4, '.') AS unused, concat_ws('-', c_name, c_mktsegment) AS pair, position('0' IN c_name) - 1 AS at, string_split(c_name, '#')[2] AS code, translate(c_mktsegment, 'AEIOU', 'aeiou') AS vowels FROM customer".replace("rpad(c_name, 4, '.') AS unused, ", ""))
def string_layout(t):
    n, m = col("c_name"), col("c_mktsegment")
    vowels = m
    for v in "AEIOU":
        vowels = vowels.str.replace_all(v, v.lower(), literal=True)
    return t("customer").select("c_custkey", col("c_custkey").cast("string").str.pad_start(8, "*").alias("padded"), b.concat_str("c_name", "c_mktsegment", separator="-").alias("pair"), n.str.find("0", literal=True).cast("int64").alias("at"), n.str.split_exact("#", 1).field("field_1").alias("code"), vowels.alias("vowels"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity <= q1 THEN 0 WHEN l_quantity <= q2 THEN 1 ELSE 2 END AS bin FROM lineitem, (SELECT quantile_cont(l_quantity, 1 / 3) AS q1, quantile_cont(l_quantity, 2 / 3) AS q2 FROM lineitem)")
def quantile_bins(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", col("l_quantity").qcut(3).alias("bin"))


@query("SELECT round(sum(value), 2) AS value, sum(user_id)::BIGINT AS user_id FROM events")
def frame_sums(t):
    return t("events").select("value", "user_id").sum().with_columns(col("value").round(2))


@query("SELECT 'count' AS statistic, count(value)::DOUBLE AS value FROM events UNION ALL SELECT 'null_count', 0 UNION ALL SELECT 'mean', round(avg(value), 6) FROM events UNION ALL SELECT 'std', round(stddev_samp(value), 6) FROM events UNION ALL SELECT 'min', round(min(value), 6) FROM events UNION ALL SELECT 'max', round(max(value), 6) FROM events")
def describe_values(t):
    return t("events").select("value").describe(()).with_columns(col("value").round(6))


@query("SELECT s_suppkey, avg(s_acctbal) OVER (PARTITION BY s_nationkey) IS NOT NULL AS known, coalesce(nullif(s_name, 'x'), '-') AS name, s_acctbal > 0 IS TRUE AS positive FROM supplier")
def null_safe(t):
    return t("supplier").select("s_suppkey", col("s_acctbal").mean().over("s_nationkey").is_not_null().alias("known"), b.coalesce(b.when(col("s_name").ne("x")).then(col("s_name")), b.lit("-")).alias("name"), (col("s_acctbal") > 0.0).eq_missing(b.lit(True)).alias("positive"))


def _described(kind: str, f: str) -> str:
    return f"SELECT '{kind}' AS statistic, round(({f.format('value')})::DOUBLE, 6) AS value, round(({f.format('user_id')})::DOUBLE, 6) AS user_id FROM events"


@query(" UNION ALL ".join([_described("count", "count({0})"), _described("null_count", "count(*) - count({0})"), _described("mean", "avg({0})"), _described("std", "stddev_samp({0})"), _described("min", "min({0})"), _described("max", "max({0})"),
    *[_described(f"{q}%", f"(list({{0}} ORDER BY {{0}}))[floor((count({{0}}) - 1) * {q / 100} + 0.5)::INT + 1]") for q in (25, 50, 75)]]))
def describe_events(t):
    return t("events").select("value", "user_id").describe().with_columns(col("value").round(6), col("user_id").round(6))


# -- without SQL -----------------------------------------------------------------------------------------------


@query()
def sample_rows(t):
    return t("orders").sort("o_orderkey").sample(100, seed=3)


@query()
def approximate_users(t):
    return t("events").group_by("event_type").agg(col("user_id").approx_n_unique().alias("users"))
