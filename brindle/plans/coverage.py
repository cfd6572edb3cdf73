"""More queries with SQL: one for each family of functions, readers and sinks that suites.py doesn't call."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

import brindle as b
from brindle import Frame, col
from brindle.frame import Series
from brindle.plans.suites import query
from brindle.sources import readers, writers
from brindle.streaming import windows

BY_TIME = {"partition_by": "user_id", "order_by": ["ts", "event_id"]}


# -- places of rows after shuffles, sorts and joins ---------------------------------------------


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id DESC LIMIT 11")
def tail_after_sort(t):
    return t("events").sort("value", "event_id").tail(11).select("event_id", "value")


@query("SELECT (row_number() OVER (ORDER BY user_id) - 1)::BIGINT AS i, user_id, count(*) AS n FROM events GROUP BY user_id")
def row_index_after_group(t):
    return t("events").group_by("user_id").len("n").sort("user_id").with_row_index("i")


@query("""SELECT o_orderkey, c_name FROM (SELECT o_orderkey, c_name, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders JOIN customer ON o_custkey = c_custkey) WHERE k IN (0, 7, 77, (SELECT count(*) FROM orders) - 2)
    UNION ALL SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)""")
def gather_after_join(t):
    rows = t("orders").join(t("customer"), left_on="o_custkey", right_on="c_custkey").sort("o_orderkey").select("o_orderkey", "c_name")
    return rows.gather([0, 7, 77, -2]).vstack(rows.take([0]))


@query("""SELECT a.user_id, a.n, z.event_type, z.m FROM (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY user_id) AS k FROM events GROUP BY 1) a
    JOIN (SELECT event_type, count(*) AS m, row_number() OVER (ORDER BY event_type) AS k FROM events GROUP BY 1) z USING (k)""")
def hstack_grouped(t):
    users = t("events").group_by("user_id").len("n").sort("user_id").head(5)
    return users.hstack(t("events").group_by("event_type").len("m").sort("event_type"))


@query("SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, 1 AS same FROM (SELECT * FROM orders LIMIT 120)")
def sample_after_sort(t):
    rows = t("orders").sort("o_totalprice", "o_orderkey")
    again = rows.sample(120, seed=5).join(rows.sample(120, seed=5).select("o_orderkey"), on="o_orderkey")
    return again.select(b.len_().alias("rows"), col("o_orderkey").n_unique().alias("keys"), b.lit(1).alias("same"))


@query("""SELECT k::BIGINT AS row, dense_rank() OVER (ORDER BY f)::BIGINT - 1 AS "group", f::BIGINT AS first FROM (SELECT k, min(k) OVER (PARTITION BY event_type) AS f FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events))""")
def group_numbers(t):
    return t("events").sort("event_id").group_indices("event_type")


@query("""SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey DESC) AS k FROM orders) WHERE k <= 6""")
def bottom_rows(t):
    return t("orders").with_columns((-col("o_orderkey")).alias("down")).bottom_k(6, ["o_totalprice", "down"]).select("o_orderkey", "o_totalprice").limit(6)


@query("SELECT (k - 1)::BIGINT AS index FROM (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) ORDER BY s_acctbal LIMIT 10")
def arg_sort_rows(t):
    return t("supplier").sort("s_suppkey").arg_sort("s_acctbal").limit(10)


# -- projection and selectors -----------------------------------------------------------------------


@query("SELECT c_custkey AS k_c_custkey, c_nationkey AS k_c_nationkey, c_name, c_acctbal AS c_acctbal_x, NULL::BIGINT AS none, c_mktsegment FROM customer")
def selectors(t):
    return t("customer").select_exprs(b.columns("key$").name_prefix("k_"), b.nth(1), b.by_dtype("float64").name_suffix("_x"), b.null("int64").alias("none"), b.last_())


@query("SELECT n_regionkey, n_name, upper(n_name) AS up, n_nationkey FROM nation")
def inserted_columns(t):
    n = t("nation").sort("n_nationkey")
    wide = n.insert_column(1, col("n_name").str.to_uppercase().alias("up"))
    return wide.select(b.exclude("n_nationkey", "up"), "up", b.first_())


@query("SELECT s_suppkey, s_name, s_acctbal, s_suppkey * 2 AS twice FROM supplier")
def added_series(t):
    s = t("supplier").sort("s_suppkey")
    twice = s.select((col("s_suppkey") * 2).alias("twice")).get_column("twice")
    return s.with_column(twice).select(b.all_()).drop("s_nationkey")


# -- rows -----------------------------------------------------------------------------------------------


@query("""SELECT event_id, coalesce(x, 0) AS zero, coalesce(x, m) AS mean, CASE WHEN isnan(y) THEN -1 ELSE y END AS y FROM (SELECT *, avg(x) OVER () AS m FROM (SELECT event_id, CASE WHEN value > 50 THEN value END AS x, CASE WHEN value < 10 THEN 'NaN'::DOUBLE ELSE value END AS y FROM events))""")
def filled_rows(t):
    v = col("value")
    e = t("events").select("event_id", b.when(v > 50.0).then(v).alias("x"), b.when(v < 10.0).then(float("nan")).otherwise(v).alias("y"))
    zero = e.fill_null(strategy="zero", subset="x").select("event_id", col("x").alias("zero"))
    mean = e.fill_null(strategy="mean", subset="x").fill_nan(-1.0).rename({"x": "mean"})
    return zero.join(mean, on="event_id")


@query("SELECT event_id, value AS y FROM events WHERE value >= 10 AND value <= 60")
def dropped_rows(t):
    v = col("value")
    e = t("events").select("event_id", b.when(v < 10.0).then(float("nan")).when(v > 60.0).then(None).otherwise(v).alias("y"))
    return e.drop_nans("y").drop_nulls().vstack(e.clear())


@query("SELECT event_id, lead(value) OVER (ORDER BY event_id) AS value FROM events")
def shifted_rows(t):
    e = t("events").sort("event_id").select("event_id", "value")
    return e.select("event_id").hstack(e.select("value").shift(-1))


@query("SELECT count(*) > 1 AS twin, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY p_brand, p_size) AS c FROM part) GROUP BY c > 1 HAVING true")
def duplicate_flags(t):
    p = t("part").select("p_brand", "p_size")
    return p.is_duplicated().group_by("value").len("n").filter(~col("value").is_null()).select((col("n") > 1).alias("twin"), "n")


# -- groups and reductions ---------------------------------------------------------------------------------


@query("""SELECT event_type, 'sum' AS kind, round(sum(value), 2) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'mean', round(avg(value), 2) FROM events GROUP BY 1 UNION ALL SELECT event_type, 'min', round(min(value), 2) FROM events GROUP BY 1 UNION ALL SELECT event_type, 'max', round(max(value), 2) FROM events GROUP BY 1
    UNION ALL SELECT event_type, 'median', round(median(value), 2) FROM events GROUP BY 1 UNION ALL SELECT event_type, 'first', round(arg_min(value, event_id), 2) FROM events GROUP BY 1 UNION ALL SELECT event_type, 'last', round(arg_max(value, event_id), 2) FROM events GROUP BY 1 UNION ALL SELECT event_type, 'n_unique', count(DISTINCT value) FROM events GROUP BY 1
    UNION ALL SELECT event_type, 'quantile', round((list(value ORDER BY value))[floor((count(*) - 1) * 0.5 + 0.5)::INT + 1], 2) FROM events GROUP BY 1""")
def group_methods(t):
    g = t("events").sort("event_id").select("event_type", "value").group_by("event_type")
    kinds = {"sum": g.sum(), "mean": g.mean(), "min": g.min(), "max": g.max(), "median": g.median(), "first": g.first(), "last": g.last(), "n_unique": g.n_unique().cast({"value": "float64"}), "quantile": g.quantile(0.5)}
    return b.concat([f.select("event_type", b.lit(k).alias("kind"), col("value").round(2).alias("value")) for k, f in kinds.items()])


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3")
def group_tail(t):
    return t("events").sort("ts", "event_id").group_by("user_id").tail(3).select("event_id", "user_id", "ts")


@query("""SELECT event_type, bool_or(user_id = 3 AND value > 90) AS some, product(CASE WHEN event_id % 997 = 0 THEN 2 ELSE 1 END)::BIGINT AS p, arg_min(k, value) AS low, arg_max(k, value) AS high, list_count(list(DISTINCT user_id)) AS users, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS big, count(*) FILTER (value <= 50) > 0 AS gaps
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1""")
def group_positions(t):
    v = col("value")
    x = b.when(v > 50.0).then(v)
    e = t("events").sort("event_id").with_columns(x.alias("x"), b.when(col("event_id") % 997 == 0).then(2).otherwise(1).cast("int64").alias("two"))
    return e.group_by("event_type").agg(((col("user_id") == 3) & (v > 90.0)).any().alias("some"), col("two").product().alias("p"), v.arg_min().cast("int64").alias("low"), v.arg_max().cast("int64").alias("high"), col("user_id").unique_counts().list.len().alias("users"), col("x").count().alias("big"), col("x").has_nulls().alias("gaps"))


@query("""SELECT event_type, list_sort(list(DISTINCT user_id))[1:3] AS few, (list(event_id ORDER BY event_id))[3:4] AS part, [(list(event_id ORDER BY event_id))[1], (list(event_id ORDER BY event_id))[-1]] AS ends, (list(event_id ORDER BY event_id))[2] AS second, list_reverse((list(event_id ORDER BY event_id))[:2]) AS back,
    (list(value ORDER BY value))[:2] AS low, (list(event_id ORDER BY value DESC, event_id))[:2] AS top, (list(event_id ORDER BY value, event_id))[:2] AS worst, (list(value ORDER BY value DESC))[:3] AS sorted, (list(k ORDER BY value, k))[:3] AS places, (list(value ORDER BY event_id) FILTER (value > 95))[:2] AS known
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1""")
def group_sequences(t):
    i, v = col("event_id"), col("value")
    e = t("events").sort("event_id").with_columns(b.when(v > 95.0).then(v).alias("x"))
    out = e.group_by("event_type").agg(
        col("user_id").unique().alias("u"), i.slice(2, 2).alias("part"), i.gather([0, -1]).alias("ends"), i.get(1).alias("second"), i.head(2).alias("h"), i.reverse().alias("r"), v.bottom_k(2).alias("low"), i.top_k_by("value", 2).alias("top"), i.bottom_k_by("value", 2).alias("worst"), v.sort(descending=True, nulls_last=True).alias("s"), v.arg_sort().alias("a"), col("x").drop_nulls().alias("d"))
    few = lambda c, n: F.slice(F.col(c), 1, n)
    return Frame(out.df.select("event_type", few("d", 2).alias("known"), F.slice(F.sort_array("u"), 1, 3).alias("few"), "part", "ends", "second", F.slice(F.reverse("h"), 1, 2).alias("back"), "low", "top", "worst", few("s", 3).alias("sorted"), few("a", 3).alias("places")))


@query("""SELECT round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, round(median(value), 4) AS median, count(value) AS n, round(stddev_samp(value), 4) AS std, round(var_samp(value), 3) AS var, count(*) FILTER (value IS NULL) AS nulls, count(DISTINCT event_type) AS kinds,
    (list(value ORDER BY value))[floor((count(*) - 1) * 0.9 + 0.5)::INT + 1] AS q, 1::DOUBLE AS product FROM events""")
def frame_methods(t):
    e = t("events")
    f = e.select("value")
    parts = {"mean": f.mean(), "low": f.min(), "high": f.max(), "median": f.median(), "n": f.count(), "std": f.std(), "var": f.var(), "nulls": f.null_count(), "q": f.quantile(0.9), "product": e.select((col("value") * 0.0 + 1.0).alias("value")).product()}
    out = Frame(t.spark.range(1).select(F.lit(e.n_unique("event_type")).cast("long").alias("kinds")))
    for k, p in parts.items():
        out = out.join(p.rename({"value": k}), how="cross")
    return out.with_columns(*[col(c).round(n) for c, n in (("mean", 4), ("median", 4), ("std", 4), ("var", 3))])


# -- windows over the whole table and by groups ---------------------------------------------------------------


@query("""SELECT event_id, round(sum(value) OVER w, 3) AS running, lag(value, 3) OVER w AS before, value - lag(value) OVER w AS change, CASE WHEN count(value) OVER r >= 5 THEN round(avg(value) OVER r, 6) END AS smooth, min(value) OVER w AS low, count(x) OVER w AS seen, round(sum(value) OVER (ORDER BY event_id DESC), 3) AS rest,
    last_value(x IGNORE NULLS) OVER w AS known, (row_number() OVER w - 1)::BIGINT AS place, value - avg(value) OVER () AS centred FROM (SELECT *, CASE WHEN value > 90 THEN value END AS x FROM events) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING), r AS (ORDER BY event_id ROWS 4 PRECEDING)""")
def whole_windows(t):
    v, x = col("value"), col("x")
    e = t("events").sort("event_id").with_columns(b.when(v > 90.0).then(v).alias("x"))
    return e.select("event_id", v.cum_sum().round(3).alias("running"), v.shift(3).alias("before"), v.diff().alias("change"), v.rolling_mean(5).round(6).alias("smooth"), v.cum_min().alias("low"), x.cum_count().alias("seen"), v.cum_sum(reverse=True).round(3).alias("rest"), x.forward_fill().alias("known"), b.int_range().alias("place"), (v - v.mean()).alias("centred"))


@query("""SELECT event_id, rank() OVER (ORDER BY value) AS low, row_number() OVER (ORDER BY value DESC, event_id) AS ordinal, (rank() OVER (ORDER BY event_type) + rank() OVER (ORDER BY event_type) + count(*) OVER (PARTITION BY event_type) - 1) / 2 AS average, rank() OVER (ORDER BY event_type) + count(*) OVER (PARTITION BY event_type) - 1 AS high FROM events""")
def whole_ranks(t):
    e = t("events").sort("event_id")
    v, k = col("value"), col("event_type")
    one = e.select("event_id", v.rank("min").cast("int64").alias("low")).join(e.select("event_id", v.rank("ordinal", descending=True).cast("int64").alias("ordinal")), on="event_id")
    return one.join(e.select("event_id", k.rank().alias("average"), k.rank("max").cast("int64").alias("high")), on="event_id")


@query("""SELECT event_id, round(sum(value) OVER w, 3) AS s, lag(event_id) OVER (ORDER BY user_id, ts, event_id) AS p FROM events WINDOW w AS (ORDER BY user_id, ts, event_id ROWS UNBOUNDED PRECEDING)""")
def whole_ordered(t):
    return t("events").select("event_id", col("value").cum_sum().over(order_by=["user_id", "ts", "event_id"]).round(3).alias("s"), col("event_id").shift(1).over(order_by=["user_id", "ts", "event_id"]).alias("p"))


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS m, max(value) OVER w AS h, CASE WHEN count(*) OVER w > 1 THEN round(stddev_samp(value) OVER w, 6) END AS s, CASE WHEN count(*) OVER w > 1 THEN round(var_samp(value) OVER w, 7) END AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '43199.999999 seconds' PRECEDING AND CURRENT ROW)""")
def rolling_by_time(t):
    v, o = col("value"), "user_id"
    return t("events").select("event_id", v.rolling_mean_by("ts", "12h").over(o).round(6).alias("m"), v.rolling_max_by("ts", "12h").over(o).alias("h"), v.rolling_std_by("ts", "12h").over(o).round(6).alias("s"), v.rolling_var_by("ts", "12h").over(o).round(7).alias("v"))


@query("""SELECT event_id, round(sum(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW), 3) AS s, min(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS low FROM events""")
def rolling_by_time_whole(t):
    v = col("value")
    return t("events").select("event_id", v.rolling_sum_by("ts", "1h").round(3).alias("s"), v.rolling_min_by("ts", "1h").alias("low"))


@query("SELECT user_id, ts, count(*) OVER w AS n, round(sum(value) OVER w, 3) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW)")
def rolling_groups(t):
    return t("events").rolling("ts", "1d", by="user_id").agg(b.len_().alias("n"), col("value").sum().round(3).alias("s"))


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN min(value) OVER w END AS low, round(product(value / 50 + 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 0 PRECEDING AND CURRENT ROW), 6) AS p, count(*) OVER (PARTITION BY user_id, event_type) > 1 AS dup, count(*) OVER (PARTITION BY user_id, event_type) = 1 AS uni FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)")
def window_rest(t):
    v = col("value")
    scaled = v / 50 + 0.5
    # A product of one factor is what is left of two running products, one a row behind.
    e = t("events").with_columns(scaled.cum_prod().over(**BY_TIME).alias("all"))
    ratio = col("all") / b.coalesce(col("all").shift(1).over(**BY_TIME), b.lit(1.0))
    return e.select("event_id", v.rolling_min(3).over(**BY_TIME).alias("low"), ratio.round(6).alias("p"), col("event_type").is_duplicated().over("user_id").alias("dup"), col("event_type").is_unique().over("user_id").alias("uni"))


@query("""SELECT event_id, CASE WHEN x IS NOT NULL THEN x WHEN a IS NULL OR z IS NULL THEN NULL ELSE round(a + (k - ak) / (zk - ak)::DOUBLE * (z - a), 6) END AS line FROM (SELECT event_id, x, k,
    last_value(x IGNORE NULLS) OVER w AS a, last_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER w AS ak, first_value(x IGNORE NULLS) OVER u AS z, first_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER u AS zk
    FROM (SELECT event_id, CASE WHEN value > 70 THEN value END AS x, row_number() OVER (ORDER BY event_id) AS k FROM events) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING), u AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def interpolated(t):
    v = col("value")
    e = t("events").sort("event_id").with_columns(b.when(v > 70.0).then(v).alias("x"))
    return e.select("event_id", b.when(col("x").is_not_null()).then(col("x")).otherwise(col("x").interpolate().round(6)).alias("line"))


# -- elementwise functions ----------------------------------------------------------------------------------------


@query("""SELECT event_id, round(pow(value, 2), 4) AS sq, round(log10(value + 1), 9) AS l10, round(ln(1 + value), 9) AS l1, round(cbrt(value), 9) AS cb, round(sin(value), 9) AS s, round(cos(value), 9) AS c, round(tan(value / 100), 9) AS t, round(cot(value / 100 + 0.1), 9) AS ct, round(asin(value / 1000), 9) AS a1, round(acos(value / 1000), 9) AS a2, round(atan(value), 9) AS a3,
    round(sinh(value / 100), 9) AS h1, round(cosh(value / 100), 9) AS h2, round(tanh(value / 100), 9) AS h3, round(asinh(value), 9) AS h4, round(acosh(value + 1), 9) AS h5, round(atanh(value / 1000), 9) AS h6, greatest(value, 20) AS low, least(value, 80) AS high, round(radians(value), 9) AS r, trunc(value) AS tr FROM events""")
def more_numbers(t):
    v = col("value")
    q, h, m = v / 100, v / 100 + 0.1, v / 1000
    return t("events").select("event_id", (v**2).round(4).alias("sq"), (v + 1.0).log10().round(9).alias("l10"), v.log1p().round(9).alias("l1"), v.cbrt().round(9).alias("cb"), v.sin().round(9).alias("s"), v.cos().round(9).alias("c"), q.tan().round(9).alias("t"), h.cot().round(9).alias("ct"), m.arcsin().round(9).alias("a1"), m.arccos().round(9).alias("a2"), v.arctan().round(9).alias("a3"), q.sinh().round(9).alias("h1"), q.cosh().round(9).alias("h2"), q.tanh().round(9).alias("h3"), v.arcsinh().round(9).alias("h4"), (v + 1.0).arccosh().round(9).alias("h5"), m.arctanh().round(9).alias("h6"), v.clip_min(20.0).alias("low"), v.clip_max(80.0).alias("high"), v.radians().round(9).alias("r"), v.truncate().alias("tr"))


@query("""SELECT event_id, value != 50 AS a, event_type = 'view' AS c, x IS NULL AS d, x IS DISTINCT FROM 5 AS e, value > 50 OR user_id < 10 AS f, (value > 50) != (user_id < 10) AS g, NOT value > 50 AS h, isnan(y) AS i, NOT isnan(y) AS j, isfinite(y) AS k, isinf(y) AS l, CASE WHEN isnan(y) THEN 0 ELSE y END AS m, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS n, CASE WHEN value > 90 THEN 'top' END AS o
    FROM (SELECT *, CASE WHEN value > 50 THEN value END AS x, CASE WHEN value < 5 THEN 'NaN'::DOUBLE WHEN value > 95 THEN 'Infinity'::DOUBLE ELSE value END AS y FROM events)""")
def more_tests(t):
    v, x, y = col("value"), col("x"), col("y")
    e = t("events").with_columns(b.when(v > 50.0).then(v).alias("x"), b.when(v < 5.0).then(float("nan")).when(v > 95.0).then(float("inf")).otherwise(v).alias("y"))
    big, few = v > 50.0, col("user_id") < 10
    return e.select("event_id", (v != 50.0).alias("a"), col("event_type").eq("view").alias("c"), x.is_null().alias("d"), x.ne_missing(5.0).alias("e"), big.or_(few).alias("f"), big.xor(few).alias("g"), big.not_().alias("h"), y.is_nan().alias("i"), y.is_not_nan().alias("j"), y.is_finite().alias("k"), y.is_infinite().alias("l"), y.fill_nan(0.0).alias("m"), col("event_type").replace_strict({"view": 1, "click": 2}, 0).alias("n"), b.when(v > 90.0).then(b.lit("top")).end().alias("o"))


@query(r"""SELECT p_partkey, strlen(p_name) AS bytes, ltrim(p_name, 'bcs') AS st, rtrim(p_name, 'tg') AS en, CASE WHEN starts_with(p_name, 'red ') THEN p_name[5:] ELSE p_name END AS pre, regexp_replace(p_name, ' ring$', '') AS suf, ends_with(p_type, 'Y') AS y, contains(p_name, 'red') OR contains(p_name, 'ring') AS anyof, regexp_extract_all(p_brand, '[0-9]') AS digits,
    struct_pack(a := regexp_extract(p_brand, '(Brand)#([0-9]+)', 1), z := regexp_extract(p_brand, '(Brand)#([0-9]+)', 2)) AS groups, replace(p_brand, '#', '\#') AS esc, replace(replace(p_name, 'red', 'R'), 'ring', 'O') AS many, p_name[:3] AS head, rpad(p_brand, 10, '.') AS padded, p_brand AS dec, p_name AS nf, p_size::BIGINT AS hexed, upper(p_name[1]) || p_name[2:] AS t1, string_split(p_name, ' ')[1] AS w1 FROM part""")
def more_strings(t):
    n, k, w = col("p_name").str, col("p_type").str, col("p_brand").str
    return t("part").select(
        "p_partkey", n.len_bytes().alias("bytes"), n.strip_chars_start("bcs").alias("st"), n.strip_chars_end("tg").alias("en"), n.strip_prefix("red ").alias("pre"), n.strip_suffix(" ring").alias("suf"), k.ends_with("Y").alias("y"), n.contains_any(["red", "ring"]).alias("anyof"), w.extract_all("[0-9]").alias("digits"), w.extract_groups("(?<a>Brand)#(?<z>[0-9]+)").alias("groups"), w.escape_regex().alias("esc"), n.replace_many(["red", "ring"], ["R", "O"]).alias("many"), n.head(3).alias("head"), w.pad_end(10, ".").alias("padded"),
        w.encode("hex").str.decode("hex").cast("string").alias("dec"), n.normalize("NFC").alias("nf"), col("p_size").cast("string").str.to_integer(10).alias("hexed"), b.concat_str(n.head(1).str.to_titlecase(), n.slice(1)).alias("t1"), n.splitn(" ", 2).field("field_0").alias("w1"))


@query("""SELECT event_id, second(ts)::INT AS s, (millisecond(ts) % 1000)::INT AS ms, (microsecond(ts) % 1000000)::INT AS us, ((microsecond(ts) % 1000000) * 1000)::INT AS ns, isoyear(ts)::INT AS iy, century(ts)::INT AS ce, millennium(ts)::INT AS mi, (date_trunc('month', ts) + (ts - date_trunc('day', ts)))::TIMESTAMP AS first, last_day(ts::DATE) + (ts - date_trunc('day', ts)) AS final, day(last_day(ts::DATE))::INT AS days, year(ts) % 4 = 0 AS leap,
    date_diff('microsecond', date_trunc('day', ts)::TIMESTAMP, ts) * 1000 AS clock, time_bucket(INTERVAL '1 hour', ts + INTERVAL '30 minutes', TIMESTAMP '1970-01-01') AS rounded, epoch_us(ts) AS t, make_timestamp(year(ts), month(ts), 1, hour(ts), 0, second(ts) + (microsecond(ts) % 1000000) / 1000000.0) AS moved, isodow(ts) < 6 AS works, ts::DATE + 0 AS again FROM events""")
def more_times(t):
    x = col("ts").dt
    return t("events").select(
        "event_id", x.second().alias("s"), x.millisecond().alias("ms"), x.microsecond().alias("us"), x.nanosecond().alias("ns"), x.iso_year().alias("iy"), x.century().alias("ce"), x.millennium().alias("mi"), x.month_start().alias("first"), x.month_end().alias("final"), x.days_in_month().alias("days"), x.is_leap_year().alias("leap"), x.time().alias("clock"), x.round("1h").alias("rounded"), x.with_time_unit("ms").dt.timestamp("us").alias("t"), x.replace(day=1, minute=0).alias("moved"), x.is_business_day().alias("works"),
        col("ts").dt.strftime("%Y-%m-%d").str.to_date().alias("again"))


@query("""SELECT event_id, make_timestamp(2024, 1, (event_id % 28 + 1)::BIGINT, (event_id % 24)::BIGINT, 30, 0.0) AS made, ts::DATE + TIME '06:30:00' AS joined, (event_id % 50) * 86400 + 3600 AS seconds, event_id % 50 AS days, (event_id % 50) * 24 + 1 AS hours, ((event_id % 50) * 24 + 1) * 60 AS minutes, ((event_id % 50) * 86400 + 3600) * 1000 AS millis, strptime(strftime(ts, '%Y%m%d %H%M'), '%Y%m%d %H%M') AS parsed FROM events""")
def made_times(t):
    k = col("event_id")
    length = b.duration((k % 50).cast("int32"), 1)
    return t("events").select("event_id", b.datetime_(2024, 1, (k % 28 + 1).cast("int32"), (k % 24).cast("int32"), 30, 0).alias("made"), col("ts").dt.date().dt.combine(b.time_(6, 30)).alias("joined"), length.dt.total_seconds().alias("seconds"), length.dt.total_days().alias("days"), length.dt.total_hours().alias("hours"), length.dt.total_minutes().alias("minutes"), length.dt.total_milliseconds().alias("millis"), col("ts").dt.strftime("%Y%m%d %H%M").str.strptime("%Y%m%d %H%M").alias("parsed"))


@query("""SELECT event_id, epoch_us(ts) + 18000000000 AS instant, ts + INTERVAL '9 hours' AS tokyo FROM events WHERE ts < TIMESTAMP '2024-03-01'""")
def time_zones(t):
    x = col("ts").dt
    e = t("events").filter(col("ts") < b.lit("2024-03-01", "datetime"))
    return e.select("event_id", x.replace_time_zone("America/New_York").dt.epoch("us").alias("instant"), x.replace_time_zone("UTC").dt.convert_time_zone("Asia/Tokyo").alias("tokyo"))


@query("""SELECT o_orderkey, (SELECT max(d) FROM (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 DAY))::DATE AS d) WHERE isodow(d) < 6 AND d >= DATE '2024-01-01' + (o_orderkey % 20)::INT) WHERE k = 6) AS due FROM orders""")
def business_days_ahead(t):
    start = b.Expr(lambda ctx: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 20).cast("int")))
    return t("orders").select("o_orderkey", start.dt.add_business_days(5, roll="forward").alias("due"))


@query("SELECT vec_id, round(list_sum(embedding)::DOUBLE, 4) AS s, round(list_avg(embedding)::DOUBLE, 6) AS m, list_min(embedding) AS low, list_contains([label, 7], 7) AS has, array_to_string([label::VARCHAR, 'x'], '-') AS joined, struct_pack(vec_id := vec_id, label := label) AS both FROM embeddings")
def more_lists(t):
    e = col("embedding").list
    pair = b.Expr(lambda ctx: F.array(F.col("label"), F.lit(7)))
    text = b.Expr(lambda ctx: F.array(F.col("label").cast("string"), F.lit("x")))
    return t("embeddings").select("vec_id", e.sum().round(4).alias("s"), e.mean().round(6).alias("m"), e.min().alias("low"), pair.list.contains(7).alias("has"), text.list.join("-").alias("joined"), b.as_struct("vec_id", "label").alias("both"))


@query("SELECT user_id, sum(event_id)::BIGINT AS exact FROM events GROUP BY 1")
def list_sums(t):
    return t("events").group_by("user_id").agg(col("event_id").implode().alias("ids")).select("user_id", col("ids").list.sum().alias("exact"))


@query("SELECT unnest(range(DATE '2024-01-31', DATE '2024-07-01', INTERVAL 1 DAY))::DATE AS day, 'd' AS kind")
def date_ranges(t):
    return b.date_range(t.spark, "2024-01-31", "2024-06-30", "1d", "day").with_columns(b.lit("d").alias("kind"))


@query("SELECT unnest(range(TIMESTAMP '2024-03-10 00:00:00', TIMESTAMP '2024-03-11 00:00:01', INTERVAL 90 MINUTE)) AS at")
def datetime_ranges(t):
    return b.datetime_range(t.spark, "2024-03-10 00:00:00", "2024-03-11 00:00:00", "90m", "at")


# -- series and tables as a whole -----------------------------------------------------------------------------------


@query("""SELECT 'sum' AS kind, round(sum(s_acctbal), 2) AS value FROM supplier UNION ALL SELECT 'mean', round(avg(s_acctbal), 2) FROM supplier UNION ALL SELECT 'min', min(s_acctbal) FROM supplier UNION ALL SELECT 'max', max(s_acctbal) FROM supplier UNION ALL SELECT 'median', round(median(s_acctbal), 2) FROM supplier UNION ALL SELECT 'std', round(stddev_samp(s_acctbal), 2) FROM supplier
    UNION ALL SELECT 'count', count(s_acctbal) FROM supplier UNION ALL SELECT 'n_unique', count(DISTINCT s_acctbal) FROM supplier UNION ALL SELECT 'first', arg_min(s_acctbal, s_suppkey) FROM supplier UNION ALL SELECT 'last', arg_max(s_acctbal, s_suppkey) FROM supplier UNION ALL SELECT 'third', s_acctbal FROM (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) WHERE k = 3
    UNION ALL SELECT 'height', count(*) FROM supplier UNION ALL SELECT 'width', 4""")
def series_values(t):
    f = t("supplier").sort("s_suppkey")
    s = f.get_column("s_acctbal")
    values = {"sum": s.sum(), "mean": s.mean(), "min": s.min(), "max": s.max(), "median": s.median(), "std": s.std(), "count": s.count(), "n_unique": s.n_unique(), "first": s.first(), "last": s.last(), "third": s.get(2), "height": f.height, "width": f.shape[1]}
    return Frame(t.spark.createDataFrame([(k, round(float(v), 2)) for k, v in values.items()], "kind string, value double"))


@query("""SELECT s_acctbal AS x, count(*) AS n FROM (SELECT round(abs(s_acctbal), -3) AS s_acctbal FROM supplier) GROUP BY 1""")
def series_counts(t):
    s = t("supplier").get_column("s_acctbal").abs().round(-3).renamed("x")
    return Series(s.frame).value_counts(sort=True).rename({"count": "n"})


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 8")
def collected_rows(t):
    f = t("supplier").lazy().sort("s_suppkey").filter(col("s_acctbal") > 0.0).select("s_suppkey")
    table, seen = f.head(8).profile()
    assert seen["rows"] == table.num_rows == f.fetch(8).num_rows and "s_acctbal" in f.explain()
    return b.from_arrow(t.spark, pa.concat_tables(list(f.head(8).iter_slices(3))))


# -- readers and sinks: written to the shared folder and read again ----------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_round_trip(t):
    path = t.scratch("csv")
    t("part").sink_csv(path, single_file=False)
    return readers.scan_csv(t.spark, path, schema=[("p_partkey", "int64"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int32"), ("p_retailprice", "float64")])


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def csv_inferred(t):
    path = t.scratch("csv")
    writers.write_csv(t("events").with_columns(col("ts").dt.strftime("%Y-%m-%d %H:%M:%S.%f")), path, quote_style="always", single_file=False)
    return readers.read_csv(t.spark, path, try_parse_dates=True)


@query("SELECT event_id, ts, value FROM events")
def csv_typed_fields(t):
    path = t.scratch("csv")
    f = t("events").select("event_id", col("ts").dt.strftime("%d.%m.%Y %H:%M:%S.%f").alias("ts"), "value")
    writers.write_csv(f, path, separator=";", single_file=False)
    fields = readers.CsvSchema([readers.CsvField.int64("event_id"), readers.CsvField.datetime("ts", format="%d.%m.%Y %H:%M:%S.%f"), readers.CsvField.float64("value")])
    return readers.read_csv(t.spark, path, fields, separator=";")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey < 12")
def parquet_round_trip(t):
    path = t.scratch("parquet")
    t("customer").sink_parquet(path, partition_by=["c_nationkey"])
    return readers.scan_parquet(t.spark, path).filter(col("c_nationkey") < 12).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT sum(n)::BIGINT AS rows, min(low) AS low, max(high) AS high FROM (SELECT count(*) AS n, min(s_suppkey) AS low, max(s_suppkey) AS high FROM supplier)")
def parquet_footers(t):
    path = t.scratch("one")
    writers.write_parquet(t("supplier"), path, single_file=True)
    footer = readers.parquet_row_group_statistics(t.spark, path).filter(col("column") == "s_suppkey")
    return footer.select(col("num_rows").sum().alias("rows"), col("min").cast("int64").min().alias("low"), col("max").cast("int64").max().alias("high"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def ndjson_round_trip(t):
    path = t.scratch("json")
    writers.write_ndjson(t("events").select("event_id", "user_id", "event_type", "value"), path, single_file=False)
    return readers.scan_ndjson(t.spark, path)


@query("SELECT n_nationkey, n_name, struct_pack(r := n_regionkey) AS s FROM nation")
def json_round_trip(t):
    path = t.scratch("json")
    n = t("nation").rename({"n_regionkey": "r"}).pack_struct("s", ["r"])
    writers.write_json(n, path)
    return readers.read_json(t.spark, path, schema=[("n_nationkey", "int32"), ("n_name", "string"), ("s", "struct<r:int>")])


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def ipc_round_trip(t):
    path = t.scratch("ipc")
    writers.write_ipc(t("supplier"), path, batch_size=100)
    names = readers.read_ipc_schema(path, t.spark).names
    return readers.scan_ipc(t.spark, path).select(*names)


@query("SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def ipc_streams(t):
    path = t.scratch("ipcs")
    writers.write_ipc_stream(t("supplier").select("s_suppkey", "s_acctbal"), path)
    one = readers.read_ipc_stream(t.spark, path)
    writers.write_ipc(one, path + "f")
    return one.vstack(readers.read_ipc(t.spark, path + "f", ["s_suppkey", "s_acctbal"]))


@query("SELECT n_nationkey AS k, n_name AS name, NULL::DOUBLE AS extra, 'a' AS part FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, n_name, n_regionkey + 0.5, 'z' FROM nation WHERE n_nationkey >= 10")
def datasets(t):
    path = t.scratch("set")
    n = t("nation")
    first = n.filter(col("n_nationkey") < 10).select(col("n_nationkey").alias("k"), col("n_name").alias("name"))
    second = n.filter(col("n_nationkey") >= 10).select(col("n_name").alias("name"), col("n_nationkey").alias("k"), (col("n_regionkey").cast("float64") + 0.5).alias("extra"))
    writers.write_parquet(first, f"{path}/part=a/x.parquet", single_file=True)
    writers.write_parquet(second, f"{path}/part=z/y.parquet", single_file=True)
    files = readers.resolve_paths(t.spark, [f"{path}/**/*.parquet"])
    return readers.read_dataset(t.spark, files, options=readers.DatasetOptions(hive_partitioning=True, missing_columns="insert", extra_columns="insert")).select("k", "name", "extra", "part")


# -- streams ----------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 3) AS s FROM events GROUP BY 1, 2")
def stream_windows(t):
    stream = windows.parquet_stream(t.spark, t.folder, table="events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.windowed(stream, "ts", "1 day", [F.count("*").alias("n"), F.sum("value").alias("v")], by=("event_type",), late="60 days")
    got = windows.run_to_files(out, t.scratch("results"), t.scratch("stream"), mode="complete")
    return Frame(got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("v", 3).alias("s")))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS end, count(*) AS n FROM (SELECT user_id, ts, sum(gap) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY user_id, s""")
def stream_sessions(t):
    stream = windows.parquet_stream(t.spark, t.folder, table="events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.sessions(stream, "ts", "2 hours", [F.count("*").alias("n")], by=("user_id",), late="60 days")
    got = windows.run_to_files(out, t.scratch("results"), t.scratch("stream"), mode="complete")
    return Frame(got.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), F.col("session.end").cast("timestamp_ntz").alias("end"), "n"))


@query("SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 3) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999 seconds' PRECEDING AND CURRENT ROW)")
def stream_trailing(t):
    stream = windows.parquet_stream(t.spark, t.folder, table="events")
    out = windows.trailing(stream, "ts", "6h", "value", keys=("user_id",), keep=("event_id",))
    got = windows.run_to_files(out, t.scratch("trailing"), t.scratch("stream"))
    return Frame(got.select("event_id", "n", F.round("s", 3).alias("s")))
