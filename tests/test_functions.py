import datetime as dt
import unicodedata

import brindle as b
import pytest
from brindle import Frame, col
from brindle.functions import geo, strings, temporal


def one(spark, value, kind, e):
    return Frame(spark.createDataFrame([(value,)], f"x {kind}")).select(e.alias("y")).item()


S = col("x").str


@pytest.mark.parametrize(("value", "e", "want"), [
    ("a_b 1st é", S.to_titlecase(), "A_B 1St É"), ("héllo", S.slice(-3, 2), "ll"), ("héllo", S.slice(-9, 6), "hé"), ("-5", S.zfill(4), "-005"), ("abcd", S.pad_start(2), "abcd"), ("a,b,", S.split(",", inclusive=True), ["a,", "b,"]), ("", S.split(","), [""]),
    ("éa", S.find("a", literal=True), 2), ("abc", S.find("z"), None), ("aaa", S.count_matches(""), 4), ("a1b22", S.extract_all("[0-9]+"), ["1", "22"]), ("xyz", S.extract("(q)"), None), ("a.b.c", S.replace(".", "-", literal=True), "a-b.c"), ("ab12", S.replace_all("([0-9])", "<${1}>"), "ab<1><2>"),
    ("ab12", S.replace("([0-9])", "<$1>"), "ab<1>2"), ("100%_x", S.like("100%x"), True), ("a\\b", S.like("a\\b"), True), ("Catdog", S.contains_any(["DOG"], True), True), ("zz", S.to_integer(36), 35 * 36 + 35), ("-ff", S.to_integer(16), -255), ("xx", S.to_integer(10, strict=False), None),
    ("abab", S.replace_many(["ab", "b"], ["b", "x"]), "bb"), ("pre-x", S.strip_prefix("pre-"), "x"), ("x.txt", S.strip_suffix(".txt"), "x"), ("hi", S.encode("hex"), "6869"), ("a+b", S.escape_regex(), "a\\+b"), (" x\t", S.strip_chars(), "x"), ('{"a":[1,{"b":"z"}]}', S.json_path_match("$..b"), "z"),
    ('{"a":[1,2,3]}', S.json_path_match("$.a[-1]"), "3"), ('{"a":[{"p":1},{"p":5,"q":7}]}', S.json_path_match("$.a[?(@.p > 2)].q"), "7"), ("bad", S.json_path_match("$.a[-1]"), None), (None, S.to_titlecase(), None), ("abc", S.head(-1), "ab"), ("abc", S.tail(-1), "bc"),
])
def test_strings(spark, value, e, want):
    assert one(spark, value, "string", e) == want


def test_normal_forms(spark):
    assert one(spark, "é", "string", S.normalize("NFC")) == unicodedata.normalize("NFC", "é")


def test_struct_splits(spark):
    assert tuple(one(spark, "a-b-c", "string", S.splitn("-", 2))) == ("a", "b-c") and tuple(one(spark, "a", "string", S.split_exact("-", 1))) == ("a", None)
    assert tuple(one(spark, "k=v", "string", S.extract_groups("(?<key>\\w)=(\\w)"))) == ("k", "v")


D = col("x").dt
T = dt.datetime(2024, 2, 29, 13, 45, 30, 123456)


@pytest.mark.parametrize(("e", "want"), [
    (D.truncate("1w"), dt.datetime(2024, 2, 26)), (D.truncate("1q"), dt.datetime(2024, 1, 1)), (D.round("1h"), dt.datetime(2024, 2, 29, 14)), (D.offset_by("1y"), dt.datetime(2025, 2, 28, 13, 45, 30, 123456)), (D.offset_by("-1mo"), dt.datetime(2024, 1, 29, 13, 45, 30, 123456)), (D.offset_by("1d-2h"), dt.datetime(2024, 3, 1, 11, 45, 30, 123456)),
    (D.month_start(), dt.datetime(2024, 2, 1, 13, 45, 30, 123456)), (D.month_end(), T), (D.days_in_month(), 29), (D.is_leap_year(), True), (D.weekday(), 4), (D.iso_year(), 2024), (D.millisecond(), 123), (D.microsecond(), 123456), (D.century(), 21), (D.millennium(), 3), (D.strftime("%Y-%j %e %W"), "2024-060 29 09"), (D.replace(day=1, hour=0), dt.datetime(2024, 2, 1, 0, 45, 30, 123456)),
])
def test_datetimes(spark, e, want):
    assert one(spark, T, "timestamp_ntz", e) == want


def test_epochs_floor(spark):
    assert one(spark, dt.datetime(1969, 12, 31, 23, 59, 59, 999000), "timestamp_ntz", D.epoch("s")) == -1


def test_business_days(spark):
    import numpy as np

    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(25)]
    off = ["2024-01-15", "2024-01-06"]
    f = Frame(spark.createDataFrame([(d,) for d in days], "x date").coalesce(1))
    got = [r[0] for r in f.select(b.business_day_count(b.lit(dt.date(2024, 1, 10)), col("x"), holidays=off).alias("n")).rows()]
    assert got == [int(np.busday_count("2024-01-10", d, holidays=off)) for d in days]
    moved = [r[0] for r in f.select(col("x").dt.add_business_days(3, holidays=off, roll="forward").alias("n")).rows()]
    assert moved == [np.busday_offset(d, 3, roll="forward", holidays=off).astype(dt.date) for d in days]


def test_intervals():
    assert temporal.interval("1mo2d-3h") == temporal.Interval(1, (48 - 3) * 3_600_000_000) and temporal.interval("-1w").micros == -7 * 86_400_000_000
    with pytest.raises(ValueError, match="not an interval"):
        temporal.interval("soon")


ZONES = ["UTC", "America/New_York", "Australia/Lord_Howe"]


@pytest.fixture(params=ZONES)
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def naive(spark, x, *es):
    """Values of expressions of a naive datetime, as text: the client's zone has no say."""
    f = Frame(spark.sql(f"SELECT TIMESTAMP_NTZ'{x}' AS x"))
    return [str(v) for v in f.select(*[e.cast("string").alias(f"e{k}") for k, e in enumerate(es)]).rows()[0]]


def test_naive_datetimes_know_no_zone(spark, zone):
    assert naive(spark, "2024-06-15 12:00:00", D.truncate("1d"), D.time(), D.month_start(), D.month_end(), D.epoch("s"), D.round("1d"), D.truncate("6h")) == ["2024-06-15 00:00:00", str(43_200 * 10**9), "2024-06-01 12:00:00", "2024-06-30 12:00:00", "1718452800", "2024-06-16 00:00:00", "2024-06-15 12:00:00"]
    # Clocks of New York skip this hour, those of Lord Howe half an hour in October.
    assert naive(spark, "2024-03-10 02:30:00", D.offset_by("1h"), D.offset_by("-1d"), D.offset_by("1mo"), D.replace(minute=45), D.truncate("1h")) == ["2024-03-10 03:30:00", "2024-03-09 02:30:00", "2024-04-10 02:30:00", "2024-03-10 02:45:00", "2024-03-10 02:00:00"]
    assert naive(spark, "2024-10-06 02:15:00.123456", D.microsecond(), D.nanosecond(), D.epoch("us"), D.round("1mo")) == ["123456", "123456000", "1728180900123456", "2024-10-01 00:00:00"]
    text = Frame(spark.sql("SELECT '2024-03-10 02:30:00' AS x, '2024-03-10' AS y, 'no' AS z"))
    assert text.select(S.to_datetime().cast("string").alias("a"), col("y").str.to_date().cast("string").alias("b"), col("z").str.to_datetime(strict=False).alias("c")).rows() == [("2024-03-10 02:30:00", "2024-03-10", None)]
    day = Frame(spark.sql("SELECT DATE'2024-03-10' AS x"))
    assert day.select(D.combine(b.time_(2, 30)).cast("string").alias("a"), D.truncate("1w").cast("string").alias("b"), D.offset_by("1mo").cast("string").alias("c")).rows() == [("2024-03-10 02:30:00", "2024-03-04", "2024-04-10")]
    hours = b.datetime_range(spark, "2024-03-10 01:00:00", "2024-03-10 04:00:00").select(col("datetime").cast("string")).rows()
    assert [r[0] for r in hours] == [f"2024-03-10 0{h}:00:00" for h in (1, 2, 3, 4)]


def test_windows_of_naive_times_know_no_zone(spark, zone):
    f = Frame(spark.sql("SELECT CAST(t AS TIMESTAMP_NTZ) AS t, 1 AS x FROM VALUES ('2024-03-10 01:10:00'), ('2024-03-10 02:10:00'), ('2024-03-10 03:10:00') AS v(t)").coalesce(1))
    got = f.group_by_dynamic("t", "1h").agg(b.len_().alias("n")).select(col("t").cast("string"), "n").rows()
    assert got == [(f"2024-03-10 0{h}:00:00", 1) for h in (1, 2, 3)]
    assert [r[0] for r in f.select(col("x").rolling_sum_by("t", "90m").alias("s")).rows()] == [1, 2, 2]


def test_totals_of_durations(spark, zone):
    f = Frame(spark.sql("SELECT INTERVAL '-1 02:03:04.5' DAY TO SECOND AS x"))
    assert f.select(D.total_days().alias("a"), D.total_hours().alias("b"), D.total_minutes().alias("c"), D.total_seconds().alias("d"), D.total_milliseconds().alias("e")).rows() == [(-1, -26, -1563, -93784, -93784500)]


def test_time_zones(spark, zone):
    def at(text, z="America/New_York", **k):
        f = Frame(spark.sql(f"SELECT TIMESTAMP_NTZ'{text}' AS x"))
        return f.select(D.replace_time_zone(z, **k).alias("y")).select(col("y").dt.epoch("s").alias("e")).item()

    assert at("2024-06-15 12:00:00") == 1718467200
    assert at("2024-03-10 02:30:00", non_existent="null") is None
    with pytest.raises(Exception, match="does not exist"):
        at("2024-03-10 02:30:00")
    with pytest.raises(Exception, match="ambiguous"):
        at("2024-11-03 01:30:00")
    assert at("2024-11-03 01:30:00", ambiguous="earliest") == 1730611800 and at("2024-11-03 01:30:00", ambiguous="latest") == 1730615400 and at("2024-11-03 01:30:00", ambiguous="null") is None
    # Half an hour is shown twice here.
    howe = {k: at("2024-04-07 01:45:00", "Australia/Lord_Howe", ambiguous=k) for k in ("earliest", "latest")}
    assert howe["latest"] - howe["earliest"] == 1800
    shown = Frame(spark.sql("SELECT timestamp_seconds(1718467200) AS x")).select(D.convert_time_zone("Asia/Tokyo").cast("string").alias("y")).item()
    assert shown == "2024-06-16 01:00:00"


def test_list_sums_are_exact(spark):
    f = Frame(spark.sql("SELECT array(9007199254740993L, 0L, NULL) AS x, array(0.5D, NULL) AS y, CAST(array() AS array<int>) AS z, CAST(NULL AS array<int>) AS u"))
    assert f.select(col("x").list.sum().alias("x"), col("y").list.sum().alias("y"), col("z").list.sum().alias("z"), col("u").list.sum().alias("u"), col("y").list.mean().alias("m")).rows() == [(9007199254740993, 0.5, 0, None, 0.5)]


def test_json_paths():
    data = {"a": [{"b": 1}, {"b": 2, "c": "x"}], "d": {"b": 3}}
    assert strings.json_path(data, "$..b") == [1, 2, 3] and strings.json_path(data, "$.a[0:1].b") == [1] and strings.json_path(data, "$.a[*].c") == ["x"] and strings.json_path(data, "$.a[?(@.c)].b") == [2]


def test_geometries(spark):
    shapes = [{"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3], [0, 0]]]}, {"type": "MultiPoint", "coordinates": [[1, 1, 5], [2, 2, 6]]}]
    df = spark.createDataFrame([(geo.to_wkb(s),) for s in shapes] + [(None,)], "g binary").coalesce(1)
    assert [r[0] for r in df.select(geo.geometry_type(df.g)).collect()] == ["Point", "Polygon", "MultiPoint", None]
    assert tuple(geo.total_bounds(df, "g").first()) == (0.0, 0.0, 4.0, 3.0)
    series = Frame(df).get_column("g")
    assert series.total_bounds() == geo.GeometryBounds(0.0, 0.0, 4.0, 3.0) and Frame(df.where("g is null")).get_column("g").total_bounds() is None
    with pytest.raises(ValueError, match="not a WKB"):
        geo.parse(b"\x01\x63")


def test_numbers(spark):
    f = Frame(spark.createDataFrame([(0.0,), (-1.0,), (2.5,), (-2.5,)], "x double").coalesce(1))
    assert [str(r[0]) for r in f.select(col("x").log()).rows()][:2] == ["-inf", "nan"]
    assert [r[0] for r in f.select(col("x").round()).rows()] == [0.0, -1.0, 3.0, -3.0] and [r[0] for r in f.select(col("x").truncate()).rows()] == [0.0, -1.0, 2.0, -2.0]
    assert [r[0] for r in f.select(col("x").clip(-2, 2)).rows()] == [0.0, -1.0, 2.0, -2.0]
    with pytest.raises(Exception, match="no mapping"):
        f.select(col("x").replace_strict({0.0: 1.0})).rows()


def test_sums_are_exact_in_any_order(spark):
    big = 2**63 - 1
    f = Frame(spark.createDataFrame([(big, 2**31 - 1, 127), (big, -5, -128), (-big, None, None), (-7, -(2**31), 3), (None, 0, 1)], "x long, y int, z byte"))
    assert f.select(col("x").sum().alias("x"), col("y").cast("int64").sum().alias("y"), col("z").sum().alias("z")).rows() == [(big - 7, -6, 3)]
    with pytest.raises(Exception, match="overflow|OVERFLOW|out of range|OUT_OF_RANGE"):
        f.filter(col("x") > 0).select(col("x").sum().alias("x")).rows()


def test_integer_division_floors(spark):
    big = 2**63 - 1
    pairs = [(a, c) for a in (-big - 1, -big, -7, -6, -1, 0, 1, 6, 7, big) for c in (-big, -7, -2, 1, 2, 7, big) if (a, c) != (-big - 1, -1)] + [(5, 0), (None, 3), (3, None)]
    f = Frame(spark.createDataFrame(pairs, "a long, c long").coalesce(1))
    want = [None if a is None or not c else a // c for a, c in pairs]
    assert [r[0] for r in f.select((col("a") // col("c")).alias("q")).rows()] == want
    small = Frame(spark.createDataFrame([(-7, 2), (7, -2), (6, 3)], "a int, c int").coalesce(1)).select((col("a") // col("c")).alias("q"))
    assert [r[0] for r in small.rows()] == [-4, -4, 2] and small.dtypes[0].simpleString() == "int"
