import brindle as b
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brindle import Frame, col
from brindle.sources import geofiles, readers, writers
from brindle.streaming import windows
from pyspark.sql import functions as F


@pytest.fixture()
def table(spark):
    return Frame(spark.createDataFrame([(1, "a,b", 1.5, None), (2, 'q"', None, True), (3, "", -2.0, False)], "i long, s string, f double, b boolean").coalesce(1))


def test_csv_round_trip(spark, table, tmp_path):
    p = str(tmp_path / "t.csv")
    writers.write_csv(table, p)
    got = readers.read_csv(spark, p)
    assert got.schema == table.schema and [r[0] for r in got.rows()] == [1, 2, 3] and got.rows()[1][1] == 'q"'
    assert readers.read_csv(spark, p, skip_rows=1, has_header=False).height == 3
    assert readers.read_csv(spark, p, schema=[("x", "string"), ("y", "string"), ("z", "float64"), ("w", "string")]).columns == ["x", "y", "z", "w"]
    assert readers.CsvBuffer("a,b\n1,x\n2,\n").read(spark).rows() == [(1, "x"), (2, None)]


def test_inference():
    names = [readers.infer_text_type(v).simpleString() for v in (["true", "false"], ["1", None, "-2"], ["1", "2.5e3"], ["x"], [None], [str(2**70)])]
    assert names == ["boolean", "bigint", "double", "string", "string", "double"]


def test_parquet(spark, table, tmp_path):
    p = str(tmp_path / "t.parquet")
    writers.write_parquet(table, p, single_file=True)
    assert readers.read_parquet(spark, p, columns=["s", "i"]).columns == ["s", "i"] and pq.ParquetFile(p).metadata.num_rows == 3
    assert readers.read_parquet(spark, p, row_groups=[0, 0]).height == 6 and readers.row_group_statistics(spark, p).height == 4
    tree = str(tmp_path / "tree")
    writers.write_parquet(table, tree, partition_by=["b"])
    assert sorted(str(r[0]) for r in readers.read_parquet(spark, tree, columns=["b"]).rows()) == ["False", "None", "True"]
    plan = readers.read_parquet(spark, p).filter(col("i") > 1).select("s").explain()
    assert "PushedFilters: [IsNotNull(i), GreaterThan(i,1)]" in plan and "ReadSchema: struct<i:bigint,s:string>" in plan


def test_json(spark, table, tmp_path):
    p = str(tmp_path / "t.json")
    writers.write_ndjson(table, p)
    got = readers.read_ndjson(spark, p)
    assert got.columns == ["i", "s", "f", "b"] and got.rows()[0] == (1, "a,b", 1.5, None)
    writers.write_json(table, p + "2")
    assert readers.read_json(spark, p + "2").height == 3
    with pytest.raises(TypeError):
        readers.merge_types(readers._json_type(1), readers._json_type([1]))


def test_ipc(spark, table, tmp_path):
    p = str(tmp_path / "t.arrow")
    writers.write_ipc(table, p, batch_size=2)
    assert readers.scan_ipc(spark, p).sort("i").rows() == table.rows() and readers.read_ipc(spark, p, ["i"], 2).height == 2 and readers.read_ipc_schema(p).names == table.columns
    writers.write_ipc_stream(table, p + "s")
    assert readers.read_ipc_stream(spark, p + "s").height == 3
    assert b.from_arrow(spark, pa.table({"x": [1, 2]})).height == 2


def test_geojson(spark, tmp_path):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","id":7,"properties":{"n":1,"t":"x"},"geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","properties":{"n":2.5},"geometry":null}]}'
    got = geofiles.from_geojson(spark, text)
    assert got.columns == ["feature_id", "n", "t", "geometry"] and [r[:3] for r in got.rows()] == [("7", 1.0, "x"), (None, 2.5, None)]
    p = str(tmp_path / "g.parquet")
    writers.write_geoparquet(got, p)
    assert b"geo" in pq.read_metadata(p).metadata


def test_streams(spark, tmp_path):
    p = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS t, id % 2 AS k, id FROM range(60)").coalesce(1).write.parquet(p)
    stream = windows.parquet_stream(spark, p)
    got = windows.run_to_table(windows.windowed(stream, "t", "10 minutes", [F.count("*").alias("n")], by=("k",)), "w1", mode="complete")
    assert got.count() == 12 and got.agg(F.sum("n")).first()[0] == 60
    assert windows.run_to_table(windows.deduplicated(windows.parquet_stream(spark, p), ["k"], "t", "2 hours"), "w2").count() == 2


def test_one_file_in_order_by_many_tasks(spark, tmp_path):
    f = Frame(spark.range(1000).repartition(7).select("id", F.concat(F.lit('a"'), "id").alias("b,c"))).sort("id")
    p = tmp_path / "x.csv"
    writers.write_csv(f, str(p))
    lines = p.read_text().splitlines()
    assert lines[0] == 'id,"b,c"' and lines[1] == '0,"a""0"' and [int(x.split(",")[0]) for x in lines[1:]] == list(range(1000))
    writers.write_ndjson(f, str(p))
    assert p.is_file() and len(p.read_text().splitlines()) == 1000
    writers.write_csv(Frame(f.df.where("false")), str(p))
    assert p.read_text() == 'id,"b,c"\n'
    writers.write_ipc(f, f"file://{tmp_path}/y.arrow", batch_size=64)
    assert [r[0] for r in readers.scan_ipc(spark, f"file://{tmp_path}/y.arrow").sort("id").rows()] == list(range(1000))


def test_paths_and_datasets(spark, tmp_path):
    for name, text in {"a.csv": "k,v\n1,x\n", "deep/b.csv": "v,k\ny,2\n", "odd[1].csv": "k,v\n3,z\n", "deep/_tmp.csv": "junk"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    names = lambda *s, **o: [p.rsplit("/", 1)[-1] for p in readers.resolve_paths(spark, [f"{tmp_path}/{x}" for x in s], **o)]
    assert names("*.csv") == ["a.csv", "odd[1].csv"] and names("**/*.csv") == ["a.csv", "b.csv", "odd[1].csv"] and names("odd[1].csv", glob=False) == ["odd[1].csv"]
    assert names("deep", "a.csv", "a.csv") == ["b.csv", "a.csv"]
    with pytest.raises(FileNotFoundError):
        names("none*.csv")
    got = readers.read_dataset(spark, f"{tmp_path}/**/*.csv", "csv", readers.DatasetOptions(union_by_name=True, include_file_paths="at"))
    assert sorted((r[0], r[1], r[2].rsplit("/", 1)[-1]) for r in got.rows()) == [(1, "x", "a.csv"), (2, "y", "b.csv"), (3, "z", "odd[1].csv")]
    tree = tmp_path / "tree"
    writers.write_parquet(Frame(spark.range(2)), f"{tree}/g=1/x.parquet", single_file=True)
    writers.write_parquet(Frame(spark.range(2).withColumn("more", F.lit(1))), f"{tree}/g=2/x.parquet", single_file=True)
    for options in ({}, {"missing_columns": "insert"}):
        with pytest.raises(Exception, match="lacks|beside"):
            readers.read_dataset(spark, f"{tree}/**", options=readers.DatasetOptions(extra_columns="raise", **options)).rows()
    plain = readers.read_dataset(spark, f"{tree}/**", options=readers.DatasetOptions(extra_columns="ignore", hive_partitioning=True, hive_schema={"g": "int32"}))
    assert sorted(plain.rows()) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_csv_fields(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("k;when;day\n1;05.01.2024 10:00;2024-02-03\n2;;\n")
    schema = readers.CsvSchema([readers.CsvField.int64("k"), readers.CsvField.datetime("when", format="%d.%m.%Y %H:%M", time_zone="America/New_York"), ("day", "date")])
    got = readers.CsvOptions(separator=";").read(spark, str(p), schema)
    assert [str(r[0]) for r in got.select(col("when").dt.epoch("s")).rows()] == ["1704466800", "None"] and str(got.rows()[0][2]) == "2024-02-03"
    strict = readers.CsvSchema([("k", "int64"), readers.CsvField("when", "string", nullable=False), ("day", "string")])
    with pytest.raises(Exception, match="null in when"):
        readers.read_csv(spark, str(p), strict, separator=";").rows()
    whole = readers.read_csv(spark, str(p), separator=";", infer_schema_length=-1, try_parse_dates=True)
    assert [t.simpleString() for t in whole.dtypes] == ["bigint", "string", "date"]


def test_arrow_series(spark):
    s = readers.import_arrow_series(spark, pa.array([1, None, 3]), "x")
    assert s.name == "x" and writers.export_arrow_series(s).to_pylist() == [1, None, 3]


def test_late_rows_and_sessions(spark, tmp_path):
    from datetime import datetime, timedelta

    p, start = str(tmp_path / "in"), datetime(2024, 1, 1)
    batches = [[0, 5, 90], [10, 95, 300], [20, 310]]  # minutes; the watermark is then 30 behind the newest
    schema = "t timestamp, k long"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.createDataFrame([], schema).write.parquet(p)
    runs = []
    for minutes in batches:
        # Written one after another: a run reads what came since the last one.
        spark.createDataFrame([(start + timedelta(minutes=m), 1) for m in minutes], schema).coalesce(1).write.mode("append").parquet(p)
        stream = windows.windowed(windows.parquet_stream(spark, p), "t", "30 minutes", [F.count("*").alias("n")], late="30 minutes")
        runs.append(windows.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state")).count())
    got = {(r.start - start).total_seconds() / 60: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # Minute 10 comes while its window is 80 minutes behind: left out, and so is minute 20.
    assert got == {0.0: 2, 90.0: 2} and runs[-1] == 2
    table = windows.sessions(windows.parquet_stream(spark, p), "t", "20 minutes", [F.count("*").alias("n")], by=("k",), late="10 days")
    found = windows.run_to_table(table, mode="complete")
    assert sorted(((r.session.start - start).total_seconds() / 60, (r.session.end - start).total_seconds() / 60, r.n) for r in found.collect()) == [(0.0, 40.0, 4), (90.0, 115.0, 2), (300.0, 330.0, 2)]


def test_trailing_rows_of_a_stream(spark, tmp_path):
    p = str(tmp_path / "in")
    rows = "SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id * 7 % 60 AS INT)) AS t, id % 2 AS k, id, CAST(id AS DOUBLE) AS v FROM range({}, {})"
    spark.sql(rows.format(0, 30)).coalesce(1).write.parquet(p)
    out = lambda: windows.run_to_files(windows.trailing(windows.parquet_stream(spark, p), "t", "15m", "v", ("k",), ("id",), late="2h"), str(tmp_path / "out"), str(tmp_path / "state"))
    first = {r.id: (r.n, r.s) for r in out().collect()}
    spark.sql(rows.format(30, 60)).coalesce(1).write.mode("append").parquet(p)
    second = {r.id: (r.n, r.s) for r in out().collect()}
    at = lambda i: i * 7 % 60

    def want(i, n):
        held = [j for j in range(n) if j % 2 == i % 2 and at(i) - 15 < at(j) <= at(i)]
        return len(held), float(sum(held))

    assert first == {i: want(i, 30) for i in range(30)}
    # Rows of the first run stay as they were given out; those of the second see both.
    assert second == {i: want(i, 30 if i < 30 else 60) for i in range(60)}
