"""Writing tables. Spark commits directories; a single file is written beside its place and moved."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.frame import Frame, Series
from brindle.sources.paths import stored


def _file_system(spark, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return at(path).getFileSystem(conf), at, conf


def _parts(fs, folder) -> list:
    return sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())


def _joined(df: DataFrame, path: str, kind: str, options: dict, head: DataFrame | None = None) -> None:
    """One text file in the table's order: all tasks write their parts, whose bytes are then strung together; there whole or not at all."""
    spark = df.sparkSession
    fs, at, conf = _file_system(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        folders = [f"{beside}/{k}" for k, x in enumerate((head, df)) if x is not None]
        for folder, x in zip(folders, [x for x in (head, df) if x is not None], strict=True):
            x.write.options(**options).format(kind).save(folder)
        whole = at(f"{beside}/whole")
        out = fs.create(whole)
        try:
            for part in [p for folder in folders for p in _parts(fs, at(folder))]:
                given = fs.open(part)
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(given, out, conf, False)
                given.close()
        finally:
            out.close()
        fs.delete(at(path), True)
        if not fs.rename(whole, at(path)):
            raise OSError(f"can't write {path}")
    finally:
        fs.delete(at(beside), True)


def _single(df: DataFrame, path: str, kind: str, options: dict) -> None:
    """One ordered file by one task, in place of a directory, there whole or not at all."""
    fs, at, _ = _file_system(df.sparkSession, path)
    beside = at(f"{path}.{uuid.uuid4().hex}.tmp")
    df.coalesce(1).write.options(**options).format(kind).save(beside.toString())
    try:
        fs.delete(at(path), True)
        if not fs.rename(_parts(fs, beside)[0], at(path)):
            raise OSError(f"can't write {path}")
    finally:
        fs.delete(beside, True)


def write_csv(frame: Frame, path: str, has_header: bool = True, separator: str = ",", quote_style: str = "necessary", null_value: str = "", line_terminator: str = "\n", single_file: bool = True) -> None:
    """One file that all tasks write, or a directory of files. quote_style: necessary, always, never or non_numeric. Binary and nested columns raise."""
    bad = [c for c, t in frame.schema.items() if isinstance(t, (T.BinaryType, T.ArrayType, T.StructType, T.MapType))]
    if bad:
        raise TypeError(f"no CSV for {bad}")
    df = frame.df
    options = {"header": has_header, "sep": separator, "nullValue": null_value, "emptyValue": '""' if quote_style != "never" else "", "escape": '"', "lineSep": line_terminator}
    if quote_style == "always":
        options["quoteAll"] = True
    elif quote_style == "never":
        options["quote"] = ""
    elif quote_style == "non_numeric":
        quoted = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')))
        df = df.select(*[F.col(c) if isinstance(t, T.NumericType) else quoted(c).alias(c) for c, t in frame.schema.items()])
        options["quote"] = ""
    if single_file:
        names = df.sparkSession.createDataFrame([tuple(frame.columns)], T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(frame.width)])).coalesce(1)
        _joined(df, path, "csv", options | {"header": False}, names if has_header else None)
    else:
        df.write.mode("overwrite").options(**options).csv(path)


def to_csv_string(frame: Frame, has_header: bool = True, separator: str = ",") -> str:
    lines = [r[0] for r in frame.df.select(F.to_csv(F.struct(*frame.columns), {"sep": separator})).collect()]
    return "\n".join([*([separator.join(frame.columns)] if has_header else []), *lines]) + "\n"


def write_parquet(frame: Frame, path: str, compression: str = "zstd", row_group_bytes: int = 128 << 20, partition_by: list[str] | None = None, single_file: bool = False) -> None:
    """A directory of files, or one; ``partition_by`` makes a tree that keeps its columns in the files."""
    options = {"compression": compression, "parquet.block.size": row_group_bytes}
    if partition_by:
        write_partitioned_parquet(frame, path, partition_by, compression)
    elif single_file:
        _single(frame.df, path, "parquet", options)
    else:
        frame.df.write.mode("overwrite").options(**options).parquet(path)


def write_partitioned_parquet(frame: Frame, path: str, partition_by: list[str], compression: str = "zstd") -> None:
    """key=value folders. Rows are dealt by their keys with room for heavy ones: rebalancing splits what is large."""
    keys = {f"__{c}": F.col(c) for c in partition_by}
    df = frame.df.withColumns(keys).hint("rebalance", *[F.col(c) for c in keys])
    renamed = df.select(*frame.columns, *keys)
    renamed.write.mode("overwrite").option("compression", compression).partitionBy(*keys).parquet(path)


def _batches(frame: Frame) -> Iterator[pa.RecordBatch]:
    """The table's batches in order; the driver holds those of one partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.serialize().to_pybytes()], pa.binary())], names=["data"])

    schema = _arrow_schema(frame)
    for row in frame.df.mapInArrow(run, "data binary").toLocalIterator():
        yield pa.ipc.read_record_batch(pa.py_buffer(bytes(row["data"])), schema)


def _arrow_schema(frame: Frame) -> pa.Schema:
    """As Spark hands its batches over: that of no rows at all."""
    return frame.df.limit(0).toArrow().schema


def write_geoparquet(frame: Frame, path: str, geometry: str = "geometry", crs: dict | None = None) -> None:
    """One file with the footer that names the geometry column."""
    import json

    from brindle.functions.geo import geometry_type

    kinds = sorted(r[0] for r in frame.df.select(geometry_type(F.col(geometry)).alias("k")).distinct().collect() if r[0] is not None)
    geo = {"version": "1.1.0", "primary_column": geometry, "columns": {geometry: {"encoding": "WKB", "geometry_types": kinds} | ({"crs": crs} if crs else {})}}
    schema = _arrow_schema(frame)
    schema = schema.with_metadata({**(schema.metadata or {}), b"geo": json.dumps(geo).encode()})
    with stored(frame.df.sparkSession, path) as beside, pq.ParquetWriter(beside, schema, compression="zstd") as w:
        for batch in _batches(frame):
            w.write_batch(batch.cast(schema) if hasattr(batch, "cast") else batch)


def write_ipc(frame: Frame, path: str, compression: str | None = None, batch_size: int = 65_536) -> None:
    """One file of record batches of up to ``batch_size`` rows."""
    schema = _arrow_schema(frame)
    with stored(frame.df.sparkSession, path) as beside, pa.ipc.new_file(beside, schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as w:
        for batch in _batches(frame):
            for at in range(0, batch.num_rows, batch_size):
                w.write_batch(batch.slice(at, batch_size))


def write_ipc_stream(frame: Frame, path: str) -> None:
    schema = _arrow_schema(frame)
    with stored(frame.df.sparkSession, path) as beside, pa.ipc.new_stream(beside, schema) as w:
        for batch in _batches(frame):
            w.write_batch(batch)


def _json_ready(c, t: T.DataType):
    if isinstance(t, T.DecimalType):
        return c.cast("string")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(t, T.BinaryType):
        return F.base64(c)
    if isinstance(t, T.DayTimeIntervalType):
        seconds = F.extract(F.lit("DAY"), c) * 86_400 + F.extract(F.lit("HOUR"), c) * 3_600 + F.extract(F.lit("MINUTE"), c) * 60 + F.extract(F.lit("SECOND"), c)
        return F.concat(F.lit("PT"), F.regexp_replace(seconds.cast("string"), r"\.?0+$", ""), F.lit("S"))
    return c


def write_ndjson(frame: Frame, path: str, single_file: bool = True) -> None:
    """One file that all tasks write, or a directory of files: an object a line, nulls written; decimals as text, binary as base64, NaN and infinities as null."""
    df = frame.df.select(*[_json_ready(F.col(f"`{c}`"), t).alias(c) for c, t in frame.schema.items()])
    if single_file:
        _joined(df, path, "json", {"ignoreNullFields": False})
    else:
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json(frame: Frame, path: str) -> None:
    """One array of objects."""
    df = frame.df.select(*[_json_ready(F.col(f"`{c}`"), t).alias(c) for c, t in frame.schema.items()])
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("v")).toLocalIterator()
    with stored(df.sparkSession, path) as beside, open(beside, "w", encoding="utf-8") as f:
        f.write("[")
        for k, r in enumerate(lines):
            f.write(("," if k else "") + "\n" + r["v"])
        f.write("\n]\n")


def export_arrow(frame: Frame) -> pa.Table:
    return frame.collect()


def export_arrow_series(series: Series) -> pa.ChunkedArray:
    return series.frame.collect().column(0)
