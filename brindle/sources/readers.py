"""Reading CSV, Parquet, JSON and Arrow files into tables.

Schemas are explicit or inferred from the first records, with the same rules everywhere:
booleans, integers, floats, else text. Inference looks at those records only; the files are
then read with the schema, so columns and filters are pushed into the scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brindle.expr import as_type
from brindle.frame import Frame, Series
from brindle.functions import temporal
from brindle.sources.paths import fetched, resolve_paths

_INT, _FLOAT = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|nan)", re.I)
_DATE, _DATETIME = re.compile(r"\d{4}-\d\d-\d\d"), re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?")


def infer_text_type(values: Iterable[str | None], dates: bool = False) -> T.DataType:
    """The narrowest of bool, int64, float64, (date, datetime,) string; nothing but nulls is string."""
    seen = [v for v in values if v is not None]
    if not seen:
        return T.StringType()
    if all(v in ("true", "false") for v in seen):
        return T.BooleanType()
    if all(_INT.fullmatch(v) and -(2**63) <= int(v) < 2**63 for v in seen):
        return T.LongType()
    if all(_FLOAT.fullmatch(v) for v in seen):
        return T.DoubleType()
    if dates and all(_DATE.fullmatch(v) for v in seen):
        return T.DateType()
    if dates and all(_DATETIME.fullmatch(v) for v in seen):
        return T.TimestampNTZType()
    return T.StringType()


def as_schema(schema: object) -> T.StructType:
    """A StructType from one, or from (name, type) pairs or a dict."""
    if isinstance(schema, T.StructType):
        return schema
    pairs = schema.items() if isinstance(schema, dict) else schema
    return T.StructType([T.StructField(n, as_type(t)) for n, t in pairs])


@dataclass
class CsvField:
    """A field of a CSV file: its name and type, whether it may be null, and for times the format of its text.

    ``time_zone``: the text's clock, for fields that become instants. A field that may not be
    null raises where it is.
    """

    name: str
    dtype: object
    nullable: bool = True
    format: str = ""
    time_zone: str = ""

    @staticmethod
    def int64(name: str, nullable: bool = True) -> CsvField: return CsvField(name, "int64", nullable)  # noqa: E704
    @staticmethod
    def float64(name: str, nullable: bool = True) -> CsvField: return CsvField(name, "float64", nullable)  # noqa: E704
    @staticmethod
    def bool(name: str, nullable: bool = True) -> CsvField: return CsvField(name, "bool", nullable)  # noqa: E704
    @staticmethod
    def string(name: str, nullable: bool = True) -> CsvField: return CsvField(name, "string", nullable)  # noqa: E704
    @staticmethod
    def categorical(name: str, nullable: bool = True) -> CsvField: return CsvField(name, "categorical", nullable)  # noqa: E704
    @staticmethod
    def date(name: str, format: str = "", nullable: bool = True) -> CsvField: return CsvField(name, "date", nullable, format)  # noqa: E704
    @staticmethod
    def datetime(name: str, format: str = "", nullable: bool = True, time_zone: str = "") -> CsvField: return CsvField(name, "datetime", nullable, format, time_zone)  # noqa: E704

    def read(self) -> T.DataType:
        """The type that the file is read as."""
        return T.StringType() if self.format or self.time_zone else as_type(self.dtype)

    def column(self, strict: bool) -> Column:
        c, t = F.col(f"`{self.name}`"), as_type(self.dtype)
        if self.format or self.time_zone:
            kind = "date" if isinstance(t, T.DateType) else temporal.NAIVE
            c = temporal.strptime(c, self.format or "%Y-%m-%d %H:%M:%S", kind, strict)
            if self.time_zone:
                c = temporal.replace_time_zone(c, self.time_zone)
        if not self.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"null in {self.name}")).cast(T.TimestampType() if self.time_zone else t))
        return c.alias(self.name)


class CsvSchema(list):
    """The fields of a CSV file, by position: CsvFields or (name, type) pairs."""

    def __init__(self, fields: Iterable[CsvField | tuple[str, object]]):
        super().__init__(f if isinstance(f, CsvField) else CsvField(*f) for f in fields)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.read()) for f in self])


@dataclass
class CsvOptions:
    """What read_csv() takes by keyword, to be kept and passed on."""

    has_header: bool = True
    separator: str = ","
    quote_char: str = '"'
    comment_prefix: str = ""
    skip_rows: int = 0
    null_value: str = ""
    ignore_errors: bool = False
    encoding: str = "UTF-8"

    def read(self, spark: SparkSession, path: str | list[str], schema: object | None = None) -> Frame:
        return read_csv(spark, path, schema, **vars(self))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: object | None = None,
    has_header: bool = True,
    separator: str = ",",
    quote_char: str = '"',
    comment_prefix: str = "",
    skip_rows: int = 0,
    null_value: str = "",
    infer_schema_length: int = 100,
    try_parse_dates: bool = False,
    ignore_errors: bool = False,
    multi_line: bool = False,
    encoding: str = "UTF-8",
) -> Frame:
    """CSV files, compressed ones too. Names of an explicit schema label fields by position.

    Short rows are filled with nulls; a field too many or of the wrong type raises, or gives a
    null with ``ignore_errors``. ``multi_line`` lets quoted fields hold line ends, at the
    price of one task a file.
    """
    options = {"sep": separator, "quote": quote_char, "escape": quote_char, "nullValue": null_value, "emptyValue": "", "encoding": encoding, "multiLine": multi_line, "mode": "PERMISSIVE" if ignore_errors else "FAILFAST"}
    if comment_prefix:
        options["comment"] = comment_prefix
    if isinstance(schema, CsvSchema):
        keywords = {"has_header": has_header, "separator": separator, "quote_char": quote_char, "comment_prefix": comment_prefix, "skip_rows": skip_rows, "null_value": null_value, "ignore_errors": ignore_errors, "multi_line": multi_line, "encoding": encoding}
        return Frame(read_csv(spark, path, schema.struct(), **keywords).df.select(*[f.column(not ignore_errors) for f in schema]))
    if skip_rows:
        return _read_csv_lines(spark, _skipped(spark, path, skip_rows), schema, has_header, options, infer_schema_length, try_parse_dates)
    if schema is None:
        loose = options | {"mode": "PERMISSIVE"}
        rows = spark.read.options(**loose).option("header", has_header).csv(path)
        rows = rows if has_header else rows.toDF(*[f"column_{k + 1}" for k in range(len(rows.columns))])
        if infer_schema_length < 0:
            schema = _inferred_from_all(rows, try_parse_dates)
        else:
            sample = rows.limit(infer_schema_length).collect()
            schema = T.StructType([T.StructField(c, infer_text_type([r[k] for r in sample], try_parse_dates)) for k, c in enumerate(rows.columns)])
    return Frame(spark.read.options(**options).option("header", has_header).option("enforceSchema", True).schema(as_schema(schema)).csv(path))


def _inferred_from_all(rows: DataFrame, dates: bool) -> T.StructType:
    """infer_text_type() of all rows, by one pass of counts: of the tests that a column's values all meet, the first."""
    tests = {"bool": "true|false", "int": _INT.pattern, "float": f"(?i:{_FLOAT.pattern})", "date": _DATE.pattern, "time": _DATETIME.pattern}
    kinds = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "date": T.DateType(), "time": T.TimestampNTZType()}
    parts = []
    for k, c in enumerate(rows.columns):
        v = F.col(f"`{c}`")
        parts += [F.count(v).alias(f"n{k}"), *[F.count_if(F.regexp_like(v, F.lit(f"^(?:{p})$")) & (v.try_cast("bigint").isNotNull() if t == "int" else F.lit(True))).alias(f"{t}{k}") for t, p in tests.items()]]
    found = rows.agg(*parts).first()
    allowed = [t for t in tests if dates or t not in ("date", "time")]
    return T.StructType([T.StructField(c, next((kinds[t] for t in allowed if found[f"n{k}"] and found[f"{t}{k}"] == found[f"n{k}"]), T.StringType())) for k, c in enumerate(rows.columns)])


def _skipped(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    """Lines without the first n of each file; only a file's first block is numbered."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("m", F.monotonically_increasing_id())
    top = lines.where("file_block_start = 0").withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("m"))).where(F.col("n") > n)
    return lines.where("file_block_start > 0").select("value", "file_path", F.lit(0).alias("n")).unionByName(top.select("value", "file_path", (F.col("n") - n).alias("n")))


def _read_csv_lines(spark: SparkSession, lines: DataFrame, schema, has_header: bool, options: dict, length: int, dates: bool) -> Frame:
    plain = {k: str(v) for k, v in options.items() if k not in ("encoding", "multiLine")}
    head = lines.where("n = 1").first()
    width = 0 if head is None else max(1, len(next(_split([head["value"]], options["sep"], options["quote"]))))
    names = next(_split([head["value"]], options["sep"], options["quote"])) if has_header and head else [f"column_{k + 1}" for k in range(width)]
    body = lines.where("n != 1") if has_header else lines
    if schema is None:
        texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
        sample = body.orderBy("n").limit(length).select(F.from_csv("value", texts.simpleString()[7:-1].replace(":", " "), plain | {"mode": "PERMISSIVE"}).alias("r")).select("r.*").collect()
        schema = T.StructType([T.StructField(n, infer_text_type([r[k] for r in sample], dates)) for k, n in enumerate(names)])
    wanted = as_schema(schema)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.fields)
    return Frame(body.where("value != ''").select(F.from_csv("value", ddl, plain).alias("r")).select("r.*"))


def _split(lines: Iterable[str], sep: str, quote: str) -> Iterator[list[str]]:
    import csv

    return csv.reader(lines, delimiter=sep, quotechar=quote)


class CsvBuffer:
    """CSV text in memory."""

    def __init__(self, data: str | bytes):
        self.text = data.decode() if isinstance(data, bytes) else data

    def __len__(self) -> int:
        return len(self.text.encode())

    def read(self, spark: SparkSession, schema: object | None = None, has_header: bool = True, separator: str = ",", infer_schema_length: int = 100) -> Frame:
        rows = list(_split(self.text.splitlines(keepends=True), separator, '"'))
        names = rows.pop(0) if has_header and rows else [f"column_{k + 1}" for k in range(len(rows[0]) if rows else 0)]
        table = [[(r[k] or None) if k < len(r) else None for k in range(len(names))] for r in rows]
        if schema is None:
            schema = [(n, infer_text_type([r[k] for r in table[: infer_schema_length if infer_schema_length >= 0 else None]])) for k, n in enumerate(names)]
        wanted = as_schema(schema)
        texts = spark.createDataFrame(table, T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields]))
        return Frame(texts.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.fields]))


def read_parquet(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    row_groups: list[int] | None = None,
    hive_partitioning: bool = False,
    hive_schema: dict | None = None,
    include_file_paths: str | None = None,
    missing_columns: str = "raise",
    extra_columns: str = "raise",
) -> Frame:
    """Parquet files and trees. ``missing_columns='insert'`` and ``extra_columns`` merge the files' schemas.

    ``row_groups`` picks groups of one file, in order and with repeats.
    """
    if row_groups is not None:
        with fetched(spark, path) as local:
            table = pa.concat_tables([pq.ParquetFile(local).read_row_group(k, columns) for k in row_groups])
        return Frame(spark.createDataFrame(table))
    reader = spark.read.option("mergeSchema", missing_columns == "insert" or extra_columns != "raise")
    if not hive_partitioning:
        reader = reader.option("recursiveFileLookup", False)
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    if hive_schema:
        df = df.withColumns({c: F.col(c).cast(as_type(t)) for c, t in hive_schema.items()})
    if include_file_paths:
        df = df.select(*df.columns, F.col("_metadata.file_path").alias(include_file_paths))
    return Frame(df if columns is None else df.select(*columns, *([include_file_paths] if include_file_paths else [])))


def row_group_statistics(spark: SparkSession, path: str) -> Frame:
    """From a file's footer: row_group, column, num_rows, min, max, null_count, compressed_size."""
    with fetched(spark, path) as local:
        meta = pq.ParquetFile(local).metadata
    rows = []
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            x = meta.row_group(g).column(c)
            s = x.statistics
            ok = s is not None and s.has_min_max
            rows.append((g, x.path_in_schema, meta.row_group(g).num_rows, str(s.min) if ok else None, str(s.max) if ok else None, s.null_count if s is not None and s.has_null_count else None, x.total_compressed_size))
    return Frame(spark.createDataFrame(rows, "row_group int, `column` string, num_rows long, `min` string, `max` string, null_count long, compressed_size long"))


def _json_type(value: object) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, list):
        inner: T.DataType = T.NullType()
        for x in value:
            inner = merge_types(inner, _json_type(x))
        return T.ArrayType(inner)
    return T.StructType([T.StructField(k, _json_type(v)) for k, v in value.items()])


def merge_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """Integers and floats are floats, mixed scalars text; a scalar with a list or an object raises."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        out = {f.name: f.dataType for f in a.fields}
        for f in b.fields:  # in the order in which names are first seen
            out[f.name] = merge_types(out[f.name], f.dataType) if f.name in out else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in out.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge_types(a.elementType, b.elementType))
    if any(isinstance(x, (T.StructType, T.ArrayType)) for x in (a, b)):
        raise TypeError("a scalar and a container under one name")
    return T.DoubleType() if {type(a), type(b)} == {T.LongType, T.DoubleType} else T.StringType()


def _settled(t: T.DataType) -> T.DataType:
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_settled(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _settled(f.dataType)) for f in t.fields])
    return t


def read_ndjson(spark: SparkSession, path: str | list[str], schema: object | None = None, infer_schema_length: int = 100, ignore_errors: bool = False) -> Frame:
    """An object a line. Inferred names come in the order in which they are first seen."""
    if schema is None:
        found: T.DataType = T.StructType([])
        for (line,) in spark.read.text(path).where(F.trim("value") != "").limit(infer_schema_length).collect():
            found = merge_types(found, _json_type(json.loads(line)))
        schema = _settled(found)
    return Frame(spark.read.schema(as_schema(schema)).option("mode", "PERMISSIVE" if ignore_errors else "FAILFAST").json(path))


def read_json(spark: SparkSession, path: str, schema: object | None = None) -> Frame:
    """Files that hold an array of objects."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return Frame((reader.schema(as_schema(schema)) if schema is not None else reader).json(path))


@dataclass
class DatasetOptions:
    """How files become one table.

    ``missing_columns``: raise, or insert nulls for what a file lacks; ``extra_columns``:
    raise, ignore, or insert them for all. ``hive_partitioning``: columns from key=value
    folders, typed by ``hive_schema`` (else text).
    """

    hive_partitioning: bool = False
    hive_schema: dict = field(default_factory=dict)
    include_file_paths: str = ""
    missing_columns: str = "raise"
    extra_columns: str = "raise"
    union_by_name: bool = False


def align_dataset_frame(frame: Frame, schema: T.StructType, options: DatasetOptions) -> Frame:
    """A file's table with the columns and types of the dataset's schema; what the options don't allow raises."""
    own = frame.schema
    _check_columns(list(own), schema.names, options)
    return Frame(frame.df.select(*[(F.col(f"`{f.name}`") if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]))


def read_dataset(spark: SparkSession, paths: str | list[str], kind: str = "parquet", options: DatasetOptions | None = None, schema: object | None = None, glob: bool = True, **keywords) -> Frame:
    """Files named by paths, folders and patterns as one table, in order of their paths.

    ``kind``: parquet, csv, ndjson or ipc. Files of one schema are one scan; where schemas differ
    and the options allow it, each file is read by its own and aligned.
    """
    options = options or DatasetOptions()
    # Spark's readers take paths as patterns: what was found is meant as it is.
    found = resolve_paths(spark, paths, glob)
    files = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in found]
    loose = DatasetOptions(missing_columns="insert" if options.union_by_name else options.missing_columns, extra_columns="insert" if options.union_by_name else options.extra_columns)
    if kind == "parquet":
        return _with_paths(_parquet_files(spark, files, loose), options)
    read = {"csv": read_csv, "ndjson": read_ndjson, "ipc": scan_ipc}[kind]
    if schema is not None and kind != "ipc" and not isinstance(schema, CsvSchema):
        return _with_paths(read(spark, files, schema=schema, **keywords).df, options)
    given = {"schema": schema} if schema is not None and kind != "ipc" else {}
    frames = [read(spark, f, **given, **keywords) for f in files]
    wanted = frames[0].df.schema
    if loose.extra_columns == "insert":
        for f in frames[1:]:
            wanted = T.StructType([*wanted.fields, *[x for x in f.df.schema.fields if x.name not in wanted.names]])
    aligned = [align_dataset_frame(f, wanted, loose) for f in frames]
    if options.include_file_paths or options.hive_partitioning:
        # A path is a constant of its file.
        aligned = [Frame(f.df.select("*", *_of_path(F.lit(path), _keys_of([path], options), options))) for f, path in zip(aligned, found, strict=True)]
    out = aligned[0].df
    for f in aligned[1:]:
        out = out.unionByName(f.df)
    return Frame(out)


def _parquet_files(spark: SparkSession, files: list[str], options: DatasetOptions) -> DataFrame:
    """One scan of all files; those whose columns differ in a way that the options don't allow raise."""
    if options.missing_columns == "insert" and options.extra_columns == "insert":
        return spark.read.option("mergeSchema", True).parquet(*files)
    schemas = [spark.read.parquet(f).schema for f in files]
    merged = spark.read.option("mergeSchema", True).parquet(*files).schema if options.extra_columns == "insert" else schemas[0]
    for own in schemas:
        _check_columns(own.names, merged.names, options)
    return spark.read.schema(merged).parquet(*files)


def _check_columns(own: list[str], wanted: list[str], options: DatasetOptions) -> None:
    missing, extra = [c for c in wanted if c not in own], [c for c in own if c not in wanted]
    if missing and options.missing_columns != "insert":
        raise ValueError(f"a file lacks {missing}")
    if extra and options.extra_columns != "ignore":
        raise ValueError(f"a file has {extra} beside the others' columns")


def _keys_of(paths: list[str], options: DatasetOptions) -> dict:
    """Names and types of the columns that key=value folders give, in order."""
    if not options.hive_partitioning:
        return {}
    found = dict.fromkeys(k for path in paths for k in re.findall(r"/([^/=]+)=[^/]*(?=/)", path))
    return {k: options.hive_schema.get(k, "string") for k in [*options.hive_schema, *found]}


def _of_path(at: Column, keys: dict, options: DatasetOptions) -> list[Column]:
    """The columns that a file's path gives."""
    value = lambda k: F.nullif(F.url_decode(F.regexp_extract(at, f"/{re.escape(k)}=([^/]*)/", 1)), F.lit("__HIVE_DEFAULT_PARTITION__"))
    out = [value(k).cast(as_type(t)).alias(k) for k, t in keys.items()]
    return [*out, at.alias(options.include_file_paths)] if options.include_file_paths else out


def _with_paths(df: DataFrame, options: DatasetOptions) -> Frame:
    """A scan with the columns that its files' paths give, in place of ones of the same names."""
    if not (options.include_file_paths or options.hive_partitioning):
        return Frame(df)
    keys = _keys_of(df.inputFiles(), options)
    own = [c for c in df.columns if c not in keys and c != options.include_file_paths]
    return Frame(df.select(*[F.col(f"`{c}`") for c in own], *_of_path(F.col("_metadata.file_path"), keys, options)))


class _Batch(InputPartition):
    def __init__(self, path: str, index: int):
        self.path, self.index = path, index


class _IpcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        with pa.memory_map(self.path) as f:
            return [_Batch(self.path, k) for k in range(pa.ipc.open_file(f).num_record_batches)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(partition.path) as f:
            yield pa.ipc.open_file(f).get_batch(partition.index).select(self.columns)


class ArrowIpc(DataSource):
    """An Arrow IPC file that all executors see, a task per record batch."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.memory_map(self.options["path"]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _IpcReader(self.options["path"], schema.names)


def scan_ipc(spark: SparkSession, path: str) -> Frame:
    """Arrow IPC files in any store that Spark reads: a file a task, its batches one at a time.

    A local file in local mode is mapped, a task per record batch.
    """
    local = path.removeprefix("file://") if path.startswith("file:///") else path
    if spark.sparkContext.master.startswith("local[") and "://" not in local:
        spark.dataSource.register(ArrowIpc)
        return Frame(spark.read.format("arrow_ipc").load(local))
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(read_ipc_schema(path, spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for data in given.column("content"):
                f = pa.ipc.open_file(data.as_buffer())
                for k in range(f.num_record_batches):
                    yield f.get_batch(k)

    return Frame(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema))


def read_ipc(spark: SparkSession, path: str, columns: list[str] | None = None, n_rows: int | None = None) -> Frame:
    with fetched(spark, path) as local, pa.memory_map(local) as f:
        table = pa.ipc.open_file(f).read_all()
        table = table if columns is None else table.select(columns)
        return Frame(spark.createDataFrame(table if n_rows is None else table.slice(0, n_rows)))


def read_ipc_stream(spark: SparkSession, path: str) -> Frame:
    with fetched(spark, path) as local, open(local, "rb") as f:
        return Frame(spark.createDataFrame(pa.ipc.open_stream(f).read_all()))


def read_ipc_schema(path: str, spark: SparkSession | None = None) -> pa.Schema:
    """The schema in a file's footer; with a session, of a file in any store that Spark reads."""
    if spark is not None:
        with fetched(spark, path) as local:
            return read_ipc_schema(local)
    with pa.memory_map(path) as f:
        return pa.ipc.open_file(f).schema


def import_arrow(spark: SparkSession, table: pa.Table) -> Frame:
    return Frame(spark.createDataFrame(table))


def import_arrow_series(spark: SparkSession, values: pa.Array | pa.ChunkedArray, name: str = "") -> Series:
    return Series(import_arrow(spark, pa.table({name or "values": values})))


def parquet_backend_version() -> str:
    """What reads footers; files themselves are read by Spark."""
    return f"pyarrow {pa.__version__}"


parquet_row_group_statistics = row_group_statistics

#: Every reader is lazy: scanning and reading are one.
scan_csv, scan_parquet, scan_ndjson = read_csv, read_parquet, read_ndjson
