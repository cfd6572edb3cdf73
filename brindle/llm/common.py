"""What the operators share: input tables, scratch tables in the shared folder, shipping code."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The white space that separates words; every other character belongs to one.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"

_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_scratch: dict[str, list[str]] = {}
_scope = "default"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where unset and all run on one machine (tests)."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, own, True)
        path = f"file://{own}"
        context.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table below the shared folder, remembered under the current scope."""
    path = f"{shared_dir(spark)}/brindle/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(_scope, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, test: Column | None = None) -> tuple[DataFrame, int]:
    """materialize(), and how many of the rows (or of those that pass the test) were written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation()
    df.observe(seen, F.count_if(F.lit(True) if test is None else test).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), (seen.get or {}).get("n", 0)


@contextmanager
def scope(spark: SparkSession, name: str, fresh: bool = False) -> Iterator[None]:
    """Scratch tables made meanwhile belong to a scope; ``fresh``: those of its earlier use are dropped."""
    global _scope
    if fresh:
        drop_scratch(spark, name)
    held, _scope = _scope, name
    try:
        yield
    finally:
        _scope = held


def drop_scratch(spark: SparkSession, scope: str = "default") -> None:
    """Delete the scratch tables of a scope; only for when every result built on them has been written."""
    for path in _scratch.pop(scope, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    """What is left goes with the process, if its session still runs."""
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context else None
    for name in list(_scratch) if spark else []:
        drop_scratch(spark, name)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, and let whole texts go to Python in smaller batches than Spark's default, unless set otherwise."""
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "8m")
    context = spark.sparkContext
    if getattr(context, "_brindle_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="brindle-zip-")
    base = os.path.join(folder, "brindle_code")
    stage = os.path.join(folder, "stage")
    shutil.copytree(top, os.path.join(stage, top.name), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    shutil.make_archive(base, "zip", stage)
    context.addPyFile(base + ".zip")
    shutil.rmtree(stage, True)
    atexit.register(shutil.rmtree, folder, True)  # executors fetch the file whenever they start
    context._brindle_shipped = True


def give_back() -> None:
    """Return what a worker no longer uses to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 512) -> DataFrame:
    """mapInPandas with frames of up to ``rows`` rows, so that no more texts than that are Python strings at once.

    Integers with nulls among them come as Python integers and None, not as floats.
    """

    shape = to_arrow_schema(StructType.fromDDL(schema))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (batch.slice(at, rows).to_pandas(integer_object_nulls=True) for batch in given for at in range(0, batch.num_rows, rows))
        for frame in run(frames):
            yield pa.RecordBatch.from_pandas(frame, schema=shape, preserve_index=False)
        give_back()

    return df.mapInArrow(batches, schema)


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(body != "", F.split(body, SPACES)).otherwise(F.array().cast("array<string>"))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of a text are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file is; the folder is a parameter of the environment's package."""
    import public_tokenizers

    return public_tokenizers.path(name)
