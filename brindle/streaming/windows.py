"""Streams: windowed, sessioned and deduplicated, with bounded state behind a watermark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.functions import temporal


def parquet_stream(spark: SparkSession, path: str, max_files: int = 64, table: str | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, or one ``table`` (a file or folder) in it; the schema is that of the files there now."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if table is None:
        return reader.schema(spark.read.parquet(path).schema).parquet(path)
    known = spark.read.parquet(f"{path}/{table}.parquet")
    # A stream reads folders: a table that is one file is picked from its folder by name.
    single = known.inputFiles()[0].rstrip("/").endswith(f"/{table}.parquet")
    return reader.schema(known.schema).option("pathGlobFilter", f"{table}.parquet").parquet(path) if single else reader.schema(known.schema).parquet(f"{path}/{table}.parquet")


def windowed(stream: DataFrame, time: str, every: str, aggregates: list[Column], by: tuple[str, ...] = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling (or sliding) windows; rows later than ``late`` behind the newest are left out."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, every, slide or every), *by)
    return grouped.agg(*aggregates).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *[c for c in grouped.agg(*aggregates).columns if c not in ("window", *by)])


def sessions(stream: DataFrame, time: str, gap: str, aggregates: list[Column], by: tuple[str, ...] = (), late: str = "10 minutes") -> DataFrame:
    """Sessions that end when nothing comes for ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *by).agg(*aggregates)


def trailing(stream: DataFrame, time: str, period: str, value: str, keys: tuple[str, ...], keep: tuple[str, ...] = (), late: str = "0s") -> DataFrame:
    """Per row: its keys, the columns ``keep`` and ``time``, and n and s, the number and sum of its key's values in (t - period, t].

    A row is given out when it comes, and looks at the rows of its key that have come by then,
    its own batch in order of time; null times and values count for nothing. A key's state
    holds the values of the last ``period`` and ``late`` before its newest time.
    """
    span, slack = temporal.interval(period).micros, temporal.interval(late).micros
    kind = stream.schema[time].dataType.simpleString()
    names = [*keys, *keep, time]
    types = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in names)
    rows = stream.select(*names, temporal.micros(F.col(time), kind).alias("__t"), F.col(value).cast("double").alias("__v"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True)
        held_t, held_v = (np.array(x) for x in (state.get if state.exists else ([], [])))
        t, v = frame["__t"].to_numpy(float), frame["__v"].to_numpy(float)
        known = ~(np.isnan(t) | np.isnan(v))
        every_t, every_v = np.r_[held_t, t[known]].astype(np.int64), np.r_[held_v, v[known]].astype(float)
        order = np.argsort(every_t, kind="stable")
        every_t, every_v = every_t[order], every_v[order]
        sums = np.r_[0.0, np.cumsum(every_v)]
        at = np.nan_to_num(t).astype(np.int64)
        low, high = np.searchsorted(every_t, at - span, side="right"), np.searchsorted(every_t, at, side="right")
        high = np.where(np.isnan(t), low, high)
        out = frame[names].copy()
        out["n"], out["s"] = (high - low).astype(np.int64), sums[high] - sums[low]
        if len(every_t):
            from_here = np.searchsorted(every_t, every_t[-1] - span - slack, side="right")
            state.update((every_t[from_here:].tolist(), every_v[from_here:].tolist()))
        yield out

    return rows.groupBy(*keys).applyInPandasWithState(run, f"{types}, n long, s double", "times array<long>, `values` array<double>", "append", GroupStateTimeout.NoTimeout)


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


#: Where streams that run into files keep their state: on the executors' disks, in memory only as much as a bound allows.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """The session with STATE_STORE, unless it names a state store itself."""
    mine = {} if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) else STATE_STORE
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in mine:
            spark.conf.unset(k)


def run_to_table(stream: DataFrame, name: str | None = None, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what there is now, into a table in the driver's memory (for small results, tests) and return it."""
    name = name or f"stream_{uuid.uuid4().hex}"
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, into Parquet files, and return them; the checkpoint lets a next run go on from there.

    ``mode``: ``append``, or ``complete`` for aggregates, whose whole result replaces what the files held
    after each batch. Executors write it; no row comes to the driver.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(path).awaitTermination()
        return spark.read.parquet(path)
    with _state_on_disk(spark):
        writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(path)).start().awaitTermination()
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing has come yet
        return spark.createDataFrame([], stream.schema)
