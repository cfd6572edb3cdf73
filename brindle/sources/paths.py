"""Paths in any store that Spark reads: single files pass through the driver, globs are resolved by the store."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@contextmanager
def fetched(spark: SparkSession, path: str) -> Iterator[str]:
    """A local copy of one file, for as long as it is read; a local file is read where it is."""
    plain = path.removeprefix("file://") if path.startswith("file:///") else path
    if "://" not in plain and os.path.exists(plain):
        yield plain
        return
    folder = tempfile.mkdtemp(prefix="brindle-")
    try:
        fs, at = _store(spark, path)
        local = os.path.join(folder, "file")
        fs.copyToLocalFile(False, at, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), True)
        yield local
    finally:
        shutil.rmtree(folder, True)


@contextmanager
def stored(spark: SparkSession, path: str) -> Iterator[str]:
    """A local file to write, moved to its path once it is whole."""
    folder = tempfile.mkdtemp(prefix="brindle-")
    try:
        local = os.path.join(folder, "file")
        yield local
        fs, at = _store(spark, path)
        beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{os.path.basename(folder)}.tmp")
        fs.copyFromLocalFile(True, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), beside)
        fs.delete(at, True)
        if not fs.rename(beside, at):
            raise OSError(f"can't write {path}")
    finally:
        shutil.rmtree(folder, True)


def resolve_paths(spark: SparkSession, sources: str | list[str], glob: bool = True) -> list[str]:
    """The files that paths and patterns name, each source's in sorted order and none twice; a folder gives all files below it.

    ``**`` stands for any folders between. Without ``glob`` every source is a path as it is.
    A source that names nothing raises.
    """
    out: dict[str, None] = {}
    for source in [sources] if isinstance(sources, str) else sources:
        fs, at = _store(spark, source)
        if not glob or fs.exists(at):
            found = _files(fs, at)
        elif "**" in source:
            top, _, rest = source.partition("**")
            last = rest.rsplit("/", 1)[-1] or "*"
            pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(last)
            base = spark._jvm.org.apache.hadoop.fs.Path(top.rstrip("/") or "/")
            found = [x for x in (_files(fs, base) if fs.exists(base) else []) if pattern.matches(x.rsplit("/", 1)[-1])]
        else:
            found = [y for x in (fs.globStatus(at) or []) for y in _files(fs, x.getPath())]
        if not found:
            raise FileNotFoundError(source)
        out.update(dict.fromkeys(sorted(found)))
    return list(out)


def _files(fs, at) -> list[str]:
    """Files below a path, but hidden ones and those of unfinished writes."""
    if not fs.exists(at):
        return []
    if not fs.getFileStatus(at).isDirectory():
        return [at.toString()]
    out, every = [], fs.listFiles(at, True)
    while every.hasNext():
        path = every.next().getPath()
        if not path.getName().startswith(("_", ".")):
            out.append(path.toString())
    return out
