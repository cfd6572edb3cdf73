"""Geometries as ISO WKB in binary columns, read in Arrow batches without other libraries."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
_CODES = {v: k for k, v in TYPES.items()}
_SUFFIX = {0: "", 1: " Z", 2: " M", 3: " ZM"}


def parse(data: bytes, at: int = 0) -> tuple[str, list[tuple[float, ...]], int]:
    """Type name, all positions, and where the geometry ends; ValueError for anything else."""
    try:
        order = {0: ">", 1: "<"}[data[at]]
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        dims, kind = divmod(code, 1000)
        name, width = TYPES[kind] + _SUFFIX[dims], (2, 3, 3, 4)[dims]
        at += 5

        def count() -> int:
            nonlocal at
            n = struct.unpack_from(order + "I", data, at)[0]
            at += 4
            return n

        def positions(n: int) -> list[tuple[float, ...]]:
            nonlocal at
            flat = struct.unpack_from(f"{order}{n * width}d", data, at)
            at += 8 * n * width
            return [flat[k : k + width] for k in range(0, len(flat), width)]

        if kind == 1:
            points = positions(1)
        elif kind == 2:
            points = positions(count())
        elif kind == 3:
            points = [p for _ in range(count()) for p in positions(count())]
        else:
            points = []
            for _ in range(count()):
                _, inner, at = parse(data, at)
                points += inner
        return name, points, at
    except (KeyError, IndexError, struct.error) as e:
        raise ValueError("not a WKB geometry") from e


def to_wkb(geometry: dict) -> bytes:
    """WKB of a GeoJSON geometry."""
    kind, code = geometry["type"], _CODES[geometry["type"]]
    if kind == "GeometryCollection":
        parts = [to_wkb(g) for g in geometry["geometries"]]
        return struct.pack("<BII", 1, code, len(parts)) + b"".join(parts)
    c = geometry["coordinates"]
    if kind.startswith("Multi"):
        parts = [to_wkb({"type": kind[5:], "coordinates": x}) for x in c]
        return struct.pack("<BII", 1, code, len(parts)) + b"".join(parts)
    first = c if kind == "Point" else (c[0] if kind == "LineString" else (c[0][0] if c else [])) if c else []
    z = len(first) > 2
    head = struct.pack("<BI", 1, code + (1000 if z else 0))

    def place(p: list[float]) -> bytes:
        return struct.pack(f"<{3 if z else 2}d", *p[: 3 if z else 2])

    def line(ps: list) -> bytes:
        return struct.pack("<I", len(ps)) + b"".join(map(place, ps))

    if kind == "Point":
        return head + (place(c) if c else struct.pack("<2d", float("nan"), float("nan")))
    if kind == "LineString":
        return head + line(c)
    return head + struct.pack("<I", len(c)) + b"".join(map(line, c))


def geometry_type(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: parse(x)[0], na_action="ignore")

    return run(c)


def bounding_box(c: Column) -> Column:
    """A struct min_x, min_y, max_x, max_y; null fields for an empty geometry."""

    @F.pandas_udf("min_x double, min_y double, max_x double, max_y double")
    def run(s: pd.Series) -> pd.DataFrame:
        def box(data: bytes | None) -> tuple:
            points = [p for p in parse(data)[1] if p[0] == p[0]] if data is not None else []
            if not points:
                return (None,) * 4
            x, y = [p[0] for p in points], [p[1] for p in points]
            return min(x), min(y), max(x), max(y)

        return pd.DataFrame([box(x) for x in s], columns=["min_x", "min_y", "max_x", "max_y"])

    return run(c)


class GeometryBounds(NamedTuple):
    """The box around all geometries of a column."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float


def bounds(df: DataFrame, column: str) -> GeometryBounds | None:
    """total_bounds() as one value; None where no geometry has a point."""
    row = total_bounds(df, column).first()
    return None if row is None or row[0] is None else GeometryBounds(*row)


def total_bounds(df: DataFrame, column: str) -> DataFrame:
    box = df.select(bounding_box(F.col(column)).alias("b"))
    return box.agg(*[(F.min if k.startswith("min") else F.max)(f"b.{k}").alias(k) for k in ("min_x", "min_y", "max_x", "max_y")])


def validated(df: DataFrame, column: str) -> DataFrame:
    """The same rows; a value that isn't WKB raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame[column]:
                if x is not None and parse(x)[2] != len(x):
                    raise ValueError("bytes after a WKB geometry")
            yield frame

    return df.mapInPandas(run, df.schema)


def with_crs(df: DataFrame, column: str, crs: str) -> DataFrame:
    """The same rows; the column's metadata name its coordinate reference system."""
    return df.withMetadata(column, {"crs": crs})


def crs(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("crs")


def from_wkb(df: DataFrame, column: str, crs: str | None = None) -> DataFrame:
    """A binary column as geometries: checked, with its reference system."""
    out = validated(df, column)
    return out if crs is None else with_crs(out, column, crs)
