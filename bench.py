"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Beside them, under "baseline_sizes": joins, as-of joins, a sort and a CSV scan over as many rows
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import brindle as b  # noqa: E402
from brindle import Frame, col  # noqa: E402
from brindle.plans import suites  # noqa: E402
from brindle.sources import readers, writers  # noqa: E402

HEADLINE = [
    "pricing_summary", "shipping_priority", "order_priority", "local_supplier_volume", "revenue_change", "returned_items", "priority_lines", "promotion_effect", "large_orders", "idle_customers",
    "join_left", "join_full", "join_semi", "join_anti", "asof_backward_by", "asof_tolerance", "group_rollup", "group_cube", "group_statistics", "group_top_k", "pivot_sum",
    "window_rank", "window_sequence", "window_rolling_rows", "window_rolling_time", "filter_on_window", "sort_slice", "top_rows", "unique_last", "string_functions", "temporal_functions", "time_windows", "list_functions", "json_functions",
]


def seconds(run, times: int = 2) -> float:
    """The best of some runs, the first of which compiles."""
    runs = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        runs.append(time.perf_counter() - began)
    return round(min(runs), 4)


def drained(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def baseline_sizes(spark: SparkSession, folder: str, millions: int = 10) -> dict[str, float]:
    n = millions * 1_000_000
    mixed = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    tables = {
        "left": spark.range(n).select(mixed("id", n).alias("k"), F.col("id").alias("x")),
        "right": spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 3).alias("y")),
        "trades": spark.range(n).select(mixed("id", 10 * n).alias("t"), (F.col("id") % 1000).alias("g"), F.col("id").alias("x")),
        "quotes": spark.range(n // 10).select(mixed(F.col("id") + 7, 10 * n).alias("t"), (F.col("id") % 1000).alias("g"), F.col("id").alias("y")),
        "keys": spark.range(n // 10).select(*[mixed(F.col("id") + k, 1 << 47).alias(f"k{k}") for k in range(3)]),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    at = {name: Frame(spark.read.parquet(f"{folder}/{name}")) for name in tables}
    lines = Frame(spark.range(n // 10).select(mixed("id", 100).alias("k"), *[F.col("id").alias(f"v{j}") for j in range(7)]))
    writers.write_csv(lines, f"{folder}/lines", single_file=False)
    kinds = [("k", "int64"), *[(f"v{j}", "int64") for j in range(7)]]
    out = {f"join_{how}": seconds(lambda how=how: drained(at["left"].join(at["right"], on="k", how=how).df)) for how in ("inner", "left", "semi", "anti")}
    for strategy in ("backward", "forward", "nearest"):
        out[f"asof_grouped_{strategy}"] = seconds(lambda s=strategy: drained(at["trades"].join_asof(at["quotes"], on="t", by="g", strategy=s).df))
    out["asof_backward"] = seconds(lambda: drained(at["trades"].select("t", "x").join_asof(at["quotes"].select("t", "y"), on="t").df))
    out["sort_three_keys"] = seconds(lambda: drained(at["keys"].sort("k0", "k1", "k2").df))
    out["csv_filter_group"] = seconds(lambda: drained(readers.scan_csv(spark, f"{folder}/lines", schema=kinds).filter(col("v0") > 1000).select("k", "v1").group_by("k").agg(col("v1").sum().alias("s"), b.len_().alias("n")).df))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = suites.queries()
    times = {name: seconds(lambda name=name: drained(found[name](spark, sf_dir))) for name in HEADLINE}
    folder = tempfile.mkdtemp(prefix="brindle-bench-")
    try:
        large = baseline_sizes(spark, folder, int(os.environ.get("BENCH_MILLIONS", "10")))
    finally:
        spark.stop()
        shutil.rmtree(folder, True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "baseline_sizes": large, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
