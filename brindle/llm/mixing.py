"""Mixing sources to target weights along a curriculum that changes over training.

Every source has a weight schedule w(t) over training time t in 0..1. Its integral gives
the source's share of the mix, and, cumulated, how much of the source has been asked for by
time t. A document's place in its source (a cumulative size, in hash order) is inverted
through that integral into the time at which training reaches it, and documents are
range-sorted by that time. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialize, partitions, words_of

#: Weights by rank of the source; repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Relative change of a source's weight from the start to the end of training, by rank; repeating.
SLOPES = (-0.5, 0.0, 0.5)
#: Up to so many sources, their table (a row of about 100 bytes each) is broadcast.
BROADCAST_SOURCES = 10_000
#: Parts of a source that are summed up together.
STRETCH = 64


def word_count(text: Column) -> Column:
    """Words of a text; 0 for a null one."""
    return F.size(words_of(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of the sources, a row each: source, source_size, n_rows, weight, slope, target.

    ``sizes`` has source, source_size and n_rows. Sources rank by code point, null last.
    Weights share ``budget`` times all sizes; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight: with caps sorted by cap / weight, the
    first cap that isn't reached fixes the level for all that follow.
    """
    size = F.col("source_size")
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (F.col("rank") % len(values) + 1).cast("int"))
    df = sizes.withColumn("rank", rank).withColumn("weight", pick(weights)).withColumn("slope", pick(slopes)).withColumn("cap", most * size)
    # Weightless sources come last, at level 0, and get nothing.
    df = df.withColumn("level", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    order = Window.orderBy(F.col("level").asc_nulls_last(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("here", F.try_divide(F.lit(budget) * F.sum(size).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(onward)))
    df = df.withColumn("water", F.min(F.when(F.col("here") <= F.col("level"), F.struct(F.col("level").alias("a"), F.col("rank").alias("b"), F.col("here").alias("here")))).over(every))
    target = F.when(F.col("water").isNull(), F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)).otherwise(F.least("cap", F.col("water.here") * F.col("weight")))
    return df.select("source", "source_size", "n_rows", "rank", "weight", "slope", target.cast("double").alias("target"))


def time_of(share: Column, slope: Column) -> Column:
    """The time by which ``share`` of a source's demand has come.

    The weight at time t is proportional to 1 + slope * (2t - 1), |slope| <= 1; its integral is
    (1 - slope) t + slope t^2, inverted here without cancellation.
    """
    return F.when(share <= 0, F.lit(0.0)).otherwise(2 * share / ((1 - slope) + F.sqrt(F.greatest(F.lit(0.0), (1 - slope) * (1 - slope) + 4 * slope * share))))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    slopes: tuple[float, ...] = SLOPES,
    budget: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    group_rows: int = 20_000,
) -> DataFrame:
    """A row per document row: _id, size, source, source_size, target, passes, taken, positions.

    ``taken`` = size * passes. Each source is read whole as often as its target allows, and the
    last pass stops at the document whose middle passes the rest, so its sum misses the target
    by half a document at most. ``positions`` are the training times (0..1) of the passes, in
    order. A null text has size 0; sizes of 0 are never taken. A null source is a source. Rows
    with equal ids are rows of their own; equal rows are placed in some order, and then
    passes may differ between them, but not their sum.
    The running size in a source comes from sums of groups of up to ``group_rows`` rows,
    so a source with a third of all rows is spread over many tasks.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_column).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("size"))
    base = materialize(base.withColumn("_at", F.xxhash64(F.col("_id"), F.lit(seed))), "sizes")
    sizes = base.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = materialize(source_targets(sizes, weights, slopes, budget, most).coalesce(1), "targets")
    n_sources, n_rows = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    held = max(16, min(group_rows, n_rows // (8 * partitions(spark))))
    if n_sources <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    # Equal parts of the range of hashes; the number follows the source's rows.
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / held)).cast("long")
    share = F.shiftrightunsigned("_at", 33) / F.lit(float(2**31))
    df = base.join(targets, F.col("_source").eqNullSafe(F.col("source"))).withColumn("_part", F.floor(share * parts).cast("long"))
    sums = df.groupBy("rank", "_part").agg(F.sum("size").alias("_sum"))
    # Where each part starts: sums of stretches of parts first, then of the parts of a stretch.
    sums = sums.withColumn("_stretch", F.floor(F.col("_part") / STRETCH))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    far = sums.groupBy(F.col("rank").alias("_r"), F.col("_stretch").alias("_s")).agg(F.sum("_sum").alias("_sums"))
    far = far.withColumn("_far", F.coalesce(F.sum("_sums").over(earlier("_r", "_s")), F.lit(0)))
    near = sums.withColumn("_near", F.coalesce(F.sum("_sum").over(earlier("rank", "_stretch", "_part")), F.lit(0)))
    starts = near.join(far, (F.col("rank") == F.col("_r")) & (F.col("_stretch") == F.col("_s"))).select(F.col("rank").alias("_rank"), F.col("_part").alias("_of"), (F.col("_far") + F.col("_near")).alias("_start"))
    inside = Window.partitionBy("rank", "_part").orderBy(F.shiftrightunsigned("_at", 33), "_at", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    df = df.join(starts, (F.col("rank") == F.col("_rank")) & (F.col("_part") == F.col("_of")))
    start, total = F.col("_start") + F.col("_in"), F.col("source_size")
    whole = F.floor(F.coalesce(F.try_divide(F.col("target"), total), F.lit(0.0))).cast("long")
    rest = F.col("target") - whole * total
    passes = F.when(F.col("size") == 0, F.lit(0)).otherwise(whole + (start + F.col("size") / 2 <= rest).cast("long")).cast("int")
    df = df.withColumn("passes", passes)
    positions = F.transform(
        F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: time_of((k * F.col("source_size") + F.col("_start") + F.col("_in")) / F.col("target"), F.col("slope")),
    )
    return df.select("_id", "size", F.col("_source").alias("source"), "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"), positions.alias("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """A row per pass of a document, range-sorted by position; ties by id."""
    return mixed.where("passes > 0").withColumn("position", F.explode("positions")).orderBy("position", "_id").drop("positions")
