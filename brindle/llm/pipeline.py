"""A corpus from raw documents: quality, toxicity, near-duplicates, mixing, packing.

Null and repeated ids, null texts and rows that occur more than once are rows like others in
every stage; columns beside those of documents are left out. An empty table gives empty ones.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import mixing, near_dedup, packing, quality_classifier, toxicity
from brindle.llm.common import materialize, read_table, scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Scores from which documents are kept (quality) or go (toxicity).
QUALITY, TOXIC = 0.7, 0.5


def _stage(f):
    """A stage's scratch tables go when the next one begins; its own rows are written by then."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scope(spark, "pipeline", fresh=True):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours are mostly of good quality."""
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.score_documents(docs, model, keep=COLUMNS).where(F.col("score") >= QUALITY).select(*COLUMNS)


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, keep=COLUMNS).where(F.col("score") < TOXIC).select(*COLUMNS)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the smallest id; texts decide, so null and repeated ids lose none."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training; equal rows are rows of their own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in COLUMNS]
    keyed = docs.select(*COLUMNS, F.unhex(F.md5(F.concat_ws("\x00", *parts))).alias("_key"))
    mixed = mixing.mix(keyed, id_column="_key").where("passes > 0")
    # Equal rows have one key, and together all its positions.
    taken = mixed.groupBy(F.col("_id").alias("_of")).agg(F.flatten(F.collect_list("positions")).alias("positions"))
    joined = keyed.dropDuplicates(["_key"]).join(taken, F.col("_key") == F.col("_of")).withColumn("_position", F.explode("positions"))
    return joined.orderBy("_position", "_key").select(*COLUMNS)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, as op5 returns them."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: learned scores and hashed samples are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def _written(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's rows where the next stage's cleaning doesn't reach."""
    with scope(df.sparkSession, f"pipeline-{name}", fresh=True):
        return materialize(df, name)
