"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import html_extract, image_copies, mixing, near_dedup, packing, quality_classifier, quality_rules, toxicity, url_filters, warc
from brindle.llm import pipeline as stages
from brindle.llm.common import fold, read_table, scope, scratch_path

#: Host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, deduplicated = scratch_path(spark, "warc"), scratch_path(spark, "warc-dedup")
    warc.write_warc(read_table(spark, sf_dir, "pages"), written)
    warc.dedup_archives(spark, written, deduplicated)
    records = warc.read_warc(spark, deduplicated, with_payload=False)
    return records.select(F.col("row_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_row").cast("long").alias("refers_to"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.match_rules(read_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels.where(fold("doc_id", 4) != 2))
    scored = quality_classifier.score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_copies.find_copies(image_copies.render_vectors(read_table(spark, sf_dir, "embeddings")), id_column="vec_id")


def op9_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    first = F.element_at(F.col("positions"), 1)
    ordered = mixed.withColumn("first_position", F.when(F.size("positions") > 0, first)).orderBy(F.col("first_position").asc_nulls_last(), "_id")
    return ordered.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "passes", "first_position")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def _scoped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query's scratch tables go when it is asked for again, or with the process."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scope(spark, f.__name__, fresh=True):
            return f(spark, sf_dir)

    return run


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's counts and base rules, which SQL can express, without the learned list."""
    counted = quality_rules.text_statistics(read_table(spark, sf_dir, "documents"))
    return counted.withColumn("base_failed", quality_rules.base_failed()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's targets by source."""
    sizes = read_table(spark, sf_dir, "documents").select("source", mixing.word_count(F.col("text")).alias("size"))
    sizes = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    return mixing.source_targets(sizes).select("source", "source_size", "n_rows", "weight", F.round("target", 4).alias("target"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _scoped(f) for f in (op1_quality_rules, op2_warc_revisits, op3_url_filters, op4_html_extraction, op5_packing, op6_quality_classifier, op7_minhash_near_dedup, op8_image_copies, op9_curriculum_mixing, op10_toxicity, pipeline, quality_base, mixing_targets)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    # Five hexadecimal digits are four letters of base32.
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, {5 * g + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
    return {
        "op2_warc_revisits": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            q AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS d, min(page_id) OVER (PARTITION BY body) AS first FROM p)
            SELECT page_id, payload_bytes, {letters} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q""",
        "quality_base": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            lines AS (SELECT doc_id, sum(n - 1)::BIGINT AS dup FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
            placed AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
            windows AS (SELECT doc_id, i, a, lead(a) OVER x AS b, lead(a, 2) OVER x AS c FROM placed WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
            twice AS (SELECT doc_id, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
            repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1)
            SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
            len(w) < 50 OR 100 * coalesce(repeats.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)""",
        "mixing_targets": r"""
            WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size, count(*) AS n_rows FROM documents GROUP BY 1),
            r AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
            o AS (SELECT *, 2.0 * source_size / weight AS level, 1.5 * sum(source_size) OVER () AS budget FROM r),
            f AS (SELECT arg_min((budget - before) / onward, level) AS water FROM (SELECT level, budget, coalesce(sum(2.0 * source_size) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (ORDER BY level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM o) WHERE (budget - before) / onward <= level)
            SELECT source, source_size, n_rows, weight, round(least(2.0 * source_size, coalesce(water * weight, 2.0 * source_size))::DOUBLE, 4) AS target FROM o, f""",
        "op3_url_filters": f"""
            WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
            rules(h, p, v) AS (VALUES {rules}),
            found AS (SELECT page_id, arg_max(h || p, length(h) * 10000 + length(p)) AS rule, arg_max(v, length(h) * 10000 + length(p)) AS verdict FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
            SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN found USING (page_id)""",
    }
