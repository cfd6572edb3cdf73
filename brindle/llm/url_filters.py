"""URL filters: rules on a host with its subdomains and on a prefix of the path.

A rule becomes an interval of canonical keys (reversed host, separator, path), and a url a
point for each of its host suffixes that some rule may name. Points and interval ends are
sorted by range over the cluster; in that order a sweep keeps, per nesting depth, the rule
that opened last, which is the stack of active rules. What a partition inherits from those
before it (depth and stack) comes from one summary row per partition. DataFrame functions
only; no partition needs the rows of one key together, as ties are split by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialize, partitions

#: Bytes that UTF-8 never uses: between host and path, and past the last key of a prefix.
SEPARATOR, PAST = b"\xfe", b"\xff"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or no ``://``."""
    host = F.regexp_extract(_after(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def _key(host: Column, path: Column) -> Column:
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")
    return F.concat(F.encode(reversed_host, "utf-8"), F.lit(SEPARATOR), F.encode(path, "utf-8"))


def _stack_column(depth: int) -> str:
    return f"_s{depth}"


def match_rules(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per row of ``urls``: its id, url, host, path, rule, verdict and rule_depth.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the
    url's path starts with its path; the longest host wins, then the longest path. Rules with a
    null part are left out; of rules with equal paths and hosts (but for case) ``block`` wins. A url that no rule fits gets
    ``default``. Rows repeat in the result as in ``urls``. Only the two columns named are read.
    """
    spark = urls.sparkSession
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host")
    rules = rules.where("host is not null and path is not null and verdict is not null").select(lower, "path", "verdict")
    rules = materialize(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules")
    pages = urls.select(F.col(id_column).alias("_id"), F.col(url).alias("_url")).groupBy("_id", "_url").agg(F.count(F.lit(1)).alias("_copies"))
    pages = pages.select("*", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    # The number of labels of the hosts in the rules; a host name has 127 labels at most.
    counts = sorted(r[0] for r in rules.select(_labels(F.col("host"))).distinct().collect())
    parts = F.split(F.col("host"), r"\.", -1)
    suffixes = F.filter(F.array(*[F.lit(c) for c in counts]).cast("array<int>"), lambda c: c <= F.size(parts))
    points = pages.where("_url is not null").select("_id", "_url", "path", "host", F.explode(suffixes).alias("_n"))
    points = points.select("_id", "_url", F.col("_n").alias("n"), _key(F.array_join(F.slice(parts, F.size(parts) - F.col("_n") + 1, F.col("_n")), "."), F.col("path")).alias("k"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("rule_host", "rule_path", "rule_verdict")]
    start = _key(F.col("host"), F.col("path"))
    ends = rules.select(F.lit(None).cast(urls.schema[id_column].dataType).alias("_id"), F.lit(None).cast("string").alias("_url"), F.lit(0).alias("n"), F.explode(F.array(F.struct(start.alias("k"), F.lit(1).alias("kind")), F.struct(F.concat(start, F.lit(PAST)).alias("k"), F.lit(0).alias("kind")))).alias("e"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    events = points.select("_id", "_url", "n", "k", F.lit(2).alias("kind"), *nothing).unionByName(ends.select("_id", "_url", "n", "e.k", "e.kind", "rule_host", "rule_path", "rule_verdict"))
    spread = events.withColumn("_tie", F.xxhash64("_id", "_url"))
    # A close comes before an open and that before the points of the same key.
    spread = materialize(spread.repartitionByRange(partitions(spark), "k", "kind", "_tie").withColumn("p", F.spark_partition_id()), "events")
    swept = _sweep(spread)
    # One row per url again: the longest host of those found, whose path is the innermost.
    best = swept.groupBy("_id", "_url").agg(F.max(F.struct(F.col("n"), F.length("found.rule_path").alias("l"), F.col("found"))).alias("best"))
    best = best.select(F.col("_id").alias("_i"), F.col("_url").alias("_u"), F.col("best.found").alias("found"))
    out = pages.join(best, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_url") == F.col("_u")), "left")
    out = out.select(
        F.col("_id").alias(id_column),
        F.col("_url").alias(url),
        "host",
        "path",
        F.concat("found.rule_host", "found.rule_path").alias("rule"),
        F.coalesce("found.rule_verdict", F.lit(default)).alias("verdict"),
        F.col("found.depth").alias("rule_depth"),
        "_copies",
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copies", "_copy")


def _sweep(events: DataFrame) -> DataFrame:
    """The points that lie in a rule, with the innermost one as ``found``.

    ``events``: p (partition in key order), k, kind (0 closes, 1 opens, 2 a point), the rule.
    """
    step = F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)
    order = Window.partitionBy("p").orderBy("k", "kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    depths = events.groupBy("p").agg(F.sum(step).alias("step")).select(F.col("p").alias("q"), F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("carried"))
    df = events.join(F.broadcast(depths), F.col("p") == F.col("q")).drop("q")
    df = df.withColumn("depth", F.col("carried") + F.sum(step).over(order))
    opened = df.where("kind = 1")
    # How deep the rules nest: no more than a path has prefixes that are rules.
    deepest = opened.agg(F.max("depth")).first()[0] or 0
    if not deepest:
        return df.where("false").select("_id", "_url", "n", F.struct("rule_host", "rule_path", "rule_verdict", F.col("depth")).alias("found"))
    rule = F.struct("rule_host", "rule_path", "rule_verdict", "depth")
    levels = range(1, deepest + 1)
    # What each partition opened last at each depth, and from that what the next ones inherit.
    stacks = events.select("p").distinct().join(opened.groupBy(F.col("p").alias("q")).agg(*[F.max(F.when(F.col("depth") == d, F.struct("k", "kind", "_tie", rule.alias("rule")))).alias(_stack_column(d)) for d in levels]), F.col("p") == F.col("q"), "left")
    carried = stacks.select(F.col("p").alias("q"), *[F.last(_stack_column(d), ignorenulls=True).over(earlier).alias(f"_c{d}") for d in levels])
    df = df.join(F.broadcast(carried), F.col("p") == F.col("q"))
    stack = [F.coalesce(F.last(F.when((F.col("kind") == 1) & (F.col("depth") == d), rule), ignorenulls=True).over(order), F.col(f"_c{d}.rule")) for d in levels]
    df = df.withColumn("stack", F.array(*stack)).where("kind = 2 and depth > 0")
    return df.select("_id", "_url", "n", F.element_at("stack", F.col("depth").cast("int")).alias("found"))
