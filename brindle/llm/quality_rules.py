"""Quality rules: a learned decision list over text statistics.

Sequential covering: while labelled rows of low quality remain, a conjunction of
thresholds is grown on one part of them by information gain, pruned on the other part, and
kept if it is precise enough; the rows that it covers are set aside. Each step asks Spark
for one histogram (feature, bin -> rows of either label), which is all that reaches the
driver. The list becomes one ordered ``CASE WHEN`` expression. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACE_CHARS, count_chars, materialize, words_of

SYMBOLS = "#*$%&|<>"

#: The features that rules may test: name -> (numerator, denominator); None: the number itself.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "marks_a_word": ("n_marks", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "duplicate_line_share": ("n_dup_lines", "n_lines"),
}


def _repeated_windows(words: str) -> list[tuple[str, Column]]:
    """Steps, each a column over the ones before, that end in ``n_repeat_words``.

    Windows are hashed to 64 bits and sorted with their position, so equal ones are
    neighbours; the positions of those are sorted, and each covers 3 words less what the
    next one covers too. n log n a text, whatever it repeats. Exact but for two windows of a
    text that share a hash: of a million windows, that happens to one text in 37 million.
    """
    w = F.col(words)
    n = F.size(w)
    triples = F.slice(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(n, F.lit(1))).alias("b"), F.slice(w, 3, F.greatest(n, F.lit(1))).alias("c")), F.lit(1), F.greatest(n - 2, F.lit(0)))
    hashes = F.transform(triples, lambda z: F.xxhash64(z["a"], z["b"], z["c"]))
    h, p = F.col("_hashes"), F.col("_sorted")
    placed = F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i"))),
    )
    after = F.slice(p, F.lit(2), F.size(p))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(p, F.lit(1), F.size(p) - 1))
    same = F.filter(F.arrays_zip(p.alias("at"), after.alias("after"), before.alias("before")), lambda z: F.coalesce(z["at"]["h"] == z["after"]["h"], F.lit(False)) | F.coalesce(z["at"]["h"] == z["before"]["h"], F.lit(False)))
    starts = F.sort_array(F.transform(same, lambda z: z["at"]["i"]))
    s = F.col("_starts")
    covered = F.aggregate(
        F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.least(b - a, F.lit(3))),
        F.lit(3),
        lambda total, x: total + x,
    )
    return [("_hashes", hashes), ("_sorted", placed), ("_starts", F.when(p.isNotNull(), starts)), ("n_repeat_words", F.when(s.isNull(), F.lit(0)).otherwise(covered).cast("long"))]


def text_statistics(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row: its id and the counts of its whole text, as long columns.

    A null text counts as an empty one: every count is 0. Rows are kept as they are, also
    when ids repeat. Only ``id_column`` and ``text`` are read, so other columns can't clash.
    """
    body = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    df = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    df = df.select(
        "_id",
        words_of(F.col("_text")).alias("_words"),
        lines.alias("_lines"),
        F.length(F.translate(body, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        count_chars(body, SYMBOLS).cast("long").alias("n_symbols"),
        count_chars(body, "!?").cast("long").alias("n_marks"),
        count_chars(body, "0123456789").cast("long").alias("n_digits"),
        F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )
    kept = ["_id", "word_chars", "n_symbols", "n_marks", "n_digits", "n_upper"]
    steps = _repeated_windows("_words")
    df = df.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        steps[0][1].alias(steps[0][0]),
    )
    kept += ["n_words", "n_distinct_words", "n_lines", "n_dup_lines"]
    for name, column in steps[1:]:
        df = df.select(*kept, column.alias(name))
    return df.withColumnRenamed("_id", id_column)


def feature_columns() -> dict[str, Column]:
    """The features as expressions over text_statistics(); 0 where the denominator is 0."""
    return {k: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) if b else F.col(a).cast("double") for k, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold`` (or ``<``)."""

    feature: str
    bin: int
    threshold: float
    at_least: bool

    def column(self) -> Column:
        value = feature_columns()[self.feature]
        return value >= self.threshold if self.at_least else value < self.threshold

    def binned(self) -> Column:
        code = F.col(f"b_{self.feature}")
        return code >= self.bin if self.at_least else code < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction that rejects; what no rule takes is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rule_number(self) -> Column:
        """1-based number of the first rule that fits, else null."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            out = F.when(_all(c.column() for c in self.rules[k - 1]), F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if {' and '.join(map(str, r))}" for k, r in enumerate(self.rules, 1))


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def learn_rules(
    labelled: DataFrame,
    label: str = "quality",
    bins: int = 64,
    max_rules: int = 10,
    max_conditions: int = 3,
    min_covered: int = 5,
    min_precision: float = 0.9,
) -> DecisionList:
    """Learn from statistics with a 0/1 label, all rows of them; 0 is what rules reject.

    Thresholds are quantiles. A rule has to reject at least ``min_covered`` bad rows, with at
    least ``min_precision`` of the covered rows bad, in growing and over all rows left. Without
    labels, or with only one label, the list is empty.
    """
    features = feature_columns()
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("good"), *[c.alias(k) for k, c in features.items()], F.pmod(F.xxhash64(*labelled.columns), F.lit(3)).alias("part"))
    rows = materialize(rows, "labelled")
    shares = [k / bins for k in range(1, bins)]
    bad = rows.where("good = 0")
    # Quantiles of the bad rows too: they are few, and rules divide them from the others.
    cuts = {k: set() for k in features}
    for part in (rows, bad):
        found = part.agg(*[F.percentile_approx(k, shares, 10_000).alias(k) for k in features]).first()
        for k in features:
            cuts[k] |= set(found[k] or [])
    cuts = {k: sorted(v) for k, v in cuts.items()}
    coded = rows.select("good", "part", *[_code(k, cuts[k]).alias(f"b_{k}") for k in features])
    # Equal rows are one from here on, with counts.
    coded = materialize(coded.groupBy(*coded.columns).count(), "coded")
    result = DecisionList()
    left = coded
    while len(result.rules) < max_rules:
        grow, prune = left.where("part < 2"), left.where("part = 2")
        rule: list[Condition] = []
        for _ in range(max_conditions):
            best = _best_condition(grow.where(_all(c.binned() for c in rule)), cuts, min_covered)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        rule = _pruned(prune, rule)
        b, g = _covered(left, [_all(c.binned() for c in rule)])[0]
        if b < min_covered or b < min_precision * (b + g):
            break
        result.rules.append(tuple(rule))
        left = left.where(~_all(c.binned() for c in rule))
    return result


def _code(feature: str, cuts: list[float]) -> Column:
    """How many of the cuts are at most the feature."""
    value = F.col(feature)
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<double>"), lambda x: x <= value)).cast("short")


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]], least: int) -> Condition | None:
    names = [k for k, v in cuts.items() if v]
    if not names:
        return None
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"b_{k}").alias("b")) for k in names])).alias("x")
    counts = rows.select(pairs, "good", "count").groupBy("x.f", "x.b").agg(F.sum(F.when(F.col("good") == 0, F.col("count")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("good") == 1, F.col("count")).otherwise(0)).alias("good")).collect()
    tables = {k: ([0] * (len(cuts[k]) + 1), [0] * (len(cuts[k]) + 1)) for k in names}
    for f, b, bad, good in counts:
        tables[f][0][b], tables[f][1][b] = bad, good
    total_bad, total_good = (sum(tables[names[0]][i]) for i in (0, 1))
    if not total_bad or not total_good:
        return None
    base, best = math.log2(total_bad / (total_bad + total_good)), (1e-9, None)
    for k in names:
        low_bad = low_good = 0
        for j in range(1, len(cuts[k]) + 1):
            low_bad, low_good = low_bad + tables[k][0][j - 1], low_good + tables[k][1][j - 1]
            for at_least, b, g in ((True, total_bad - low_bad, total_good - low_good), (False, low_bad, low_good)):
                if b >= least and b + g < total_bad + total_good:
                    gain = b * (math.log2(b / (b + g)) - base)
                    if gain > best[0]:
                        best = (gain, Condition(k, j, cuts[k][j - 1], at_least))
    return best[1]


def _covered(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    found = rows.agg(*[F.coalesce(F.sum(F.when(t & (F.col("good") == y), F.col("count"))), F.lit(0)).alias(f"c{k}_{y}") for k, t in enumerate(tests) for y in (0, 1)]).first()
    return [(found[f"c{k}_0"], found[f"c{k}_1"]) for k in range(len(tests))]


def _pruned(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The prefix that is best on rows that growing hasn't seen."""
    found = _covered(rows, [_all(c.binned() for c in rule[:k]) for k in range(1, len(rule) + 1)])
    worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in found]
    best = max(range(len(rule)), key=lambda k: (round(worth[k], 4), found[k][0]))
    return rule[: best + 1]


def base_failed() -> Column:
    """Over text_statistics(): fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge_documents(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "quality") -> tuple[DataFrame, DecisionList]:
    """Statistics, base rule and verdict of every row, and the list that was learned.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows.
    ``kept``: neither that nor a learned rule rejects. ``rule``: the rule that fits first.
    Labels of one id that differ count as the lower one; null labels and ids teach nothing.
    """
    stats = materialize(text_statistics(docs, text, id_column), "statistics")
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_label_id")).agg(F.min(label).alias("_label"))
    learned = learn_rules(stats.join(marks, F.col(id_column) == F.col("_label_id")).drop("_label_id"), "_label")
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", learned.rule_number())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), learned
