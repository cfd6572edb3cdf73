import re

from brindle.llm import quality_rules as q
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    places = {}
    for k in range(len(words) - 2):
        places.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + j for v in places.values() if len(v) > 1 for k in v for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "one", "a b c", "a b c a b c", "x x x x x", "a b c d a b c d\na b c d a b c d", "#*$ %&|<> x\n\ny\ny \ny", "é ü ß\x0b\x0cñ\r\nñ", "w " * 3000, "a b " * 700 + "tail"]


def test_statistics_match_brute_force(spark):
    rows = [(k, t, "other") for k, t in enumerate(TEXTS)] + [(5, TEXTS[5], "again"), (None, "a b c", None)]
    got = q.text_statistics(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    want = sorted((str(k), *brute(t)) for k, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_rules_learn_and_reject(spark):
    good = [(k, " ".join(f"word{(k * 7 + j * j) % 97}" for j in range(80)), 1) for k in range(60)]
    bad = [(100 + k, " ".join(f"w{j + k}###" for j in range(80)), 0) for k in range(30)]
    docs = spark.createDataFrame([x[:2] for x in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in good + bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    judged, rules = q.judge_documents(docs, labels)
    kept = {r.doc_id: r.kept for r in judged.collect()}
    assert rules.rules and all(kept[k] for k, _, _ in good) and not any(kept[k] for k, _, _ in bad)


def test_empty_tables(spark):
    judged, rules = q.judge_documents(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert judged.count() == 0 and not rules.rules


def test_base_rule(spark):
    docs = spark.createDataFrame([(1, "a b c " * 40), (2, " ".join(map(str, range(60)))), (3, "short")], "doc_id long, text string")
    judged, _ = q.judge_documents(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.doc_id: (r.base_failed, r.kept) for r in judged.select("doc_id", "base_failed", "kept").orderBy(F.col("doc_id")).collect()} == {1: (True, False), 2: (False, True), 3: (True, False)}


def test_best_condition_is_that_of_all(spark):
    """Against every feature, threshold and direction, counted row by row."""
    import math
    import random

    rng = random.Random(8)
    names = list(q.FEATURES)[:4]
    rows = [(rng.random() < 0.7, *[rng.randrange(9) for _ in names]) for _ in range(300)]
    rows = [(0 if r[2] > 5 and rng.random() < 0.9 else int(r[0]), *r[1:]) for r in rows]
    table = spark.createDataFrame([(*r, 1) for r in rows], ["good", *[f"b_{n}" for n in names], "count"])
    cuts = {n: [k / 10 for k in range(1, 9)] for n in names}

    def gain(covered):
        b, n = sum(r[0] == 0 for r in covered), len(covered)
        total = sum(r[0] == 0 for r in rows)
        return b * (math.log2(b / n) - math.log2(total / len(rows))) if b >= 5 and n < len(rows) else 0.0

    every = {(n, j, up): gain([r for r in rows if (r[k + 1] >= j) == up]) for k, n in enumerate(names) for j in range(1, 9) for up in (True, False)}
    found = q._best_condition(table, cuts, 5)
    assert math.isclose(every[found.feature, found.bin, found.at_least], max(every.values())) and found.threshold == cuts[found.feature][found.bin - 1]


def test_list_rejects_what_its_rules_say(spark):
    """The one CASE WHEN against the rules applied in Python, over statistics as they are."""
    good = [(k, " ".join(f"word{(k * 7 + j * j) % 97}" for j in range(80)), 1) for k in range(60)]
    bad = [(100 + k, " ".join(["BUY!!!", "$$$", f"x{k}"] * 30) + f" t{k}", 0) for k in range(40)]
    docs = spark.createDataFrame([(a, t) for a, t, _ in good + bad], "doc_id long, text string")
    judged, learned = q.judge_documents(docs, spark.createDataFrame([(a, y) for a, _, y in good + bad], "doc_id long, quality int"))
    assert learned.rules

    def value(r, feature):
        a, c = q.FEATURES[feature]
        return (r[a] / r[c] if r[c] else 0.0) if c else float(r[a])

    for r in judged.collect():
        fits = [k for k, rule in enumerate(learned.rules, 1) if all((value(r, c.feature) >= c.threshold) == c.at_least for c in rule)]
        assert r.rule == (fits[0] if fits else None) and r.kept == (not r.base_failed and not fits)
