import collections
import math
import os
import random
import re

import numpy as np
import pytest
from brindle.llm import near_dedup as n
from brindle.llm.links import Measure, connected_components, find_links, shared_members
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"

NONE = n.WordWeights(np.zeros(0, np.uint64), np.zeros(0))


def text(rng, words=120):
    return " ".join(f"w{rng.randrange(100_000)}" for _ in range(words))


def changed(rng, base, k):
    words = base.split()
    for at in rng.sample(range(len(words)), k):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def weighted_pairs(texts):
    """Similarity of all pairs, from words: no hashes, no samples."""
    words = [(t or "").lower().split() for t in texts]
    df = collections.Counter(w for own in words for w in set(own))

    def weight(w):
        return 1 + min(1, max(0, math.log(df[w] / len(texts)) / math.log(n.FREQUENT))) if df[w] > max(1, n.FREQUENT * len(texts)) else 2

    bags = []
    for own in words:
        size = min(5, len(own))
        bags.append(collections.Counter(tuple(own[k : k + size]) for k in range(len(own) - size + 1)) if own else collections.Counter())
    value = {s: sum(map(weight, s)) / len(s) for bag in bags for s in bag}
    mass = [sum(value[s] * c for s, c in bag.items()) for bag in bags]
    for a in range(len(texts)):
        for b in range(a):
            both = sum(value[s] * min(c, bags[b][s]) for s, c in bags[a].items() if s in bags[b])
            yield a, b, both / (mass[a] + mass[b] - both) if mass[a] + mass[b] else 1.0


def brute(texts):
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b, like in weighted_pairs(texts):
        if like >= 0.8 - 1e-9:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [root(k) for k in range(len(texts))]


def test_classes_match_brute_force(spark):
    rng = random.Random(3)
    base = [text(rng) for _ in range(12)]
    texts = list(base)
    for k in range(6):
        texts += [changed(rng, base[k], rng.choice([1, 2])) for _ in range(k + 1)] + [base[k]]
    shared = text(rng, 60)
    texts += [f"{shared} {text(rng, 60)}" for _ in range(8)] + ["", None, " \n", "one two", "one two", "One  TWO", "three"]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, class_id int")
    got = {r.doc_id: r.class_id for r in n.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_samples_estimate_weighted_similarity():
    rng = random.Random(4)
    base = text(rng, 400)
    for k in (4, 20, 60):
        a, b = (n.shingles(n.word_hashes(t), NONE) for t in (base, changed(rng, base, k)))
        same = (n.signature(*a[:2]) == n.signature(*b[:2])).mean()
        assert abs(same - n.similarity(n.elements(*a), n.elements(*b))) < 0.25
    assert (n.signature(*a[:2], block=16) == n.signature(*a[:2])).all()


def test_similarities_are_those_of_words():
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(30)}" for _ in range(80))
    texts = [base, base + " " + base, changed(rng, base, 3), changed(rng, base, 9), "", "one two", "one two one two one two one two", "one two one two one two", None]
    shared = [n.WordWeights(np.zeros(0, np.uint64), np.zeros(0))]
    df = collections.Counter(w for t in texts for w in set((t or "").split()))
    hashes = {w: int(n.word_hashes(w)[0]) for w in df if df[w] > 1}
    order = sorted(hashes, key=hashes.get)
    share = [1 + min(1, math.log(df[w] / len(texts)) / math.log(n.FREQUENT)) for w in order]
    shared = n.WordWeights(np.array([hashes[w] for w in order], np.uint64), np.array(share))
    items = [n.elements(*n.shingles(n.word_hashes(t), shared)) for t in texts]
    want = {(a, b): like for a, b, like in weighted_pairs(texts)}
    for columns in (7, 2048):
        got = n.similarities(items, items, columns)
        for (a, b), like in want.items():
            assert abs(got[a, b] - like) < 1e-9 and abs(n.similarity(items[a], items[b]) - like) < 1e-9, (a, b)


def test_word_hashes_are_of_words():
    a, b = n.word_hashes("Alpha beta\n\tgamma"), n.word_hashes("gamma ALPHA beta")
    assert a[0] == b[1] and a[1] == b[2] and a[2] == b[0] and len(set(a.tolist())) == 3
    assert len(n.word_hashes(None)) == len(n.word_hashes(" \x0b ")) == 0


def test_repeats_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 2 + [(None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = n.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == [("1", "1", 3), ("1", "1", 3), ("None", "1", 3), ("None", "None", 1)]
    assert n.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keeps_one_row_of_each_class(spark):
    base = "a b c d e f g"
    rows = [(1, base, "x"), (1, "other words that have the same id", "y"), (None, base, "z"), (None, "no id and no copy at all", "u"), (None, "no id and no copy at all", "u"), (7, None, "v"), (8, "  ", "w")]
    got = n.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _digest string")).collect()
    assert sorted((str(r.doc_id), str(r.text), r["_digest"]) for r in got) == sorted([("1", base, "x"), ("1", rows[1][1], "y"), ("None", rows[3][1], "u"), ("7", "None", "v")])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 23


def classes_of(spark, buckets, similar, **more):
    """Labels by find_links over {key: numbers}, with pairs that ``similar`` names as links."""

    class Near(Measure):  # workers get it by value
        pairs = frozenset(similar)

        def read(self, payload):
            return int(payload)

        def linked(self, one, two, wanted=None):
            return np.array([[(a, b) in self.pairs or (b, a) in self.pairs for b in two] for a in one])

    members = spark.createDataFrame([(k, x) for k, xs in buckets.items() for x in xs], "k long, node long")
    held = members.select("node").distinct().withColumn("_size", F.lit(1).cast("long")).withColumn("_payload", F.col("node").cast("string"))
    shared, _ = shared_members(members)
    links, labels = find_links(shared, held, Near(), **more)
    assert links is None or {(r.a, r.b) for r in links.collect()} <= {p for x, y in similar for p in ((x, y), (y, x))}
    return {} if labels is None else {r.node: r.label for r in labels.collect()}


def test_rows_that_never_were_centres_meet(spark):
    # One bucket of many unlike rows; blocks smaller and larger than it.
    pairs = [(3, 41), (17, 18), (22, 59), (59, 58)]
    for rows in (7, 1024):
        got = classes_of(spark, {1: range(60), 2: [1, 2]}, pairs, rows=rows)
        assert got == {3: 3, 41: 3, 17: 17, 18: 17, 22: 22, 59: 22, 58: 22}


def test_large_component_meets_the_rest(spark):
    # All but a few rows are linked with one centre; the rest is linked with its leaves only.
    star = [(0, k) for k in range(1, 50)]
    for rows in (5, 1024):
        got = classes_of(spark, {1: range(60), 2: [0, 1, 2]}, [*star, (48, 55), (55, 56)], rows=rows)
        assert {k for k, v in got.items() if v == 0} == {*range(50), 55, 56} and 57 not in got


def test_blocks_follow_sizes(spark):
    got = classes_of(spark, {1: range(20)}, [(4, 15), (15, 9)], rows=1024, size=3)
    assert got == {4: 4, 15: 4, 9: 4}


def rows_joined_by_node(spark, run):
    """Rows that joins of node columns give while run() runs, by Spark's own counts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    every, out = store.executionsList(), 0
    for at in range(before, every.size()):
        execution = every.apply(at).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if re.match(r"\w*Join \[node\d*#\d+L\], \[node", node.desc()):
                counts = [node.metrics().apply(k) for k in range(node.metrics().size())]
                out += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in counts if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return out


def test_joins_see_a_node_once(spark):
    # Copies of many common keys: joins take a row per node, not one for each of its keys.
    copies, keys = 50, 40
    joined = rows_joined_by_node(spark, lambda: classes_of(spark, {k: range(copies) for k in range(keys)}, [(a, b) for a in range(copies) for b in range(a)]))
    assert copies <= joined <= 10 * copies


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_recall_of_links_on_documents(spark):
    """Of all pairs with ids divisible by 20 as queries that brute force links, those in one class."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.class_id for r in n.near_duplicates(docs).collect()}
    weights = n.word_weights(docs)
    rows = docs.collect()
    items = [n.elements(*n.shingles(n.word_hashes(r.text), weights)) for r in rows]
    mine = [k for k, r in enumerate(rows) if r.doc_id % 20 == 0]
    like = n.similarities([items[k] for k in mine], items) >= 0.8 - 1e-9
    pairs = [(rows[mine[x]].doc_id, rows[y].doc_id) for x, y in zip(*np.nonzero(like), strict=True) if mine[x] != y]
    assert pairs and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
