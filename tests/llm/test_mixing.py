from collections import defaultdict

from brindle.llm.mixing import mix, source_targets, training_order


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over


def rows():
    out = [(k, "w " * (k % 13 + (400 if k % 97 == 0 else 0)), ["big", "a", None, "é", "z"][0 if k % 3 == 0 else k % 5]) for k in range(1500)]
    return [*out, (5, "again x", "a"), (5, "again x", "a"), (None, None, "a"), (9999, "", "lone")]


def test_targets_and_takes(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 0) for r in data], "doc_id long, text string, source string, size int")
    got = mix(docs, group_rows=40).collect()
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, text, source in data:
        n = len((text or "").split())
        sizes[source] += n
        longest[source] = max(longest[source], n)
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken in (0, r.size, 2 * r.size) and len(r.positions) == r.passes
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
    assert len(got) == len(data) and all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    again = mix(docs.repartition(7), group_rows=40).collect()
    key = lambda r: (str(r._id), r.size, r.passes, tuple(r.positions))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_moves_sources(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "ab"[k % 2]) for k in range(400)], "doc_id long, text string, source string")
    mixed = mix(docs, weights=(1.0,), slopes=(-1.0, 1.0), budget=1.0)
    mean = {s: sum(p for r in mixed.collect() if r.source == s for p in r.positions) / 200 for s in "ab"}
    assert mean["a"] < 0.4 and mean["b"] > 0.6
    positions = [r.position for r in training_order(mixed).collect()]
    assert positions == sorted(positions) and len(positions) == 400


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 1, 1), ("b", 100, 1), (None, 50, 1), ("c", 0, 1)], "source string, source_size long, n_rows long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    want = brute_targets({"a": 1, "b": 100, None: 50, "c": 0})
    assert all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
