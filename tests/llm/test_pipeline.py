import os

import corpus_pipeline
from brindle.llm import pipeline
import pytest
from brindle.llm.common import read_table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_keep_columns_and_act(spark):
    docs = read_table(spark, DATA, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
            docs = pipeline._written(out, name)
            ids = docs.select("doc_id").distinct().count()
            assert 0 < ids <= n
            n = ids
        else:
            assert out.groupBy("doc_id").count().count() == n


def rows():
    word = [f"w{k}" for k in range(400)]
    out = [(k, " ".join(word[k : k + 60]), "en", "abc"[k % 3], 9) for k in range(0, 300, 60)]
    out += [(None, "no id " + " ".join(word[300:340]), "en", "a", 9), (None, "no id either " + " ".join(word[340:390]), None, None, None), (7, "one of two texts of an id", "en", "b", 9), (7, "the other one of these texts", "en", "b", 9)]
    return out + [out[0], (999, out[0][1], "en", "c", 9), (500, None, "en", "a", 0), (501, "", "en", "a", 0)]


def test_null_and_repeated_ids_stay(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(pipeline.STAGES)["near_dedup"](spark, docs, DATA)
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    # Brute force: the first row of each text by id, null last; null and empty texts are one.
    first = {}
    for r in sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(r[1] or "", (str(r[0]), str(r[1])))
    assert got == sorted(first.values())


def test_mixing_takes_what_the_operator_says(spark):
    from collections import Counter

    from brindle.llm.mixing import mix

    docs = spark.createDataFrame(rows() * 3, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = dict(pipeline.STAGES)["mixing"](spark, docs, DATA).collect()
    want, got = Counter(), Counter()
    for r in mix(docs).collect():
        want[str(r.source)] += r.taken
    for r in mixed:
        got[str(r.source)] += len((r.text or "").split())
    assert {k: v for k, v in want.items() if v} == dict(got)
    sizes = Counter()
    for r in docs.collect():
        sizes[(r.doc_id, r.text)] += 1
    # No row more than twice.
    assert all(n <= 2 * sizes[k] for k, n in Counter((r.doc_id, r.text) for r in mixed).items())


def test_stages_on_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES[2:]:
        assert stage(spark, docs, DATA).count() == 0, name
