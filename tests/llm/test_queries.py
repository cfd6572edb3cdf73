"""The queries as they are registered: values against SQL where there is some, and their digests otherwise."""

import os
import zlib

import pytest
from brindle.llm import packing, queries
from brindle.llm.common import vocabulary_path

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return db


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_values_match_sql(spark, db, name):
    got = queries.queries()[name](spark, DATA)
    found = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(found.fetchall(), key=key)


def test_packing_query(spark, db):
    rows = queries.queries()["op5_packing"](spark, DATA).collect()
    texts = dict(db.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    encode = packing.encoder(vocabulary_path("word_bpe_49k.json"))
    ids = {k: encode._slow(x) + packing.array("I", [packing.END_ID]).tobytes() for k, x in texts.items()}
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) // 4 and r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
    for k, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[k]) // 4
    assert len(pieces) == len(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at in (512, 1024, 2048, 4096) or at & (at - 1) == 0


@pytest.mark.parametrize(("name", "folds", "out", "column", "least"), [("op6_quality_classifier", 4, 2, "quality", 0.7), ("op10_toxicity", 5, 0, "toxic", 0.5)])
def test_classifier_queries(spark, db, name, folds, out, column, least):
    got = {r.doc_id: r for r in queries.queries()[name](spark, DATA).collect()}
    assert set(got) == {r[0] for r in db.execute("SELECT doc_id FROM documents").fetchall()}
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    labels = dict(db.execute(f"SELECT doc_id, {column} FROM labels").fetchall())
    held = [(got[k].predicted, y) for k, y in labels.items() if k in got and got[k].held_out]
    assert sum(a == y for a, y in held) >= 0.9 * len(held)


def test_mixing_query(spark, db):
    rows = queries.queries()["op9_curriculum_mixing"](spark, DATA).collect()
    sizes = {k: len((x or "").split(" ")) for k, x in db.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert len(rows) == len(sizes)
    places = [r.first_position for r in rows]
    known = [p for p in places if p is not None]
    assert known == sorted(known) and places[len(known) :] == [None] * (len(rows) - len(known))
    taken, target, longest = {}, {}, {}
    for r in rows:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
        target[r.source] = r.target
    assert all(abs(taken[k] - target[k]) <= longest[k] for k in taken)


def test_html_query_is_one_row_a_page(spark, db):
    rows = queries.queries()["op4_html_extraction"](spark, DATA).collect()
    assert sorted(r.page_id for r in rows) == sorted(x[0] for x in db.execute("SELECT page_id FROM pages").fetchall()) and all(r.n_chars == len(r.text) for r in rows)


def test_scratch_tables_go_when_a_query_is_asked_for_again(spark):
    from brindle.llm import common

    run = queries.queries()["op9_curriculum_mixing"]
    run(spark, DATA).count()
    held = list(common._scratch["op9_curriculum_mixing"])
    assert held and all(os.path.isdir(p.removeprefix("file://")) for p in held)
    run(spark, DATA)
    assert not any(os.path.isdir(p.removeprefix("file://")) for p in held)
