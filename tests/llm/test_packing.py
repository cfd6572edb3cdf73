import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
from brindle.llm.packing import END_ID, Encoder, Packer, pack
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's we'll don't !!'s I'd 've", "áb Σας ΟΔΟΣ", "x\x1cy z\x85w", "<|endoftext|> hi", "", "a\tb\n\nc　d", "naïve İstanbul ﬁ", "é café", "日本語 текст", "'ll'", "A" * 300 + " b" * 300, "½ ² 12345", "​x﻿"]


def test_ids_are_the_tokenizer_s():
    ours, theirs = Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ODD + ODD:
        assert ours.encode(text) == array("I", theirs.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_packer_loses_nothing():
    rng = random.Random(1)
    packer, lengths = Packer((4, 8, 16)), {}
    for k in range(500):
        lengths[k] = rng.choice([1, 2, 3, 5, 9, 15, 16, 17, 40, rng.randint(1, 100)])
        packer.add(k, lengths[k])
        if k % 37 == 0:
            packer.pack()
            packer.bound(10)
    packer.close()
    seen = defaultdict(list)
    for size, window in packer.done:
        assert sum(p[2] for p in window) == size and size & (size - 1) == 0 and size <= 16
        for doc, start, length in window:
            seen[doc].append((start, length))
    for k, total in lengths.items():
        at = 0
        for start, length in sorted(seen[k]):
            assert start == at and length > 0
            at += length
        assert at == total


def test_pieces_cover_documents(spark):
    texts = ODD + [None, "word " * 9000, "same", "same"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "x", 1), (0, ODD[0], 1)], "doc_id long, text string, length int").coalesce(1)
    theirs = Tokenizer.from_file(PATH)
    rows = pack(docs).collect()
    by_sequence, whole = defaultdict(list), defaultdict(int)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        whole[r.doc_id] += r.length
        text = "x" if r.doc_id is None else texts[r.doc_id] or ""
        ids = theirs.encode(text, add_special_tokens=False).ids + [END_ID]
        assert r.doc_tokens == len(ids) and zlib.crc32(array("I", ids[r.start : r.start + r.length])) == zlib.crc32(bytes(r.token_ids))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].tier <= 4096
    assert whole[13] == 1 and len(whole) == len(texts) + 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_ids_with_nulls_stay(spark):
    from brindle.llm import near_dedup, quality_classifier

    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "a b c"), (None, "d e f"), (None, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in pack(docs).collect()} == {big, None}
    assert {r.doc_id for r in near_dedup.near_duplicates(docs).collect()} == {big, None}
    model = quality_classifier.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.doc_id for r in quality_classifier.score_documents(docs, model).collect()} == {big, None}
