import zlib

import numpy as np
from brindle.llm import image_copies as m


def picture(seed, side=160):
    return m.drawn(np.random.default_rng(seed).normal(size=64), side)[0]


def png(pixels):
    rows = b"".join(b"\0" + r.tobytes() for r in pixels.astype(np.uint8))

    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    head = pixels.shape[1].to_bytes(4, "big") + pixels.shape[0].to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_finds_crops_and_edits(spark):
    base = picture(1)
    rows = [(k, m.encode_pgm(picture(k))) for k in range(1, 9)]
    noise = np.random.default_rng(0).normal(0, 3, base.shape)
    rows += [(20, m.encode_pgm(base[20:, 15:])), (21, m.encode_pgm(base * 0.8 + 20)), (22, m.encode_pgm(base + noise)), (23, png(base)), (24, m.encode_pgm(base)), (30, None), (31, b""), (32, b"junk"), (33, m.encode_pgm(np.zeros((40, 40)))), (34, b"junk")]
    got = {r.image_id: r for r in m.find_copies(spark.createDataFrame([(*r, 1) for r in rows], "image_id long, image binary, class_size int")).collect()}
    assert {k for k, r in got.items() if r.class_id == 1} == {1, 20, 21, 22, 23, 24}
    assert all(got[k].class_id == k for k in (2, 3, 4, 5, 6, 7, 8, 33)) and got[31].class_id == 30 and got[34].class_id == 32


def test_turned_picture_agrees():
    base = picture(2, 200)
    assert m.agreeing(m.descriptors(base), m.descriptors(np.rot90(base).copy())) >= m.AGREEING
    assert m.agreeing(m.descriptors(base), m.descriptors(picture(3, 200))) < m.AGREEING


def test_decoders_agree():
    base = np.rint(picture(4))
    assert (m.decode(png(base)) == m.decode(m.encode_pgm(base))).all() and m.decode(b"P5 broken") is None


def test_empty_table(spark):
    assert m.find_copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_pairs_at_once_are_those_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    pictures = [picture(k, 96) for k in range(6)]
    pictures += [p + rng.normal(0, sd, p.shape) for p in pictures[:4] for sd in (12, 28, 45)] + [np.zeros((96, 96))]
    found = [m.descriptors(np.clip(np.rint(p), 0, 255)) for p in pictures]
    agree = {(a, b) for b in range(len(found)) for a in range(len(found)) if m.agreeing(found[a], found[b]) >= m.AGREEING}
    data = [f.tobytes() for f in found]
    for part in (3, 64):
        monkeypatch.setattr(m, "SLICE", part)
        met = m.copies(data, data)
        assert {tuple(x) for x in np.argwhere(met)} <= agree
        # Several descriptors with one nearest partner may count once here and twice there.
        assert len(agree) - met.sum() <= 0.05 * len(agree)


def edits(pixels, rng):
    """Crops to a half and a quarter of each side, and edits of the whole."""
    h, w = pixels.shape
    small = m.resized(m._blur(pixels[None], 1)[0], round(h * 0.71), round(w * 0.71))
    return [pixels[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4], pixels[h // 3 : h // 3 + h // 4 + 8, w // 3 : w // 3 + w // 4 + 8], pixels * 0.7 + 20, pixels + rng.normal(0, 8, pixels.shape), pixels + rng.normal(0, 20, pixels.shape), small, np.rot90(pixels).copy(), pixels[:, ::1] * 1.2 - 10]


def test_recall_of_crops_and_edits(spark):
    """Planted crops and edits, and pairs that brute force finds, end in one class; strangers don't."""
    rng = np.random.default_rng(11)
    pictures = [picture(100 + k, 200) for k in range(12)]
    rows, owner = [], []
    for k, p in enumerate(pictures):
        for x in [p, *edits(p, rng)]:
            owner.append(k)
            rows.append(np.clip(np.rint(x), 0, 255))
    for k in range(40):
        owner.append(100 + k)
        rows.append(np.rint(picture(500 + k, 120)))
    table = spark.createDataFrame([(k, m.encode_pgm(x)) for k, x in enumerate(rows)], "image_id long, image binary")
    got = {r.image_id: r.class_id for r in m.find_copies(table).collect()}
    firsts = {k: owner.index(k) for k in set(owner)}
    assert all(got[k] == k for k, own in enumerate(owner) if own >= 100)
    caught = [got[k] == firsts[own] for k, own in enumerate(owner) if own < 100 and k != firsts[own]]
    assert sum(caught) >= 0.9 * len(caught)
    found = [m.descriptors(x) for x in rows]
    mine = range(0, len(rows), 20)
    pairs = [(a, b) for a in mine for b in range(len(rows)) if a != b and m.agreeing(found[a], found[b]) >= m.AGREEING]
    assert pairs and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_common_keys_are_met_in_cells(spark, monkeypatch):
    # Copies of two pictures: their keys are in more images than give pairs.
    rng = np.random.default_rng(3)
    rows = [np.clip(np.rint(picture(own, 96) + rng.normal(0, 6, (96, 96))), 0, 255) for own in (1, 2) for _ in range(24)]
    table = spark.createDataFrame([(k, m.encode_pgm(x)) for k, x in enumerate(rows)], "image_id long, image binary")
    monkeypatch.setattr(m, "FEW", 4)
    monkeypatch.setattr(m, "BLOCK", 7)
    got = {r.image_id: r.class_id for r in m.find_copies(table).collect()}
    assert got == {k: 0 if k < 24 else 24 for k in range(48)}


def test_drawn_pictures():
    v = np.random.default_rng(0).normal(size=(3, 64))
    assert np.allclose(m.drawn(v)[1], m.drawn(v[1])[0], atol=1e-3) and m.drawn(np.zeros((1, 64))).std() == 0
    # Numbers beyond the 64th count too, fewer are filled up.
    assert (m.drawn(np.r_[v[0], 5.0]) != m.drawn(v[0])).any() and m.drawn([1.0, float("nan")]).shape == (1, 64, 64)


def test_shared_keys_are_counted():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(9)]
    for columns in (7, 2048):
        got = m.shared_keys(lists[:4], lists, columns)
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in lists] for a in lists[:4]]


def test_strongest_places():
    r = np.random.default_rng(2).random((2, 20, 17))
    got = m._strongest(r, 5)
    for k, y, x in np.ndindex(r.shape):
        assert got[k, y, x] == (r[k, y, x] >= r[k, max(0, y - 5) : y + 6, max(0, x - 5) : x + 6].max())
