"""Cropped and edited copies of images, by local descriptors.

Corners are found at several scales, those that stand out most within a radius, so that their
number grows with the area and a crop finds those of its part again. Each gets the direction
of its patch's centre of mass, and 128 comparisons of brightness at places turned by it.
Hamming tables hold every descriptor under several keys of some of its bits; images that share
two keys are candidates, and geometry decides: they are copies if enough matches of mutually
nearest descriptors follow one shift, turn and scale.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_frames, materialize, ship
from brindle.llm.links import Measure, find_links, shared_members, with_classes

#: Sides of the pyramid's levels, relative to the image; larger images are shrunk to this longest side first.
SCALES, LONGEST = (1.0, 0.71, 0.5, 0.35, 0.25), 1024
#: Corners closer than this at one level: the stronger one stays.
APART = 5
RADIUS, TURNS = 7, 32
#: Bits by which descriptors of one place may differ; matches that have to agree, and within how many pixels.
NEAR_BITS, AGREEING, PIXELS = 20, 6, 3.0
#: Hamming tables, and the bits of a descriptor that make a key. Descriptors that differ in 8 bits
#: share a key of one of the tables with probability 0.57, in 12 bits 0.23, in 16 bits 0.08; copies
#: have tens of matches, and two keys that they share are enough.
TABLES, KEY_BITS, SHARED_KEYS = 8, 32, 2
#: Keys of more images than this are met in cells, where all keys of its images are counted.
FEW = 16
#: Images of a block, and of each side of what is compared at once.
BLOCK, SLICE = 256, 64

_rng = np.random.default_rng(7)
_PAIRS = np.clip(_rng.normal(0, RADIUS / 2, (128, 2, 2)), -RADIUS + 1.5, RADIUS - 1.5)
_angles = np.arange(TURNS) * 2 * np.pi / TURNS
_TURNED = np.rint(np.einsum("tij,pqj->tpqi", np.stack([np.stack([np.cos(_angles), -np.sin(_angles)], -1), np.stack([np.sin(_angles), np.cos(_angles)], -1)], -2), _PAIRS)).astype(np.int32)
_grid = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_grid**2).sum(0) <= RADIUS**2
_BITS = np.array([bin(k).count("1") for k in range(256)], np.uint8)
_TAKEN = np.stack([np.sort(_rng.permutation(128)[:KEY_BITS]) for _ in range(TABLES)])
_KIND = np.dtype([("x", "<f4"), ("y", "<f4"), ("s", "<f4"), ("t", "<f4"), ("d", "u1", 16)])


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM, or of a plain PNG (8 bits, not interlaced); None for anything else."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            fields = data[:64].split(None, 4)
            width, height = int(fields[1]), int(fields[2])
            depth = 3 if data[:2] == b"P6" else 1
            pixels = np.frombuffer(data[-width * height * depth :], np.uint8).reshape(height, width, depth)
            return pixels.mean(2)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _decode_png(data)
    except (ValueError, IndexError, zlib.error):
        return None
    return None


def _decode_png(data: bytes) -> np.ndarray | None:
    at, packed, head = 8, [], b""
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    width, height, bits, colour, interlaced = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    depth = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth is None or bits != 8 or interlaced:
        return None
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * depth)
    out = np.zeros((height, width * depth), np.uint8)
    above = np.zeros(width * depth, np.uint8)
    for y in range(height):
        kind, row = raw[y, 0], raw[y, 1:]
        if kind in (0, 2):
            above = row + above if kind == 2 else row
        else:
            line = bytearray(row.tobytes())
            for x in range(len(line)):
                a, b, c = (line[x - depth] if x >= depth else 0), int(above[x]), (int(above[x - depth]) if x >= depth else 0)
                if kind == 4:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                else:
                    guess = a if kind == 1 else (a + b) // 2
                line[x] = (line[x] + guess) & 255
            above = np.frombuffer(bytes(line), np.uint8)
        out[y] = above
    pixels = out.reshape(height, width, depth).astype(float)
    return pixels[:, :, : min(depth, 3) if depth > 2 else 1].mean(2)


def encode_pgm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, over the last two axes."""
    rows, columns = pixels.shape[-2:]
    y = np.clip((np.arange(height) + 0.5) * rows / height - 0.5, 0, rows - 1)
    x = np.clip((np.arange(width) + 0.5) * columns / width - 0.5, 0, columns - 1)
    y0, x0 = np.minimum(y.astype(int), max(rows - 2, 0)), np.minimum(x.astype(int), max(columns - 2, 0))
    fy, fx = (y - y0).astype(np.float32)[:, None], (x - x0).astype(np.float32)
    y1, x1 = np.minimum(y0 + 1, rows - 1), np.minimum(x0 + 1, columns - 1)
    at = pixels[..., y0, :] * (1 - fy) + pixels[..., y1, :] * fy
    return at[..., x0] * (1 - fx) + at[..., x1] * fx


def _along(x: np.ndarray, axis: int, low: int, high: int | None) -> np.ndarray:
    return x[:, low:high] if axis == 1 else x[:, :, low:high]


def _blur(x: np.ndarray, r: int = 2) -> np.ndarray:
    """Mean over a square, of each of a stack of images, by running sums."""
    n = 2 * r + 1
    for axis in (1, 2):
        edge = [(0, 0)] * 3
        edge[axis] = (r + 1, r)
        sums = np.cumsum(np.pad(x, edge, mode="edge"), axis, dtype=np.float64)
        x = ((_along(sums, axis, n, None) - _along(sums, axis, 0, -n)) / n).astype(np.float32)
    return x


def _strongest(r: np.ndarray, apart: int) -> np.ndarray:
    """Where a value is the largest of the square of ``apart`` places around it: maxima over 2, 4, 8 .. places, the last two overlapping."""
    width, top = 2 * apart + 1, r
    for axis in (1, 2):
        edge = [(0, 0)] * 3
        edge[axis] = (apart, apart)
        top = np.pad(top, edge, constant_values=-np.inf)
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            top = np.maximum(_along(top, axis, 0, -step), _along(top, axis, step, None))
            reach += step
    return r >= top


def _level(images: np.ndarray, ratio: float) -> list[np.ndarray]:
    """The corners of each of a stack of images of one size, at one level."""
    smooth = _blur(images, 1)
    gy, gx = np.gradient(smooth, axis=(1, 2))
    xx, yy, xy = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inside = (slice(None), slice(RADIUS + 1, -RADIUS - 1), slice(RADIUS + 1, -RADIUS - 1))
    top = np.zeros(r.shape, bool)
    top[inside] = (_strongest(r, APART) & (r > 1.0))[inside]
    k, ys, xs = np.nonzero(top)
    out = np.zeros(len(k), _KIND)
    for at in range(0, len(k), 20_000):
        part = slice(at, at + 20_000)
        i, y, x = k[part], ys[part], xs[part]
        patches = images[i[:, None, None], y[:, None, None] + _grid[0], x[:, None, None] + _grid[1]] * _DISC
        angle = np.arctan2((patches * _grid[0]).sum((1, 2)), (patches * _grid[1]).sum((1, 2)))
        places = _TURNED[np.rint(angle / (2 * np.pi / TURNS)).astype(int) % TURNS]
        values = smooth[i[:, None, None], y[:, None, None] + places[..., 1], x[:, None, None] + places[..., 0]]
        rows = out[part]
        rows["x"], rows["y"], rows["s"], rows["t"] = (x + 0.5) / ratio, (y + 0.5) / ratio, 1 / ratio, angle
        rows["d"] = np.packbits(values[..., 0] < values[..., 1], axis=1)
    return np.split(out, np.searchsorted(k, np.arange(1, len(images))))


def descriptors_of(images: list[np.ndarray | None]) -> list[np.ndarray]:
    """Per image its corners as rows of x, y, scale, angle (float32) and 16 bytes of bits; images of one size go together."""
    out = [np.zeros(0, _KIND)] * len(images)
    sizes: dict[tuple, list[int]] = {}
    for k, x in enumerate(images):
        if x is not None and min(x.shape) >= 2 * RADIUS + 4:
            sizes.setdefault(x.shape, []).append(k)
    for shape, every in sizes.items():
        step = max(1, (1 << 18) // (shape[0] * shape[1]))
        for at in range(0, len(every), step):
            chosen = every[at : at + step]
            stack = np.stack([images[k] for k in chosen]).astype(np.float32)
            shrink = min(1.0, LONGEST / max(shape))
            found: list[list[np.ndarray]] = [[] for _ in chosen]
            for scale in SCALES:
                ratio = scale * shrink
                height, width = (max(1, round(n * ratio)) for n in shape)
                if min(height, width) < 2 * RADIUS + 4:
                    continue
                level = stack if ratio == 1 else resized(_blur(stack, max(1, round(0.5 / ratio))), height, width)
                for own, rows in zip(found, _level(level, ratio), strict=True):
                    own.append(rows)
            for k, own in zip(chosen, found, strict=True):
                out[k] = np.concatenate(own)
    return out


def descriptors(pixels: np.ndarray | None) -> np.ndarray:
    """descriptors_of() of one image."""
    return descriptors_of([pixels])[0]


def keys_of(found: np.ndarray) -> np.ndarray:
    """The keys of an image's descriptors in the Hamming tables."""
    if not len(found):
        return np.zeros(0, np.int64)
    bits = np.unpackbits(found["d"], axis=1).astype(np.int64)
    keys = [(bits[:, taken] << np.arange(KEY_BITS)).sum(1) | table << KEY_BITS for table, taken in enumerate(_TAKEN)]
    return np.unique(np.concatenate(keys))


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Most matches of descriptors that one shift, turn and scale explains; 0 for fewer than AGREEING."""
    if len(a) < AGREEING or len(b) < AGREEING:
        return 0
    apart = _BITS[a["d"][:, None] ^ b["d"][None]].sum(2, dtype=int)
    to = apart.argmin(1)
    own = np.arange(len(a))
    good = (apart[own, to] <= NEAR_BITS) & (apart.argmin(0)[to] == own)
    a, b = a[good], b[to[good]]
    if len(a) < AGREEING:
        return 0
    turn, scale = b["t"] - a["t"], b["s"] / a["s"]
    pa, pb = a["x"] + 1j * a["y"], b["x"] + 1j * b["y"]
    # Every match proposes a motion; the others are counted that it takes near their partners.
    motion = scale * np.exp(1j * turn)
    reached = pb[:, None] + motion[:, None] * (pa[None] - pa[:, None])
    close = np.abs(reached - pb[None]) <= PIXELS * np.maximum(scale, 1)[:, None] + 0.08 * np.abs(pa[None] - pa[:, None])
    same = (np.abs(np.log(scale[None] / scale[:, None])) < 0.5) & (np.abs(np.angle(np.exp(1j * (turn[None] - turn[:, None])))) < 0.5)
    # Matches at one place count once.
    best = close & same
    places = [len({(round(z.real), round(z.imag)) for z in pa[row]}) for row in best[best.sum(1) >= AGREEING]]
    most = max(places, default=0)
    return most if most >= AGREEING else 0


def copies(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Which pairs of images agree in AGREEING matches; those with fewer mutual nearest descriptors are ruled out at once."""
    one, two = ([np.frombuffer(x, _KIND) for x in side] for side in (a, b))
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), SLICE):
        for start in range(0, len(b), SLICE):
            left, right = one[at : at + SLICE], two[start : start + SLICE]
            if not any(map(len, left)) or not any(map(len, right)):
                continue
            x, y = (2.0 * np.unpackbits(np.concatenate(side)["d"], axis=1).astype(np.float32) - 1 for side in (left, right))
            like = x @ y.T
            of, to = (np.repeat(np.arange(len(side)), list(map(len, side))) for side in (left, right))
            # Per descriptor the nearest one of each image of the other side.
            first = [np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) for own in (of, to)]
            best_right = np.maximum.reduceat(like, first[1], axis=1)
            best_left = np.maximum.reduceat(like, first[0], axis=0)
            i, j = np.nonzero(like >= 128 - 2 * NEAR_BITS)
            rank = [np.searchsorted(f, np.arange(len(own)), side="right") - 1 for f, own in zip(first, (of, to), strict=True)]
            near = like[i, j]
            mutual = (near == best_right[i, rank[1][j]]) & (near == best_left[rank[0][i], j])
            i, j = i[mutual], j[mutual]
            # Descriptors of the first image that have a mutual nearest one in the second, counted once each.
            met = np.unique(np.stack([i, to[j]]), axis=1)
            count = np.zeros((len(left), len(right)), np.int32)
            np.add.at(count, (of[met[0]], met[1]), 1)
            for p, q in zip(*np.nonzero(count >= AGREEING), strict=True):
                out[at + p, start + q] = agreeing(left[p], right[q]) >= AGREEING
    return out


def shared_keys(one: list[np.ndarray], two: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many keys each two of two lists of keys_of() have in common: products of 0/1 matrices over the keys that both sides have."""
    n, every = len(one), [*one, *two]
    found = np.concatenate(every)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, place, times = np.unique(found, return_inverse=True, return_counts=True)
    often = times[place] > 1
    _, place = np.unique(place[often], return_inverse=True)
    row = row[often]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((n, len(two)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        x, y = np.searchsorted(place, [low, low + columns])
        has = np.zeros((len(every), columns), np.float32)
        has[row[x:y], place[x:y] - low] = 1
        out += has[:n] @ has[n:].T
    return out.astype(int)


@dataclass
class Images(Measure):
    """Images are linked by geometric agreement; of many at once, those pairs are looked at that share SHARED_KEYS keys."""

    def read(self, payload: bytes) -> np.ndarray:
        return np.frombuffer(bytes(payload), _KIND)

    def linked(self, one: list, two: list, wanted: np.ndarray | None = None) -> np.ndarray:
        if wanted is None:
            return copies([x.tobytes() for x in one], [x.tobytes() for x in two])
        out = np.zeros((len(one), len(two)), bool)
        keys = [[keys_of(x) for x in side] for side in (one, two)]
        for i, j in zip(*np.nonzero((shared_keys(*keys) >= SHARED_KEYS) & wanted), strict=True):
            out[i, j] = agreeing(one[i], two[j]) >= AGREEING
        return out


def _described(images: DataFrame, id_column: str, image: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame.columns = ["_id", "_digest", "_image"]
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                found = descriptors_of([decode(x) for x in part["_image"]])
                yield pd.DataFrame({"_id": part["_id"], "_digest": part["_digest"], "_payload": [d.tobytes() for d in found], "_keys": [keys_of(d) for d in found]})

    kind = images.schema[id_column].dataType.simpleString()
    data = F.coalesce(F.col(image), F.lit(b""))
    rows = images.select(F.col(id_column).alias("_id"), F.unhex(F.md5(data)).alias("_digest"), data.alias("_image"))
    return map_frames(rows, run, f"_id {kind}, _digest binary, _payload binary, _keys array<long>")


def find_copies(images: DataFrame, id_column: str = "image_id", image: str = "image") -> DataFrame:
    """Per row: its id, class_id (smallest id of its copies), class_size, n_links, n_corners.

    Equal bytes are copies from the start. Null, empty and unreadable images, and those without
    corners, have only such copies. ``n_links``: links from or to the row's image among those
    that hold its class together. ``image``: bytes, see decode(). Rows are kept as they are;
    null ids belong to classes but don't name them; other columns aren't looked at.
    """
    ship(images.sparkSession)
    rows = materialize(_described(images, id_column, image), "described")
    nodes = rows.groupBy("_digest").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("rows"), F.first("_payload").alias("_payload"), F.first("_keys").alias("_keys"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members, some = shared_members(nodes.select(F.explode("_keys").alias("k"), "node"))
    links = labels = None
    if some:
        corners = (F.octet_length("_payload") / _KIND.itemsize).cast("long")
        # A block's images have some thousand descriptors.
        links, labels = find_links(members, nodes.select("node", corners.alias("_size"), "_payload"), Images(), rows=BLOCK, size=BLOCK * 64, few=FEW, shared=SHARED_KEYS)
    classes = with_classes(nodes.select("node", "least", "rows"), links, labels)
    names = nodes.select(F.col("node").alias("node2"), F.col("_digest").alias("d"), (F.octet_length("_payload") / _KIND.itemsize).cast("int").alias("n_corners"))
    out = materialize(names.join(classes, F.col("node2") == F.col("node")).drop("node2", "node", "label"), "classes")
    return rows.select("_id", "_digest").join(out, F.col("_digest") == F.col("d")).select(F.col("_id").alias(id_column), "class_id", "class_size", "n_links", "n_corners")


def _waves(side: int, waves: int = 12) -> np.ndarray:
    """64 textures: sums of waves of random directions, lengths and phases."""
    draw = np.random.default_rng(23)
    y, x = np.mgrid[0:side, 0:side].astype(np.float32)
    out = np.zeros((64, side, side), np.float32)
    for own in out:
        for _ in range(waves):
            angle, length, phase = draw.uniform(0, np.pi), draw.uniform(3, 12), draw.uniform(0, 2 * np.pi)
            own += np.cos((x * np.cos(angle) + y * np.sin(angle)) * (2 * np.pi / length) + phase, dtype=np.float32)
    return out.reshape(64, side * side) / np.float32(np.sqrt(waves / 2))


_textures: dict[int, np.ndarray] = {}


def drawn(vectors: np.ndarray, side: int = 64) -> np.ndarray:
    """Pictures of vectors: textures mixed by their numbers, grey values in 0..255; every further 64 numbers turn the signs."""
    if side not in _textures:
        _textures[side] = _waves(side)
    v = np.nan_to_num(np.atleast_2d(np.asarray(vectors, np.float32)))
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % 64))).reshape(len(v), -1, 64)
    v = (v * np.where(np.arange(v.shape[1])[:, None] % 2, -1, 1)).sum(1)
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
    return np.clip(128 + 48 * (v @ _textures[side]), 0, 255).reshape(len(v), side, side)


def render_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, image: a picture per vector, equal for equal ones and alike for near ones; null vectors have none.

    The data have no table of images; this makes one of the same number of rows.
    """
    ship(vectors.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                yield pd.DataFrame({id_column: part.iloc[:, 0], "image": [None if v is None else encode_pgm(drawn(v)[0]) for v in part.iloc[:, 1]]})

    kind = vectors.schema[id_column].dataType.simpleString()
    return map_frames(vectors.select(id_column, vector), run, f"`{id_column}` {kind}, image binary")
