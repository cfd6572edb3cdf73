"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles; a shingle weighs the mean weight of its
words, which falls with the share of all documents that have the word, times its count. 48
consistent weighted samples make 24 bands of 6. Rows that share a band are candidates, and
whole texts decide: a link needs a weighted Jaccard similarity of 0.8. Exact copies are one
node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACES, SPACE_CHARS, map_frames, materialize, ship
from brindle.llm.links import Measure, find_links, shared_members, with_classes

WORDS, THRESHOLD = 5, 0.8
SAMPLES = 48
#: A band is the values of BAND_ROWS samples, drawn by a fixed seed. Of pairs of similarity 0.8
#: 1.3 % share no band, 0.6 % at 0.82, 0.2 % at 0.85 (simulated); at 0.5, 28 % share one.
BANDS, BAND_ROWS = 24, 6
#: Words in fewer than this share of documents weigh most; of those in more, so many of the
#: most frequent ones have weights of their own, which bounds the table that is broadcast.
FREQUENT, MOST_WORDS = 1e-3, 500_000
#: Words of 32 bits of the set of marks by which rows are passed over whose texts aren't needed: 16 MB, broadcast.
MARK_WORDS = 1 << 20

_POOL = 1 << 16
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base of the running hash, and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 14)
            steps = np.ones(n, np.uint64)
            steps[1:] = np.uint64(_BASE)
            self.up = np.multiply.accumulate(steps)
            steps[1:] = np.uint64(_INVERSE)
            self.down = np.multiply.accumulate(steps)


_powers = _Powers()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text in lower case, in order."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    _powers.reach(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers.up[: len(data)], out=total[1:])
    return _mix((total[ends] - total[starts]) * _powers.down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class WordWeights:
    """Weights of the frequent words, by sorted hash; all others weigh 2."""

    hashes: np.ndarray
    weights: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), 2.0)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            hit = self.hashes[at] == words
            out[hit] = self.weights[at[hit]]
        return out


def shingles(words: np.ndarray, weights: WordWeights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles, their weights (times their counts), and their counts.

    A text of fewer than five words is one shingle.
    """
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    n = min(WORDS, len(words))
    count = len(words) - n + 1
    hashes = np.full(count, n, np.uint64)
    mass = np.zeros(count)
    value = weights.of(words)
    for k in range(n):
        hashes = _mix(hashes + words[k : k + count])
        mass += value[k : k + count]
    distinct, inverse, times = np.unique(hashes, return_inverse=True, return_counts=True)
    each = np.zeros(len(distinct))
    each[inverse] = mass / n
    return distinct, each * times, times


_variates: dict[int, tuple] = {}


def _randoms(seed: int = 3) -> tuple:
    """Pools of gamma and uniform variates, and a multiplier per sample."""
    if seed not in _variates:
        rng = np.random.default_rng(seed)
        r = rng.gamma(2.0, 1.0, _POOL).astype(np.float32)
        c = np.log(rng.gamma(2.0, 1.0, _POOL)).astype(np.float32)
        b = rng.random(_POOL, np.float32)
        a = rng.integers(1, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)
        _variates[seed] = (r, c, b, a)
    return _variates[seed]


def signature(hashes: np.ndarray, weights: np.ndarray, block: int = 2048) -> np.ndarray:
    """The consistent weighted samples: per sample, its number (6 bits) and a hash of what it chose (26).

    For a shingle with weight S: t = floor(ln S / r + b), ln y = r (t - b), ln a = ln c - ln y - r,
    with r, c, b drawn for the shingle and the sample; the smallest ln a is chosen, with its t.
    """
    r_pool, c_pool, b_pool, a = _randoms()
    log_w = np.log(weights).astype(np.float32)
    best = np.full(SAMPLES, np.inf, np.float32)
    chosen = np.zeros(SAMPLES, np.uint64)
    column = np.arange(SAMPLES)
    for at in range(0, len(hashes), block):
        h = hashes[at : at + block]
        draws = h[:, None] * a
        one = (draws >> np.uint64(48)).astype(np.intp)
        two = ((draws >> np.uint64(32)) & np.uint64(_POOL - 1)).astype(np.intp)
        r, b = r_pool[one], b_pool[two]
        t = np.floor(log_w[at : at + block, None] / r + b)
        log_a = c_pool[two] - r * (t - b + np.float32(1))
        k = log_a.argmin(0)
        low = log_a[k, column]
        better = low < best
        best = np.where(better, low, best)
        chosen = np.where(better, h[k] + t[k, column].astype(np.int64).astype(np.uint64) * np.uint64(_BASE), chosen)
    return ((_mix(chosen) >> np.uint64(38)).astype(np.int64) | (column << 26)).astype(np.int32)


def elements(hashes: np.ndarray, weights: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multiset of shingles as a sorted set: an element per occurrence, its weight that of the shingle."""
    if not len(hashes) or times.max() == 1:
        return hashes, weights
    level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    out = np.repeat(hashes, times)
    out = np.where(level > 0, _mix(out + level.astype(np.uint64) * np.uint64(_BASE)), out)
    order = np.argsort(out)
    return out[order], np.repeat(weights / times, times)[order]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two results of elements(): shared weight by all weight."""
    if not len(a[0]) or not len(b[0]):
        return 1.0 if len(a[0]) == len(b[0]) else 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = a[1][b[0][at] == a[0]].sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def similarities(one: list[tuple], two: list[tuple], columns: int = 2048) -> np.ndarray:
    """similarity() of all pairs of two lists: products of 0/1 matrices over the elements that more than one has."""
    n, m = len(one), len(two)
    if n * m <= 8:
        return np.array([[similarity(a, b) for b in two] for a in one])
    every = [*one, *two]
    mass = np.array([x[1].sum() for x in every])
    found, weight = (np.concatenate([x[k] for x in every]) for k in (0, 1))
    row = np.repeat(np.arange(n + m), [len(x[0]) for x in every])
    order = np.argsort(found, kind="stable")
    found, weight, row = found[order], weight[order], row[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = found[1:] != found[:-1]
    place = np.cumsum(fresh) - 1
    often = np.bincount(place, minlength=1)[place] > 1 if len(place) else fresh
    weight, row, place = weight[often], row[often], place[often]
    place = np.cumsum(np.r_[True, place[1:] != place[:-1]]) - 1 if len(place) else place
    both = np.zeros((n, m))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        x, y = np.searchsorted(place, [low, low + columns])
        has = np.zeros((n + m, columns))
        has[row[x:y], place[x:y] - low] = np.sqrt(weight[x:y])
        both += has[:n] @ has[n:].T
    total = mass[:n, None] + mass[None, n:] - both
    return np.where(total > 0, both / np.maximum(total, 1e-300), 1.0)


@dataclass
class Texts(Measure):
    """Texts are linked by weighted similarity; ``weights`` is broadcast."""

    weights: object

    def read(self, payload: str) -> tuple[np.ndarray, np.ndarray]:
        return elements(*shingles(word_hashes(payload), self.weights.value))

    def linked(self, one: list, two: list, wanted: np.ndarray | None = None) -> np.ndarray:
        # Sums in another order differ in the last digits.
        return similarities(one, two) >= THRESHOLD - 1e-9


def _digest(text: Column) -> Column:
    """What exact copies share: the words, in lower case."""
    return F.unhex(F.md5(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), F.lit(SPACE_CHARS)))))


def word_weights(docs: DataFrame, text: str = "text") -> WordWeights:
    """Count, over all documents, those that have each word; keep the frequent words' weights."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = rows = 0

        def counted() -> pd.DataFrame:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"word": values.view(np.int64), "n": times.astype(np.int64)})

        for frame in frames:
            for t in frame.iloc[:, 0]:
                held.append(np.unique(word_hashes(t)))
                size += len(held[-1])
                rows += 1
                if size > 2_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()
        # The number of documents goes along, as a word of its own.
        yield pd.DataFrame({"word": [None], "n": [rows]}).astype({"word": "Int64"})

    counts = map_frames(docs.select(text), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where("n > 1 or word is null"), "word-counts")
    total = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.where(F.col("word").isNotNull() & (F.col("n") > max(1.0, FREQUENT * total)))
    found = frequent.orderBy(F.desc("n"), "word").limit(MOST_WORDS).toArrow()
    hashes = found["word"].to_numpy().astype(np.int64).view(np.uint64)
    share = found["n"].to_numpy().astype(np.float64) / max(total, 1)
    order = np.argsort(hashes)
    return WordWeights(hashes[order], (1 + np.clip(np.log(share) / math.log(FREQUENT), 0, 1))[order])


def _signed(docs: DataFrame, weights, text: str, id_column: str) -> DataFrame:
    """_id, _raw (hash of the text as it is), _digest, _bands, _size (words) per row; a text without words has no bands."""
    draw = np.random.default_rng(9)
    bands = np.array([np.sort(draw.choice(SAMPLES, BAND_ROWS, replace=False)) for _ in range(BANDS)])

    def keys(sig: np.ndarray) -> np.ndarray:
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in sig.astype(np.uint64)[bands].T:
            out = _mix(out * np.uint64(_BASE) + column)
        return out.view(np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame.columns = ["_id", "_raw", "_digest", "_text"]
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                found = [word_hashes(t) for t in part["_text"]]
                signed = [keys(signature(*shingles(x, weights.value)[:2])) if len(x) else np.zeros(0, np.int64) for x in found]
                yield pd.DataFrame({"_id": part["_id"], "_raw": part["_raw"], "_digest": part["_digest"], "_bands": signed, "_size": [len(x) for x in found]})

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_raw"), _digest(F.col(text)).alias("_digest"), F.col(text).alias("_text"))
    return map_frames(rows, run, f"_id {kind}, _raw long, _digest binary, _bands array<long>, _size long")


def _texts(docs: DataFrame, wanted: DataFrame, text: str, id_column: str) -> DataFrame:
    """node, _size, _payload (the text) of the rows that wanted (_first, _raw1, node, _size) names.

    A set of marks of fixed size passes over most other rows before texts are shuffled.
    """
    mark = F.xxhash64("_first", "_raw1")
    marks = wanted.groupBy(F.shiftrightunsigned(mark, 5).bitwiseAND(F.lit(MARK_WORDS - 1)).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(xxhash64(_first, _raw1) & 31 AS INT))")).alias("_bits"))
    source = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_raw"), F.col(text).alias("_payload"))
    own = F.xxhash64("_id", "_raw")
    marked = F.expr("shiftrightunsigned(_bits, CAST(xxhash64(_id, _raw) & 31 AS INT)) & 1") == 1
    source = source.join(F.broadcast(materialize(marks, "marks")), (F.shiftrightunsigned(own, 5).bitwiseAND(F.lit(MARK_WORDS - 1)) == F.col("_word")) & marked, "left_semi")
    found = source.join(wanted, (F.col("_raw") == F.col("_raw1")) & F.col("_id").eqNullSafe(F.col("_first")))
    # Equal rows of one id and text are one node's text more than once.
    return found.groupBy("node").agg(F.first("_size").alias("_size"), F.first("_payload").alias("_payload"))


def _classified(docs: DataFrame, text: str, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _digest), and per distinct text: _digest, _first and _raw1 (the row that stands for it), label, class_id, class_size, n_links."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(word_weights(docs, text))
    rows = materialize(_signed(docs, weights, text, id_column), "signed")
    first = F.min(F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("id"), F.col("_raw").alias("raw"))).alias("first")
    nodes = rows.groupBy("_digest").agg(first, F.count(F.lit(1)).alias("rows"), F.first("_bands").alias("_bands"), F.max("_size").alias("_size"))
    # The number of a text is fixed by writing it.
    nodes = nodes.select("_digest", F.col("first.id").alias("_first"), F.col("first.raw").alias("_raw1"), "rows", "_bands", "_size", F.monotonically_increasing_id().alias("node"))
    nodes = materialize(nodes, "nodes")
    members, some = shared_members(nodes.select(F.explode("_bands").alias("k"), "node"))
    links = labels = None
    if some:
        several = members.select(F.col("node").alias("node2")).distinct()
        wanted = materialize(nodes.select("_first", "_raw1", "node", "_size").join(several, F.col("node") == F.col("node2"), "left_semi"), "wanted")
        links, labels = find_links(members, materialize(_texts(docs, wanted, text, id_column), "held"), Texts(weights))
    classes = with_classes(nodes.select("node", F.col("_first").alias("least"), "rows"), links, labels)
    names = nodes.select(F.col("node").alias("node2"), "_digest", "_first", "_raw1")
    return rows.select("_id", "_digest"), materialize(names.join(classes, F.col("node2") == F.col("node")).drop("node2", "node"), "classes")


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row: its id, class_id, class_size and n_links.

    ``class_id`` is the smallest id of the rows that are connected by links, ``class_size``
    their number, ``n_links`` the links from or to the row's text among those that hold its
    class together (0 where only exact copies exist). Null texts count as empty; texts without
    words are copies of each other. Rows with null ids belong to classes too, but don't name
    them; a class of nothing else has a null class_id. Rows are kept as they are, repeated ones too; columns
    beside id and text are not looked at.
    """
    rows, classes = _classified(docs, text, id_column)
    return rows.join(classes.withColumnRenamed("_digest", "d"), F.col("_digest") == F.col("d")).select(F.col("_id").alias(id_column), "class_id", "class_size", "n_links")


def keep_one(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row of each class of near-duplicates, whole: that with the smallest id (null last), ties by the text's digest.

    Of equal rows of one id and text any one stays. Ids need not be unique or present: texts decide.
    """
    _, classes = _classified(docs, text, id_column)
    best = F.min(F.struct(F.col("_first").isNull().alias("x"), F.col("_first").alias("id"), F.col("_digest").alias("digest"), F.col("_raw1").alias("raw"))).alias("m")
    first = classes.groupBy("label").agg(best).select(F.col("m.id").alias("_first"), F.col("m.raw").alias("_raw1"), F.col("m.digest").alias("_of"))
    first = materialize(first.withColumn("_key", F.xxhash64("_first", "_raw1")), "first")
    # Whole rows as one column: their names may be anything. Rows meet by one hash, in whose partitions equal ones are dropped.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    whole = whole.withColumn("_raw", F.xxhash64(F.col("_row")[text])).withColumn("_mark", F.xxhash64(F.col("_row")[id_column], "_raw"))
    found = whole.join(first, (F.col("_mark") == F.col("_key")) & (F.col("_raw") == F.col("_raw1")) & F.col("_row")[id_column].eqNullSafe(F.col("_first")))
    return found.dropDuplicates(["_mark", "_of"]).select("_row.*")
