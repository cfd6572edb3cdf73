"""Toxicity: a linear classifier of words that may not depend on which group a text names.

Features are the words of a text and how they begin. A bounded sample of labelled rows
trains a logistic model with two penalties: on the size of its weights, and on the change of
a sentence's score when its identity terms are swapped for other ones of their set. Every
labelled sentence that names a group makes such a pair; besides, each term is paired with the
next of its set and with no term at all in a neutral mention, so that terms that the sample
doesn't have gain no weight from other words that begin alike. That keeps weight off identity
terms, which a sample may tie to toxicity by accident.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_frames, ship

#: Terms by which texts name groups of people, per set of terms that swap.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "arab", "european", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("immigrant", "refugee", "foreigner", "native", "citizen", "migrant"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens", "migrants"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique"),
    ("noir", "blanc", "asiatique", "arabe", "africain", "européen"),
    ("immigré", "réfugié", "étranger", "migrant", "citoyen"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("einwanderer", "flüchtlinge", "ausländer", "migranten", "bürger"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico"),
    ("negro", "blanco", "asiático", "árabe", "africano", "europeo"),
    ("inmigrante", "refugiado", "extranjero", "migrante", "ciudadano"),
)
#: Per term the other ones of its sets; a term of two languages has both sets.
_SWAPS: dict[str, list[str]] = {}
for _group in IDENTITY_TERMS:
    for _term in _group:
        _SWAPS.setdefault(_term, []).extend(x for x in _group if x != _term)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Lengths of the beginnings of words that are features.
PREFIXES = (3, 4, 5)
SAMPLE_ROWS = 12_000
WIDTH = 1 << 18


def word_features(word: str) -> list[int]:
    """The hashed features of a word in lower case: itself and its beginnings."""
    out = [zlib.crc32(f"={word}".encode()) % WIDTH]
    out += [zlib.crc32(f"{n}{word[:n]}".encode()) % WIDTH for n in PREFIXES if len(word) > n]
    return out


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def feature_array(found: set[str]) -> np.ndarray:
    return np.unique(np.array([f for w in found for f in word_features(w)], np.int32))


def packed(features: np.ndarray) -> bytes:
    """Sorted features as bytes, at most WIDTH / 8 of them and one that names the form."""
    if features.nbytes <= WIDTH // 8:
        return b"\0" + features.tobytes()
    bits = np.zeros(WIDTH, np.uint8)
    bits[features] = 1
    return b"\1" + np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, np.int32, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1))).astype(np.int32)


@dataclass
class Model:
    """Weights of the features that matter, by hash, the bias, and how many labelled sentences had counterfactuals."""

    weights: dict[int, float]
    bias: float
    pairs: int = 0

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}

    def word_weight(self, word: str) -> float:
        """The sum of a word's features: itself and its beginnings."""
        known = self._known
        if word not in known:
            if len(known) > 100_000:
                known.clear()
            known[word] = sum(self.weights.get(f, 0.0) for f in set(word_features(word)))
        return known[word]

    def score(self, text: str | None) -> float:
        z = self.bias + sum(map(self.word_weight, words(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


Pair = tuple[np.ndarray, np.ndarray]


def swapped(found: set[str], turn: int) -> set[str] | None:
    """The words with each identity term swapped for another one of its set; None without any."""
    terms = found & _SWAPS.keys()
    if not terms:
        return None
    return (found - terms) | {_SWAPS[t][(turn + k) % len(_SWAPS[t])] for k, t in enumerate(sorted(terms))}


def _difference(one: set[str], two: set[str]) -> Pair:
    """The features that only the first and only the second set of words has."""
    a, b = feature_array(one), feature_array(two)
    return np.setdiff1d(a, b), np.setdiff1d(b, a)


def counterfactuals(text: str | None) -> list[Pair]:
    """For each sentence that names a group: the features that swapping its identity terms takes and gives."""
    out = []
    for sentence in _SENTENCE.findall(text or ""):
        found = words(sentence)
        twin = swapped(found, zlib.crc32(sentence.encode("utf-8", "surrogatepass")))
        if twin is not None:
            out.append(_difference(found, twin))
    return out


def neutral_mentions() -> list[Pair]:
    """Of each identity term: itself against the next of its set, and against no term."""
    out = []
    for group in IDENTITY_TERMS:
        for k, term in enumerate(group):
            out += [_difference({term}, {group[(k + 1) % len(group)]}), _difference({term}, set())]
    return out


def pack_pairs(pairs: list[Pair]) -> bytes:
    return b"".join(np.array([len(a), len(b), *a, *b], np.int32).tobytes() for a, b in pairs)


def unpack_pairs(data: bytes) -> list[Pair]:
    x, at, out = np.frombuffer(data, np.int32), 0, []
    while at < len(x):
        n, m = int(x[at]), int(x[at + 1])
        out.append((x[at + 2 : at + 2 + n], x[at + 2 + n : at + 2 + n + m]))
        at += 2 + n + m
    return out


@dataclass
class Objective:
    """What training makes small, over weights of ``m`` features and a bias.

    The logistic loss of n texts, both labels counting the same, plus ridge / 2n times the
    squared weights, plus the squared changes of score over pairs: of sentences, by
    counterfactual / n each, and of neutral mentions, by counterfactual on their mean.
    """

    texts: tuple[np.ndarray, np.ndarray]  # row, feature
    labels: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]  # pair, feature, 1 or -1
    weight: np.ndarray  # of each pair
    m: int
    ridge: float

    def __call__(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Its value and gradients."""
        (row, col), (pair, of, sign), y, n = self.texts, self.pairs, self.labels, len(self.labels)
        z = np.clip(b + np.bincount(row, w[col], n), -30, 30)
        share = y.mean()
        each = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / n
        error = (1 / (1 + np.exp(-z)) - y) * each
        value = (each * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum() + self.ridge / (2 * n) * (w * w).sum()
        grad = np.bincount(col, error[row], self.m) + self.ridge * w / n
        change = np.bincount(pair, sign * w[of], len(self.weight))
        value += (self.weight * change * change).sum()
        grad += np.bincount(of, sign * (2 * self.weight * change)[pair], self.m)
        return float(value), grad, float(error.sum())


def train(rows: list[np.ndarray], pairs: list[Pair], labels: np.ndarray, least: int = 4, most_features: int = 4_000, ridge: float = 2.0, counterfactual: float = 5.0, rounds: int = 200) -> Model:
    """Fit by gradient steps on hashed features per text, with counterfactual pairs of sentences.

    ``least``: toxic texts that a feature is in at least.
    """
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model({}, 0.0 if not len(y) else (-4.0 if y.max() == 0 else 4.0), len(pairs))
    in_any, in_toxic = np.zeros(WIDTH), np.zeros(WIDTH)
    for r, t in zip(rows, y, strict=True):
        in_any[r] += 1
        if t:
            in_toxic[r] += 1
    share = y.mean()
    # Features more frequent in toxic texts than chance allows, by a z value.
    z = (in_toxic - in_any * share) / np.sqrt(in_any * share * (1 - share) + 1)
    fit = np.flatnonzero((in_toxic >= least) & (in_any < 0.98 * len(y)) & (z > 3))
    chosen = fit[np.lexsort((fit, -z[fit]))][:most_features]
    if not len(chosen):
        return Model({}, float(np.log(share / (1 - share))), len(pairs))
    place = np.full(WIDTH, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def matrix(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        columns = [p[p >= 0] for p in (place[r] for r in found)]
        return np.repeat(np.arange(len(found)), [len(c) for c in columns]), np.concatenate([*columns, np.zeros(0, np.int32)])

    standing = neutral_mentions()
    every = [*pairs, *standing]
    plus, minus = matrix([a for a, _ in every]), matrix([b for _, b in every])
    met = (np.r_[plus[0], minus[0]], np.r_[plus[1], minus[1]], np.r_[np.ones(len(plus[0])), -np.ones(len(minus[0]))])
    weight = counterfactual * np.r_[np.full(len(pairs), 1 / len(y)), np.full(len(standing), 1 / len(standing))]
    objective = Objective(matrix(rows), y, met, weight, len(chosen), ridge)
    w, b, square = np.zeros(len(chosen)), float(np.log(share / (1 - share))), np.zeros(len(chosen) + 1)
    for _ in range(rounds):
        _, grad_w, grad_b = objective(w, b)
        grad = np.append(grad_w, grad_b)
        square += grad * grad
        step = 0.3 * grad / (np.sqrt(square) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Model({f: float(x) for f, x in zip(chosen.tolist(), w, strict=True) if abs(x) > 1e-3}, float(b), len(pairs))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_column: str = "doc_id", sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> Model:
    """Fit on up to ``sample_rows`` labelled rows, those with the smallest hashes of their ids.

    Ids whose labels differ count as toxic; null labels and ids teach nothing, null texts
    have no words. Of rows with equal ids one counts, the first by its features. A text
    reaches the driver as the hashed features of all its distinct words, a bitmap over
    WIDTH where that is smaller, and the differences that swapping makes in its sentences.
    """
    ship(docs.sparkSession)
    marks = labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    marks = marks.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_column).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(marks), F.col("_doc") == F.col("_id")).select("_doc", "_text", "_label")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                own = [packed(feature_array(words(x))) for x in part["_text"]]
                pairs = [pack_pairs(counterfactuals(x)) for x in part["_text"]]
                yield pd.DataFrame({"_doc": part["_doc"].to_numpy(), "_label": part["_label"].to_numpy(), "own": own, "pairs": pairs})

    kind = docs.schema[id_column].dataType.simpleString()
    got = map_frames(rows, run, f"_doc {kind}, _label int, own binary, pairs binary").groupBy("_doc").agg(F.min(F.struct("own", "_label", "pairs")).alias("x")).orderBy("_doc").select("x.own", "x._label", "x.pairs").collect()
    return train([unpacked(r[0]) for r in got], [p for r in got for p in unpack_pairs(r[2])], np.array([r[1] for r in got]))


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and a score (0 to 1) per row; null texts count as empty ones."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    names = list(keep)
    extra = [] if text in names else [text]
    position = (names + extra).index(text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for frame in frames:
            scores = [own.score(t) for t in frame.iloc[:, position]]
            yield frame.iloc[:, : len(names)].assign(score=np.array(scores, np.float64))

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    return map_frames(docs.select(*names, *extra), run, ", ".join([*kinds, "score double"]))
