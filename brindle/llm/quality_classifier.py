"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Texts become weighted counts of hashed byte n-grams and of coarse marks of style. A bounded
sample of labelled rows fits the weights and a truncated singular value decomposition, whose
vectors are broadcast. Every document is projected and compared with all of them, block by
block, by exact cosine; its nearest neighbours vote with their labels, by similarity. Equally
near ones count in the order of the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_frames, ship

HASHED = 1536
#: Marks of style: their number, and the steps that each is divided into.
MARKS, STEPS = 7, 16
WIDTH = HASHED + MARKS * STEPS
#: How much a mark weighs beside the n-grams.
MARK_WEIGHT = 2.0
#: Rows of the sample that fits the model; bytes of text counted at a time.
SAMPLE_ROWS, SLICE = 4_000, 1 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4


def _hash(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(2654435761)) >> np.uint32(12)) % np.uint32(HASHED)


def _grams(data: np.ndarray) -> np.ndarray:
    """Counts of the hashed pairs and triples of bytes."""
    out = np.zeros(HASHED, np.int64)
    for at in range(0, len(data), SLICE):
        # Two bytes more than the slice: grams across its end belong to it.
        x = data[at : at + SLICE + 2].astype(np.uint32)
        if len(x) > 1:
            pair = x[:-1] | x[1:] << 8
            out += np.bincount(_hash(pair[:SLICE] + np.uint32(1 << 25)), minlength=HASHED)
            if len(x) > 2:
                out += np.bincount(_hash((pair[:-1] | x[2:] << 16)[:SLICE]), minlength=HASHED)
    return out


def _style(text: str, data: np.ndarray) -> list[float]:
    """Shares in 0..1: distinct words and lines, upper case, digits, marks, spaces, length."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = np.bincount(_KIND[data], minlength=5)
    n = max(len(data), 1)
    return [len(set(words)) / len(words) if words else 0.0, len(set(lines)) / len(lines) if lines else 0.0, min(1.0, 2 * kinds[2] / n), min(1.0, 4 * kinds[3] / n), min(1.0, 2 * kinds[4] / n), min(1.0, 3 * kinds[1] / n), min(1.0, math.log2(1 + len(words)) / 16)]


def features(texts: list[str | None]) -> np.ndarray:
    """A row of raw weights per text: logarithms of counts, and a bump at each mark's step."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for k, text in enumerate(texts):
        text = text or ""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        counts = _grams(data)
        seen = np.flatnonzero(counts)
        out[k, seen] = np.log1p(counts[seen])
        for m, share in enumerate(_style(text, data)):
            # Shared between the two steps that it lies between, so near shares are near.
            low = share * (STEPS - 1)
            i = min(int(low), STEPS - 2)
            out[k, HASHED + m * STEPS + i] = 1 - (low - i)
            out[k, HASHED + m * STEPS + i + 1] = low - i
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of the k largest; of equal ones at the end, the first."""
    if k == cosine.shape[1]:
        return np.tile(np.arange(k), (len(cosine), 1))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, 1).min(1)
    for row in np.flatnonzero((cosine >= least[:, None]).sum(1) > k):
        near[row] = np.argsort(-cosine[row], kind="stable")[:k]
    return near


@dataclass
class Model:
    """What is broadcast: about WIDTH + SAMPLE_ROWS rows of ``rank`` floats."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def latent(self, raw: np.ndarray) -> np.ndarray:
        x = raw * self.idf
        x[:, :HASHED] = _unit(x[:, :HASHED])
        x[:, HASHED:] *= MARK_WEIGHT / math.sqrt(MARKS)
        return _unit(_unit(x) @ self.axes)

    def score(self, texts: list[str | None], block: int = 64) -> np.ndarray:
        """Shares of the votes for label 1; without labelled rows, 0.5."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out, k = np.empty(len(texts)), min(self.neighbours, len(self.labels))
        for at in range(0, len(texts), block):
            # The last digits of a product depend on where a row lies in its block.
            cosine = np.round(self.latent(features(texts[at : at + block])) @ self.vectors.T, 5)
            near = _nearest(cosine, k)
            # Similar ones count more: the eighth power divides 0.9 from 0.99.
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** 8
            out[at : at + block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_column: str = "doc_id", sample_rows: int = SAMPLE_ROWS, rank: int = 64, neighbours: int = 15, seed: int = 5) -> Model:
    """Fit on up to ``sample_rows`` labelled rows, those with the smallest hashes of their ids.

    Ids whose labels differ count as the lower label; null labels and ids teach nothing. The
    sample's raw weights reach the driver, about 6 kB a row, whatever the texts' lengths.
    """
    ship(docs.sparkSession)
    marks = labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    marks = marks.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_column).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(marks), F.col("_doc") == F.col("_id")).select("_doc", "_text", "_label")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                raw = features(list(part["_text"])).astype(np.float16)
                yield pd.DataFrame({"_doc": part["_doc"].to_numpy(), "_label": part["_label"].to_numpy(), "raw": [x.tobytes() for x in raw]})

    kind = docs.schema[id_column].dataType.simpleString()
    # Rows of one id may repeat in docs; the first by its features stands for them.
    found = map_frames(rows, run, f"_doc {kind}, _label int, raw binary").groupBy("_doc").agg(F.min(F.struct("raw", "_label")).alias("x")).orderBy("_doc").select("x.raw", "x._label").collect()
    if not found:
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours)
    raw = np.stack([np.frombuffer(r[0], np.float16) for r in found]).astype(np.float32)
    y = np.array([r[1] for r in found], np.float64)
    idf = np.ones(WIDTH, np.float32)
    idf[:HASHED] = np.log((1 + len(raw)) / (1 + (raw[:, :HASHED] > 0).sum(0))) + 0.2
    model = Model(idf, np.eye(WIDTH, dtype=np.float32), raw[:0], y, neighbours)
    x = model.latent(raw).astype(np.float64)
    # The singular vectors are the eigenvectors of the small square matrix.
    _, axes = np.linalg.eigh(x.T @ x)
    model.axes = np.ascontiguousarray(axes[:, ::-1][:, :rank]).astype(np.float32)
    model.vectors = model.latent(raw)
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and a score (0 to 1) per row; null texts count as empty ones."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = list(keep)
    extra = [] if text in names else [text]
    position = (names + extra).index(text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = shared.value.score(list(frame.iloc[:, position]))
            yield frame.iloc[:, : len(names)].assign(score=scores)

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    return map_frames(docs.select(*names, *extra), run, ", ".join([*kinds, "score double"]))
