"""Compression classifier for text quality.

Two zstandard dictionaries hold good and bad labelled texts.  A text is compressed once with
each; the difference of the two sizes, divided by their mean, says which kind of text it
resembles.  A logistic curve, fitted on labelled texts that the dictionaries have not seen,
calibrates the difference to a score.  How far a difference can be trusted depends on how
long the text is and on how well it compresses at all, so the curve's slope is linear in the
logarithms of the mean size and of the compression ratio.  Neither counts by itself: texts
without a difference all have the same score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import smallest_hashes


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries, the curve's weights on ``Scorer.features``, and the score without a text."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float
    level: int

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The compressors of a model, made once a worker."""

    def __init__(self, model: QualityModel):
        self.model = model
        load = lambda data: zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if data else None
        given = [load(d) for d in (model.good, model.bad)]
        for d in given:
            if d:
                d.precompute_compress(level=model.level)
        self.tools = [zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in given]

    def features(self, text: str) -> tuple[float, float, float, float]:
        """The difference (positive where the good dictionary saves more), by itself and times log size and log ratio, and 1."""
        data = text.encode()
        good, bad = (len(t.compress(data)) for t in self.tools)
        mean = (good + bad) / 2
        difference = (bad - good) / mean
        return difference, difference * math.log(mean), difference * math.log(mean / len(data)), 1.0

    def score(self, text: str | None) -> float:
        if not text or not any(self.model.weights):
            return self.model.prior
        x = sum(w * f for w, f in zip(self.model.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _fit_curve(design: np.ndarray, y: np.ndarray, good_share: float) -> tuple[float, ...]:
    """Logistic regression by Newton's method, with smoothed targets and a slight ridge.

    The rows are weighted so that good ones have the share of all labelled rows.
    """
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, good_share / n1, (1 - good_share) / n0) * len(y)
    w = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - target)) + 1e-3 * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def train(rows: list[tuple[str, int]], dict_bytes: int = 1 << 20, level: int = 3, good_share: float | None = None) -> QualityModel:
    """Fit a model from (text, label) rows, label 1 for good.

    Every second row of each class feeds its dictionary, the others the calibration.  Where
    a class has no rows, its dictionary is empty; with one class only, or none, every score is
    the smoothed share of good rows.
    """
    own = {c: [t for t, y in rows if y == c and t] for c in (0, 1)}
    good, bad = (_dictionary(own[c][::2], dict_bytes) for c in (1, 0))
    if good_share is None:
        good_share = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    base = QualityModel(good, bad, (0.0,) * 4, good_share, level)
    held = [(t, c) for c, texts in own.items() for t in texts[1::2]]
    if len({c for _, c in held}) < 2:
        return base
    tools = base.scorer()
    weights = _fit_curve(np.array([tools.features(t) for t, _ in held]), np.array([c for _, c in held]), good_share)
    return replace(base, weights=weights)


def _dictionary(texts: list[str], size: int) -> bytes:
    """Dictionary content: whole texts in the order given until ``size`` bytes are full; only the last is cut."""
    out = bytearray()
    for text in texts:
        if len(out) >= size:
            break
        out += text.encode()[: size - len(out)]
    return bytes(out)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 4000,
    max_chars: int = 1 << 16,
    dict_bytes: int = 1 << 21,
    level: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> QualityModel:
    """Train from a bounded sample of the labelled rows.

    The sample is the ``per_class`` rows of each class with the smallest hash of their id,
    so it is the same in every run; texts of more than ``max_chars`` code points are not
    sampled.  These bounds limit what the driver holds.  Every second of these texts goes
    into its class's dictionary, whole and in the order of their hash, until it has
    ``dict_bytes``; the others fit the curve.  Rows with a null id, text or label teach
    nothing, and ids that are labelled both ways teach both.  The share of good rows is
    counted over all labelled rows given.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("__i"), F.col(label_col).cast("int").alias("__y")).distinct()
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    texts = docs.where(F.length(text_col).between(1, max_chars)).select(F.col(id_col).cast("long").alias("__i"), F.col(text_col).alias("__t"))
    chosen: list[tuple[int, int]] = []
    for label in (0, 1):
        own = known.where(F.col("__y") == label).select("__i")
        chosen += [(r["__i"], label) for r in smallest_hashes(own, F.xxhash64("__i"), per_class, counts.get(label, 0))]
    if not chosen:
        return train([], dict_bytes, level)
    wanted = docs.sparkSession.createDataFrame(chosen, "__i long, __y int")  # at most 2 * per_class rows
    rows = texts.join(F.broadcast(wanted), "__i").select("__i", "__t", "__y").collect()
    rows.sort(key=lambda r: (r["__y"], r["__i"] * 2654435761 % 2**32, r["__t"]))
    return train([(r["__t"], r["__y"]) for r in rows], dict_bytes, level, (counts.get(1, 0) + 1) / (sum(counts.values()) + 2))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from the whole text alone.

    A null or empty text scores the share of good rows among the labelled.  Repeated rows each get a
    score, null ids stay null, other columns are ignored, and an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = shared.value.scorer()
        for batch in batches:
            scores = [tools.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns.

    Null and empty texts have the score of texts without evidence, the share of good rows
    among the labelled, and stay or go by it.  Rows are judged one by one, so repeated ones
    share their fate; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([tools.score(t.as_py()) >= threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
