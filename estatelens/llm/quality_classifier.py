"""Quality classifier: ridge regression on random Fourier features of document statistics.

One pass over the texts turns each into a short vector of statistics, which is written. From the labelled
rows of the training folds, each partition sums its part of the normal equations of a ridge regression on
random Fourier features (they approximate a Gaussian kernel); the sums are added up in two levels, so the
driver gets a fixed number of matrices however many partitions there are. Isotonic calibration comes from a
fixed number of score bins, summed over all training rows in the same way, and is interpolated between the
blocks, so that a score is the share of label 1 at that height.

Defined results: null text counts as empty and is scored like any other; labels of null quality and labels
without a document are not learned from; without any training row every score is 0.5; with one class only,
every score is that class; rows that repeat a doc_id in documents are learned once each; an empty documents
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import text_slices, written

#: Fourier features, kernel width in standard deviations of the statistics, ridge, seed, bins of calibration.
FEATURES, WIDTH, RIDGE, SEED, BINS = 256, 4.0, 1e-3, 7, 2048
#: Folds by crc32 of the id; fold 0 is held out.
FOLDS = 5
#: Scores from here on are predicted as label 1.
THRESHOLD = 0.3
#: Partial sums that reach the driver at once, at most.
SUMS = 16

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOPS = np.frombuffer(b".!?", np.uint8)


def statistics(text: bytes) -> list[float]:
    """The statistics of one text; all finite."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = sum(map(len, words))
    kinds, pairs = len(set(words)), len(set(zip(words, words[1:], strict=False)))
    stalls = sum(map(bytes.__eq__, words, words[1:]))
    share = counts[counts > 0] / size
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    return [
        math.log1p(len(words)),
        min(30.0, chars / n),
        math.sqrt(counts[_SYMBOLS].sum() / size),
        counts[_UPPER].sum() / letters,
        math.sqrt(counts[_DIGIT].sum() / size),
        counts[128:].sum() / size,
        math.sqrt(min(1.0, counts[33] / n)),
        math.sqrt(min(1.0, counts[124] / n)),
        min(1.0, counts[_STOPS].sum() / n),
        min(1.0, counts[44] / n),
        math.log1p(len(words) / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        min(6.0, kinds / math.sqrt(n)),
        pairs / max(1, len(words) - 1),
        stalls / n,
        float(-(share * np.log(share)).sum()),
    ]


STATISTICS = 16


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], ["doc_id", "stats"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("stats")).flatten()).reshape(-1, STATISTICS)


def _label(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("quality")).to_numpy(zero_copy_only=False).astype(float)


class Fourier:
    """Standardised statistics to random Fourier features; fixed by its moments and the seed."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.frequencies = rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES))
        self.phases = rng.uniform(0, 2 * math.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        waves = np.cos(z @ self.frequencies + self.phases) * math.sqrt(2 / FEATURES)
        return np.hstack([waves, np.ones((len(z), 1))])


def summed(rows: DataFrame, part) -> np.ndarray | None:
    """The sum over all batches of the arrays part(batch), added per partition, then in SUMS tasks."""

    def blob(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["total"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = part(batch)
                total = x if total is None else total + x
        yield from blob(total)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                x = np.frombuffer(x.as_py(), "<f8")
                total = x if total is None else total + x
        yield from blob(total)

    sums = rows.mapInArrow(first, "total binary").repartition(SUMS).mapInArrow(second, "total binary").collect()
    return sum(np.frombuffer(bytes(r["total"]), "<f8") for r in sums) if sums else None


def pooled(bins: np.ndarray, weights: np.ndarray, positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and heights of the isotonic blocks."""
    blocks: list[list[float]] = []
    for x, w, p in zip(bins, weights, positives, strict=True):
        if w <= 0:
            continue
        blocks.append([x * w, w, p])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


class Model:
    """What is fitted: features, weights, calibration."""

    def __init__(self, fourier: Fourier, weights: np.ndarray) -> None:
        self.fourier, self.weights = fourier, weights
        self.centres, self.heights = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The calibrated score, with a slight slope so that heights within a flat block keep their order."""
        raw = np.clip(self.raw(stats), -0.5, 1.5)
        return np.clip(0.999 * np.interp(raw, self.centres, self.heights) + 0.001 * (raw + 0.5) / 2, 0, 1)


def fit(training: DataFrame) -> Model | None:
    """training: stats and quality (0 or 1)."""
    moments = summed(training, lambda b: np.concatenate([[b.num_rows], (x := _matrix(b)).sum(axis=0), (x * x).sum(axis=0)]))
    if moments is None:
        return None
    n, mean = moments[0], moments[1 : STATISTICS + 1] / moments[0]
    fourier = Fourier(mean, np.sqrt(np.maximum(moments[STATISTICS + 1 :] / n - mean**2, 1e-6)))

    def equations(b: pa.RecordBatch) -> np.ndarray:
        z = fourier(_matrix(b))
        return np.concatenate([(z.T @ z).ravel(), z.T @ _label(b)])

    sums, k = summed(training, equations), FEATURES + 1
    left = sums[: k * k].reshape(k, k) / n + RIDGE / FEATURES * np.diag([1.0] * FEATURES + [0.0])
    model = Model(fourier, np.linalg.solve(left + 1e-10 * np.eye(k), sums[k * k :] / n))

    def binned(b: pa.RecordBatch) -> np.ndarray:
        raw = np.clip(model.raw(_matrix(b)), -0.5, 1.5)
        at = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, _label(b), minlength=BINS)]).astype(float)

    bins = summed(training, binned)
    model.centres, model.heights = pooled((np.arange(BINS) + 0.5) / BINS * 2 - 0.5, bins[:BINS], bins[BINS:])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = written(ids.mapInArrow(_measured, "doc_id long, stats array<double>"), "statistics")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter(F.col("quality").isNotNull() & (fold != 0))
    training = written(stats.join(known, "doc_id").select("stats", "quality"), "training")
    model = fit(training)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b)) if model is not None else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(score)], ["doc_id", "score"])

    out = stats.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
