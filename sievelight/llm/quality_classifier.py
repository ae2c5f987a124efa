"""Quality classifier: naive Bayes support vectors, fitted by dual coordinate descent."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sievelight.functions.shipping import ship
from sievelight.llm.common import WORD

#: Features are hashed to this many places; the model is two vectors of this length, whatever the input.
PLACES = 1 << 18
CACHE_WORDS = 200_000
#: Parts of the sample for the calibration: each part's margins come from a model of the others.
PARTS = 3

_RUNS = re.compile(rb"(?s)(.)\1+")
_SHAPES = bytes.maketrans(
    bytes(range(256)),
    bytes(
        ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c for c in range(256)
    ),
)


def _shape(word: bytes) -> bytes:
    """The word with letters as a or A, digits as 9, and runs of the same cut to one."""
    return _RUNS.sub(rb"\1", word.translate(_SHAPES))


class Features:
    """Places of a text's n-grams: words and word pairs, shapes of words in runs of one to three, repeated lines."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}

    def _codes(self, w: bytes) -> tuple[int, int]:
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[w] = (xxhash.xxh64_intdigest(w.lower(), 1) >> 1, xxhash.xxh64_intdigest(_shape(w), 2) >> 1)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        w = raw.split()
        if not w:
            return np.zeros(0, np.int32)
        codes = np.array([self.known.get(x) or self._codes(x) for x in w], np.uint64)
        word, shape = codes[:, 0].copy(), codes[:, 1].copy()
        same = np.r_[False, word[1:] == word[:-1]]
        shape[same] ^= np.uint64(0x5BD1E995)  # a word that repeats the one before has a shape of its own
        mix = np.uint64(0x9E3779B97F4A7C15)
        grams = [word, shape]
        if len(w) > 1:
            grams += [word[:-1] * mix + word[1:], (shape[:-1] * mix + shape[1:]) ^ np.uint64(1)]
        if len(w) > 2:
            grams.append(((shape[:-2] * mix + shape[1:-1]) * mix + shape[2:]) ^ np.uint64(2))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        if len(set(lines)) < len(lines):
            grams.append(np.array([3], np.uint64))
        h = np.concatenate(grams)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return np.unique((h >> np.uint64(64 - 18)).astype(np.int32))


@dataclass(frozen=True)
class Model:
    """Margin of a text: sum of ``weights`` at its places over the norm of ``ratios`` there, plus ``bias``."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, places: np.ndarray) -> float:
        norm = float(np.sqrt(np.square(self.ratios[places], dtype=np.float64).sum()))
        return self.bias + (float(self.weights[places].sum(dtype=np.float64)) / norm if norm > 0 else 0.0)

    def score(self, places: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(places) + self.shift, -500, 500))))


def _descend(rows: list[np.ndarray], labels: np.ndarray, cost: float, rounds: int, seed: int) -> Model:
    """Log-count ratios of the classes, and the hinge-loss model over the scaled indicators.

    Dual coordinate descent: each step moves one row's multiplier to the best place in [0, its cost] and the weights with
    it.  Costs are in inverse proportion to the classes' rows.  Rows are scaled to unit length; the bias is a feature.
    """
    yes, no = np.ones(PLACES), np.ones(PLACES)
    for row, label in zip(rows, labels):
        (yes if label else no)[row] += 1.0
    ratios = np.log(yes / yes.sum()) - np.log(no / no.sum())
    ratios[(yes == 1.0) & (no == 1.0)] = 0.0  # places that no row has say nothing
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, len(labels) / (2.0 * max(1, (labels == 1).sum())), len(labels) / (2.0 * max(1, (labels == 0).sum())))
    values = []
    for row in rows:
        norm = float(np.sqrt(np.square(ratios[row]).sum()))
        values.append((ratios[row] / norm if norm > 0 else np.zeros(len(row))).astype(np.float32))
    w, bias = np.zeros(PLACES), 0.0
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    square = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost * share[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return Model(ratios.astype(np.float32), (w * ratios).astype(np.float32), bias, 1.0, 0.0)


def _calibrate(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton steps with a small ridge, slope not negative."""
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (p - goal) + 1e-3 * b
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(b[0]), 0.0), float(b[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, *, cost: float = 1.0, rounds: int = 12, seed: int = 3) -> Model:
    """Fit on feature places and labels 0 or 1.  With one class or no rows: a constant score, (ones + 1) / (rows + 2).

    The curve from margins to scores is fitted on margins of rows that the models in use had not seen, in PARTS parts.
    """
    if len(set(labels.tolist())) < 2:
        odds = (float((labels == 1).sum()) + 1) / (len(labels) + 2)
        zero = np.zeros(PLACES, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log(odds / (1 - odds))))
    part = np.random.default_rng(seed).permutation(len(rows)) % PARTS
    margins = np.zeros(len(rows))
    told = np.zeros(len(rows), bool)
    for p in range(PARTS):
        own = part == p
        if len(set(labels[~own].tolist())) == 2:
            first = _descend([r for r, o in zip(rows, own) if not o], labels[~own], cost, rounds, seed)
            margins[own] = [first.margin(r) for r, o in zip(rows, own) if o]
            told |= own
    slope, shift = _calibrate(margins[told], labels[told]) if told.any() else (1.0, 0.0)
    last = _descend(rows, labels, cost, rounds, seed)
    return Model(last.ratios, last.weights, last.bias, slope, shift)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        places = [features(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), pa.array(places, pa.binary())], ["quality", "places"])


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8_000, max_bytes: int = 128 << 20, salt: int = 9) -> Model:
    """Fit on a sample of at most ``max_rows`` labelled rows of ``docs``, whose features take ``max_bytes`` at most.

    The sample's ids are the first ``max_rows`` of ``labels`` (doc_id, quality) by a hash of the id, and its rows the
    first of theirs by a hash of id, text and label, up to the row that would pass a bound.  Equal rows count once, so
    neither repeated ids nor repeated rows make it larger.  Only the sample's features come to the driver.  Null or other
    qualities than 0 and 1 are left out, and so are null ids and ids that ``docs`` lacks.
    """
    ship(docs.sparkSession)
    sample = labels.select("doc_id", "quality").where("quality in (0, 1) and doc_id is not null").distinct()
    sample = sample.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id", "quality").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.select("quality", "text", F.xxhash64(F.lit(salt), "doc_id", "quality", "text").alias("u"))
    # Five features a word and one more at most, each a place of four bytes.
    size = 4 * F.least(F.lit(PLACES), 5 * F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) + 1)
    order = rows.select("u", size.alias("size")).groupBy("u").agg(F.max("size").alias("size")).orderBy("u").limit(max_rows).collect()
    held = np.cumsum([r["size"] for r in order]) <= max_bytes if order else np.zeros(0, bool)
    last = order[int(held.sum()) - 1]["u"] if held.any() else None
    taken = rows.where(F.col("u") <= F.lit(last).cast("long")).groupBy("u").agg(F.first("quality").alias("quality"), F.first("text").alias("text"))
    found = taken.select("quality", "text").mapInArrow(_featurise, "quality int, places binary").collect()
    found.sort(key=lambda r: (r["places"], r["quality"]))  # reruns agree
    return fit_rows([np.frombuffer(r["places"], np.int32) for r in found], np.array([r["quality"] for r in found], np.int64))


def score_quality(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1, the chance of label 1 by the text alone) and predicted (1 from ``threshold`` on).

    One pass, row by row.  Null and empty texts get the score of the bias; equal texts get equal scores, whatever their
    other columns hold.  Columns named score or predicted are replaced; empty input gives empty output.
    """
    ship(docs.sparkSession)
    base = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 2^18 single-precision numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), shared.value
        for batch in batches:
            score = pa.array((m.score(features(t.as_py())) for t in batch.column("text")), pa.float64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    schema = StructType([*base.schema.fields, StructField("score", DoubleType())])
    return base.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold(modulus: int) -> Column:
    """Remainder that deals documents to folds, by their id alone; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op9_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows.  A row with a null id is in no fold, so it is not held out, and no label is its own."""
    model = fit_quality(docs, labels.where(fold(5) != 0))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
