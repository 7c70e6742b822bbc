"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, and a linear hinge-loss model.

The model is fitted on a bounded sample of labelled rows, which is all that reaches the driver; every document is
scored in its own task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

DIMENSIONS = 1 << 18


class Codes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, seed=1)
        return value


CODES, ENDINGS = Codes(), Codes()


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text: words, word endings, pairs of neighbours of either kind.

    Two equal neighbours are one feature whatever the word, and so are longer runs. Null and empty texts have none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    one = np.fromiter(map(CODES.__getitem__, words), np.uint64, n)
    # The last two bytes and the case of the first letter stand for the shape of a word.
    end = np.fromiter(map(ENDINGS.__getitem__, [w[:1].isupper() * b"^" + w[-2:] for w in words]), np.uint64, n)
    step = np.uint64(0x9E3779B97F4A7C15)
    pairs = one[:-1] * step + one[1:]
    equal = one[:-1] == one[1:]
    pairs[equal] = 7
    shapes = end[:-1] * step + end[1:]
    # Runs of 2, 4, 8 ... equal words are n-grams of their own.
    edges = np.flatnonzero(np.diff(np.r_[0, equal, 0]))
    longest = int((edges[1::2] - edges[::2]).max()) + 1 if len(edges) else 1
    runs = np.arange(1, longest.bit_length(), dtype=np.uint64) + np.uint64(100)
    every = np.concatenate([one, end, pairs, shapes, runs])
    every = (every ^ (every >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(every >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64)


@dataclass
class Model:
    """``weights`` act on ratio-scaled indicators of length one; ``slope, offset`` turn margins into scores."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        self.both, self.squares = self.ratios * self.weights, self.ratios**2

    def margin(self, features: np.ndarray) -> float:
        length = np.sqrt(self.squares[features].sum())
        return float(self.both[features].sum() / length if length else 0.0) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -700, 700))))


def log_count_ratios(rows: Sequence[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = [np.full(DIMENSIONS, smoothing), np.full(DIMENSIONS, smoothing)]
    for features, label in zip(rows, labels):
        counts[int(label)][features] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(
    rows: Sequence[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 15
) -> Model:
    """A linear model of the hinge loss by dual coordinate descent, classes weighed to equal shares."""
    signs = np.where(labels == 1, 1.0, -1.0)
    share = {s: cost * len(signs) / (2 * max(1, (signs == s).sum())) for s in (1.0, -1.0)}
    values = [ratios[r] for r in rows]
    values = [v / max(np.sqrt((v * v).sum()), 1e-12) for v in values]
    weights, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    random = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            x, at, y = values[i], rows[i], signs[i]
            slack = y * (float(weights[at] @ x) + bias) - 1
            # The bias is one more feature of value 1.
            new = min(max(alpha[i] - slack / (float(x @ x) + 1), 0.0), share[y])
            if new != alpha[i]:
                change = (new - alpha[i]) * y
                weights[at] += change * x
                bias += change
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return Model(ratios, weights, bias)


def calibrated(model: Model, rows: Sequence[np.ndarray], labels: np.ndarray) -> Model:
    """Slope and offset of the logistic curve that fits the labels best at the margins (Newton steps)."""
    x, y = np.array([model.margin(r) for r in rows]), labels.astype(float)
    if len(set(y)) < 2:
        return model
    # Targets keep off 0 and 1, as in Platt's method.
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    y, beta = np.where(y == 1, up, down), np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -50, 50)))
        gradient = design @ (p - y) + 1e-6 * beta
        hessian = (design * (p * (1 - p) + 1e-9)) @ design.T + 1e-6 * np.eye(2)
        beta = beta - np.linalg.solve(hessian, gradient)
    return Model(model.ratios, model.weights, model.bias, *map(float, beta))


def remainder(doc_id: str = "doc_id"):
    """The fold of a document: the CRC of its id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model:
    """The model of ``labels.quality`` from at most ``sample`` rows whose fold is not 2.

    The rows are those with the smallest hashes of their ids; of an id with several texts each is a row, in the order of
    their features, as far as ``sample`` goes. Fold 1 is for the calibration, the others for the
    weights. Rows without a label or id are left out; an id labelled twice counts with its smallest label. With
    one class or none the score is that class's share for every text (0.5 without labels).
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(remainder() != 2)
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "quality"))  # at most ``sample`` rows
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indicators(t.as_py()).astype(np.int32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "quality", "found"])

    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("quality").cast("int").alias("quality"))
    got = rows.mapInArrow(extract, "doc_id bigint, quality int, found binary").withColumn("fold", remainder())
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "found").limit(sample).collect()
    got.sort(key=lambda r: (r.doc_id, r.found))
    features = [np.frombuffer(r.found, np.int32) for r in got]
    target, fold = np.array([r.quality for r in got], int), np.array([r.fold for r in got], int)
    if len(set(target)) < 2:
        share = float(np.clip(target.mean(), 0.001, 0.999)) if len(target) else 0.5
        return Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0, float(np.log(share / (1 - share))))
    learning = fold != 1
    if len(set(target[learning])) < 2 or len(set(target[~learning])) < 2:
        learning = np.ones(len(fold), bool)
    pick = lambda mask: [f for f, m in zip(features, mask) if m]
    ratios = log_count_ratios(pick(learning), target[learning])
    model = dual_descent(pick(learning), target[learning], ratios)
    check = ~learning if (~learning).any() else learning
    return calibrated(model, pick(check), target[check])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id``, ``text``), whole texts.

    Null and empty texts get the score of a text without features. A null id is scored and not held out. Rows with
    equal ids are scored one by one; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                scores = [fitted.score(indicators(t.as_py())) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
