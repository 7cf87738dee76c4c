"""Quality classifier (operator 3): naive Bayes support vectors.

Features are indicators of the byte n-grams (1 to 3) of the whole text. Each is scaled
by its class log-count ratio; a linear hinge-loss model over the scaled indicators is
fitted by dual coordinate descent; a logistic curve fitted on rows kept apart turns the
margin into a score. The fit takes at most ``PER_CLASS`` labelled rows of either class;
the score covers every row where it lies, without a shuffle.

Defined results: null and empty texts have no feature and get the score of the bias;
with no labelled row of a class the score is the smoothed share of label 1; a null label is no
label; a doc_id labelled twice counts once with each different label; equal texts get
equal scores; every row, repeated or not, is scored; a text of any length is read whole; an empty
table gives no row; extra columns of any name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, text_column
from .labelled import fold, sample

PER_CLASS = 3000
HASHED = 17
SIZE = 256 + 65536 + (1 << HASHED)
_ODD = np.uint32(0x9E3779B1)


def features(data: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sorted distinct feature numbers of one text; flags is a scratch array of SIZE False values."""
    b = data.astype(np.uint32)
    flags[b] = True
    if len(b) > 1:
        pair = b[:-1] << np.uint32(8) | b[1:]
        flags[pair + np.uint32(256)] = True
        if len(b) > 2:
            triple = (pair[:-1] << np.uint32(8) | b[2:]) * _ODD
            flags[(triple >> np.uint32(32 - HASHED)) + np.uint32(256 + 65536)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = float(self.weight[found].sum() + self.bias)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Minimise the hinge-loss support vector problem by dual coordinate descent.

    values[f] is the value of feature f in every row that has it; one more feature of
    value 1 is the bias; cost: the largest dual variable of each row.
    """
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(y))
    own = np.array([values[r] @ values[r] + 1 for r in rows])
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            v = values[rows[i]]
            slope = y[i] * (w[rows[i]] @ v + bias) - 1
            new = min(max(alpha[i] - slope / own[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the score, by Newton steps on the smoothed log loss."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, 0.5 / max(pos, 1), 0.5 / max(neg, 1)) * len(y)
    x, theta = np.column_stack([margin, np.ones(len(y))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (p - target)) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        p = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(SIZE), 0.0, 1.0, float(np.log(p / (1 - p))))
    apart = np.arange(len(y)) % 5 == 0
    used = np.flatnonzero(~apart) if min((y[apart] > 0).sum(), (y[apart] < 0).sum()) and abs(y[~apart].sum()) < (~apart).sum() else np.arange(len(y))
    counts = [np.bincount(np.concatenate([rows[i] for i in used if y[i] == c]), minlength=SIZE) + 1.0 for c in (1, -1)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    ratio[counts[0] + counts[1] < 5] = 0.0  # seen in fewer than three rows: no evidence
    scale = ratio / np.sqrt(np.mean([ratio[rows[i]] @ ratio[rows[i]] for i in used]) + 1e-12)
    balance = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w, bias = dual_descent([rows[i] for i in used], scale, y[used], balance[used])
    weight = w * scale
    calm = np.flatnonzero(apart) if len(used) < len(y) else used
    margin = np.array([weight[rows[i]].sum() + bias for i in calm])
    return Model(weight, bias, *logistic_curve(margin, y[calm]))


def fit_on(docs: DataFrame, labels: DataFrame, label_col: str = "quality", of: int = 3, out: int = 1, per_class: int = PER_CLASS) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(SIZE, bool)
        for batch in batches:
            found = []
            for lo, hi, data, offsets in text_chunks(text_column(batch.column(1))):
                found += [features(data[offsets[k] : offsets[k + 1]], flags).astype("<i4").tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "found"])

    rows = sample(docs, labels, label_col, of, out, per_class).mapInArrow(run, "doc_id long, label int, found binary").toPandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    return fit([np.frombuffer(x, "<i4") for x in rows["found"]], rows["label"].to_numpy())


def score(docs: DataFrame, model: Model, of: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    parts = (model.weight.astype(np.float32), model.bias, model.slope, model.shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, flags = Model(*parts), np.zeros(SIZE, bool)
        for batch in batches:
            scores = []
            for lo, hi, data, offsets in text_chunks(text_column(batch.column(1))):
                scores += [own.score(features(data[offsets[k] : offsets[k + 1]], flags)) for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), of) == out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
