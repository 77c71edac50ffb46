"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of quality 1; unlabelled are any documents. A linear model on text features
minimises  prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])  with the logistic loss. The class prior
is estimated from a first model that tells positives from unlabelled: the least ratio, over score thresholds, of
the share of unlabelled rows above it to that of held-back positives, each with a confidence bound. Negative
labels are not used.

Features are shares of pairs of adjacent character classes, word and line statistics: never the id, source or
language. A text of any length is read whole; an empty or null text has features of its own (all zero and a flag)
and a score like any other.

Fitting covers every row outside the held-out fold as unlabelled: their features are stored once, and each step of
Newton's method sums slopes and curvatures over all of them on the executors, down a tree. Where the unlabelled
risk less the positives' share is negative it counts as nothing, and the descent ends. Trusted positives are a bounded sample,
the POSITIVES labelled ids that come first in the order of a hash, one row an id. Nulls: a null doc_id is never used
for fitting and is scored; a null quality is no label. If there are no positives, or no other documents, every score
is 0.5, which rejects nothing by itself but is below the threshold of the query. Repeated rows are scored each, and
weigh each as unlabelled rows. An empty table gives no rows. Only doc_id and text are read, whatever other columns are
called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filter_arrow, map_arrow, steps, store, text_or_empty

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Labelled positives that fitting reads at most, steps of Newton's method for each of the two models, weight of the squares.
POSITIVES = 4000
STEPS, DECAY = 10, 1e-2
#: Sums of tasks that are added in one place (about half a megabyte each).
FAN_IN = 32
SCORE = "doc_id long, score double"

# Character classes.
_GROUPS = (" ", "\n\r", "\t\v\f", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,", ";:'\"-", "!?", "|", "#$%&*^~@", "()[]{}<>", "/\\_=+`")
_OTHER, _LEAD, _CONTINUED = len(_GROUPS), len(_GROUPS) + 1, len(_GROUPS) + 2
CLASSES = len(_GROUPS) + 3
N_FEATURES = CLASSES * CLASSES + CLASSES + 8


def _class_table() -> np.ndarray:
    table = np.full(256, _OTHER, np.int64)
    for k, group in enumerate(_GROUPS):
        table[list(group.encode())] = k
    table[0x80:0xC0], table[0xC0:] = _CONTINUED, _LEAD
    return table


_TABLE = _class_table()


def features(texts: list[str]) -> np.ndarray:
    """One row of features a text."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    pairs = CLASSES * CLASSES
    for row, text in zip(out, texts, strict=True):
        data = _TABLE[np.frombuffer(text.encode(), np.uint8)]
        if not len(data):
            row[-1] = 1
            continue
        if len(data) > 1:
            row[:pairs] = np.sqrt(np.bincount(data[:-1] * CLASSES + data[1:], minlength=pairs) / (len(data) - 1))
        row[pairs : pairs + CLASSES] = np.bincount(data, minlength=CLASSES) / len(data)
        words = text.split()
        lines = text.split("\n")
        n = max(1, len(words))
        row[-8:-1] = (
            len(set(words)) / n,
            len(set(lines)) / len(lines),
            np.log1p(len(words)) / 10,
            min(len(text) / n, 50) / 20,
            np.log1p(len(words) / len(lines)) / 10,
            sum(map(str.isupper, words)) / n,
            sum(map(str.istitle, words)) / n,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class QualityModel:
    """Standardisation, weights and bias; `prior` is the estimated share of positives."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(standardised(rows, self.mean, self.scale) @ self.weights + self.bias)


class Unlabelled:
    """The stored features of all unlabelled rows, in two halves, and sums over them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("half", "row")
        self.parts = self.rows.rdd.getNumPartitions()
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def sums(self, make: Callable[[np.ndarray], np.ndarray], half: int | None = None) -> np.ndarray:
        """The sum of make(standardised rows of a slice) over all rows, or over one half."""
        mean, scale = self.mean, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in steps(batches, 4096):
                rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float16).reshape(-1, N_FEATURES)
                total = total + make(standardised(rows.astype(np.float32), mean, scale).astype(np.float32))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["sum"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(np.frombuffer(x, np.float64) for batch in batches for x in batch.column(0).to_pylist())
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

        rows = self.rows if half is None else self.rows.filter(F.col("half") == half)
        found, parts = rows.select("row").mapInArrow(run, "sum binary"), self.parts
        while parts > FAN_IN:
            parts = -(-parts // FAN_IN)
            found = found.repartition(parts).mapInArrow(add, "sum binary")
        found = [np.frombuffer(r[0], np.float64) for r in found.collect()]  # at most FAN_IN rows
        return sum(found) if found else np.zeros(0)

    def standardise(self) -> float:
        """Set mean and scale to those of all rows; return how many there are."""
        total = self.sums(lambda x: np.concatenate([[len(x)], x.sum(axis=0, dtype=np.float64), (x.astype(np.float64) ** 2).sum(axis=0)]))
        if not len(total):
            return 0
        n = total[0]
        self.mean = total[1 : 1 + N_FEATURES] / n
        self.scale = np.sqrt(np.maximum(total[1 + N_FEATURES :] / n - self.mean**2, 0)) + 0.02
        return n


def standardised(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((rows - mean) / scale, -8, 8)


def fit(positive: np.ndarray, unlabelled: Unlabelled, seed: int = 0) -> QualityModel | None:
    if len(positive) < 2 or unlabelled.standardise() < 2:
        return None
    mean, scale = unlabelled.mean, unlabelled.scale
    p = standardised(positive.astype(np.float64), mean, scale)
    order = np.random.default_rng(seed).permutation(len(p))
    back, front = p[order[: max(1, len(p) // 3)]], p[order[len(p) // 3 :]]
    told = _newton(front, unlabelled, None, 0)
    line = lambda x: x @ told[:-1] + told[-1]
    prior = estimate_prior(line(back), lambda tops: unlabelled.sums(lambda x: count_above(line(x), tops), 1))
    weights = _newton(p, unlabelled, prior)
    return QualityModel(mean, scale, weights[:-1], float(weights[-1]), prior)


def estimate_prior(positive: np.ndarray, above: Callable[[np.ndarray], np.ndarray]) -> float:
    """The least bounded ratio of the shares above a threshold: how much of the unlabelled can be positive.
    positive: scores of held-back positives; above(thresholds): how many unlabelled rows there are, and how many at each or above."""
    tops = np.quantile(positive, np.linspace(0.02, 0.9, 45))
    total = above(tops)
    if not len(total):
        return 0.5
    share_p = (positive[None, :] >= tops[:, None]).mean(axis=1)
    share_u = total[1:] / total[0]
    slack = np.sqrt(np.log(20) / 2 / len(positive)) + np.sqrt(np.log(20) / 2 / total[0])
    best = np.argmin((share_u + slack) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def count_above(scores: np.ndarray, tops: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(scores)], len(scores) - np.searchsorted(np.sort(scores), tops, "left")])


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.ones(len(x), x.dtype)]


def _newton(p: np.ndarray, unlabelled: Unlabelled, prior: float | None, half: int | None = None) -> np.ndarray:
    """Weights, the bias last. Without a prior: logistic regression of positive against unlabelled, as heavy.

    With one, prior * (l(f) - l(-f)) over positives is -prior * f for the logistic loss, so the risk is the unlabelled
    rows' loss less a linear term, and its curvature is theirs. The unlabelled rows' loss less the positives' share of it
    counts as nothing where it is negative; the descent ends with the first step that goes there, and halves steps that gain nothing.
    """
    size = N_FEATURES + 1
    p1 = _with_one(p)
    decay = np.r_[np.full(N_FEATURES, DECAY), 0.0]
    w, last, step, best = np.zeros(size), np.zeros(size), np.zeros(size), np.inf
    for _ in range(STEPS):

        def at(x: np.ndarray, w=w.astype(np.float32)) -> np.ndarray:
            x1 = _with_one(x)
            f = x1 @ w
            up = _sigmoid(f).astype(np.float32)
            curve = x1.T @ (x1 * (up * (1 - up))[:, None])
            return np.concatenate([[len(x), np.logaddexp(0, f.astype(np.float64)).sum()], up @ x1, curve.ravel()]).astype(np.float64)

        total = unlabelled.sums(at, half)
        if not len(total):
            break
        loss_u, slope, curve = total[1] / total[0], total[2 : 2 + size] / total[0], total[2 + size :].reshape(size, size) / total[0]
        fp = p1 @ w
        if prior is None:
            loss, rest = 0.5 * (np.logaddexp(0, -fp).mean() + loss_u), 0.0
            up = _sigmoid(-fp)
            slope = 0.5 * (slope - up @ p1 / len(p))
            curve = 0.5 * (curve + p1.T @ (p1 * (up * (1 - up))[:, None]) / len(p))
        else:
            rest = loss_u - prior * np.logaddexp(0, fp).mean()
            loss = prior * np.logaddexp(0, -fp).mean() + max(0.0, rest)
            slope = slope - prior * p1.mean(axis=0)
        loss += (decay * w * w).sum() / 2
        if loss > best + 1e-9:
            step = step / 2
            w = last + step
            continue
        best, last = loss, w
        if rest < 0:
            break
        step = -np.linalg.solve(curve + np.diag(decay + 1e-6), slope + decay * w)
        if np.abs(step).max() < 1e-3:
            break
        w = last + step
    return last


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def _featured(rows: DataFrame, schema: str, kind: type) -> DataFrame:
    """The first columns of rows, and the features of the last, their text, as `row`."""
    keep = len(rows.columns) - 1

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, object]:
            made = features(batch.column(keep).to_pylist()).astype(kind)
            return {name: batch.column(k) for k, name in enumerate(rows_names)} | {"row": [x.tobytes() for x in made]}

        return step

    rows_names = rows.columns[:keep]
    return map_arrow(rows, schema, make)


def fit_quality(docs: DataFrame, labels: DataFrame, scope: str = "op") -> QualityModel | None:
    """A model from the labelled positives and all documents outside the held-out fold."""
    train = F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).filter(train)
    positives = labels.select(F.col("doc_id").cast("long"), "quality").filter(train & (F.col("quality") == 1)).select("doc_id").distinct()
    positives = positives.orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES)
    trusted = docs.join(F.broadcast(positives), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    positive = _featured(trusted, "doc_id long, row binary", np.float32).select("row").collect()  # at most POSITIVES rows
    positive = np.frombuffer(b"".join(bytes(r[0]) for r in positive), np.float32).reshape(-1, N_FEATURES)
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")
    rows = store(_featured(docs.select(half, "text"), "half int, row binary", np.float16), "quality-rows", scope)
    return fit(positive, Unlabelled(rows))


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id and score for every row of docs."""
    state = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = state.value

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            rows = features(batch.column(1).to_pylist())
            return {"doc_id": batch.column(0), "score": own.score(rows) if own else np.full(len(rows), 0.5)}

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty()), SCORE, make)


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold."""
    state = docs.sparkSession.sparkContext.broadcast(model)
    return filter_arrow(docs, "text", lambda: lambda texts: state.value.score(features([t or "" for t in texts])) >= threshold)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
