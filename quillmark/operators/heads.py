"""Training of the residual head: a linear head plus one with a hidden layer, by gradients that tasks sum.

Rows are staged once, dealt into buckets by a hash of their key and sorted inside them. A step is one job: every task
runs its rows of the step's mini-batch through the network and back, and gives one gradient for each bucket that it
holds. The driver adds them in the order of buckets and keys, so the sums, and with them the whole loss curve, are the
same however tasks are placed or run again. What comes to the driver in a step is buckets x parameters.

A mini-batch is the rows whose hash of seed, epoch and key falls to it: no shuffle between epochs.

Defined for odd rows: rows without vector or label are no training rows; ties and repeated rows count each; an empty table is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.plans.staging import drop_staged, staged

BUCKETS = 16
NAMES = ("skip.weight", "skip.bias", "hidden.weight", "hidden.bias", "output.weight", "output.bias")


def started(size: int, hidden: int, classes: int, seed: int) -> dict[str, np.ndarray]:
    """Parameters before the first step: the hidden layer random, all else zero, so that the head begins as no head."""
    random = np.random.default_rng(seed)
    shapes = {"skip.weight": (classes, size), "skip.bias": classes, "hidden.weight": (hidden, size), "hidden.bias": hidden, "output.weight": (classes, hidden), "output.bias": classes}
    return {k: random.uniform(-1, 1, s) / np.sqrt(size) if k.startswith("hidden") else np.zeros(s) for k, s in shapes.items()}


def forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities, and what the hidden layer gave."""
    units = np.maximum(x @ p["hidden.weight"].T + p["hidden.bias"], 0)
    scores = x @ p["skip.weight"].T + p["skip.bias"] + units @ p["output.weight"].T + p["output.bias"]
    odds = np.exp(scores - scores.max(1, keepdims=True))
    return odds / odds.sum(1, keepdims=True), units


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted cross entropy, summed over rows, and its gradient."""
    found, units = forward(p, x)
    rows = np.arange(len(y))
    loss = float(-(w * np.log(np.maximum(found[rows, y], 1e-300))).sum())
    error = found.copy()
    error[rows, y] -= 1
    error *= w[:, None]
    back = (error @ p["output.weight"]) * (units > 0)
    return loss, {"skip.weight": error.T @ x, "skip.bias": error.sum(0), "hidden.weight": back.T @ x, "hidden.bias": back.sum(0), "output.weight": error.T @ units, "output.bias": error.sum(0)}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES])


def shaped(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([like[k].size for k in NAMES])[:-1]
    return {k: x.reshape(like[k].shape) for k, x in zip(NAMES, np.split(v, cuts), strict=True)}


def _summed(rows: DataFrame, p: dict[str, np.ndarray]) -> tuple[float, float, np.ndarray]:
    """Loss, weight and gradient of `rows` (bucket, key, x, y, w), added up in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bucket, y, w = (batch.column(c).to_numpy() for c in ("bucket", "y", "w"))
            heads = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
            out = []
            for a, b in zip(heads, [*heads[1:], len(bucket)], strict=True):
                loss, g = gradient(p, x[a:b], y[a:b], w[a:b])
                out.append((int(bucket[a]), batch.column("key")[int(a)].as_py(), loss, float(w[a:b].sum()), flat(g)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2]), pa.array(columns[3]), pa.array(columns[4], pa.list_(pa.float64()))], names=["bucket", "key", "loss", "weight", "gradient"])

    parts = rows.mapInArrow(run, "bucket long, key string, loss double, weight double, gradient array<double>").collect()
    parts.sort(key=lambda r: (r.bucket, r.key))
    return sum(r.loss for r in parts), sum(r.weight for r in parts), sum((np.array(r.gradient) for r in parts), np.zeros(flat(p).size))


def train_head(df: DataFrame, features: str, label: str, key: str, classes: int, hidden: int = 16, epochs: int = 8, batches: int = 2, rate: float = 0.5, momentum: float = 0.9, decay: float = 1e-4, weight: str | None = None, seed: int = 7) -> tuple[dict[str, np.ndarray], list[float]]:
    """(parameters for `models.residual_head`, mean loss of each epoch) by steps with momentum and weight decay."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(BUCKETS))
    own = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(bucket.alias("bucket"), F.col(key).cast("string").alias("key"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("long").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    rows = staged(own.repartition("bucket").sortWithinPartitions("bucket", "key", "y"), "head-rows")
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no training rows")
    p, curve = started(first[0], hidden, classes, seed), []
    speed = np.zeros(flat(p).size)
    for epoch in range(epochs):
        total = weights = 0.0
        for k in range(batches):
            batch = rows.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "key"), F.lit(batches)) == k) if batches > 1 else rows
            loss, n, g = _summed(batch, p)
            if n:
                at = flat(p)
                speed = momentum * speed - rate * (g / n + decay * at)
                p = shaped(at + speed, p)
            total, weights = total + loss, weights + n
        curve.append(total / weights)
    drop_staged(rows)
    return p, curve
