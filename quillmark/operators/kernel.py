"""A kernel machine with a radial kernel, on landmarks.

Landmarks are a bounded sample of the training rows (`landmarks` rows of least keyed hash, a documented parameter). A row's kernel
values to them, whitened by the landmarks' own kernel matrix, are a vector whose dot products are the kernel's best
approximation from those landmarks, and the kernel itself between landmarks. On these vectors a machine with squared hinge loss
is fitted over all rows: its gradient is a sum over rows, so tasks send one vector of the parameters' length each, and
the driver takes quasi-Newton steps. With all rows as landmarks it is the exact machine.

Defined for odd rows: rows without vector or label are no training rows and get a null score; repeated rows count each;
equal landmarks count once, for directions without variance are left out; an empty table is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.linear import minimised
from quillmark.operators.selection import shuffled
from quillmark.plans.staging import drop_staged, staged


def radial(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    apart = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(apart, 0))


@dataclass
class Machine:
    landmarks: np.ndarray
    whiten: np.ndarray
    gamma: float
    weights: np.ndarray
    bias: float

    def vectors(self, x: np.ndarray) -> np.ndarray:
        return radial(x, self.landmarks, self.gamma) @ self.whiten

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.vectors(x) @ self.weights + self.bias


def whitened(landmarks: np.ndarray, gamma: float, least: float = 1e-10) -> np.ndarray:
    values, axes = np.linalg.eigh(radial(landmarks, landmarks, gamma))
    kept = values > least * values.max()
    return axes[:, kept] / np.sqrt(values[kept])


def hinge(z: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of squared hinge losses of rows with y = -1 or 1, and its gradient."""
    short = np.maximum(1 - y * (z @ theta[:-1] + theta[-1]), 0)
    push = -2 * short * y
    return float(short @ short), np.r_[z.T @ push, push.sum()]


def fit_kernel(df: DataFrame, features: str, label: str, key: str, c: float = 1.0, gamma: float | None = None, landmarks: int = 128, seed: int = 7) -> Machine:
    """Minimises |w|^2 / 2 + c x the rows' squared hinge losses; label is 1 for the positive class. gamma: by default 1 over the values' variance and size."""
    own = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(features).cast("array<double>").alias("x"), F.when(F.col(label) == 1, 1.0).otherwise(-1.0).alias("y"))
    picked = np.array([r.x for r in own.orderBy(shuffled("k", seed), "k").limit(landmarks).select("x").collect()])
    if not len(picked):
        raise ValueError("no training rows")
    width = gamma if gamma is not None else 1 / max(picked.shape[1] * picked.var(), 1e-12)
    machine = Machine(picked, whitened(picked, width), width, np.zeros(0), 0.0)
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(list(shared.value.vectors(x)), pa.list_(pa.float64())), batch.column("y")], names=["z", "y"])

    rows = staged(own.select("x", "y").mapInArrow(mapped, "z array<double>, y double"), "kernel-rows")
    size = machine.whiten.shape[1]

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, slope = 0.0, np.zeros(len(theta))
            for batch in batches:
                if batch.num_rows:
                    z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    own_loss, own_slope = hinge(z, batch.column("y").to_numpy(), theta)
                    total, slope = total + own_loss, slope + own_slope
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([slope], pa.list_(pa.float64()))], names=["loss", "slope"])

        parts = rows.mapInArrow(run, "loss double, slope array<double>").collect()
        w = np.r_[theta[:-1], 0.0]
        return 0.5 * w @ w + c * sum(p["loss"] for p in parts), w + c * sum(np.array(p["slope"]) for p in parts)

    theta = minimised(loss, np.zeros(size + 1), steps=60, tolerance=1e-4)
    drop_staged(rows)
    return Machine(picked, machine.whiten, width, theta[:-1], float(theta[-1]))


def kernel_scored(df: DataFrame, machine: Machine, features: str, name: str = "score") -> DataFrame:
    """Adds the machine's score; above zero is the positive class."""
    shared = df.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        there = v.notna()
        out = pd.Series(np.nan, index=v.index, dtype="float64").astype(object)
        out[:] = None
        if there.any():
            out[there] = shared.value.scores(np.stack(v[there].to_numpy()))
        return out

    return df.withColumn(name, run(F.col(features).cast("array<double>")))
