"""The residual head: its gradient, its training, its expression; and the projection that a classifier doesn't see."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import models
from quillmark.operators import heads, linear


def made(spark, n=400, size=5):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, size))
    y = (np.abs(x[:, 0]) > 0.7).astype(int) + (x[:, 1] > 1)
    return spark.createDataFrame([(k, [float(v) for v in x[k]], int(y[k])) for k in range(n)], "id long, x array<double>, y int"), x, y


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(9, 4)), rng.integers(0, 3, 9), rng.uniform(0.5, 2, 9)
    p = {k: rng.normal(size=v.shape) for k, v in heads.started(4, 6, 3, 0).items()}
    at, g = heads.flat(p), heads.flat(heads.gradient(p, x, y, w)[1])
    for k in range(len(at)):
        step = np.zeros(len(at))
        step[k] = 1e-6
        gap = (heads.gradient(heads.shaped(at + step, p), x, y, w)[0] - heads.gradient(heads.shaped(at - step, p), x, y, w)[0]) / 2e-6
        assert abs(gap - g[k]) < 1e-5 * max(1, abs(g[k]))


def test_training_is_repeatable_and_learns_what_no_linear_head_can(spark):
    df, x, y = made(spark)
    p, curve = heads.train_head(df, "x", "y", "id", 3, hidden=12, epochs=12, batches=2)
    again, other = heads.train_head(df.repartition(7), "x", "y", "id", 3, hidden=12, epochs=12, batches=2)
    assert curve == other and all((p[k] == again[k]).all() for k in p)
    assert curve[-1] < curve[0] / 2
    right = lambda p: (heads.forward(p, x)[0].argmax(1) == y).mean()
    linear_head, _ = heads.train_head(df, "x", "y", "id", 3, hidden=0, epochs=12, batches=2)
    assert right(p) > right(linear_head) + 0.15
    got = np.array([r.p for r in df.select("id", models.residual_head(p)("x").alias("p")).orderBy("id").collect()])
    assert np.allclose(got, heads.forward(p, x)[0], atol=1e-12)


def test_training_rows(spark):
    df, _, _ = made(spark, 20)
    odd = df.unionByName(spark.createDataFrame([(100, None, 1), (101, [0.0] * 5, None)], "id long, x array<double>, y int"))
    assert heads.train_head(odd, "x", "y", "id", 3, epochs=1)[1] == heads.train_head(df, "x", "y", "id", 3, epochs=1)[1]
    with pytest.raises(ValueError, match="no training rows"):
        heads.train_head(df.where("id < 0"), "x", "y", "id", 3)


def test_layers_may_be_many(spark):
    rng = np.random.default_rng(5)
    layers = [(rng.normal(size=(4, 3)), rng.normal(size=4)), (rng.normal(size=(5, 4)), rng.normal(size=5)), (rng.normal(size=(2, 5)), rng.normal(size=2))]
    v = np.array([0.3, -1.0, 2.0])
    for k, (w, b) in enumerate(layers):
        v = w @ (np.maximum(v, 0) if k else v) + b
    got = spark.range(1).select(models.layered_scores(F.array(F.lit(0.3), F.lit(-1.0), F.lit(2.0)), layers).alias("s")).first().s
    assert np.allclose(got, v)


def test_projection_keeps_scores_and_the_widest_of_the_rest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) * np.array([1, 5, 1, 3, 0.1, 0.5])
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>")
    c = np.array([[1.0, 0, 2, 0, 0, 0], [2.0, 0, 4, 0, 0, 0]])  # of rank one
    basis = linear.preserving_projection(df, "x", c, 3)
    assert np.allclose(basis @ basis.T, np.eye(3)) and np.allclose(c @ basis.T @ basis, c)
    free = np.eye(6) - np.outer(c[0], c[0]) / 5
    values = np.linalg.eigvalsh(free @ (x.T @ x / 299) @ free)[::-1]
    assert np.allclose(np.diag(basis[1:] @ (x.T @ x / 299) @ basis[1:].T), values[:2])
    for size in (0, 7):
        with pytest.raises(ValueError, match="size"):
            linear.preserving_projection(df, "x", c, size)
