"""The kernel machine against the exact one."""

import numpy as np
import pytest

from quillmark.operators import kernel


def made(spark, n=300):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 > 1.5).astype(int)
    return spark.createDataFrame([(k, [float(v) for v in x[k]], int(y[k])) for k in range(n)], "id long, x array<double>, y int"), x, y


def exact(x, y, gamma, c):
    """Newton's method on the full kernel matrix: f = K a + b, with a the losses' slopes."""
    k, sign = kernel.radial(x, x, gamma), np.where(y == 1, 1.0, -1.0)
    a, b = np.zeros(len(x)), 0.0
    for _ in range(60):
        active = sign * (k @ a + b) < 1
        m = np.zeros((active.sum() + 1,) * 2)
        m[:-1, :-1] = k[np.ix_(active, active)] + np.eye(active.sum()) / (2 * c)
        m[:-1, -1] = m[-1, :-1] = 1
        found = np.linalg.solve(m, np.r_[sign[active], 0.0])
        a, b = np.zeros(len(x)), found[-1]
        a[active] = found[:-1]
    return a, b


def test_all_rows_as_landmarks_give_the_exact_machine(spark):
    df, x, y = made(spark, 120)
    machine = kernel.fit_kernel(df, "x", "y", "id", c=0.5, gamma=0.7, landmarks=120)
    a, b = exact(x, y, 0.7, 0.5)
    assert np.allclose(machine.scores(x), kernel.radial(x, x, 0.7) @ a + b, atol=5e-3)


def test_few_landmarks_come_near_and_learn_a_ring(spark):
    df, x, y = made(spark)
    machine = kernel.fit_kernel(df.where("id % 3 <> 0"), "x", "y", "id", gamma=0.7, landmarks=60)
    held = np.arange(300) % 3 == 0
    a, b = exact(x[~held], y[~held], 0.7, 1.0)
    right = ((machine.scores(x[held]) > 0) == y[held]).mean()
    best = ((kernel.radial(x[held], x[~held], 0.7) @ a + b > 0) == y[held]).mean()
    assert right > best - 0.05 and right > max(y[held].mean(), 1 - y[held].mean()) + 0.1
    got = {r.id: r.score for r in kernel.kernel_scored(df, machine, "x").collect()}
    assert np.allclose([got[k] for k in range(300)], machine.scores(x))


def test_odd_rows(spark):
    df, _, _ = made(spark, 30)
    odd = df.unionByName(spark.createDataFrame([(100, None, 1), (101, [0.0] * 3, None)], "id long, x array<double>, y int"))
    a, b = (kernel.fit_kernel(d, "x", "y", "id", landmarks=10) for d in (df, odd))
    assert np.allclose(a.weights, b.weights)
    assert {r.id for r in kernel.kernel_scored(odd, b, "x").where("score IS NULL").collect()} == {100}
    with pytest.raises(ValueError, match="no training rows"):
        kernel.fit_kernel(df.where("id < 0"), "x", "y", "id")
