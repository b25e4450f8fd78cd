"""The bootstrap's draws, and its intervals against a plain one."""

import numpy as np
from pyspark.sql import functions as F

from quillmark.operators import metrics


def test_draws_of_all_blocks_sum_to_n():
    weights = np.array([5, 0, 900, 17, 3, 75, 1000])
    draws = np.array([metrics.block_draws(2000, weights, b, 400, [3, 0]) for b in range(7)])
    assert (draws.sum(0) == 2000).all() and (draws[1] == 0).all()
    assert np.allclose(draws.mean(1), weights, atol=6 * np.sqrt(weights / 400).max() + 1)
    sums = metrics.drawn_sums(np.array([1.0, 10.0]), np.array([3, 1]), draws[2], [1])
    assert abs(sums.mean() / draws[2].mean() - 13 / 4) < 0.1


def test_intervals_equal_those_of_a_plain_bootstrap(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BOOTSTRAP_VALUES", 64)
    rng = np.random.default_rng(5)
    gap, right = rng.normal(0.3, 2, 1500), rng.integers(-1, 2, 1500).astype(float)
    df = spark.createDataFrame([(k, float(gap[k]), float(right[k]), 1.0, None if k % 3 else float(gap[k])) for k in range(1500)], "id long, gap double, right double, one double, third double")
    got = {r.metric: r for r in metrics.bootstrap_difference(df, "id", ["gap", "right", "one", "third"], 2000).collect()}
    assert (got["one"].difference, got["one"].low, got["one"].high) == (1.0, 1.0, 1.0)  # every repetition draws n
    for name, x in (("gap", gap), ("right", right), ("third", gap[::3])):
        plain = np.quantile(x[rng.integers(0, len(x), (2000, len(x)))].mean(1), [0.025, 0.975])
        error = x.std() / np.sqrt(len(x)) / 5
        assert abs(got[name].difference - x.mean()) < 1e-9
        assert abs(got[name].low - plain[0]) < error and abs(got[name].high - plain[1]) < error
    again = {r.metric: r for r in metrics.bootstrap_difference(df.repartition(7).orderBy(F.desc("gap")), "id", ["gap", "right", "one", "third"], 2000).collect()}
    for name in got:
        assert np.allclose(got[name][1:], again[name][1:], atol=1e-12)
