"""Metrics and thresholds against exhaustive searches and known values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import features, linear, metrics, selection
from quillmark.operators import thresholds as t
from quillmark.plans.components import components
from quillmark.plans.prefix import quantiles, running


def frame(spark, rows, schema="label int, prob double"):
    return spark.createDataFrame(rows, schema)


def test_known_counts(spark):
    rows = [(1, 0.9), (1, 0.4), (0, 0.2), (0, 0.6)]
    r = metrics.binary_metrics(frame(spark, rows), "label", "prob").first()
    assert (r.tp, r.fn, r.fp, r.tn) == (1, 1, 1, 1) and r.auc == 0.75
    assert metrics.auc(frame(spark, [(1, 0.5), (0, 0.5)]), "label", "prob").first().auc == 0.5
    assert math.isnan(metrics.auc(frame(spark, [(1, 0.5)]), "label", "prob").first().auc)


def test_replayed_confusion(spark):
    rows = [(1, 0.9)] * 926 + [(1, 0.1)] * 62 + [(0, 0.1)] * 105 + [(0, 0.9)] * 142
    r = metrics.binary_counts(frame(spark, rows), "label", "prob").first()
    assert (r.tp, r.fn, r.tn, r.fp, r.n) == (926, 62, 105, 142, 1235)


def test_empty_and_one_class_give_zero_rates(spark):
    r = metrics.binary_counts(frame(spark, []), "label", "prob").first()
    assert r.n == 0 and r.accuracy == r.recall == r.f1_macro == 0.0


def scored(seed, n=200, digits=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = int(rng.random() < 0.6)
        rows.append((y, round(min(1.0, max(0.0, rng.gauss(0.45 + 0.2 * y, 0.2))), digits)))
    return rows


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_and_ap_equal_brute_force(spark, seed):
    rows = scored(seed)
    df = frame(spark, rows)
    assert metrics.auc(df, "label", "prob").first().auc == pytest.approx(brute_auc(rows), abs=1e-12)
    ap, seen = 0.0, 0
    whole = sum(y for y, _ in rows)
    for s in sorted({p for _, p in rows}, reverse=True):
        tp = sum(y for y, p in rows if p >= s)
        ap += (tp - seen) / whole * tp / sum(p >= s for _, p in rows)
        seen = tp
    assert metrics.average_precision(df, "label", "prob").first().ap == pytest.approx(ap, abs=1e-12)


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_running_sums_equal_a_global_order(spark, buckets):
    rng = random.Random(buckets)
    rows = [(k / 7, rng.randint(0, 9)) for k in rng.sample(range(1000), 300)]
    out = {r.k: r for r in running(spark.createDataFrame(rows, "k double, v long"), "k", ["v"], follow=True, buckets=buckets).collect()}
    total, ordered = 0, sorted(rows)
    for i, (k, v) in enumerate(ordered):
        assert out[k].v_before == total and out[k].k_next == (ordered[i + 1][0] if i + 1 < len(ordered) else None)
        total += v


def test_quantiles_are_linear(spark):
    import numpy as np

    for n in (1, 2, 5, 1000):
        values = [random.Random(k).randint(0, 40) / 3 for k in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "x double").groupBy("x").agg(F.count(F.lit(1)).alias("c"))
        found = [r.q for r in quantiles(df, "x", "c", 100).orderBy("i").collect()]
        assert np.allclose(found, np.quantile(values, np.linspace(0, 1, 101)))


def balanced_value(rows, at):
    p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    return (sum(y for y, s in rows if s >= at) / p + sum(1 - y for y, s in rows if s < at) / n) / 2


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_thresholds_equal_exhaustive_search(spark, seed):
    rows = scored(seed)
    df = frame(spark, rows)
    scores = sorted({s for _, s in rows})
    mids = [(a + b) / 2 for a, b in zip(scores, scores[1:], strict=False)]
    r = t.balanced(df, "label", "prob").first()
    best = max([0.0, 0.5, *mids, math.nextafter(scores[-1], 2)], key=lambda x: (round(balanced_value(rows, x), 12), -abs(x - 0.5), x))
    assert r.threshold == pytest.approx(best) and r.value == pytest.approx(balanced_value(rows, best))

    def recalls(x):
        p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
        return sum(y for y, s in rows if s >= x) / p, sum(1 - y for y, s in rows if s < x) / n

    r = t.worst_recall(df, "label", "prob").first()
    best = max([0.5, *mids], key=lambda x: (round(min(recalls(x)), 12), round(sum(recalls(x)) / 2, 12), -abs(x - 0.5)))
    assert r.worst == pytest.approx(min(recalls(best))) and abs(r.threshold - 0.5) == pytest.approx(abs(best - 0.5))

    r = t.grid(df, "label", "prob").first()
    best = max([k / 100 for k in range(5, 100, 5)], key=lambda x: (round(balanced_value(rows, x), 12), -x))
    assert r.threshold == best


def test_threshold_rules_refuse_one_class(spark):
    with pytest.raises(Exception, match="both classes"):
        t.balanced(frame(spark, [(1, 0.5), (1, 0.6)]), "label", "prob").collect()
    with pytest.raises(Exception, match="both labels"):
        metrics.forensic_metrics(frame(spark, [(1, 0.5)]), "label", "prob").collect()
    assert t.grid(frame(spark, [(1, 0.5)]), "label", "prob").first().threshold == 0.5


def test_recall_constraint_holds(spark):
    rows = [(s, k / 10) for s in (1, 2) for k in range(10)]
    df = spark.createDataFrame(rows, "scenario int, prob double")
    at = t.recall_constrained(df, "scenario", "prob", {1: 0.9, 2: 0.5}).first().threshold
    assert at == 0.1 and sum(p >= at for s, p in rows if s == 1) / 10 >= 0.9


def test_seven_cells_row_order_doesnt_matter(spark):
    rows = [(g, s, ((i * 7) % 10) / 10) for i, (g, s, _) in enumerate(t.CELLS) for _ in range(1)] * 2
    df = spark.createDataFrame(rows, "g string, s int, p double")
    a = t.recall_floor(df, "g", "s", "p", 0.5).collect()
    assert a == t.recall_floor(spark.createDataFrame(rows[::-1], "g string, s int, p double"), "g", "s", "p", 0.5).collect()
    with pytest.raises(Exception, match="no rows"):
        t.recall_floor(df.where("g = 'paired_news'"), "g", "s", "p", 0.5).collect()


def test_pairs(spark):
    rows = [("a", 4, 0.2), ("a", 1, 0.8), ("b", 4, 0.6), ("b", 1, 0.6)]
    r = metrics.paired_summary(metrics.caption_pairs(spark.createDataFrame(rows, "caption_id string, scenario int, prob double")), 0.5).first()
    assert (r.genuine_recall, r.ooc_recall, r.both_correct, r.within_caption_ranking) == (0.5, 1.0, 0.5, 0.75)
    assert r.mean_probability_gap == pytest.approx(0.3)
    bad = spark.createDataFrame([*rows, ("c", 4, 0.1)], "caption_id string, scenario int, prob double")
    assert metrics.incomplete_pairs(bad).first().caption_id == "c"


def test_bootstrap_of_equal_scores_is_zero(spark):
    df = spark.range(50).selectExpr("id", "0.0D AS a")
    r = metrics.bootstrap_difference(df, "id", ["a"], 50).first()
    assert (r.difference, r.low, r.high) == (0.0, 0.0, 0.0)


def test_wilson_contains_the_share(spark):
    low, high = metrics.wilson(F.lit(9), F.lit(10))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert 0.59 < r.l < 0.6 and 0.98 < r.h < 0.99


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(900 + k, 900 + (k + 1) % 20) for k in range(20)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    rng.shuffle(edges)
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {v: root(v) for e in edges if e[0] != e[1] for v in e}


def test_splits_keep_clusters_whole_and_near_their_shares(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(300) if k % 2 else 1000 + k, ["genuine", "ooc"][k % 2]) for k in range(1200)]
    df = selection.split_clusters(spark.createDataFrame(rows, "id long, cluster long, `group` string"), "cluster", "group")
    assert df.groupBy("cluster").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    shares = {r.split: r["count"] / 1200 for r in df.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.7) < 0.04 and abs(shares["val"] - 0.15) < 0.04


def test_independent_set_equals_the_greedy_one(spark):
    rng = random.Random(6)
    edges = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(120)}
    rows = [(k, (k * 37) % 80) for k in range(80)]
    taken = set()
    for k, _ in sorted(rows, key=lambda r: r[1]):
        if not any((min(k, o), max(k, o)) in edges for o in taken):
            taken.add(k)
    df = selection.independent(spark.createDataFrame(rows, "k long, r long"), spark.createDataFrame(list(edges), "a long, b long"), "k", "r")
    assert {r.k for r in df.collect()} == taken


def test_logistic_is_the_optimum_of_the_c_form(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x @ [1, -2, 0.5] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "x array<double>, y int")
    model = linear.fit_logistic(df, "x", "y", c=0.3)
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(0.3 * x.T @ (p - y) + w).max() < 1e-4 and abs((p - y).sum()) < 1e-3


def test_zscores_and_early_stop(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id long, x array<double>")
    found = [r.x for r in features.zscored(df, df, "x", population=True).orderBy("id").collect()]
    assert [[round(v, 9) for v in x] for x in found] == [[-1.0, 0.0], [1.0, 0.0]]
    history = spark.createDataFrame([("r", e, m) for e, m in enumerate([0.1, 0.5, 0.4, 0.3, 0.9], 1)], "run string, epoch int, metric double")
    r = features.early_stop(history, "run", "epoch", "metric", 2).first()
    assert (r.best_epoch, r.best, r.stopped) == (2, 0.5, 4)


def test_buckets_keep_the_order_and_split_where_the_bounds_are(spark):
    from quillmark.plans.prefix import bucketed

    rows = spark.range(5000).selectExpr("id * 37 % 1009 / 8.0D AS key").unionByName(spark.createDataFrame([(None,)], "key double"))
    for n in (1, 2, 31, 32, 33, 200):
        found = bucketed(rows, "key", n).groupBy("_bucket").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("key").alias("n")).orderBy("_bucket").collect()
        assert [r._bucket for r in found] == list(range(len(found))) and sum(r.n for r in found) == 5000
        assert all(a.high < b.low for a, b in zip(found, found[1:], strict=False))
        assert len(found) == n and max(r.n for r in found) <= 5000 / n + 40
