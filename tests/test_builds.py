"""The data-set build end to end, reservations, audits, filters and models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import labels, models
from quillmark.operators import audits, filters, linear, reservation, selection
from quillmark.plans import build

FOLDERS = {"genuine": "bbc", "ooc": "Newsclipings_person", "fake_text_real_image": "rumor_match", "real_text_fake_image": "coco_image_edit", "fake_text_fake_image": "llm_rewrite"}


def raw(spark, n=12):
    rows = [(f"{g}{k}", f"caption {g} {k}", f"/x/{f}_val_{k}/{k}.png", f"sha1:{g}{k}", "s") for g, f in FOLDERS.items() for k in range(n)]
    rows += [("genuine_copy", "Caption, genuine 0!", "/x/bbc_test_1/c.png", "sha1:genuine0", "s"), ("shared_image", "other caption", "/x/bbc_val_1/d.png", "sha1:ooc3", "s"), ("shared_text", "caption ooc 5", "/x/bbc_val_1/e.png", "sha1:new", "s")]
    return spark.createDataFrame(rows, "row_id string, text string, image_path string, image_key string, source string")


def test_build_balances_drops_copies_and_keeps_shared_content_together(spark):
    rows = build.records(raw(spark))
    assert rows.where("row_id = 'genuine0'").first().scenario == 4
    out, report = build.build_dataset(rows, tolerance=0.2)
    assert report.count() == 0
    counts = {r["group"]: r["count"] for r in out.groupBy("group").count().collect()}
    assert counts == dict.fromkeys(labels.GROUPS, 12)
    kept = {r.sample_id: r for r in out.collect()}
    assert len({"genuine0", "genuine_copy"} & set(kept)) <= 1
    for a, b in (("shared_image", "ooc3"), ("shared_text", "ooc5")):
        if a in kept and b in kept:
            assert kept[a].split == kept[b].split and kept[a].cluster == kept[b].cluster
    again, _ = build.build_dataset(rows.repartition(5), tolerance=0.2)
    assert {(r.sample_id, r.split) for r in again.collect()} == {(k, r.split) for k, r in kept.items()}


def test_first_rows_by_either_way(spark, monkeypatch):
    df = spark.range(300).selectExpr("id * 7 % 300 AS r", "id")
    small = {r.id for r in selection.first_by(df, "r", 41).collect()}
    monkeypatch.setattr(selection, "MOST_GATHERED", 10)
    assert {r.id for r in selection.first_by(df, "r", 41).collect()} == small and len(small) == 41


def test_real_fake_goals():
    available = {"ooc": 6, "fake_text_real_image": 6, "real_text_fake_image": 6, "genuine": 14, "fake_text_fake_image": 6}
    assert selection.goals(available, "real_fake")["genuine"] == 12 and selection.goals(available, "real_fake")["ooc"] == 3


def test_unknown_folders_fail(spark):
    with pytest.raises(Exception, match="unknown folder"):
        build.records(raw(spark).withColumn("image_path", F.lit("/x/nowhere_val_1/a.png"))).collect()


def test_top_up_takes_sources_in_turn(spark):
    base = spark.createDataFrame([("b", "train")], "sample_id string, split string")
    more = spark.createDataFrame([(f"{s}{k}", s) for s, n in (("x", 9), ("y", 2)) for k in range(n)], "sample_id string, subcategory string")
    out = build.topped_up(base, more, 6)
    assert {r.subcategory: r["count"] for r in out.groupBy("subcategory").count().collect()} == {None: 1, "x": 4, "y": 2}
    with pytest.raises(ValueError, match="needed"):
        build.topped_up(base, more, 12)


def test_reservations_fill_cells_and_stay_apart(spark):
    rng = random.Random(1)
    rows = [(k, ["a", "b"][k % 2], k // 2 % 2, f"c{k if k % 9 else k - 9}", rng.getrandbits(63), f"i{k % 300}") for k in range(400)]
    rows += [(1000 + k, g, y, f"n{k}", f ^ 1, i + "x") for k, (_, g, y, _, f, i) in enumerate(rows[:40])]
    df = spark.createDataFrame(rows, "id long, g string, y int, content string, fp long, identity string")
    out = reservation.reserved(df, {"test": 10, "val": 5, "train": 40}, "id", ["g", "y"], "content", "fp", 2, identity="identity").collect()
    assert len(out) == 4 * 55 and len({r.content for r in out}) == len(out)
    by = {s: [r for r in out if r.split == s] for s in ("test", "val", "train")}
    for s, t in (("test", "val"), ("test", "train"), ("val", "train")):
        assert not {r.identity for r in by[s]} & {r.identity for r in by[t]}
        assert min((a.fp ^ b.fp).bit_count() for a in by[s] for b in by[t]) > 2
    assert audits.manifest(spark.createDataFrame(out), {"test": 10, "val": 5, "train": 40}, ["g", "y"], ["content"], "fp", 2, key="id").count() == 0
    with pytest.raises(ValueError, match="too few"):
        reservation.reserved(df, {"test": 200}, "id", ["g", "y"], "content")


def test_audits_find_what_is_wrong(spark):
    rows = [("1", "test", 0, "a", 0), ("2", "train", 0, "a", 3), ("3", "train", 1, "b", 1 << 40)]
    df = spark.createDataFrame(rows, "sample_id string, split string, label int, sha string, dhash long")
    assert {r.check for r in audits.manifest(df, {"test": 1, "train": 1}, ["label"], ["sha"]).collect()} == {"duplicate_sha", "near_across_splits"}
    pairs = spark.createDataFrame([("a", "c", "c", 4, "t", 0, "s1"), ("b", "c", "d", 1, "t", 1 << 20, "s2"), ("e", "f", "f", 1, "u", 31 << 50, "s3")], "sample_id string, caption_id string, image_id string, scenario int, text string, dhash long, sha string")
    old = spark.createDataFrame([(1, "s2", "zz")], "dhash long, sha string, text string")
    found = {(r.check, r.key) for r in audits.new_pairs(pairs, old, ["sha", "text"]).collect()}
    assert found == {("broken_pair", "f"), ("pair_ids", "e"), ("shared_sha", "b"), ("near_protected", "a"), ("near_protected", "b")}
    origin = spark.createDataFrame([("1", "test", "val", 0, "x/val/nature/1"), ("2", "test", "train", 0, "x/val/nature/1"), ("3", "train", "train", 1, "x/train/nature/1")], "sample_id string, split string, source_split string, label int, member string")
    assert {(r.key, r.detail) for r in audits.origin(origin, {"test": "val", "train": "train"}, "member", {0: "/nature/", 1: "/ai/"}).collect()} == {("2", "source_split"), ("3", "member_label")}


def test_suffixes_boxes_vectors_and_gates(spark):
    found = {r.path: r for r in audits.by_suffix(spark.createDataFrame([("b/c.png",), ("c.png",), ("z",)], "path string"), spark.createDataFrame([("a/b/c.png",), ("d/c.png",)], "member string")).collect()}
    assert (found["b/c.png"].member, found["c.png"].problem, found["z"].problem) == ("a/b/c.png", "ambiguous", "missing")
    boxes = spark.createDataFrame([([[0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 9.0, 9.0]], [0.0, 0.0, 4.0, 4.0]), ([], [0.0, 0.0, 1.0, 1.0])], "boxes array<array<double>>, target array<double>")
    assert [(r.k, r.outside, r.under_half) for r in audits.coverage(boxes, "boxes", "target", (1, 2)).collect()] == [(1, 1, 2), (2, 1, 1)]
    vectors = spark.createDataFrame([("a", 2, [1.0]), ("a", 1, [1.00001]), ("b", 1, [5.0])], "asset string, k int, v array<double>")
    assert {(r.asset, r.n, r.v[0]) for r in audits.reused_vectors(vectors, "asset", "v", "k").collect()} == {("a", 2, 1.00001), ("b", 1, 5.0)}
    with pytest.raises(Exception, match="vectors differ"):
        audits.reused_vectors(vectors.withColumn("v", F.array(F.col("k") * 1.0)), "asset", "v", "k").collect()
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "s int, v double")
    b = spark.createDataFrame([(1, 0.89), (2, 0.7)], "s int, v double")
    assert {(r.s, r.passes, r.promote) for r in audits.promotion(a, b, "s", "v", 0.02).collect()} == {(1, True, False), (2, False, False)}


def test_filters(spark):
    df = spark.createDataFrame([(1, "train", "a|b", 1, "1"), (2, "val", "a", 1, ""), (3, "val", None, 0, "-1"), (4, "val", "c", 1, None)], "id long, split string, categories string, label int, ai string")
    assert filters.of_splits(df, ("val",)).count() == 3
    with pytest.raises(ValueError):
        filters.of_splits(df, ("val",), forbid=("train",))
    assert filters.where_equal(df, "split=train").count() == 1 and filters.where_equal(df, "absent=").count() == 4
    with pytest.raises(ValueError, match="no row"):
        filters.where_equal(df, "absent=x")
    assert [r.id for r in filters.known(df, "ai").collect()] == [1]
    assert filters.not_in(df, spark.createDataFrame([(1,), (None,)], "id long"), "id").count() == 3
    train, target = filters.source_holdout(df, "a")
    assert train.count() == 0 and {r.id for r in target.collect()} == {2, 3}


def test_draws_are_repeatable_and_near_their_means(spark):
    df = spark.range(2000).selectExpr("id", "if(id % 4 = 0, 3.0D, 1.0D) AS w")
    drawn = reservation.weighted_draws(df, "w", 6000, "id", 3)
    assert abs(drawn.count() - 6000) < 200 and drawn.count() == reservation.weighted_draws(df.repartition(7), "w", 6000, "id", 3).count()
    audit = {r.h: r.drawn for r in reservation.draw_audit(drawn.selectExpr("id % 4 = 0 AS h"), ["h"]).collect()}
    assert abs(audit[True] / audit[False] - 1) < 0.1


def test_models_never_see_labels(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), ([3.0, 4.0], 0)], "x array<float>, label int")

    def make():
        return lambda x: np.asarray(x) * 2

    assert [list(r.features) for r in models.encoded(df, make, ["x"], shapes=[[2]]).collect()] == [[2.0, 4.0], [6.0, 8.0]]
    with pytest.raises(ValueError, match="label"):
        models.encoded(df, make, ["x", "label"])
    assert models.resolve_layer(33, 30) == 30 and models.resolve_layer(33, -1) == 32
    with pytest.raises(IndexError):
        models.resolve_layer(29, 30)
    p = {"hidden.weight": np.eye(2), "hidden.bias": [0, 0], "skip.weight": np.zeros((3, 2)), "skip.bias": [0, 0, 0], "output.weight": [[1, 0], [0, 1], [0, 0]], "output.bias": [0, 0, 0]}
    out = df.select(models.residual_head(p)("x").alias("p")).first().p
    assert np.allclose(out, np.exp([1, 2, 0]) / np.exp([1, 2, 0]).sum())


def test_verdict_records(spark):
    classes = tuple(labels.GROUPS)
    df = spark.createDataFrame([(0.7, 0.3, 0.6, [0.1, 0.1, 0.1, 0.6, 0.1])], "s double, m double, i double, f array<double>")
    with_fusion = df.select(models.analysis(F.col("s"), F.col("m"), F.col("i"), 0.5, F.col("f"), classes).alias("r")).first().r
    assert with_fusion.verdict == "genuine" and with_fusion.confidence == 60.0 and with_fusion.modules.overall == 0.4
    pending = df.select(models.analysis(F.col("s"), F.col("m"), F.col("i"), 0.5, None, classes).alias("r")).first().r
    assert pending.verdict == "pending" and pending.modules.overall == 0.7 and not pending.final_available


def test_forests_kernels_whitening_and_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [1, 2, 3, 4]
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(k), float(v @ [1, 2, 0, 0] + 3)) for v, k in zip(x, y, strict=True)], "x array<double>, y int, m double")
    model = linear.random_forest(df, "x", "y")
    assert linear.fake_probability(model, df, "x").where("(prob >= 0.5) = (y = 1)").count() > 280
    mean, rows = linear.whitening(df, "x", 3)
    z = (x - mean) @ rows.T
    assert np.allclose(np.cov(z.T), np.eye(3), atol=1e-8)
    k = np.array([r.kernel for r in linear.kernel_features(df, "x", 0.05, 4096).select("kernel").collect()])
    exact = np.exp(-0.05 * ((x[:20, None] - x[None, :20]) ** 2).sum(-1))
    assert np.abs(k[:20] @ k[:20].T - exact).max() < 0.1
    coefficients, intercept = linear.midpoint_correction(df, "x", "m", 1e-9)
    assert np.allclose(coefficients, [1, 2, 0, 0]) and abs(intercept - 3) < 1e-6


def test_joint_loss_gradient_and_descent(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 2)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(v.tolist(), int(k), 1.0 + int(k)) for v, k in zip(x, y, strict=True)], "x array<double>, y int, w double")
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x[:10], x[10:20], strict=True)], "real array<double>, ooc array<double>")
    loss = lambda t: linear.joint_loss(t, df, pairs, 0.5, 0.25)
    theta = rng.normal(size=9) * 0.1
    value, gradient = loss(theta)
    for k in (0, 3, 8):
        e = np.zeros(9)
        e[k] = 1e-5
        assert abs((loss(theta + e)[0] - loss(theta - e)[0]) / 2e-5 - gradient[k]) < 1e-6
    best = linear.minimised(loss, theta, steps=15, tolerance=1e-3)
    assert loss(best)[0] < value and np.abs(loss(best)[1]).max() < 0.02


def test_clusters_are_never_broadcast(spark, small, monkeypatch):
    from quillmark.operators import selection
    from quillmark.plans import build, components
    from quillmark.queries_records import _records

    plans, write = [], components.staged

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    for module in (build, components):
        monkeypatch.setattr(module, "staged", seen)
    monkeypatch.setattr(components, "MOST_BROADCAST", 0)
    rows = _records(spark, small)
    linked = seen(build.clustered(rows, ("text_key", "image_key"), "doc_id"), "clustered")
    seen(selection.split_clusters(linked, "cluster", "group"), "data-set")
    assert {"edges", "clustered", "data-set"} == {name for name, _ in plans} and len(plans) > 3
    keys = [line for _, plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all("_profile" in line for line in keys)  # kinds of clusters alone


def test_the_build_and_its_report_broadcast_bounded_tables_alone(spark, small, monkeypatch):
    import re

    from quillmark.plans import components
    from quillmark.queries_misc import dataset_build_leaks

    monkeypatch.setattr(components, "MOST_BROADCAST", 0)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    ran = lambda: [e.apply(k) for e in [store.executionsList()] for k in range(e.size())]
    bus.waitUntilEmpty()
    last = max((e.executionId() for e in ran()), default=-1)
    assert dataset_build_leaks(spark, small).where("check = 'leak'").count() == 0
    bus.waitUntilEmpty()
    plans = [e.physicalPlanDescription() for e in ran() if e.executionId() > last]
    joins = [k for plan in plans for k in re.findall(r"BroadcastHashJoin.*\nLeft keys \[\d+\]: \[(.*)\]\n", plan)]
    # kinds of clusters, buckets, groups and splits; never parts of ranks, contents or clusters
    assert len(plans) > 10 and {re.sub(r"#\d+L?", "", k) for k in joins} <= {"_profile", "_bucket", "g", "group", "g, s"}


def test_what_the_build_broadcasts_stays_as_the_table_grows(spark, small, monkeypatch):
    from quillmark.plans import components
    from quillmark.queries_misc import dataset_build_leaks

    monkeypatch.setattr(components, "MOST_BROADCAST", 0, raising=False)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    items = lambda found: [found.apply(k) for k in range(found.size())]

    def sent(folder):
        """Rows of all broadcasts, which the driver gathers."""
        bus.waitUntilEmpty()
        last, rows = max((e.executionId() for e in items(store.executionsList())), default=-1), 0
        assert dataset_build_leaks(spark, folder).where("check = 'leak'").count() == 0
        bus.waitUntilEmpty()
        for k in (e.executionId() for e in items(store.executionsList()) if e.executionId() > last):
            counted = {m.accumulatorId() for n in items(store.planGraph(k).allNodes()) if n.name() == "BroadcastExchange" for m in items(n.metrics()) if m.name() == "number of output rows"}
            values = store.executionMetrics(k).iterator()
            while values.hasNext():
                v = values.next()
                rows += int(v._2().replace(",", "")) if v._1() in counted else 0
        return rows

    few, many = sent(small), sent("/root/testdata/sf0.01")
    assert 0 < few and many < few + 250, (few, many)  # five times the documents, 1,000: a few more kinds of clusters
