"""Greedy splits of clusters, draws with replacement and running moments, each against a plain loop."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import features, reservation, selection


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def one_by_one(rows, fractions, seed=42):
    """(id, cluster, group) rows: every cluster placed by itself, then kinds dealt by ranks."""
    clusters, totals = {}, {}
    for _, c, g in rows:
        clusters.setdefault(c, {}).setdefault(g, 0)
        clusters[c][g] += 1
        totals[g] = totals.get(g, 0) + 1
    kind = {c: ",".join(f"{g}={n}" for g, n in sorted(own.items())) for c, own in clusters.items()}
    order = sorted(clusters, key=lambda c: (-sum(clusters[c].values()), kind[c], md5(f"{seed}:{c}"), c))
    have, given = {s: dict.fromkeys(totals, 0) for s in fractions}, {}
    for c in order:
        fill = lambda s, own=clusters[c]: max((have[s][g] + n) / (fractions[s] * totals[g]) for g, n in own.items())
        best = min(fractions, key=lambda s: (fill(s), sum(have[s].values())))
        for g, n in clusters[c].items():
            have[best][g] += n
        given.setdefault(kind[c], dict.fromkeys(fractions, 0))[best] += 1
    out = {}
    for k in given:
        own = sorted((c for c in clusters if kind[c] == k), key=lambda c: (md5(f"{seed}:{c}"), c))
        for s in fractions:
            out.update(dict.fromkeys(own[: given[k][s]], s))
            own = own[given[k][s] :]
    return out


@pytest.mark.parametrize("fractions", [{"train": 0.7, "val": 0.15, "test": 0.15}, {"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.1}, {"only": 1.0}])
def test_split_equals_one_by_one(spark, fractions):
    rng = random.Random(9)
    rows = [(k, rng.choice([rng.randrange(40), rng.randrange(3), 100 + k]), rng.choice(["genuine", "ooc", "ai", "image_fake"])) for k in range(900)]
    df = selection.split_clusters(spark.createDataFrame(rows, "id long, cluster long, `group` string"), "cluster", "group", fractions)
    got = {(r.cluster, r.split) for r in df.collect()}
    assert got == set(one_by_one(rows, fractions).items()) and df.count() == len(rows)


def test_many_equal_clusters_take_one_step():
    quota = np.array([[0.7e9, 0.7e9], [0.15e9, 0.15e9], [0.15e9, 0.15e9]])
    given = selection._filled(10**9, np.array([1.0, 1.0]), 2, np.zeros((3, 2)), np.zeros(3, np.int64), quota)
    assert sum(given) == 10**9 and given == [700_000_000, 150_000_000, 150_000_000]


def test_split_of_odd_rows(spark):
    schema = "id long, cluster long, `group` string, split string"
    rows = [(1, None, "a", "x"), (2, None, None, "x"), (3, 5, "a", None), (4, 5, None, None)]
    df = selection.split_clusters(spark.createDataFrame(rows, schema), "cluster", "group")
    assert df.count() == 4 and df.groupBy("cluster").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert selection.split_clusters(spark.createDataFrame([], schema), "cluster", "group").count() == 0


def plain_draws(rows, draws, seed, epoch=0):
    largest = max(w for _, w in rows)
    parts = [(k, max(1, int(w / largest * (1 << 30)))) for k, w in sorted(rows) if w > 0]
    ends = np.cumsum([p for _, p in parts])
    out = []
    for d in range(draws):
        at = int(md5(f"{seed}:{epoch}:{d}")[:13], 16) * int(ends[-1]) >> 52
        out.append((d, parts[int(np.searchsorted(ends, at, side="right"))][0]))
    return out


@pytest.mark.parametrize("heavy", [1.0, 5000.0])
def test_draws_equal_a_plain_search(spark, heavy):
    """Also where one row has most of the weight."""
    rng = random.Random(2)
    rows = [(k * 3, rng.choice([0.0, 0.5, 1.0, 2.25])) for k in range(500)] + [(700, heavy)]
    df = spark.createDataFrame(rows, "id long, w double").withColumn("name", F.concat(F.lit("n"), "id"))
    for epoch in (0, 1):
        got = sorted((r.draw, r.id) for r in reservation.weighted_draws(df, "w", 800, "id", 3, epoch, cells=16).collect())
        assert got == plain_draws(rows, 800, 3, epoch)


def test_draws_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0), (4, 0.0)], "id long, w double")
    assert {r.id for r in reservation.weighted_draws(df, "w", 5, "id", 1).collect()} == {1}
    assert reservation.weighted_draws(df, "w", 0, "id", 1).count() == 0
    with pytest.raises(ValueError, match="weight"):
        reservation.weighted_draws(df.where("id > 1"), "w", 5, "id", 1)
    report = reservation.draw_report(df, "w", 7, "id", 1, 3, ["w"]).collect()
    assert [(r.epoch, r.drawn, r.distinct_rows) for r in sorted(report, key=lambda r: r.epoch)] == [(e, 7, 1) for e in range(3)]


def test_moments_equal_the_fold_over_many_tasks(spark):
    n = 20_000
    hot = spark.range(n).selectExpr("'hot' AS k", "id AS step", "sin(id) AS m", "abs(cos(id)) AS v")
    few = spark.createDataFrame([("few", 7, 1.0, 2.0), ("few", 3, 5.0, 1.0)], "k string, step long, m double, v double")
    got = {r.k: r for r in features.exponential_moments(hot.unionByName(few), "k", "step", "m", "v", buckets=32).collect()}
    m, v = 0.0, 1.0
    for i in range(n):
        m, v = 0.9 * m + 0.1 * np.sin(i), 0.9 * v + 0.1 * abs(np.cos(i))
    assert abs(got["hot"].mean - m) < 1e-12 and abs(got["hot"].variance - v) < 1e-12
    assert abs(got["few"].mean - (0.9 * 0.5 + 0.1)) < 1e-12 and abs(got["few"].variance - (0.9 * (0.9 + 0.1) + 0.2)) < 1e-12


def test_hamming_parts_are_exact(spark):
    from quillmark.operators import neardup

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 20))) for x in base for _ in range(5)]
    prints = [x - (1 << 64) if x >> 63 else x for x in base + near] + [0, -1, 0]
    df = spark.createDataFrame(list(enumerate(prints)) + [(9999, None)], "id long, fp long")
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    every = set(prints)
    for radius, parts in ((0, [(0, 64, 0)]), (4, neardup.cut(4, 2)), (4, neardup.cut(4, 5)), (8, neardup.cut(8, 3)), (18, neardup.cut(18, 4)), (18, neardup.cut(18, 7)), (18, None), (3, None)):
        want = {(a, b): bits(a, b) for a in every for b in every if bits(a, b) <= radius}
        got = [tuple(r) for r in neardup.pairs_within(df, df, radius, parts=parts).collect()]
        assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want
    got = {r.id: r for r in neardup.near_classes(df, 18, "id", parts=neardup.cut(18, 4)).collect()}
    assert len(got) == len(prints) + 1 and got[9999].links == 0
    for k, x in enumerate(prints):
        assert got[k]["class"] == prints.index(x) and got[k].links == sum(0 < bits(x, y) <= 18 for y in every)


def test_parts_follow_the_size():
    from quillmark.operators import neardup

    assert len(neardup.best_parts(4, 2_000)) == 5
    assert len(neardup.best_parts(4, 10**9)) == 2
    assert neardup.best_parts(40, 1_000) is None
    for radius in range(1, 20):
        for m in range(1, radius + 2):
            parts = neardup.cut(radius, m)
            assert sum(r + 1 for _, _, r in parts) == radius + 1 and sum(w for _, w, _ in parts) <= 64


def test_wide_radii_meet_block_by_block_and_no_row_is_a_pair(spark, monkeypatch):
    """Of a wide radius parts ask for thousands of values a fingerprint; blocks compare arrays, and counts and least distances make no pairs."""
    from quillmark.operators import neardup

    # 3 blocks a side, and rows that don't fill the last step
    monkeypatch.setattr(neardup, "BLOCK", 100)
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(250)]
    prints = [x - (1 << 64) if x >> 63 else x for x in [*prints, *(x ^ 5 for x in prints[:9]), 0, (1 << 64) - 1]]
    df = spark.createDataFrame([*enumerate(prints), (900, prints[3]), (901, None)], "id long, fp long")
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert neardup.best_parts(18, 600_000, neardup.ROW_COST) is None and neardup.best_parts(4, 600_000, neardup.ROW_COST)
    pairs = neardup.pairs_within(df, df.where("id < 100"), 18)
    want = sorted((a, b, bits(a, b)) for a in prints for b in prints[:100] if bits(a, b) <= 18)
    assert sorted(map(tuple, pairs.collect())) == want and pairs.columns == ["a", "b", "distance"]
    links = {r.a: r.links for r in neardup.neighbours(df, 18).collect()}
    assert links == {x: n for x in prints if (n := sum(0 < bits(x, y) <= 18 for y in prints))}
    nearest = {r.id: r.nearest for r in neardup.nearest_distance(df, "id").collect()}
    assert nearest == {k: 0 if k == 3 else min(bits(x, y) for y in prints if x != y) for k, x in enumerate(prints)} | {900: 0, 901: None}
    assert neardup.nearest_distance(df.where("id = 0"), "id").first().nearest is None
    assert neardup.nearest_distance(df.limit(0), "id").count() == neardup.near_classes(df.limit(0), 18, "id").count() == 0


def test_pairs_taken_before_are_never_broadcast(spark, small, monkeypatch):
    from quillmark.queries_records import _records

    plans, write = [], selection.staged

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(selection, "staged", seen)
    selection.select_balanced(_records(spark, small), "group", "text_key", "image_key", "doc_id", "source")
    taken = [plan for name, plan in plans if name == "taken"]
    assert len(taken) == 5 and all("LeftAnti" in plan for plan in taken[1:])
    assert not any("BroadcastHashJoin" in plan for plan in taken)


def test_parts_of_ranks_are_never_broadcast(spark):
    from pyspark.sql import Window

    from quillmark.plans.prefix import hashed_rank

    rng = random.Random(5)
    rows = [(k, rng.choice([None, "a", "b", *map(str, range(400))]), rng.choice([None, "x", "y"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, m string")
    ranked = hashed_rank(df, ["g"], [F.col("m")], selection.shuffled("id", 3), "id")
    assert ranked.columns == ["id", "g", "m", "rank"]
    over = Window.partitionBy("g").orderBy("m", selection.shuffled("id", 3), "id")
    assert sorted((r.id, r["rank"]) for r in ranked.collect()) == sorted(tuple(r) for r in df.select("id", F.row_number().over(over).alias("rank")).collect())
    assert "isFinalPlan=true" in (plan := ranked._jdf.queryExecution().executedPlan().toString()) and "BroadcastExchange" not in plan
