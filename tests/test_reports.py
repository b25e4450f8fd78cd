"""Releases, reports, bundles and image files: their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import audits
from quillmark.operators import metrics as m
from quillmark.sources import bundles, images, sinks, stores


def test_gates_are_joined(spark):
    before = spark.createDataFrame([("class", "0", 0.9), ("class", "1", 0.8), ("scenario", "4", 0.7)], "kind string, key string, value double")
    after = spark.createDataFrame([("class", "0", 0.89), ("class", "1", 0.95), ("scenario", "4", 0.69)], "kind string, key string, value double")
    ends = spark.createDataFrame([("gap", 0.1, 0.3)], "metric string, low double, high double")
    limits = {"class": 0.01, "scenario": 0.02}
    rows = audits.release_gates(before, after, limits, ends).collect()
    assert len(rows) == 4 and all(r.passes and r.promote for r in rows)

    touching = ends.withColumn("low", F.lit(0.0))
    rows = {r.key: r for r in audits.release_gates(before, after, limits, touching).collect()}
    assert not rows["gap"].passes and rows["0"].passes and not rows["0"].promote

    missing = {r.key: r.passes for r in audits.release_gates(before, after.where("key <> '4'"), limits, ends).collect()}
    assert missing["4"] is False
    unknown = {r.key: r.passes for r in audits.release_gates(before, after, {"class": 0.01}, ends).collect()}
    assert unknown["4"] is False
    assert audits.release_gates(before.limit(0), after.limit(0), limits, ends.limit(0)).count() == 0


def test_interval_of_few_rows(spark):
    one = spark.createDataFrame([(0.5, None)], "a double, b double")
    found = {r.metric: r for r in m.paired_interval(one, ["a", "b"]).collect()}
    assert (found["a"].n, found["a"].mean, found["a"].low) == (1, 0.5, None)
    assert (found["b"].n, found["b"].mean) == (0, None)
    many = spark.createDataFrame([(float(k % 3),) for k in range(90)], "a double")
    r = m.paired_interval(many, ["a"]).first()
    half = m.Z95 * np.std([k % 3 for k in range(90)], ddof=1) / np.sqrt(90)
    assert np.allclose([r.low, r.high], [1 - half, 1 + half])


def test_markdown(spark, tmp_path):
    rows = spark.createDataFrame([("b|c", 1, 0.25), ("a", 2, None)], "name string, n int, share double")
    lines = sinks.markdown_lines("Shares", rows, ("share",))
    assert lines == ["## Shares", "", "| name | n | share |", "|---|---|---|", "| a | 2 |  |", "| b\\|c | 1 | 25.0% |"]
    sinks.write_report(spark, [lines, ["end"]], f"{tmp_path}/report")
    assert spark.read.text(f"{tmp_path}/report", wholetext=True).first().value.split("\n")[-2:] in (["", "end"], ["end", ""])


def test_a_changed_classifier_is_refused(spark, tmp_path):
    path = f"{tmp_path}/bundle"
    bundles.write_bundle(spark, path, np.array([1.0, -2.0]), np.array([0.5]), ("genuine", "fake"), 0.5)
    bundle = bundles.read_bundle(spark, path)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None)], "id int, x array<double>")
    found = {r.id: r for r in bundles.predicted(rows, "x", bundle).collect()}
    assert found[1].prob == pytest.approx(1 / (1 + np.exp(-1.5))) and found[1].pred == 1
    assert found[2].prob == pytest.approx(1 / (1 + np.exp(1.5))) and found[2].pred == 0
    assert found[3].prob is None and found[4].pred is None

    other = f"{tmp_path}/other"
    bundles.write_bundle(spark, other, np.array([1.0, -2.1]), np.array([0.5]), ("genuine", "fake"), 0.5)
    sinks.write_json(spark, sinks.read_json(spark, f"{path}/bundle"), f"{tmp_path}/mixed/bundle")
    sinks.write_json(spark, sinks.read_json(spark, f"{other}/classifier"), f"{tmp_path}/mixed/classifier")
    with pytest.raises(OSError):
        bundles.read_bundle(spark, f"{tmp_path}/mixed")
    with pytest.raises(ValueError):
        bundles.write_bundle(spark, f"{tmp_path}/bad", np.eye(2), np.zeros(2), ("a", "b", "c"), 0.5)


def test_files_by_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a.pgm", b"P5\n9 8\n255\n" + bytes(72)), ("b.pgm", b"x"), ("c.pgm", None), ("empty.pgm", b"")], "name string, content binary")
    place = f"{tmp_path}/files"
    assert stores.write_files(rows, place) == 3
    assert stores.write_files(rows, place) == 3
    assert stores.write_files(rows.limit(0), place) == 0
    assert [p.rsplit("/", 1)[1] for p in stores.listed(place, ("",))] == ["a.pgm", "b.pgm", "empty.pgm"]
    wanted = spark.createDataFrame([(1, "a.pgm"), (2, "a.pgm"), (3, "b.pgm"), (4, "c.pgm"), (5, None)], "id int, image_path string")
    found = {r.id: (r.info.ok, r.info.error) if r.info else None for r in images.image_table(wanted, place).collect()}
    assert found[1] == found[2] == (True, None) and found[3] == (False, "corrupt") and found[4] == (False, "missing")
