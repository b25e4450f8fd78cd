"""Committed tables, array files, archives by member: what a failure or a changed byte does."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

from quillmark.sources import archives, array_files, committed, sinks


def files(folder):
    return sorted(f for _, _, names in os.walk(folder) for f in names)


def test_committed_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(1000).selectExpr("id", "if(id % 7 = 0, null, concat('t', id)) AS t", "array(id, id + 1) AS a", "named_struct('x', id) AS s").repartition(4)
    back = committed.write_committed(rows, path)
    assert back.dtypes == rows.dtypes and back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    assert len(files(tmp_path / "t")) == 5
    with pytest.raises(Exception, match="never overwritten"):
        committed.write_committed(rows, path)
    none = committed.write_committed(rows.where("id < 0"), f"file://{tmp_path}/none")
    assert none.count() == 0 and none.columns == rows.columns


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    bad = spark.range(0, 400, 1, 4).select("id", F.when(F.col("id") == 399, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("t"))
    with pytest.raises(Exception, match="no"):
        committed.write_committed(bad, path)
    assert files(tmp_path) == []
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, path)


def test_a_part_that_changes_before_the_commit_is_found(spark, tmp_path, monkeypatch):
    path, check = f"file://{tmp_path}/t", committed.changed_parts

    def spoiled(spark, path, manifest):
        name = tmp_path / "t" / manifest["parts"][0]["file"]
        raw = bytearray(name.read_bytes())
        raw[len(raw) // 2] ^= 1
        name.write_bytes(raw)
        return check(spark, path, manifest)

    monkeypatch.setattr(committed, "changed_parts", spoiled)
    with pytest.raises(OSError, match="doesn't hold"):
        committed.write_committed(spark.range(100), path)
    assert files(tmp_path) == []


def bundle(spark, n=20_000):
    return spark.range(n).select(F.col("id").cast("string").alias("ids"), "id", F.array(F.col("id") * 0.5, F.lit(1.0)).cast("array<float>").alias("v"))


def test_bundles_are_read_by_ranges(spark, tmp_path):
    path = f"{tmp_path}/b"
    array_files.write_bundles(bundle(spark).repartition(2), path, {"from": "test"}, rows_per_file=9_000)
    got = array_files.read_bundles(spark, path, ("ids", "v"), rows=4096)
    assert dict(got.dtypes) == {"ids": "string", "id": "bigint", "v": "array<float>"}
    assert got.rdd.getNumPartitions() >= 6 and len([f for f in files(path) if f.endswith("npz")]) == 4
    assert got.exceptAll(bundle(spark)).isEmpty() and got.count() == 20_000
    with pytest.raises(Exception, match="missing arrays"):
        array_files.read_bundles(spark, path, ("absent",)).count()
    with pytest.raises(FileExistsError):
        array_files.write_bundles(bundle(spark), path, {})


def test_a_changed_byte_is_an_error(spark, tmp_path):
    path = f"{tmp_path}/b"
    array_files.write_bundles(bundle(spark, 5_000).coalesce(1), path, {})
    name = next(p for p in (tmp_path / "b").iterdir() if p.suffix == ".npz")
    raw = bytearray(name.read_bytes())
    at = raw.rfind(np.float32(2499.0).tobytes() + np.float32(1.0).tobytes())
    raw[at] ^= 1
    name.write_bytes(raw)
    with pytest.raises(Exception, match="provenance"):
        array_files.read_bundles(spark, path).count()


def test_other_array_files(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(12, dtype=np.int16).reshape(6, 2))
    got = array_files.read_bundles(spark, f"{tmp_path}/x.npy")
    assert [r.x for r in got.collect()] == [[2 * k, 2 * k + 1] for k in range(6)]
    np.savez_compressed(tmp_path / "z.npz", a=np.arange(9000), b=np.array(["é" * (k % 3) for k in range(9000)]))
    got = array_files.read_bundles(spark, f"{tmp_path}/z.npz", rows=4096)
    assert got.rdd.getNumPartitions() == 3 and got.where("length(b) = a % 3").count() == 9000
    np.savez(tmp_path / "bad.npz", a=np.arange(3), b=np.arange(4))
    with pytest.raises(Exception, match="no table"):
        array_files.read_bundles(spark, f"{tmp_path}/bad.npz").count()
    np.save(tmp_path / "o.npy", np.array([{}]), allow_pickle=True)
    with pytest.raises(Exception, match="plain values"):
        array_files.read_bundles(spark, f"{tmp_path}/o.npy").count()


def test_features_are_held_against_their_hash(spark, tmp_path):
    store = f"{tmp_path}/store"
    rows = spark.range(50).selectExpr("cast(id as string) AS sample_id", "array(id * 0.25D) AS features")
    sinks.write_features(rows, store, "clip", "news", "clean", {})
    assert sinks.verified_features(spark, store, "clip", "news", "clean").count() == 50
    rows.limit(1).withColumns({"encoder": F.lit("clip"), "dataset": F.lit("news"), "condition": F.lit("clean")}).write.mode("append").partitionBy("encoder", "dataset", "condition").parquet(store)
    with pytest.raises(OSError, match="provenance"):
        sinks.verified_features(spark, store, "clip", "news", "clean")


def test_archives_are_read_by_members():
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for k in range(40):
            z.writestr(zipfile.ZipInfo(f"{'a' if k % 4 else 'b'}/{k}.txt"), f"content {k} " * 300, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
    whole, fetched = raw.getvalue(), []

    def read(part, start, end):
        fetched.append(end - start)
        return {"p": whole[:5000], "q": whole[5000:]}[part][start:end]

    reader = archives._PushingReader({"z": [("p", 5000), ("q", len(whole) - 5000)]}, read, ".txt", 8_000)
    left = list(reader.pushFilters([StringStartsWith(("member",), "b/"), GreaterThan(("crc",), 5), EqualTo(("content",), b"")]))
    assert len(left) == 2
    parts = reader.partitions()
    assert len(parts) > 2 and sum(fetched) < len(whole) / 2  # the central directory alone
    fetched.clear()
    got = {m: c for p in parts for _, m, _, c in reader.read(p)}
    assert got == {f"b/{k}.txt": (f"content {k} " * 300).encode() for k in range(0, 40, 4)}
    wanted = sum(m[4] for p in parts for m in p.wanted)
    assert sum(fetched) == wanted + 30 * len(got)


def test_a_damaged_member_is_an_error():
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("x.txt", "plain content")
    spoiled = raw.getvalue().replace(b"plain", b"plaim")
    reader = archives._Reader({"z": [("p", len(spoiled))]}, lambda part, a, b: spoiled[a:b], "", 1 << 20)
    with pytest.raises(OSError, match="wrong CRC"):
        list(reader.read(reader.partitions()[0]))
