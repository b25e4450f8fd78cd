"""Scans, writers, images, archives, plug-ins and streams."""

import gzip
import io
import json
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import plugins
from quillmark.operators import neardup, quality
from quillmark.sources import archives, files, images, sinks
from quillmark.streaming import requests


def test_csv_keeps_strings_blanks_quotes_and_order(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('sample_id,text,split\n1,"a, ""b""\nc",train\n2,,test\n')
    rows = files.csv_rows(spark, str(path))
    assert rows.columns == ["sample_id", "text", "split"]
    assert [tuple(r) for r in rows.orderBy("sample_id").collect()] == [("1", 'a, "b"\nc', "train"), ("2", "", "test")]
    assert files.csv_split(spark, str(path), "test").count() == 1
    with pytest.raises(ValueError, match="no rows"):
        files.csv_split(spark, str(path), "val", required=True)
    assert files.id_column(files.caption_rows(spark, str(path))) == "sample_id"
    path.write_text("id,text\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="more than once"):
        files.caption_rows(spark, str(path))


def test_json_shapes(spark, tmp_path):
    (tmp_path / "val.json").write_text(json.dumps([{"text": "a"}, {"text": "b"}]))
    rows = files.json_array(spark, str(tmp_path / "val.json"), "struct<text: string>", "mm").orderBy("ordinal").collect()
    assert [(r.row_id, r.text) for r in rows] == [("mm_val_0", "a"), ("mm_val_1", "b")]
    (tmp_path / "no.json").write_text("{}")
    with pytest.raises(Exception, match="no array"):
        files.json_array(spark, str(tmp_path / "no.json"), "struct<text: string>").collect()
    (tmp_path / "bank.json").write_text(json.dumps({"7": {"caption": "c", "image_path": "p"}, "8": {"caption": "d", "image_path": "q"}}))
    (tmp_path / "a1.json").write_text(json.dumps({"annotations": [{"id": 7, "image_id": 7, "falsified": False}, {"id": 8, "image_id": 9, "falsified": True}]}))
    bank = files.json_map(spark, str(tmp_path / "bank.json"), "struct<caption: string, image_path: string>")
    pristine = files.annotations(spark, str(tmp_path / "a1.json"))
    found = files.matched_candidates(bank, pristine).collect()
    assert [(r.sample_id, r.text, len(r.files)) for r in found] == [("nc_genuine_7", "c", 1)]
    with gzip.open(tmp_path / "l.json.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "l.json.gz"), "a int").agg(F.sum("a")).first()[0] == 3
    for k in (1, 2):
        (tmp_path / f"run_epoch_{k}.csv").write_text("m\n0.5\n")
    assert sorted(r.epoch for r in files.named_files(spark, str(tmp_path / "run_epoch_*.csv"), "_epoch_([0-9]+)", "epoch").collect()) == [1, 2]


def test_dataset_manifest_and_lock(spark, tmp_path):
    rows = spark.createDataFrame([("1", "s", "genuine", "train", "a\nb"), ("2", "s", "ooc", "test", "")], "sample_id string, source string, `group` string, split string, text string")
    path = str(tmp_path / "set")
    manifest = sinks.write_dataset(rows, path)
    assert manifest["rows"] == 2 and sinks.read_json(spark, path + ".manifest") == manifest
    back = files.csv_rows(spark, path)
    assert back.columns == list(sinks.DATASET_COLUMNS) and sinks.content_hash(back) == manifest["hash"]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_dataset(rows, path)
    lock = str(tmp_path / "lock")
    sinks.write_lock(spark, lock, {"threshold": 0.5}, {"rows": rows})
    assert sinks.check_lock(spark, lock, {"rows": rows.repartition(3)})["choices"] == {"threshold": 0.5}
    with pytest.raises(ValueError, match="changed"):
        sinks.check_lock(spark, lock, {"rows": rows.limit(1)})


def test_feature_store_prunes_partitions(spark, tmp_path):
    store = str(tmp_path / "features")
    df = spark.createDataFrame([("1", "train", [1.0])], "sample_id string, split string, features array<double>")
    for c in ("clean", "blur"):
        sinks.write_features(df, store, "clip", "news", c, {"source": "x"})
    rows = files.feature_rows(spark, store, "clip", "news", "blur")
    assert rows.count() == 1
    assert "PartitionFilters: [isnotnull(encoder" in rows._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="test rows"):
        files.development_rows(rows.withColumn("split", F.lit("test")))
    with pytest.raises(ValueError, match="wrong form"):
        files.fusion_bundle(rows.withColumn("scenario", F.lit(1)), {"features": 2}, ("train",))


def test_checked_round_trip_and_rewrite(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "cast(id as double) / 3 AS x")
    assert sinks.write_checked(df, str(tmp_path / "p")).count() == 5
    sinks.append_lines(df, str(tmp_path / "lines"))
    kept = sinks.rewritten_without(spark, str(tmp_path / "lines"), df.where("id < 2"), "id", str(tmp_path / "kept"))
    assert kept.count() == 3


def pgm(values):
    a = np.asarray(values, np.uint8)
    return b"P5\n# c\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def test_images_are_fingerprinted_once_and_never_raise(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.pgm").write_bytes(pgm(rng.integers(0, 255, (16, 18))))
    (tmp_path / "img/b.pgm").write_bytes(b"P5\n9 9\n")
    rows = spark.createDataFrame([(1, "a.pgm", "ooc"), (2, "a.pgm", "ooc"), (3, "b.pgm", "ooc"), (4, "c.pgm", "genuine")], "id long, image_path string, `group` string")
    table = images.image_table(rows, str(tmp_path / "img"))
    found = {r.id: r.info for r in table.collect()}
    assert found[1].ok and found[1].width == 18 and found[1] == found[2]
    assert (found[3].error, found[4].error) == ("corrupt", "missing") and found[3].sha1 and not found[4].sha1
    kept, left = images.usable(table)
    assert kept.count() == 2 and {(r.group, r.reason, r["count"]) for r in left.collect()} == {("ooc", "corrupt_image", 1), ("genuine", "missing_image", 1)}


def test_hash_directions_differ(spark):
    from quillmark.functions.hashes import difference_hash, hex_to_long, long_to_hex

    grey = spark.createDataFrame([([float(k % 9) for k in range(72)],)], "g array<double>")
    r = grey.select(difference_hash(True)("g").alias("up"), difference_hash(False)("g").alias("down")).first()
    assert (r.up, r.down) == (-1, 0)
    assert spark.sql("SELECT 'ff00000000000001' AS h").select(long_to_hex(hex_to_long(F.col("h"))).alias("h")).first().h == "ff00000000000001"


def test_block_dct_equals_the_literal_sum(spark):
    from quillmark.functions.hashes import block_dct

    g = np.random.default_rng(3).uniform(0, 255, (16, 16))
    found = np.array(spark.createDataFrame([(g.reshape(-1).tolist(),)], "g array<double>").select(block_dct("g")).first()[0]).reshape(16, 16)

    def dct(tile):
        n = len(tile)
        out = np.zeros((n, n))
        for u in range(n):
            for v in range(n):
                a = [np.sqrt((1 if k == 0 else 2) / n) for k in (u, v)]
                out[u, v] = a[0] * a[1] * sum(tile[x, y] * np.cos(np.pi * (2 * x + 1) * u / (2 * n)) * np.cos(np.pi * (2 * y + 1) * v / (2 * n)) for x in range(n) for y in range(n))
        return np.log(np.abs(out) + 1e-8)

    eight = np.block([[dct(g[:8, :8]), dct(g[:8, 8:])], [dct(g[8:, :8]), dct(g[8:, 8:])]])
    assert np.allclose(found, (eight + dct(g)) / 2, atol=1e-6)


def test_split_archives_are_read_by_ranges():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(20):
            z.writestr(f"d/{k}.txt", f"content {k} " * 500)
    raw = buffer.getvalue()
    cut = len(raw) // 3
    parts = {"p0": raw[:cut], "p1": raw[cut : 2 * cut], "p2": raw[2 * cut :]}
    failed = set()

    def read(name, a, b):
        if name not in failed:
            failed.add(name)
            raise OSError("once")
        return parts[name][a:b]

    found = {n: c for n, _, c in archives.members([(k, len(v)) for k, v in parts.items()], read, lambda n: n.endswith("7.txt"))}
    assert found == {f"d/{k}.txt": (f"content {k} " * 500).encode() for k in (7, 17)}


class Plugin:
    classes = ("genuine", "ooc", "fake_text_real_image", "real_text_fake_image", "fake_text_fake_image")

    def __call__(self, semantic, image, text):
        return np.tile(np.arange(5.0), (len(text), 1)) + text[:, :1]


def test_plugins_are_checked_and_reordered(spark):
    v = spark.createDataFrame([([0.0], [0.0], [1.0])], "s array<double>, i array<double>, t array<double>")
    out = v.select(plugins.fusion_udf("tests.test_sources:Plugin")("s", "i", "t").alias("p")).first().p
    assert out == [2.0, 3.0, 4.0, 1.0, 5.0]
    with pytest.raises(ValueError, match="permutation"):
        plugins.load_plugin("builtins:dict")
    with pytest.raises(ValueError, match="module:factory"):
        plugins.load_plugin("builtins")


def test_stream_gives_the_verdicts_of_the_batch(spark, tmp_path):
    for k in range(3):
        lines = [{"request_id": f"r{i}", "ts": f"2026-01-01T00:0{k}:0{i}", "text": "x" if i else " ", "score": i / 10} for i in range(k, k + 4)]
        (tmp_path / f"{k}.json").write_text("\n".join(map(json.dumps, lines)))
    stream = requests.verdicts(requests.request_stream(spark, str(tmp_path)), 0.3)
    q = stream.writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = requests.verdicts(spark.read.schema(requests.SCHEMA).json(str(tmp_path)), 0.3)
    got = {(r.request_id, r.verdict, r.reason) for r in spark.sql("SELECT * FROM verdicts").collect()}
    assert got == {(r.request_id, r.verdict, r.reason) for r in batch.collect()} and len(got) == 6


@pytest.mark.parametrize("radius", [0, 2, 4, 12])
def test_banded_pairs_equal_all_pairs(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(2**63), 2**63 - 1, 60, dtype=np.int64)
    near = base ^ np.array([sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 9), replace=False)) for _ in base], np.int64)
    values = np.concatenate([base, near, base[:5]]).tolist()
    want = {(i, j, (values[i] ^ values[j] & 0xFFFFFFFFFFFFFFFF).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if ((values[i] ^ values[j]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius}
    df = spark.createDataFrame(list(enumerate(values)), "id long, fp long")
    assert {(r.left, r.right) for r in neardup.near_pairs(df, radius, "id").collect()} == {(a, b) for a, b, _ in want}


def test_a_tampered_split_is_reported(spark):
    rows = [(str(k), ["ooc", "fake_text_real_image", "real_text_fake_image", "genuine", "fake_text_fake_image"][k % 5], k % 5 + 1, int(k % 5 != 3), "train" if k < 70 else "val" if k < 85 else "test", f"t{k}", f"i{k}") for k in range(100)]
    schema = "sample_id string, `group` string, scenario int, label_binary int, split string, text_key string, image_key string"
    assert quality.verified(spark.createDataFrame(rows, schema)).count() == 0
    rows[0] = (*rows[0][:5], "t99", rows[0][6])
    assert {r.check for r in quality.verified(spark.createDataFrame(rows, schema)).collect()} == {"leak"}


def test_a_served_stream_goes_on_after_a_restart(spark, tmp_path):
    """The first by time wins whatever the order of arrival; copies count, late rows are counted and get no answer."""
    from quillmark.streaming import serving

    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    row = lambda i, minute, text, score: {"request_id": i, "ts": f"2024-01-01T00:{minute:02d}:00.000001Z", "text": text, "score": score}

    def arrive(name, *rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        query = serving.serve(spark, folder, out, checkpoint, lateness_minutes=10)
        query.awaitTermination()
        return serving.late_rows(query)

    assert arrive("1.json", row("a", 5, "x", 0.9), row("b", 5, " ", 0.9), row("c", 5, "x", None), row(None, 5, "x", 0.9)) == 0
    assert arrive("2.json", row("a", 3, "x", 0.1), row("a", 4, "x", 0.9), row("b", 6, "x", 0.9), row("d", 40, "x", 0.9)) == 0
    assert arrive("3.json", row("e", 1, "x", 0.9), row("f", 41, "x", 0.2)) == 1
    got = {r.request_id: (r.verdict, r.reason, r.revision) for r in serving.answers(spark, out, 0.5).collect()}
    assert got == {"a": ("genuine", None, 2), "b": ("rejected", "empty_text", 1), "c": ("rejected", "no_score", 1), "d": ("fake", None, 1), "f": ("genuine", None, 1)}


def test_png_depths_and_damage():
    import struct
    import zlib

    from quillmark.sources import png

    def made(depth, colour, rows, palette=b"", interlaced=0):
        size = len(rows[0]) * 8 // depth if colour in (0, 3) else len(rows[0]) * 8 // depth // png.SAMPLES[colour]
        parts = [(b"IHDR", struct.pack(">IIBBBBB", size, len(rows), depth, colour, 0, 0, interlaced)), *([(b"PLTE", palette)] if palette else []), (b"tEXt", b"note"), (b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))), (b"IEND", b"")]
        return png.SIGNATURE + b"".join(struct.pack(">I", len(c)) + n + c + struct.pack(">I", zlib.crc32(n + c)) for n, c in parts)

    assert png.decode_png(made(1, 0, [b"\xa0"]))[0, :, 0].tolist() == [255, 0, 255, 0, 0, 0, 0, 0]
    assert png.decode_png(made(2, 0, [b"\x1b"]))[0, :, 0].tolist() == [0, 85, 170, 255]
    assert png.decode_png(made(4, 3, [b"\x01"], palette=bytes(range(6)))).tolist() == [[[0, 1, 2], [3, 4, 5]]]
    assert png.decode_png(made(16, 2, [bytes([7, 9, 8, 9, 9, 9])])).tolist() == [[[7, 8, 9]]]
    good = made(8, 0, [b"ab", b"cd"])
    for bad in (good[:-20], good.replace(b"note", b"nite"), made(8, 3, [b"\x05"], palette=bytes(6)), b"\x89PNG", good[:8]):
        with pytest.raises((ValueError, KeyError, zlib.error)):
            png.decode_png(bad)


def test_states_of_many_ids_are_one_table(spark, tmp_path):
    """Calls of the stream's function are as many as buckets, not ids; the answers are those of each id alone, in two batches."""
    from quillmark.streaming import serving

    folder, out, checkpoint = (str(tmp_path / n) for n in ("requests", "answers", "checkpoint"))
    rng = np.random.default_rng(3)
    rows = [(f"r{i}", f"2024-01-01T00:{m:02d}:00.{k:06d}Z", None if k == 3 else f"t{k}", None if k == 5 else k / 10) for i in range(3000) for m, k in zip(rng.integers(0, 3, 3).tolist(), rng.integers(0, 10, 3).tolist(), strict=True)]
    revisions: dict = {}
    for half in (rows[::2], rows[1::2]):
        spark.createDataFrame(half, "request_id string, ts string, text string, score double").coalesce(1).write.mode("append").json(folder)
        serving.serve(spark, folder, out, checkpoint, lateness_minutes=60).awaitTermination()
        now = {}
        for r in rows[::2] if half == rows[::2] else rows:
            key = (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or 0.0)
            now[r[0]] = min(now.get(r[0], (key, r)), (key, r), key=lambda x: x[0])
        for i, (key, _) in now.items():
            if revisions.get(i, (None, 0))[0] != key:
                revisions[i] = key, revisions.get(i, (None, 0))[1] + 1
    got = {r.request_id: r for r in serving.answers(spark, out, 0.5).collect()}
    assert set(got) == set(now)
    for i, (key, r) in now.items():
        reason = "empty_text" if r[2] is None else "no_score" if r[3] is None else None
        assert (got[i].reason, got[i].verdict, got[i].revision) == (reason, "rejected" if reason else "fake" if r[3] >= 0.5 else "genuine", revisions[i][1])
    copies = spark.read.schema(serving.ANSWER).parquet(out).groupBy("request_id").agg({"copies": "max"}).collect()
    assert max(c[1] for c in copies) == 3


def test_volumes_and_dealt_tables_grow_in_number_not_in_size(spark, small, monkeypatch):
    """More documents give more volumes and partitions; the members and the lock stay the same."""
    from quillmark import queries_files

    want = sorted(map(tuple, queries_files.archive_documents(spark, small).collect()))
    monkeypatch.setattr(queries_files, "VOLUME_ROWS", 20)
    monkeypatch.setattr(queries_files, "DEALT_ROWS", 20)
    sizes = []
    monkeypatch.setattr(queries_files, "_new", lambda spark, name, own=queries_files._new: sizes.append(own(spark, name)) or sizes[-1])
    assert sorted(map(tuple, queries_files.archive_documents(spark, small).collect())) == want
    volumes = {p.name.rsplit(".", 1)[0] for p in Path(sizes[-1].removeprefix("file://")).iterdir() if "~" in p.name}
    documents = spark.read.parquet(f"{small}/documents.parquet")
    assert len(volumes) > documents.select("lang").distinct().count()
    assert queries_files._dealt(documents).rdd.getNumPartitions() == -(-documents.count() // 20) > 3
    assert queries_files.lock_check(spark, small).first().changed_found


def test_the_nearest_neighbour_is_the_first_of_equals():
    """Without the distances' list and key function, the same choice for all neighbours, ties included."""
    from quillmark.sources import png

    for left, above, corner in np.random.default_rng(2).integers(0, 6, (500, 3)).tolist() + [[255, 0, 255], [0, 255, 0]]:
        assert png._nearest(left, above, corner) == min((left, above, corner), key=lambda x: abs(left + above - corner - x))
