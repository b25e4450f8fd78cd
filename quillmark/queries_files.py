"""Queries of scans, writers, stores, images, plug-ins and audits: tables written to the shared folder, read back by the operator.

Fixture files are made from the whole tables. The SQL reads the tables themselves, so it knows nothing of
how they were written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillmark.functions import arrays, hashes, models, plugins
from quillmark.operators import audits, filters, neardup, quality
from quillmark.plans.fixtures import SCORED_SQL, scored
from quillmark.plans.staging import new_path as _new
from quillmark.sources import archives, array_files, committed, files, images, png, sinks, stores
from quillmark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _md5(column: str):
    return F.md5(F.col(column).cast("binary"))


def _rows(spark, folder):
    """Documents as records of a data set; each seventh text is blank."""
    d = scored(spark, folder).join(table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")).alias("text")), "doc_id")
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "val").otherwise("train")
    return d.select(F.col("doc_id").cast("string").alias("sample_id"), "doc_id", "source", F.lit("genuine").alias("group"), split.alias("split"), "text", "label", "scenario", "lang")


_SPLIT = "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END"
_TEXT = "CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END"


# --- CSV


@query("csv_scan", f"SELECT CAST(doc_id AS VARCHAR) AS sample_id, {_SPLIT} AS split, '' AS rule, md5({_TEXT}) AS text_md5 FROM documents")
def csv_scan(spark, folder):
    """A data set written with its fixed columns and read back, every value a string, blanks kept, line breaks and quotes whole."""
    path = _new(spark, "csv")
    sinks.write_dataset(_rows(spark, folder), path)
    return files.csv_rows(spark, path).select("sample_id", "split", "rule", _md5("text").alias("text_md5"))


@query("csv_manifest", f"SELECT {_SPLIT} AS split, source, count(*) AS n FROM documents GROUP BY 1, 2")
def csv_manifest(spark, folder):
    path = _new(spark, "csv")
    sinks.write_dataset(_rows(spark, folder), path)
    return spark.createDataFrame([(split, source, n) for _, split, source, n in sinks.read_json(spark, f"{path}.manifest")["counts"]], "split string, source string, n long")


@query("csv_split_scan", f"SELECT CAST(doc_id AS VARCHAR) AS sample_id, md5({_TEXT}) AS text_md5 FROM documents WHERE {_SPLIT} = 'val'")
def csv_split_scan(spark, folder):
    path = _new(spark, "csv")
    sinks.write_dataset(_rows(spark, folder), path)
    return files.csv_split(spark, path, "val", required=True).select("sample_id", _md5("text").alias("text_md5"))


@query("caption_scan", f"SELECT 'sample_id' AS id_column, CAST(doc_id AS VARCHAR) AS id, length({_TEXT}) AS n FROM documents WHERE {_SPLIT} = 'train'")
def caption_scan(spark, folder):
    path = _new(spark, "csv")
    sinks.write_dataset(_rows(spark, folder), path)
    rows = files.caption_rows(spark, path, "train")
    return rows.select(F.lit(files.id_column(rows)).alias("id_column"), F.col(files.id_column(rows)).alias("id"), F.length("text").cast("long").alias("n"))


@query("named_files_scan", "SELECT doc_id % 3 AS epoch, count(*) AS n, sum(doc_id) AS ids FROM documents GROUP BY 1")
def named_files_scan(spark, folder):
    """Files whose folder names carry the epoch."""
    base = _new(spark, "epochs")
    d = table(spark, folder, "documents").select("doc_id")
    for k in range(3):
        d.where(F.col("doc_id") % 3 == k).write.csv(f"{base}/run_epoch_{k}", header=True)
    rows = files.named_files(spark, f"{base}/run_epoch_*", r"_epoch_([0-9]+)", "epoch")
    return rows.groupBy(F.col("epoch").cast("long").alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id").cast("long")).alias("ids"))


# --- JSON


#: Items of one JSON file of a fixture.
ITEMS = 50


def _json_files(items, value, place: str, prefix: str = "part-") -> str:
    """Writes `value`, an aggregate over up to `ITEMS` items, as files named by `prefix` and their number."""
    parts = items.groupBy(F.floor(F.col("item_id") / ITEMS).alias("part")).agg(value.alias("content"))
    stores.write_files(parts.withColumn("name", F.concat(F.lit(prefix), F.col("part").cast("string"), F.lit(".json"))), place)
    return place


@query("json_array_scan", "SELECT 'mm_part-' || item_id // 50 || '_' || k AS row_id, k AS ordinal, md5(text) AS text_md5 FROM (SELECT item_id, text, row_number() OVER (PARTITION BY item_id // 50 ORDER BY item_id) - 1 AS k FROM benchmark)")
def json_array_scan(spark, folder):
    """The benchmark as arrays in files of 50 items; ids are made of the file's name and the place in its array."""
    array = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda r: F.struct(r["text"].alias("text"))))
    path = _json_files(table(spark, folder, "benchmark"), array, _new(spark, "array"))
    return files.json_array(spark, path, "struct<text: string>", "mm").select("row_id", F.col("ordinal").cast("long").alias("ordinal"), _md5("text").alias("text_md5"))


def _annotation_files(items, place: str, prefix: str = "part-") -> str:
    mark = F.struct(F.col("item_id").alias("id"), F.col("item_id").alias("image_id"), (F.col("item_id") % 5 == 0).alias("falsified"))
    return _json_files(items, F.to_json(F.struct(F.collect_list(mark).alias("annotations"))), place, prefix)


@query("annotation_scan", "SELECT CAST(item_id AS VARCHAR) AS id, CAST(item_id AS VARCHAR) AS image_id, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 1 END AS files FROM benchmark WHERE item_id % 5 <> 0")
def annotation_scan(spark, folder):
    """Each fifth annotation is falsified; each third stands in two files."""
    b, place = table(spark, folder, "benchmark"), _new(spark, "annotations")
    _annotation_files(b, place)
    _annotation_files(b.where("item_id % 3 = 0"), place, "again-")
    return files.annotations(spark, place).select("id", "image_id", F.size("files").cast("long").alias("files"))


@query("matched_candidates", "SELECT 'nc_genuine_' || item_id AS sample_id, md5(text) AS text_md5, 'newsclippings' AS source, 'img/' || item_id AS image_path FROM benchmark WHERE item_id % 5 <> 0")
def matched_candidates(spark, folder):
    """A bank of captions by id, joined with what isn't falsified."""
    b = table(spark, folder, "benchmark")
    record = F.struct(F.col("text").alias("caption"), F.concat(F.lit("img/"), "item_id").alias("image_path"))
    bank = _json_files(b, F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("item_id").cast("string"), record)))), _new(spark, "bank"))
    found = files.matched_candidates(files.json_map(spark, bank, "struct<caption: string, image_path: string>"), files.annotations(spark, _annotation_files(b, _new(spark, "annotations"))))
    return found.select("sample_id", _md5("text").alias("text_md5"), "source", "image_path")


@query("json_lines_scan", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents")
def json_lines_scan(spark, folder):
    path = _new(spark, "lines")
    table(spark, folder, "documents").write.json(path)
    return files.json_lines(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", _md5("text").alias("text_md5"))


@query("json_lines_gz_scan", "SELECT doc_id, source, md5(text) AS text_md5 FROM documents")
def json_lines_gz_scan(spark, folder):
    path = _new(spark, "lines-gz")
    table(spark, folder, "documents").write.option("compression", "gzip").json(path)
    return files.json_lines(spark, path, "doc_id long, source string, text string").select("doc_id", "source", _md5("text").alias("text_md5"))


@query("class_annotations", "SELECT 'DGM4/' || lang || '/' || doc_id AS image, CASE doc_id % 4 WHEN 0 THEN 'orig' WHEN 1 THEN 'face_swap' ELSE 'face_attribute' END AS fake_cls, n_chars AS area FROM documents WHERE doc_id % 4 < 3")
def class_annotations(spark, folder):
    """Annotations of three classes by image; the fourth class is left out."""
    d = table(spark, folder, "documents")
    names = F.element_at(F.array(*map(F.lit, ("orig", "face_swap", "face_attribute", "text_swap"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = _new(spark, "classes")
    d.select(F.concat_ws("/", F.lit("DGM4"), "lang", F.col("doc_id").cast("string")).alias("image"), names.alias("fake_cls"), F.col("n_chars").alias("area")).write.json(path)
    return files.class_annotations(spark, path, "image string, fake_cls string, area long")


# --- stores and writers


@query("feature_store_scan", "SELECT CAST(vec_id AS VARCHAR) AS sample_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings WHERE vec_id % 10 <> 0")
def feature_store_scan(spark, folder):
    """Two conditions of a store; one is read, and holds no test rows."""
    store = _new(spark, "features")
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.lit("train").alias("split"), arrays.doubles(F.col("embedding")).alias("features"), "vec_id").where("vec_id % 10 <> 0").drop("vec_id")
    for condition in ("clean", "blur"):
        sinks.write_features(e, store, "clip", "news", condition, {"source": folder})
    rows = files.development_rows(files.feature_rows(spark, store, "clip", "news", "clean"))
    return rows.select("sample_id", F.round(arrays.total(F.col("features")), 5).alias("total"))


@query("fusion_bundle_scan", "SELECT CAST(vec_id AS VARCHAR) AS sample_id, vec_id % 5 + 1 AS scenario FROM embeddings WHERE vec_id % 4 <> 0")
def fusion_bundle_scan(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.when(F.col("vec_id") % 4 == 0, "test").otherwise("train").alias("split"), (F.col("vec_id") % 5 + 1).alias("scenario"), arrays.doubles(F.col("embedding")).alias("pair"))
    return files.fusion_bundle(e, {"pair": 64}, ("train", "val")).select("sample_id", "scenario")


@query("verified_features", "SELECT CAST(vec_id AS VARCHAR) AS sample_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def verified_features(spark, folder):
    """One condition of a store, its rows held against the hash that was stored with them."""
    store = _new(spark, "features")
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), arrays.doubles(F.col("embedding")).alias("features"))
    sinks.write_features(e, store, "clip", "news", "clean", {"source": folder})
    rows = sinks.verified_features(spark, store, "clip", "news", "clean")
    return rows.select("sample_id", F.round(arrays.total(F.col("features")), 5).alias("total"))


@query("array_bundle_scan", "SELECT CAST(vec_id AS VARCHAR) AS sample_ids, CASE WHEN vec_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, CAST(vec_id % 5 + 1 AS BIGINT) AS scenario, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def array_bundle_scan(spark, folder):
    """Vectors written as bundles of arrays with provenance, read back by row ranges, every block held against its hash."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("sample_ids"), F.when(F.col("vec_id") % 4 == 0, "test").otherwise("train").alias("split"), (F.col("vec_id") % 5 + 1).alias("scenario"), F.col("embedding").cast("array<float>").alias("semantic"))
    path = _new(spark, "bundle")
    array_files.write_bundles(e, path, {"source": folder})
    rows = array_files.read_bundles(spark, path, ("sample_ids", "split", "scenario", "semantic"), rows=array_files.BLOCK)
    return rows.select("sample_ids", "split", "scenario", F.round(arrays.total(arrays.doubles(F.col("semantic"))), 5).alias("total"))


@query("committed_write", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def committed_write(spark, folder):
    rows = table(spark, folder, "documents").repartition(8, "doc_id")
    return committed.write_committed(rows, _new(spark, "committed")).select("doc_id", _md5("text").alias("text_md5"), "lang")


@query("checked_write", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def checked_write(spark, folder):
    back = sinks.write_checked(table(spark, folder, "documents"), _new(spark, "checked"))
    return back.select("doc_id", _md5("text").alias("text_md5"))


@query("lines_rewritten", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 'again' FROM labels WHERE toxic = 0")
def lines_rewritten(spark, folder):
    """Lines appended twice, then written anew without quarantined ids."""
    path = _new(spark, "appended")
    marks = table(spark, folder, "labels")
    sinks.append_lines(table(spark, folder, "documents").select("doc_id", "lang"), path)
    sinks.append_lines(marks.where("toxic = 0").select("doc_id", F.lit("again").alias("lang")), path)
    return sinks.rewritten_without(spark, path, marks.where("toxic = 1"), "doc_id", _new(spark, "rewritten")).select("doc_id", "lang")


@query("overwrite_refused", "SELECT true AS refused, count(*) AS n FROM documents")
def overwrite_refused(spark, folder):
    """A second write to the same place fails and leaves the first as it was."""
    from pyspark.errors import AnalysisException

    path, rows, refused = _new(spark, "once"), _rows(spark, folder), False
    sinks.write_dataset(rows, path)
    try:
        sinks.write_dataset(rows.limit(1), path)
    except AnalysisException:
        refused = True
    return files.csv_rows(spark, path).agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


@query("wide_predictions", f"WITH {SCORED_SQL} SELECT doc_id AS sample_id, label AS v1_true, round(prob, 6) AS v1_prob, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS v1_pred FROM scored")
def wide_predictions(spark, folder):
    """Two heads, of which one scored a subset and is left out."""
    s = scored(spark, folder).withColumnRenamed("doc_id", "sample_id")
    head = s.select("sample_id", F.col("label").alias("truth"), "prob", (F.col("prob") >= 0.5).cast("int").alias("pred"))
    return sinks.wide_predictions(s.select("sample_id"), {"v1": head, "part": head.where("sample_id % 2 = 0")})


#: Rows of a partition when a table is dealt anew.
DEALT_ROWS = 1 << 14


def _dealt(rows):
    """The rows in another order and in other partitions, more of them as the table grows."""
    return rows.repartition(max(3, -(-rows.count() // DEALT_ROWS)))


@query("lock_check", "SELECT 0.5 AS threshold, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, true AS changed_found")
def lock_check(spark, folder):
    """A lock over two inputs holds while they are as they were; the number of rows is part of each hash."""
    path = _new(spark, "lock")
    inputs = {"documents": table(spark, folder, "documents"), "labels": table(spark, folder, "labels")}
    sinks.write_lock(spark, path, {"threshold": 0.5}, inputs)
    lock = sinks.check_lock(spark, path, {k: _dealt(v) for k, v in inputs.items()})
    try:
        sinks.check_lock(spark, path, inputs | {"labels": inputs["labels"].where("toxic = 0")})
        found = False
    except ValueError:
        found = True
    n = {k: int(v.split(":")[0]) for k, v in lock["inputs"].items()}
    return spark.createDataFrame([(float(lock["choices"]["threshold"]), n["documents"], n["labels"], found)], "threshold double, documents long, labels long, changed_found boolean")


class _Regions(archives.ArchiveSource):
    """One archive a region, cut into two parts, whose members are its nations."""

    cut: dict = {}

    @classmethod
    def name(cls) -> str:
        return "quillmark_regions"

    def archives(self) -> dict:
        return {name: [(f"{name}/0", len(a)), (f"{name}/1", len(b))] for name, (a, b) in self.cut.items()}

    def transport(self):
        parts = {f"{name}/{k}": part for name, both in self.cut.items() for k, part in enumerate(both)}
        return lambda part, start, end: parts[part][start:end]


@query("archive_members", "SELECT r.r_name AS archive, 'nations/' || n.n_nationkey || '.txt' AS member, md5(n.n_name) AS content_md5 FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def archive_members(spark, folder):
    import io
    import zipfile

    named = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey", "n_name").orderBy("n_nationkey").collect()
    cut = {}
    for region in sorted({r.r_name for r in named}):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for r in named:
                if r.r_name == region:
                    z.writestr(f"nations/{r.n_nationkey}.txt", r.n_name)
                    z.writestr(f"other/{r.n_nationkey}.bin", "x")
        whole = raw.getvalue()
        cut[region] = (whole[: len(whole) // 3], whole[len(whole) // 3 :])
    source = type("Regions", (_Regions,), {"cut": cut})
    spark.dataSource.register(source)
    found = spark.read.format("quillmark_regions").option("suffix", ".txt").load()
    return found.select("archive", "member", _md5("content").alias("content_md5"))


class _Folders(archives.ArchiveSource):
    """Archives of documents by language, in volumes that are each cut into two parts in the shared folder, and read there by ranges."""

    @classmethod
    def name(cls) -> str:
        return "quillmark_folders"

    def archives(self) -> dict:
        store, root = stores.opened(self.options["folder"])
        size = lambda name: store.get_file_info(f"{root}/{name}").size
        names = sorted({f.rsplit("/", 1)[-1].rsplit(".", 1)[0] for f in stores.listed(self.options["folder"], (".0", ".1"))})
        return {n: [(f"{n}.{k}", size(f"{n}.{k}")) for k in (0, 1)] for n in names}

    def transport(self):
        folder = self.options["folder"]

        def read(part: str, start: int, end: int) -> bytes:
            store, root = stores.opened(folder)
            with store.open_input_file(f"{root}/{part}") as file:
                return file.read_at(end - start, start)

        return read


#: Documents of all languages that share a volume's number, about.
VOLUME_ROWS = 1 << 13


def _write_archives(folder: str):
    """Writes the rows of a group (lang, volume) as an archive of a member for each, cut in two."""
    import io
    import zipfile

    import pyarrow as pa

    def run(rows: pa.Table) -> pa.Table:
        raw, lang, volume = io.BytesIO(), rows.column("lang")[0].as_py(), rows.column("volume")[0].as_py()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                z.writestr(f"{'a' if doc_id % 3 else 'b'}/{doc_id}.txt", text)
        store, root = stores.opened(folder)
        store.create_dir(root, recursive=True)
        whole = raw.getbuffer()
        for k, half in enumerate((whole[: len(whole) // 3], whole[len(whole) // 3 :])):
            with store.open_output_stream(f"{root}/{lang}~{volume}.{k}") as out:
                out.write(half)
        return pa.table({"lang": [lang]})

    return run


@query("archive_documents", "SELECT coalesce(lang, 'none') AS archive, 'b/' || doc_id || '.txt' AS member, md5(coalesce(text, '')) AS content_md5 FROM documents WHERE doc_id % 3 = 0")
def archive_documents(spark, folder):
    """All documents in archives by language, in volumes of bounded size; the members of one folder are asked for, and only they are fetched, a volume by several tasks."""
    place = _new(spark, "archives")
    rows = table(spark, folder, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    volumes = -(-rows.count() // VOLUME_ROWS)
    dealt = rows.withColumn("volume", F.pmod(F.xxhash64("doc_id"), F.lit(max(volumes, 1)).cast("long")))
    dealt.groupBy("lang", "volume").applyInArrow(_write_archives(place), "lang string").count()
    spark.dataSource.register(_Folders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("quillmark_folders").option("folder", place).option("bytes", 1 << 16).option("pushdown", "true").load()
    return found.where(F.col("member").startswith("b/")).select(F.regexp_replace("archive", "~[0-9]+$", "").alias("archive"), "member", _md5("content").alias("content_md5"))


# --- images and hashes


def _grey(spark, folder):
    """72 grey values of each document: the hexadecimal digits of its text's digest, as codes, again and again."""
    d = table(spark, folder, "documents").select("doc_id", F.rpad(F.sha2(F.col("text").cast("binary"), 256), 64, "0").alias("h"))
    return d.select("doc_id", F.concat("h", F.substring("h", 1, 8)).alias("g"))


_GREY_SQL = "g AS (SELECT doc_id, sha256(text) || substr(sha256(text), 1, 8) AS g FROM documents), p AS (SELECT doc_id, g, list_transform(range(1, 73), lambda i: ascii(g[i])) AS v FROM g)"
_HASH_SQL = "CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN v[i // 8 * 9 + i % 8 + 1] {sign} v[i // 8 * 9 + i % 8 + 2] THEN (CASE WHEN i = 0 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << (63 - i)::INTEGER END) ELSE CAST(0 AS HUGEINT) END)) AS BIGINT)"


@query("difference_hashes", f"WITH {_GREY_SQL} SELECT doc_id, {_HASH_SQL.format(sign='>')} AS falling, {_HASH_SQL.format(sign='<')} AS rising FROM p")
def difference_hashes(spark, folder):
    g = _grey(spark, folder).select("doc_id", F.transform(F.filter(F.split("g", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double")).alias("grey"))
    return g.select("doc_id", hashes.difference_hash(False)("grey").alias("falling"), hashes.difference_hash(True)("grey").alias("rising"))


@query("image_fingerprints", f"WITH {_GREY_SQL} SELECT doc_id, doc_id % 9 <> 0 AS ok, CASE WHEN doc_id % 9 = 0 THEN 'corrupt' END AS error, sha256(CASE WHEN doc_id % 9 = 0 THEN 'no image' ELSE 'P5' || chr(10) || '9 8' || chr(10) || '255' || chr(10) || g END) AS sha256, CASE WHEN doc_id % 9 <> 0 THEN 'PGM' END AS format, CASE WHEN doc_id % 9 <> 0 THEN 9 END AS width, CASE WHEN doc_id % 9 <> 0 THEN {_HASH_SQL.format(sign='>')} END AS dhash FROM p")
def image_fingerprints(spark, folder):
    """Grey images of 9 x 8 made from the documents; each ninth is no image."""
    content = F.when(F.col("doc_id") % 9 == 0, F.lit("no image")).otherwise(F.concat(F.lit("P5\n9 8\n255\n"), "g")).cast("binary")
    i = _grey(spark, folder).select("doc_id", images.fingerprint_udf()(content).alias("i"))
    return i.select("doc_id", "i.ok", "i.error", "i.sha256", "i.format", F.col("i.width").cast("long").alias("width"), "i.dhash")


def _as_png():
    """(doc_id, 72 grey values) -> a PNG of 9 x 8: the colour type, the rows' filters and the interlace by turns of doc_id."""
    def nearest(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
        """Of three neighbours the one nearest to left + above - corner, the first of equals, for a row at once."""
        of = np.stack([left, above, corner])
        return np.take_along_axis(of, np.abs(left + above - corner - of).argmin(axis=0)[None], 0)[0]

    def filtered(rows: np.ndarray, step: int, turn: int) -> bytes:
        """Rows of bytes, filtered by the five kinds in turn; of averages and nearest neighbours each byte for itself."""
        out = b""
        for k, row in enumerate(rows.astype(int)):
            kind, above = (turn + k) % 5, rows[k - 1].astype(int) if k else np.zeros(rows.shape[1], int)
            left, corner = (np.concatenate([np.zeros(step, int), x])[: len(row)] for x in (row, above))
            guess = (0, left, above, (left + above) // 2, nearest(left, above, corner) if kind == 4 else 0)[kind]
            out += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        return out

    def one(doc_id: int, grey) -> bytes:
        g, colour = np.array(grey, np.uint8).reshape(8, 9), (0, 2, 3, 4, 6)[doc_id % 5]
        alpha = np.full_like(g, 200)
        pixels = np.stack({0: [g], 2: [g] * 3, 3: [255 - g], 4: [g, alpha], 6: [g, g, g, alpha]}[colour], axis=2)
        n, interlaced = pixels.shape[2], doc_id % 2
        cut = [pixels[y::d, x::r] for x, y, r, d in png.PASSES] if interlaced else [pixels]
        data = b"".join(filtered(p.reshape(len(p), -1), n, doc_id) for p in cut if p.size)
        palette = [(b"PLTE", bytes(v for k in range(256) for v in [255 - k] * 3))] if colour == 3 else []
        packed = zlib.compress(data)
        parts = [(b"IHDR", struct.pack(">IIBBBBB", 9, 8, 8, colour, 0, 0, interlaced)), *palette, (b"IDAT", packed[:20]), (b"IDAT", packed[20:]), (b"IEND", b"")]
        return png.SIGNATURE + b"".join(struct.pack(">I", len(c)) + name + c + struct.pack(">I", zlib.crc32(name + c)) for name, c in parts)

    @F.pandas_udf("binary")
    def run(doc_id: pd.Series, grey: pd.Series) -> pd.Series:
        return pd.Series([one(d, g) for d, g in zip(doc_id, grey, strict=True)], dtype=object)

    return run


@query("png_fingerprints", f"WITH {_GREY_SQL} SELECT doc_id, true AS ok, 'PNG' AS format, CAST(9 AS BIGINT) AS width, {_HASH_SQL.format(sign='>')} AS dhash FROM p")
def png_fingerprints(spark, folder):
    """PNG files of all documents in five colour types, with all row filters, half of them interlaced: the fingerprints of their pixels."""
    values = F.transform(F.filter(F.split("g", ""), lambda c: c != ""), lambda c: F.ascii(c))
    i = _grey(spark, folder).select("doc_id", images.fingerprint_udf()(_as_png()("doc_id", values)).alias("i"))
    return i.select("doc_id", "i.ok", "i.format", F.col("i.width").cast("long").alias("width"), "i.dhash")


@query("usable_images", "SELECT lang AS \"group\", 'corrupt_image' AS reason, count(*) AS n FROM documents WHERE doc_id % 9 = 0 GROUP BY lang UNION ALL SELECT lang, 'missing_image', count(*) FROM documents WHERE doc_id % 9 = 1 GROUP BY lang")
def usable_images(spark, folder):
    state = F.when(F.col("doc_id") % 9 == 0, "corrupt").when(F.col("doc_id") % 9 == 1, "missing")
    rows = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("group"), F.struct(state.isNull().alias("ok"), state.alias("error")).alias("info"))
    return images.usable(rows)[1].withColumnRenamed("count", "n")


@query("block_dct_energy", "SELECT vec_id, true AS finite FROM embeddings")
def block_dct_energy(spark, folder):
    """Every vector as a tile that is laid out four times over 16 x 16; its map has 256 finite values."""
    e = table(spark, folder, "embeddings").select("vec_id", F.flatten(F.array_repeat(arrays.doubles(F.col("embedding")), 4)).alias("g"))
    return e.select("vec_id", hashes.block_dct("g").alias("m")).select("vec_id", ((F.size("m") == 256) & arrays.all_finite(F.col("m"))).alias("finite"))


def _dct_sql(n: int) -> str:
    """Coefficients of blocks of n x n by rows, then by columns, as their logarithms."""
    return f"""b{n} AS (SELECT u, x, cos(pi() * (2 * x + 1) * u / {2 * n}) * sqrt(2.0::DOUBLE / {n}) * CASE WHEN u = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END AS b FROM range({n}) a(u), range({n}) c(x)),
r{n} AS (SELECT g.vec_id, g.r // {n} * {n} + b.u AS r, g.c, sum(b.b * g.v) AS v FROM g JOIN b{n} b ON b.x = g.r % {n} GROUP BY 1, 2, 3),
m{n} AS (SELECT g.vec_id, g.r, g.c // {n} * {n} + b.u AS c, ln(abs(sum(b.b * g.v)) + 1e-8) AS v FROM r{n} g JOIN b{n} b ON b.x = g.c % {n} GROUP BY 1, 2, 3)"""


@query("block_dct_values", f"WITH e AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), g AS (SELECT vec_id, k * 4 + i // 16 AS r, i % 16 AS c, v FROM e, range(4) t(k)), {_dct_sql(8)}, {_dct_sql(16)} SELECT a.vec_id, round(avg((a.v + b.v) / 2), 4) AS mean, round(avg((a.v + b.v) / 2 * (a.r * 16 + a.c)), 2) AS mark FROM m8 a JOIN m16 b ON a.vec_id = b.vec_id AND a.r = b.r AND a.c = b.c GROUP BY a.vec_id")
def block_dct_values(spark, folder):
    """The same map's mean, and its mean weighed by place, of every vector."""
    e = table(spark, folder, "embeddings").select("vec_id", F.flatten(F.array_repeat(arrays.doubles(F.col("embedding")), 4)).alias("g"))
    m = e.select("vec_id", hashes.block_dct("g").alias("m"))
    return m.select("vec_id", F.round(arrays.total(F.col("m")) / 256, 4).alias("mean"), F.round(arrays.total(F.transform("m", lambda x, i: x * i)) / 256, 2).alias("mark"))


# --- encoders and plug-ins


def _mean_encoder():
    return lambda x: x.mean(axis=1, keepdims=True)


@query("encoded_vectors", "SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) + 0.0 AS mean FROM embeddings")
def encoded_vectors(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("image"))
    found = models.encoded(e, _mean_encoder, ["image"], shapes=[[64]])
    return found.select("vec_id", (F.round(F.col("features")[0].cast("double"), 4) + 0.0).alias("mean"))


class MeanFusion:
    """A plug-in: classes in reverse order, all but the last sharing what the mean of the first vector leaves."""

    def __init__(self):
        from quillmark.functions.labels import GROUPS

        self.classes = tuple(reversed(GROUPS))

    def __call__(self, semantic, image, text):
        import numpy as np

        p = 1 / (1 + np.exp(-semantic.sum(axis=1, keepdims=True)))
        return np.hstack([(1 - p) / 4] * 4 + [p])


@query("plugin_fusion", "SELECT vec_id, round(1 / (1 + exp(-list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))))), 4) AS first, 5 AS n FROM embeddings")
def plugin_fusion(spark, folder):
    """Probabilities come back in the order of the groups, whatever the plug-in's own is."""
    fuse = plugins.fusion_udf("quillmark.queries_files:MeanFusion")
    v = arrays.doubles(F.col("embedding"))
    return table(spark, folder, "embeddings").select("vec_id", fuse(v, v, v).alias("p")).select("vec_id", F.round(F.col("p")[0], 4).alias("first"), F.size("p").cast("long").alias("n"))


@query("layer_index", "SELECT vec_id, CASE WHEN vec_id % 13 < 7 THEN vec_id % 13 ELSE 13 - (vec_id % 13 - 6) END AS layer FROM embeddings")
def layer_index(spark, folder):
    """Layers 0 to 6 of 13 states, and -1 to -6 from the end."""
    wanted = [k if k < 7 else 6 - k for k in range(13)]
    layers = F.array(*(F.lit(models.resolve_layer(13, k)) for k in wanted))
    return table(spark, folder, "embeddings").select("vec_id", F.element_at(layers, (F.col("vec_id") % 13 + 1).cast("int")).cast("long").alias("layer"))


@query("verdict_record", f"WITH {SCORED_SQL} SELECT doc_id, round(prob, 4) AS cross_modal, CASE WHEN rough >= 0.4 THEN 'fake' ELSE 'real' END AS image_prediction, 'pending' AS verdict FROM scored")
def verdict_record(spark, folder):
    s = scored(spark, folder)
    record = models.analysis(F.col("rough"), F.col("prob"), F.col("rough"), 0.4, None, ("genuine", "ooc"))
    return s.select("doc_id", record.alias("r")).select("doc_id", F.col("r.modules.cross_modal").alias("cross_modal"), "r.image_prediction", "r.verdict")


# --- filters and audits


@query("where_equal_slice", "SELECT doc_id FROM documents WHERE lang = 'de'")
def where_equal_slice(spark, folder):
    return filters.where_equal(table(spark, folder, "documents").select("doc_id", "lang"), "lang=de").select("doc_id")


@query("split_mask", f"SELECT doc_id FROM documents WHERE {_SPLIT} = 'val'")
def split_mask(spark, folder):
    return filters.of_splits(_rows(spark, folder), ("val",)).select("doc_id")


@query("reused_vectors", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def reused_vectors(spark, folder):
    """The first vector of each label stands for all of its rows."""
    from pyspark.sql import Window

    e = table(spark, folder, "embeddings").select("vec_id", "label", arrays.doubles(F.col("embedding")).alias("v"))
    same = e.withColumn("v", F.first("v").over(Window.partitionBy("label").orderBy("vec_id")))
    return audits.reused_vectors(same, "label", "v", "vec_id").select("label", "n")


@query("dq_required_columns", "SELECT 'missing_column' AS \"check\", c AS key FROM (SELECT unnest(['rule', 'image_sha1']) AS c)")
def dq_required_columns(spark, folder):
    rows = _rows(spark, folder)
    return quality.required(rows, (*rows.columns, "rule", "image_sha1")).select("check", "key")


@query("dq_manifest_cells", "SELECT 'cell_size' AS \"check\", count(*) AS n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) <> 100) UNION ALL SELECT 'duplicate_source', count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(*) > 1)")
def dq_manifest_cells(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.lit("test").alias("split"), "lang", "source", F.col("doc_id").alias("dhash"))
    report = audits.manifest(rows, {"test": 100}, ["lang"], ["source"], radius=0, key="doc_id")
    n = report.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    wanted = spark.createDataFrame([("cell_size",), ("duplicate_source",)], "check string")
    return wanted.join(n, "check", "left").select("check", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("dq_origin", "SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 11 = 0 THEN 'source_split' WHEN doc_id % 13 = 0 THEN 'member_split' ELSE 'member_label' END AS detail FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0")
def dq_origin(spark, folder):
    k = F.col("doc_id")
    label = k % 2
    member = F.concat(F.lit("set/"), F.when(k % 13 == 0, "train").otherwise("val"), F.lit("/"), F.when((label == 0) != (k % 17 == 0), "nature").otherwise("ai"), F.lit("/x.png"))
    rows = table(spark, folder, "documents").select("doc_id", F.lit("test").alias("split"), F.when(k % 11 == 0, "train").otherwise("val").alias("source_split"), label.cast("int").alias("label"), member.alias("member"))
    return audits.origin(rows, {"test": "val"}, "member", {0: "/nature/", 1: "/ai/"}, key="doc_id").select("key", "detail")


@query("dq_new_pairs", "SELECT 'pair_ids' AS \"check\", CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 23 = 0 UNION ALL SELECT 'shared_text_md5', CAST(d.doc_id AS VARCHAR) FROM documents d WHERE md5(d.text) IN (SELECT md5(text) FROM benchmark)")
def dq_new_pairs(spark, folder):
    """Pairs by neighbouring ids; each 23rd row's ids contradict its scenario. Values of the benchmark are protected."""
    s = scored(spark, folder).join(table(spark, folder, "documents").select("doc_id", _md5("text").alias("text_md5")), "doc_id")
    image = F.when((F.col("pair_scenario") == 4) != (F.col("doc_id") % 23 == 0), F.col("caption_id")).otherwise(F.col("caption_id") + 1_000_000)
    rows = s.select(F.col("doc_id").alias("sample_id"), "caption_id", image.alias("image_id"), F.col("pair_scenario").alias("scenario"), F.lit("x").alias("text"), "text_md5", F.col("doc_id").alias("dhash"))
    protected = table(spark, folder, "benchmark").select(_md5("text").alias("text_md5"), F.lit(-1).cast("long").alias("dhash"))
    return audits.new_pairs(rows, protected, ["text_md5"], radius=0).where("check <> 'broken_pair'").select("check", "key")


@query("near_classes", """WITH fp AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INTEGER) ELSE CAST(0 AS HUGEINT) END))::HUGEINT AS fp FROM embeddings)
SELECT a.vec_id, (SELECT min(b.vec_id) FROM fp b WHERE b.fp = a.fp) AS class, count(DISTINCT b.fp) - 1 AS links FROM fp a JOIN fp b ON bit_count(xor(a.fp, b.fp)) <= 8 GROUP BY a.vec_id, a.fp""")
def near_classes(spark, folder):
    """One row a vector: the least id with its fingerprint, and how many other fingerprints are within 8 bits."""
    e = table(spark, folder, "embeddings").select("vec_id", arrays.sign_bits(F.col("embedding")).alias("fp"))
    return neardup.near_classes(e, 8, "vec_id")


@query("split_report", f"""WITH r AS (SELECT lang, {_SPLIT} AS split FROM documents), c AS (SELECT lang, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'val') AS b, count(*) FILTER (WHERE split = 'test') AS c FROM r GROUP BY lang UNION ALL SELECT 'total', count(*) FILTER (WHERE split = 'train'), count(*) FILTER (WHERE split = 'val'), count(*) FILTER (WHERE split = 'test') FROM r)
SELECT rpad(lang, 22, ' ') || ' ' || lpad(CAST(a AS VARCHAR), 8, ' ') || ' ' || lpad(CAST(b AS VARCHAR), 8, ' ') || ' ' || lpad(CAST(c AS VARCHAR), 8, ' ') AS line FROM c UNION ALL SELECT rpad('', 22, ' ') || '    train      val     test'""")
def split_report(spark, folder):
    lines = sinks.report_lines(_rows(spark, folder), "lang", "split", ("train", "val", "test"))
    return spark.createDataFrame([(x,) for x in lines], "line string")
