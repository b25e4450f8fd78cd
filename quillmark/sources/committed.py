"""Committed tables: a write is seen whole or not at all.

Tasks write Parquet parts under a folder of their attempt and send home each part's rows, bytes and SHA-256. When all
have ended, the commit holds the messages against the stored parts (sizes and row counts, from footers), deletes parts
that no message names (of tasks that were run again), and publishes a manifest by one rename. Readers open
only what the manifest names. When a task fails for good, or the commit finds a difference, the attempt's folder is
deleted: no manifest, no part. A table that has a manifest is never written again.

`write_committed` also has tasks read the parts anew and compare their hashes before the manifest is published, so a store that
doesn't hold what was written is found out while nobody has seen the table.

Defined for odd rows: an empty table has a manifest without parts, and its schema; null and nested values are what
Parquet holds; repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quillmark.sources import stores

MANIFEST, PENDING = "_manifest.json", "_manifest.pending.json"


@dataclass
class Part(WriterCommitMessage):
    file: str
    rows: int
    bytes: int
    sha256: str


class _Hashing:
    """An output stream that hashes what passes."""

    def __init__(self, out):
        self.out, self.digest, self.size, self.closed = out, hashlib.sha256(), 0, False

    def write(self, data) -> int:
        data = bytes(data)
        self.digest.update(data)
        self.size += len(data)
        return self.out.write(data)

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        self.out.flush()

    def close(self) -> None:
        self.closed = True


class CommittedTable(DataSource):
    """Format "committed": append to `path`, which must have no manifest. With `pending`, the manifest isn't published yet."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        path = self.options["path"].rstrip("/")
        if overwrite or stores.exists(f"{path}/{MANIFEST}"):
            raise FileExistsError(f"{path} is there; committed tables are never overwritten")
        return _Writer(path, uuid.uuid4().hex, schema.json(), self.options.get("pending", "false") == "true")


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, attempt: str, schema: str, pending: bool):
        self.path, self.attempt, self.schema, self.pending = path, attempt, schema, pending

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, folder = stores.opened(f"{self.path}/{self.attempt}")
        store.create_dir(folder, recursive=True)
        name, rows, writer, stream = f"{uuid.uuid4().hex}.parquet", 0, None, None
        with store.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                if writer is None:
                    stream = _Hashing(out)
                    writer = pq.ParquetWriter(pa.PythonFile(stream, mode="w"), batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
            if writer:
                writer.close()
        if not writer:
            store.delete_file(f"{folder}/{name}")
            return Part("", 0, 0, "")  # a task without rows
        return Part(f"{self.attempt}/{name}", rows, stream.size, stream.digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m and m.file]
        store, root = stores.opened(self.path)
        try:
            for p in parts:
                size, rows = store.get_file_info(f"{root}/{p.file}").size, pq.read_metadata(f"{root}/{p.file}", filesystem=store).num_rows
                if (size, rows) != (p.bytes, p.rows):
                    raise OSError(f"{p.file} has {rows} rows in {size} bytes; {p.rows} in {p.bytes} were written")
            named = {f"{root}/{p.file}" for p in parts}
            for stray in stores.listed(f"{self.path}/{self.attempt}", (".parquet",)) if parts else []:
                if stray not in named:
                    store.delete_file(stray)
        except Exception:
            self.abort(messages)
            raise
        store.create_dir(root, recursive=True)
        stores.put_json(f"{self.path}/{PENDING if self.pending else MANIFEST}", {"schema": self.schema, "rows": sum(p.rows for p in parts), "parts": [vars(p) for p in sorted(parts, key=lambda p: p.file)]})

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = stores.opened(f"{self.path}/{self.attempt}")
        if stores.exists(f"{self.path}/{self.attempt}"):
            store.delete_dir(folder)


def changed_parts(spark: SparkSession, path: str, manifest: dict) -> list[str]:
    """Parts whose bytes aren't those that were written; tasks read them, a part at a time."""
    want = {p["file"]: p["sha256"] for p in manifest["parts"]}
    if not want:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = stores.opened(path)
        for batch in batches:
            wrong = []
            for name, sha in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                digest = hashlib.sha256()
                with store.open_input_stream(f"{root}/{name}") as file:
                    while block := file.read(1 << 20):
                        digest.update(block)
                if digest.hexdigest() != sha:
                    wrong.append(name)
            yield pa.RecordBatch.from_pydict({"file": pa.array(wrong, pa.string())})

    parts = spark.createDataFrame(sorted(want.items()), "file string, sha256 string").repartition(len(want))
    return sorted(r.file for r in parts.mapInArrow(run, "file string").collect())


def write_committed(rows: DataFrame, path: str) -> DataFrame:
    """Writes, reads every part anew, publishes, and returns the table."""
    spark, path = rows.sparkSession, path.rstrip("/")
    spark.dataSource.register(CommittedTable)
    rows.write.format("committed").mode("append").option("path", path).option("pending", "true").save()
    manifest = stores.get_json(f"{path}/{PENDING}")
    wrong = changed_parts(spark, path, manifest)
    store, root = stores.opened(path)
    if wrong:
        store.delete_dir(root)
        raise OSError(f"{path} doesn't hold what was written: {wrong[:3]}")
    store.move(f"{root}/{PENDING}", f"{root}/{MANIFEST}")
    return read_committed(spark, path)


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The table of the manifest at `path`; files that it doesn't name aren't opened."""
    path = path.rstrip("/")
    if not stores.exists(f"{path}/{MANIFEST}"):
        raise FileNotFoundError(f"{path} has no committed table")
    manifest = stores.get_json(f"{path}/{MANIFEST}")
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    files = [f"{path}/{p['file']}" for p in manifest["parts"]]
    return spark.read.schema(schema).parquet(*files).select(*(F.col(f"`{c}`") for c in schema.names)) if files else spark.createDataFrame([], schema)
