"""Bundles of arrays (NPY files, NPZ archives of them) as tables, read by row ranges.

An array's header tells its type and rows, and a row's bytes are as many as any other's, so a partition is a range of
rows: it seeks to its own bytes in each array. Planning reads headers alone. The first axis is the row; an array with one more
axis is an array column. Compressed archives are read, too, but each partition inflates what stands before its rows.

`write_bundles` writes NPZ files, so many rows each at most, and a provenance file beside them: what the caller says of the
rows' origin, and a SHA-256 for every block of rows of every array. Partitions begin and end with blocks, and each holds its
own blocks against the provenance, so a changed byte is an error wherever it is, and no file is read twice for it.

Defined for odd rows: null values can't be written (an error); empty tables give no files and can't be read as a table (an error, for
nothing tells the columns); object arrays are refused, as are arrays of one bundle with different numbers of rows.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmark.sources import stores

BLOCK = 4096
PROVENANCE = "_provenance.json"


def _arrays(batch: pa.Table) -> dict[str, np.ndarray]:
    out = {}
    for name, column in zip(batch.column_names, batch.columns, strict=True):
        if column.null_count:
            raise ValueError(f"{name}: null values have no place in an array")
        flat = column.combine_chunks()
        if pa.types.is_list(flat.type) or pa.types.is_large_list(flat.type):
            values = flat.flatten()
            if values.null_count or len({len(x) for x in flat}) > 1:
                raise ValueError(f"{name}: vectors of several sizes, or with null values")
            out[name] = values.to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        else:
            out[name] = np.array(flat.to_pylist()) if pa.types.is_string(flat.type) else flat.to_numpy(zero_copy_only=False)
    return out


def block_hashes(array: np.ndarray) -> list[str]:
    return [hashlib.sha256(np.ascontiguousarray(array[k : k + BLOCK]).tobytes()).hexdigest() for k in range(0, len(array), BLOCK)]


def write_bundles(rows: DataFrame, path: str, provenance: dict, rows_per_file: int = 1 << 16) -> dict:
    """NPZ files of the columns of `rows`, a task's rows in files of `rows_per_file`, and their provenance, which comes last."""
    if stores.exists(path):
        raise FileExistsError(path)
    path = path.rstrip("/")
    schema = "file string, rows long, blocks map<string, array<string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, waiting, k = TaskContext.get().partitionId(), [], 0

        def flushed(table: pa.Table, k: int) -> pa.RecordBatch:
            arrays, name = _arrays(table), f"part-{task:05d}-{k:04d}.npz"
            store, folder = stores.opened(path)
            store.create_dir(folder, recursive=True)
            raw = io.BytesIO()
            np.savez(raw, **arrays)
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(raw.getbuffer())
            blocks = [[(c, block_hashes(a)) for c, a in arrays.items()]]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([table.num_rows], pa.int64()), pa.array(blocks, pa.map_(pa.string(), pa.list_(pa.string())))], names=["file", "rows", "blocks"])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            while sum(b.num_rows for b in waiting) >= rows_per_file:
                whole = pa.Table.from_batches(waiting)
                yield flushed(whole.slice(0, rows_per_file), k)
                waiting, k = whole.slice(rows_per_file).to_batches(), k + 1
        if sum(b.num_rows for b in waiting):
            yield flushed(pa.Table.from_batches(waiting), k)

    files = {r.file: {"rows": r["rows"], "blocks": r.blocks} for r in rows.mapInArrow(run, schema).collect()}
    value = {"provenance": provenance, "block": BLOCK, "files": files}
    store, folder = stores.opened(path)
    store.create_dir(folder, recursive=True)
    stores.put_json(f"{path}/{PROVENANCE}", value)
    return value


class Member:
    """One array of a bundle: where it is, its type, and its rows' shape."""

    def __init__(self, path: str, name: str | None):
        self.path, self.name = path, name

    def opened(self, store):
        file = store.open_input_file(self.path)
        return zipfile.ZipFile(file).open(f"{self.name}.npy") if self.name else file

    def header(self, store) -> tuple[tuple[int, ...], np.dtype, int]:
        """(shape, type, first data byte)."""
        with self.opened(store) as file:
            version = np.lib.format.read_magic(file)
            shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
            if dtype.hasobject or by_columns and len(shape) > 1 or not 1 <= len(shape) <= 2:
                raise ValueError(f"{self.path}: {self.name or 'array'} is no table of plain values by rows")
            return shape, dtype, file.tell()

    def rows(self, store, first: int, last: int) -> np.ndarray:
        shape, dtype, at = self.header(store)
        width = dtype.itemsize * int(np.prod(shape[1:]))
        with self.opened(store) as file:
            file.seek(at + first * width)
            raw = file.read((last - first) * width)
        if len(raw) != (last - first) * width:
            raise OSError(f"{self.path}: {self.name or 'array'} ends early")
        return np.frombuffer(raw, dtype).reshape(last - first, *shape[1:])


def bundle_members(store, path: str) -> dict[str, Member]:
    if path.endswith(".npy"):
        return {path.rsplit("/", 1)[-1].removesuffix(".npy"): Member(path, None)}
    with store.open_input_file(path) as file, zipfile.ZipFile(file) as z:
        return {n.removesuffix(".npy"): Member(path, n.removesuffix(".npy")) for n in z.namelist() if n.endswith(".npy")}


_TYPES = {"f8": "double", "f4": "float", "i8": "long", "i4": "int", "i2": "short", "i1": "byte", "b1": "boolean", "u1": "short", "u2": "int", "u4": "long"}


def column_type(shape: tuple[int, ...], dtype: np.dtype) -> str:
    kind = "string" if dtype.kind == "U" else "binary" if dtype.kind == "S" else _TYPES.get(f"{dtype.kind}{dtype.itemsize}")
    if kind is None:
        raise ValueError(f"no column type for {dtype}")
    return f"array<{kind}>" if len(shape) > 1 else kind


class Rows(InputPartition):
    def __init__(self, path: str, first: int, last: int, blocks: dict | None):
        super().__init__(f"{path}:{first}")
        self.path, self.first, self.last, self.blocks = path, first, last, blocks


class ArrayBundle(DataSource):
    """Format "array_bundle". Options: path (a bundle or a folder of them), rows (of a partition), required (names, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "array_bundle"

    def _files(self) -> list[str]:
        files = stores.listed(self.options["path"], (".npz", ".npy"))
        if not files:
            raise FileNotFoundError(f"{self.options['path']}: no bundle")
        return files

    def schema(self) -> str:
        store, _ = stores.opened(self.options["path"])
        found = bundle_members(store, self._files()[0])
        missing = {x for x in self.options.get("required", "").split(",") if x} - set(found)
        if missing:
            raise ValueError(f"missing arrays {sorted(missing)}")
        return ", ".join(f"`{name}` {column_type(*m.header(store)[:2])}" for name, m in found.items())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._files(), schema, int(self.options.get("rows", 1 << 16)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, files: list[str], schema, rows: int):
        self.path, self.files, self.schema = path, files, schema
        self.step = max(1, rows // BLOCK) * BLOCK

    def partitions(self) -> list[InputPartition]:
        store, root = stores.opened(self.path)
        known = stores.get_json(f"{self.path.rstrip('/')}/{PROVENANCE}")["files"] if stores.exists(f"{self.path.rstrip('/')}/{PROVENANCE}") else None
        if known is not None and {f.rsplit("/", 1)[-1] for f in self.files} != set(known):
            raise OSError(f"{self.path}: the files aren't those of the provenance")
        out = []
        for file in self.files:
            sizes = {name: m.header(store)[0][0] for name, m in bundle_members(store, file).items()}
            mine = known[file.rsplit("/", 1)[-1]] if known is not None else None
            if len(set(sizes.values())) != 1 or set(sizes) != set(self.schema.names) or mine and mine["rows"] not in sizes.values():
                raise ValueError(f"{file}: arrays {sizes} are no table of {self.schema.names}")
            n = next(iter(sizes.values()))
            for a in range(0, n, self.step):
                b = min(n, a + self.step)
                out.append(Rows(file, a, b, mine and {c: x[a // BLOCK : -(-b // BLOCK)] for c, x in mine["blocks"].items()}))
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, _ = stores.opened(self.path)
        arrow = to_arrow_schema(self.schema)
        found = bundle_members(store, partition.path)
        for a in range(partition.first, partition.last, BLOCK):
            b = min(partition.last, a + BLOCK)
            columns = []
            for field in arrow:
                x = found[field.name].rows(store, a, b)
                if partition.blocks and block_hashes(x) != [partition.blocks[field.name][(a - partition.first) // BLOCK]]:
                    raise OSError(f"{partition.path}: {field.name} isn't what its provenance says, rows {a} to {b}")
                if x.ndim == 2:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())).cast(field.type))
                else:
                    columns.append(pa.array(x.tolist() if x.dtype.kind in "US" else x).cast(field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)


def read_bundles(spark, path: str, required: tuple[str, ...] = (), rows: int = 1 << 16) -> DataFrame:
    """The bundles at `path` as one table; all columns of `required` must be there."""
    spark.dataSource.register(ArrayBundle)
    return spark.read.format("array_bundle").option("rows", rows).option("required", ",".join(required)).load(path)
