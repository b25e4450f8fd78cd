"""Files of the shared store as Python sources and sinks see them: by URI, whatever file system pyarrow knows."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI, or of a path on this machine's own file system."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def exists(uri: str) -> bool:
    store, path = opened(uri)
    return store.get_file_info(path).type != fs.FileType.NotFound


def listed(uri: str, suffixes: tuple[str, ...]) -> list[str]:
    """Paths of a folder's files (or the file itself) with one of the suffixes, by name."""
    store, path = opened(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.path.endswith(suffixes))


def put_json(uri: str, value: dict) -> None:
    """Writes beside the place first and moves it there, so that readers see all of it or nothing."""
    store, path = opened(uri)
    with store.open_output_stream(f"{path}.new") as out:
        out.write(json.dumps(value, sort_keys=True).encode())
    store.move(f"{path}.new", path)


def get_json(uri: str) -> dict:
    store, path = opened(uri)
    with store.open_input_stream(path) as file:
        return json.loads(file.read())


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Writes each row's content (binary) as a file of its own in `folder`, by the tasks that hold it; returns how many.

    A file is moved to its name when it is whole, so a task that runs again replaces it by the same. Names must differ; a null content is no file.
    """

    def run(batches):
        import pyarrow as pa

        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/.{own}.new") as out:
                    out.write(data)
                store.move(f"{root}/.{own}.new", f"{root}/{own}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = files.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).where("content IS NOT NULL")
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
