"""Image files: fingerprints that never raise, one for each distinct path."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from quillmark.sources.png import decode_png

def decode_netpbm(raw: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of a binary PGM or PPM file with 8 bits a sample."""
    fields, at = [], 0
    while len(fields) < 4:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("header ends early")
        fields.append(raw[at:end])
        at = end
    kind, width, height, most = fields[0], *map(int, fields[1:])
    bands = {b"P5": 1, b"P6": 3}[kind]
    if most > 255:
        raise ValueError("more than 8 bits a sample")
    pixels = np.frombuffer(raw, np.uint8, width * height * bands, at + 1).reshape(height, width, bands)
    return np.repeat(pixels, 3, axis=2) if bands == 1 else pixels


def grey_grid(pixels: np.ndarray, width: int = 9, height: int = 8) -> np.ndarray:
    """Mean grey of each cell of a grid over the image."""
    grey = pixels.astype(float) @ np.array([0.299, 0.587, 0.114])
    rows = np.linspace(0, grey.shape[0], height + 1).astype(int)
    cols = np.linspace(0, grey.shape[1], width + 1).astype(int)
    cell = lambda a, i: slice(a[i], max(a[i + 1], a[i] + 1))
    return np.array([[grey[min(cell(rows, i).start, grey.shape[0] - 1) : cell(rows, i).stop, min(cell(cols, j).start, grey.shape[1] - 1) : cell(cols, j).stop].mean() for j in range(width)] for i in range(height)])


INFO = StructType().add("ok", BooleanType()).add("sha1", StringType()).add("sha256", StringType()).add("pixel_sha256", StringType()).add("dhash", LongType()).add("width", IntegerType()).add("height", IntegerType()).add("format", StringType()).add("error", StringType())


#: What the first bytes of a file say of its format.
SIGNATURES = ((b"\x89PNG\r\n\x1a\n", "PNG"), (b"\xff\xd8\xff", "JPEG"), (b"GIF8", "GIF"), (b"BM", "BMP"), (b"P5", "PGM"), (b"P6", "PPM"))


def image_format(raw: bytes) -> str | None:
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        return "WEBP"
    return next((name for start, name in SIGNATURES if raw.startswith(start)), None)


def decode_image(raw: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of a PNG, PGM or PPM file."""
    return decode_png(raw) if image_format(raw) == "PNG" else decode_netpbm(raw)


def fingerprint_udf(decode: Callable[[bytes], np.ndarray] = decode_image, rising: bool = False):
    """Content -> fingerprint. Formats besides PNG, PGM and PPM need a `decode` of their own; libraries for them aren't assumed."""

    @F.pandas_udf(INFO)
    def run(content: pd.Series) -> pd.DataFrame:
        def one(raw):
            if raw is None:
                return (False, None, None, None, None, None, None, None, "missing")
            kind = image_format(bytes(raw))
            sums = hashlib.sha1(raw).hexdigest(), hashlib.sha256(raw).hexdigest()
            try:
                pixels = decode(bytes(raw))
                g = grey_grid(pixels)
            except Exception:  # any fault of any decoder is a property of the file
                return (False, *sums, None, None, None, None, kind, "corrupt")
            bits = g[:, 1:] > g[:, :-1] if rising else g[:, :-1] > g[:, 1:]
            dhash = int(np.packbits(bits.reshape(-1)).view(">u8")[0].astype(np.int64))
            return (True, *sums, hashlib.sha256(np.ascontiguousarray(pixels).tobytes()).hexdigest(), dhash, pixels.shape[1], pixels.shape[0], kind, None)

        # whole numbers never pass through floats, which would round fingerprints beside missing ones
        columns = list(zip(*map(one, content), strict=True)) or [[] for _ in INFO.names]
        return pd.DataFrame({name: pd.array(values, "Int64") if name in ("dhash", "width", "height") else values for name, values in zip(INFO.names, columns, strict=True)})

    return run


def image_table(rows: DataFrame, folder: str, path: str = "image_path", **how) -> DataFrame:
    """`rows` with a struct `info` of each row's image below `folder`. A path read by many rows is decoded once; a missing file is `missing`."""
    spark = rows.sparkSession
    base = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    name = F.regexp_replace(F.col("path"), rf"^.*?{base.split(':')[-1].lstrip('/')}/", "")
    wanted = rows.select(F.col(path).alias("_path")).distinct()
    found = wanted.join(files.select(name.alias("_path"), "content"), "_path", "left").select("_path", fingerprint_udf(**how)("content").alias("info"))
    return rows.join(found, F.col(path) == F.col("_path"), "left").drop("_path")


def usable(rows: DataFrame, required: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows to go on with, and counts by group and reason of those left out. Without `required` all go on."""
    reason = F.when(F.col("info.ok"), None).otherwise(F.when(F.col("info.error") == "missing", "missing_image").otherwise("corrupt_image"))
    marked = rows.withColumn("_reason", reason)
    counts = marked.where("_reason IS NOT NULL").groupBy("group", F.col("_reason").alias("reason")).count()
    return (marked.where("_reason IS NULL") if required else marked).drop("_reason"), counts
