"""Byte-level text helpers that several operators share.

Texts reach Python as UTF-8 bytes: `bytes.lower()` changes A-Z alone, and `bytes.split()` and
`bytes.strip()` know exactly the white space of the contracts, 0x20 and 0x09 to 0x0D.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = b" \t\n\x0b\x0c\r"
#: UTF-8 continuation bytes; what is left without them has one byte for each code point.
CONTINUATION = bytes(range(0x80, 0xC0))


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.translate(None, CONTINUATION))


def raw_text(df: DataFrame, name: str = "text") -> Column:
    """The column as UTF-8 bytes; null stays null."""
    return F.col(name).cast("string").cast("binary").alias(name)


#: Most bytes of an Arrow batch: a batch is held several times over, in the JVM, in Python and as objects.
BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> None:
    """Lowers the session's bound on Arrow batches, which by rows alone would let very long texts fill an executor.

    `build_session` sets it already. In other sessions it stays lowered: plans read it when they run, not when they are made.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def filter_rows(df: DataFrame, keep: Callable[[str | None], bool], column: str = "text") -> DataFrame:
    """The rows of `df` whose text `keep` approves, with all their columns."""
    bound_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(keep(x.as_py())) for x in batch.column(column)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_rows(df: DataFrame, rows: Callable[[pa.RecordBatch], dict | Iterator[dict]], schema: str) -> DataFrame:
    """Runs `rows` on each Arrow batch. It returns the output columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bound_batches(df)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
