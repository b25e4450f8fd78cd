"""Serving as a running query: requests in, verdicts out, the first request by time answered.

Each request_id has a state (a row of its bucket's table) with the time of the request that was answered and how often it came. The first one to
arrive is answered at once. One that comes later but is earlier by time corrects the answer under the next revision; others
of the same id only count. State goes when the watermark has passed the answered request by `lateness`. Rows that are older than the
watermark get no answer; how many there were is counted (`late_rows`). Files of answers go to the shared folder by Spark's own file sink; with its checkpoint there, too, a
restarted query goes on where it stopped and answers nothing twice.

Defined for odd rows: requests without id or time can't be answered and are left out; one without text
or score is rejected with its reason; ties in time go to the least text, then score, null first; repeated rows count as copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from quillmark.streaming.requests import request_stream

ANSWER = "request_id string, ts timestamp, text string, score double, revision long, copies long"


#: Ids are dealt into so many buckets; the ids of a bucket have their states in one table, so that tasks work on columns.
BUCKETS = 1024
STATE = "ids binary"
HELD = ["request_id", "micros", "text", "score", "revision", "copies", "until"]


def _packed(ids: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(ids, _HELD_SCHEMA, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


_HELD_SCHEMA = pa.schema([("request_id", pa.string()), ("micros", pa.int64()), ("text", pa.string()), ("score", pa.float64()), ("revision", pa.int64()), ("copies", pa.int64()), ("until", pa.int64())])


def _least_first(rows: pd.DataFrame) -> pd.DataFrame:
    """The first row of each id by time, text and score, null first."""
    return rows.sort_values(["request_id", "micros", "text", "score"], na_position="first", kind="stable").drop_duplicates("request_id")


def first_by_time(lateness_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Emits an answer when an id's first request by time changes. A call takes the requests of a bucket of ids."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else _HELD_SCHEMA.empty_table()
        held = held.to_pandas()
        come = pd.concat([f[["request_id", "ts", "text", "score"]] for f in frames]) if not state.hasTimedOut else pd.DataFrame(columns=["request_id", "ts", "text", "score"])
        if len(come):
            come = come.assign(micros=come["ts"].astype("datetime64[us]").astype("int64"), text=come["text"].astype(object), score=come["score"].astype(float))
            copies = come.groupby("request_id").size()
            mine = _least_first(come).merge(held, "left", "request_id", suffixes=("", "_held"))
            known = mine["micros_held"].notna()
            first = _least_first(pd.concat([held[held["request_id"].isin(copies.index)], mine[["request_id", "micros", "text", "score"]]])).set_index("request_id").loc[mine["request_id"]]
            same = lambda c: (first[c].to_numpy(object) == mine[f"{c}_held"].to_numpy(object)) | (first[c].isna() & mine[f"{c}_held"].isna().to_numpy()).to_numpy()
            changed = ~(known.to_numpy() & same("micros") & same("text") & same("score"))
            out = pd.DataFrame({"request_id": mine["request_id"].to_numpy(), "micros": first["micros"].to_numpy(), "text": first["text"].to_numpy(object), "score": first["score"].to_numpy()})
            out["revision"] = mine["revision"].fillna(0).astype("int64") + changed
            out["copies"] = mine["copies"].fillna(0).astype("int64") + copies.loc[out["request_id"]].to_numpy()
            out["until"] = np.where(changed, np.maximum(out["micros"] // 1000, watermark) + lateness_ms, mine["until"].fillna(0)).astype("int64")
            held = pd.concat([held[~held["request_id"].isin(copies.index)], out])
        left = held[held["until"] > watermark]
        if len(left):
            state.update((_packed(left[HELD]),))
            # a call clears the timer
            state.setTimeoutTimestamp(int(left["until"].min()))
        elif state.exists:
            state.remove()
        if len(come) and changed.any():
            yield out[changed].assign(ts=lambda o: pd.to_datetime(o["micros"], unit="us"))[["request_id", "ts", "text", "score", "revision", "copies"]]

    return run


def serve(spark: SparkSession, requests: str, answers: str, checkpoint: str, lateness_minutes: int = 10, files_a_batch: int = 4) -> StreamingQuery:
    """Starts the query over the request files of a folder; it ends when all files that are there are answered. Start it again for more."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = request_stream(spark, requests, files_a_batch=files_a_batch)
    whole = stream.where(F.col("request_id").isNotNull() & F.col("ts").isNotNull())
    marked = whole.withWatermark("ts", f"{lateness_minutes} minutes")
    answered = marked.withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS).cast("long"))).groupBy("bucket").applyInPandasWithState(first_by_time(lateness_minutes * 60_000), ANSWER, STATE, "append", "EventTimeTimeout")
    return answered.writeStream.format("parquet").option("path", answers).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Requests of this run that were older than the watermark."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def answers(spark: SparkSession, folder: str, threshold: float) -> DataFrame:
    """The last revision of each answer, with its verdict and reason; one row a request_id."""
    rows = spark.read.schema(ANSWER).parquet(folder)
    last = rows.groupBy(F.col("request_id").alias("_id")).agg(F.max_by(F.struct(*rows.columns), "revision").alias("r")).select("r.*")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    reason = F.when(blank, F.lit("empty_text")).when(F.col("score").isNull(), F.lit("no_score"))
    return last.select("request_id", "ts", F.when(reason.isNull(), F.when(F.col("score") >= threshold, "fake").otherwise("genuine")).otherwise("rejected").alias("verdict"), reason.alias("reason"), "revision")
