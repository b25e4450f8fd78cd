"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a keyed random order, form blocks of `block_docs`. In the fluid mix every
source with blocks left is served at its weight's share of each slot; block j of a source occupies the
time from its j-th to its (j+1)-th unit of service. Rounded outwards that is the block's window: released
at the floor, due by the ceiling. In every slot the released block with the earliest deadline goes next
(ties by the name of the source), so each block stays in its window and after t slots each source has had
its fluid share of t, more or less than one block. While all sources last that is weight x t; when one
runs out, the others share its slots in their proportions, so no slot is empty and each document is placed once.

Weights are taken exactly, as integers in their ratio; no rounding adds up however long the mix is. Fluid
service is linear between the times at which sources run out, so every window is a closed form:

* The schedule is cut into segments of `segment` slots, or more, so that there are SEGMENTS at most. At a boundary at
  most one block of each source lies across it. The driver walks over the boundaries alone and chooses which
  of those blocks go before, so that no interval on either side holds more windows than slots
  (`boundaries`). Then earliest-deadline-first fills every segment, and tasks schedule them side by side.
* A mix shorter than a segment is earliest-deadline-first in one go.

Ranks within a source don't need a source in one task: the order is by a hash, whose top bits deal
each source into buckets of about `bucket_rows` at most, small enough that all partitions have some;
rank = rows in earlier buckets + rank in the bucket. A bucket brings the slots of its blocks with it, so
rows are shuffled once, to their buckets. The driver holds a count and a weight of each source.

A null source is a source of its own. Default weights are document counts to the power `alpha`. Rows
that share a doc_id, and repeated rows, get places of their own. Texts are carried, never read. An empty
table gives no row. Columns named as the results are replaced.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.texts import map_rows
from quillmark.plans.sizing import shuffle_partitions
from quillmark.plans.staging import staged

BLOCK_DOCS, ALPHA, BUCKET_ROWS, SEED, SEGMENT = 64, 0.5, 20_000, 17, 1 << 16
#: Most segments of a schedule; a longer mix has longer ones.
SEGMENTS = 128
#: Sources whose numbers of buckets are broadcast.
MOST_BROADCAST = 1 << 20
#: Blocks whose slots are in one row.
CHUNK = 256
RESULTS = ("block", "mix_slot", "mix_position")


def exact_weights(weights: dict) -> dict:
    """Integers in exactly the ratios of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    unit = math.lcm(*(x.denominator for x in exact.values())) if exact else 1
    return {s: int(x * unit) for s, x in exact.items()}


@dataclass(frozen=True)
class Plan:
    """Sources by name with integer weights and numbers of blocks, and the phases between the times at which sources run out."""

    names: tuple
    weights: tuple[int, ...]
    blocks: tuple[int, ...]
    #: By time: blocks of the sources that ran out before, weight of those still served, and the time at which it starts.
    phases: tuple[tuple[int, int, Fraction], ...]
    #: Service for a unit of weight by the end of each phase.
    levels: tuple[Fraction, ...]
    #: The phase in which each source runs out.
    last: tuple[int, ...]

    def whole(self, times: range) -> np.ndarray:
        """Whole blocks of fluid service by each of the times, a row each. Where a float is too close to a whole number, integers decide."""
        p, q = self.phase(times[0]), self.phase(times[-1])
        if p != q:
            cut = len(times) // 2
            return np.concatenate([self.whole(times[:cut]), self.whole(times[cut:])])
        gone, weight, _ = self.phases[p]
        last, w, blocks, small = self.arrays
        t = np.array(times, np.int64)[:, None] - gone
        if small is not None and max(self.weights) * max(abs(times[-1] - gone), 1) < 1 << 62:
            return np.where(last >= p, small * t // weight, blocks)
        out = w / float(weight) * t
        close = (np.abs(out - np.round(out)) < 1e-9 * (1 + np.abs(out))) & (last >= p)
        out = np.floor(out).astype(np.int64)
        for i, k in np.argwhere(close).tolist():
            out[i, k] = self.weights[k] * (times[i] - gone) // weight
        return np.where(last >= p, out, blocks)

    @cached_property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        small = np.array(self.weights, np.int64) if sum(self.weights) < 1 << 62 else None
        return np.array(self.last, np.int64), np.array([float(w) for w in self.weights]), np.array(self.blocks, np.int64), small

    def phase(self, t: int) -> int:
        return max(0, bisect_right(self.phases, t, key=lambda p: p[2]) - 1)

    def time(self, k: int, j: int, near: int) -> tuple[int, int]:
        """When a source has had j units of service: numerator and denominator. `near` is a phase to look at first."""
        w, last, p = self.weights[k], self.last[k], min(near, self.last[k])
        ends = self.ends
        if p and j * ends[p - 1][1] <= ends[p - 1][0] * w:
            p = bisect_left(self.levels, Fraction(j, w))
        while p < last and j * ends[p][1] > ends[p][0] * w:
            p += 1
        gone, weight, _ = self.phases[p]
        return j * weight + gone * w, w

    @cached_property
    def ends(self) -> list[tuple[int, int]]:
        return [(x.numerator, x.denominator) for x in self.levels]


def plan(weights: dict, blocks: dict) -> Plan:
    names = tuple(sorted(blocks, key=lambda s: (s is None, s or "")))
    exact = exact_weights(weights)
    w, b = tuple(exact[s] for s in names), tuple(blocks[s] for s in names)
    order = sorted(range(len(names)), key=lambda k: (Fraction(b[k], w[k]), k))
    phases, levels, last, gone, left, before = [], [], [0] * len(names), 0, sum(w), Fraction(-1)
    for k in order:
        level = Fraction(b[k], w[k])
        if level > before:  # ends in a phase of its own
            start = phases[-1][0] + before * phases[-1][1] if phases else Fraction(0)
            phases.append((gone, left, start))
            levels.append(level)
            before = level
        last[k] = len(phases) - 1
        gone, left = gone + b[k], left - w[k]
    return Plan(names, w, b, tuple(phases), tuple(levels), tuple(last))


#: Times whose whole blocks are held at once.
TIMES = 512


def boundaries(own: Plan, segment: int) -> list[list[int]]:
    """How many blocks of each source go before each boundary, from 0 to the end.

    Let R(t) be t less the whole blocks of all sources by t: as many of the blocks that lie across t go before it. For every
    later y, those due by y that stay behind must find room before y, so R(t) - R(y) of them at least must go. Whenever
    that calls for one, the one released first goes, for it asks least of the slots before t; so does the rest.
    """
    total, count = sum(own.blocks), len(own.names)
    given, out = np.zeros(count, np.int64), [[0] * count]
    for t in [*range(segment, total, segment), *([total] if total else [])]:
        whole, p = own.whole(range(t, t + 1))[0], own.phase(t)
        room, across, due = t - int(whole.sum()), [], []
        for k in range(count):
            top, bottom = own.time(k, int(whole[k]), p)
            if whole[k] < own.blocks[k] and top < t * bottom:
                end, below = own.time(k, int(whole[k]) + 1, p)
                due.append((-(-end // below), top // bottom, k))
        due.sort()
        gone = {k for _, _, k in due if given[k] > whole[k]}
        at = met = 0
        while at < len(due) and len(gone) < room:
            y = due[at][0]
            while at < len(due) and due[at][0] == y:
                if due[at][2] in gone:
                    met += 1
                else:
                    heapq.heappush(across, due[at][1:])
                at += 1
            upto = due[at][0] if at < len(due) else y  # after the last one any choice of as many as there is room for will do
            while y < upto and len(gone) < room:
                times = range(y, min(y + TIMES, upto))
                least = int((np.array(times) - own.whole(times).sum(1)).min())
                while met < room - least:
                    gone.add(heapq.heappop(across)[1])
                    met += 1
                y = times[-1] + 1
        rest = sorted([*across, *(x[1:] for x in due[at:] if x[2] not in gone)])
        gone.update(k for _, k in rest[: room - len(gone)])
        given = whole.copy()
        given[list(gone)] += 1
        out.append(given.tolist())
    return out


def fill(own: Plan, first: int, given: list[int], upto: list[int]) -> list[list[int]]:
    """The slots of each source's blocks from `given` to `upto`, in slots from `first` on: earliest deadline first."""
    at, waiting, ready, out, p = list(given), [], [], [[] for _ in given], own.phase(first)

    def enter(k: int) -> None:
        top, bottom = own.time(k, at[k], p)
        heapq.heappush(waiting, (top // bottom, k))

    for k, (a, b) in enumerate(zip(given, upto, strict=True)):
        if a < b:
            enter(k)
    slot = first
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            k = heapq.heappop(waiting)[1]
            top, bottom = own.time(k, at[k] + 1, p)
            heapq.heappush(ready, (-(-top // bottom), k))
        k = heapq.heappop(ready)[1]
        out[k].append(slot)
        slot += 1
        at[k] += 1
        if at[k] < upto[k]:
            enter(k)
    return out


def exact_slots(weights: dict, blocks: dict, segment: int = SEGMENT) -> dict:
    """The slots of each source's blocks, all in one place: what the tasks find together."""
    own = plan(weights, blocks)
    out = {s: [] for s in own.names}
    marks = boundaries(own, segment)
    for i, (a, b) in enumerate(zip(marks, marks[1:], strict=False)):
        for s, slots in zip(own.names, fill(own, i * segment, a, b), strict=True):
            out[s] += slots
    return out


def order_mark(doc_id: Column, seed: int) -> Column:
    """The hex string that orders a source's documents; the same in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary"))


def _slot_table(spark: SparkSession, own: Plan, segment: int) -> DataFrame:
    """(source, chunk, first, slots): the slots of each source's blocks, in pieces of CHUNK blocks at most; a task for each segment."""
    marks = boundaries(own, segment)
    pack = lambda row: np.array(row, np.int64).tobytes()
    rows = [(k, pack(a), pack(b)) for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False))]
    shared = spark.sparkContext.broadcast(own)

    def schedule(batch: pa.RecordBatch) -> dict:
        out = {"__qm_null": [], "__qm_source": [], "__qm_chunk": [], "__qm_first": [], "__qm_slots": []}
        for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "a", "b")), strict=True):
            start, end = (np.frombuffer(x, np.int64).tolist() for x in (a, b))
            for k, slots in enumerate(fill(shared.value, i * segment, start, end)):
                at = start[k]
                while at < end[k]:
                    upto = min(end[k], (at // CHUNK + 1) * CHUNK)
                    s = shared.value.names[k]
                    for name, value in zip(out, (s is None, s or "", at // CHUNK, at, slots[at - start[k] : upto - start[k]]), strict=True):
                        out[name].append(value)
                    at = upto
        return out

    table = spark.createDataFrame(rows, "i long, a binary, b binary").repartition(max(1, min(len(rows), 16 * shuffle_partitions(spark))), "i")
    return map_rows(table, schedule, "__qm_null boolean, __qm_source string, __qm_chunk long, __qm_first long, __qm_slots array<long>")


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, block_docs: int = BLOCK_DOCS, bucket_rows: int = BUCKET_ROWS, seed: int = SEED, segment: int = SEGMENT) -> DataFrame:
    """Returns every row of `docs` with block, mix_slot and mix_position; reading by mix_position interleaves the sources.

    `weights` maps each source, None for null, to a positive weight; a source without one is an error.
    """
    spark = docs.sparkSession
    source, key = F.col("source").cast("string"), ["__qm_null", "__qm_source", "__qm_bucket"]
    kept = [c for c in docs.columns if c not in RESULTS]
    named = {"__qm_null": source.isNull(), "__qm_source": F.coalesce(source, F.lit("")), "__qm_h": order_mark(F.col("doc_id"), seed)}
    narrow = docs.select(*(c.alias(name) for name, c in named.items()))
    counts = {(None if r[0] else r[1]): r[2] for r in narrow.groupBy("__qm_null", "__qm_source").count().collect()}
    own = plan({s: n**alpha for s, n in counts.items()} if weights is None else {s: weights[s] for s in counts}, {s: -(-n // block_docs) for s, n in counts.items()})
    size = max(1.0, min(bucket_rows, sum(counts.values()) / (4 * shuffle_partitions(spark))))
    bits_of = {s: min(32, max(0, math.ceil(math.log2(n / size)))) for s, n in counts.items()}
    few = len(counts) <= MOST_BROADCAST
    table = spark.createDataFrame([(s is None, s or "", b) for s, b in bits_of.items()] if few else [], "__qm_null boolean, __qm_source string, __qm_bits int")

    def in_buckets(rows: DataFrame) -> DataFrame:
        """Adds the bucket: the top bits of the hash, as many as the source needs, or as the largest one does where sources are too many to broadcast."""
        top = F.conv(F.substring("__qm_h", 1, 8), 16, 10).cast("long")
        if not few:
            return rows.withColumn("__qm_bucket", F.shiftright(top, 32 - max(bits_of.values())))
        return rows.join(F.broadcast(table), key[:2]).withColumn("__qm_bucket", F.floor(top / F.pow(F.lit(2.0), 32 - F.col("__qm_bits")))).drop("__qm_bits")

    before = Window.partitionBy("__qm_null", "__qm_source").orderBy("__qm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_buckets(narrow).groupBy(*key).agg(F.count(F.lit(1)).alias("__qm_n")).withColumn("__qm_before", F.coalesce(F.sum("__qm_n").over(before), F.lit(0)))
    slots = _slot_table(spark, own, max(segment, 4 * len(counts), -(-sum(own.blocks) // SEGMENTS)))
    chunk = lambda row: F.floor(row / (block_docs * CHUNK)).cast("long")
    spans = offsets.select(*key, "__qm_before", "__qm_n", F.explode(F.sequence(chunk(F.col("__qm_before")), chunk(F.col("__qm_before") + F.col("__qm_n") - 1))).alias("__qm_chunk"))
    pieces = F.sort_array(F.collect_list(F.struct("__qm_first", "__qm_slots")))
    brought = spans.join(slots, ["__qm_null", "__qm_source", "__qm_chunk"]).groupBy(*key).agg(F.max("__qm_before").alias("__qm_before"), F.max("__qm_n").alias("__qm_n"), pieces.alias("__qm_p"))
    first, last = (F.floor(r / block_docs) for r in (F.col("__qm_before"), F.col("__qm_before") + F.col("__qm_n") - 1))
    own_slots = F.slice(F.flatten("__qm_p.__qm_slots"), (first - F.col("__qm_p")[0]["__qm_first"] + 1).cast("int"), (last - first + 1).cast("int"))
    buckets = staged(brought.select(*key, "__qm_before", first.alias("__qm_first"), own_slots.alias("__qm_slots")), "mix-buckets")
    hashed = in_buckets(docs.select(*(F.col(f"`{c}`") for c in kept)).withColumns(named))
    # rows that share a doc_id are told apart by their contents, so that a task run again ranks them alike
    ties = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.select(*(F.col(f"`{c}`") for c in kept)).dtypes if "map<" not in kind and kind != "variant"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("__qm_h", "doc_id", ties)) - 1
    ranked = hashed.withColumn("__qm_rank", inside).join(buckets, key).withColumn("__qm_rank", F.col("__qm_before") + F.col("__qm_rank"))
    placed = ranked.withColumn("block", F.floor(F.col("__qm_rank") / block_docs))
    slot = F.get("__qm_slots", (F.col("block") - F.col("__qm_first")).cast("int"))
    return placed.select(*(F.col(f"`{c}`") for c in kept), "block", slot.alias("mix_slot"), (slot * block_docs + F.pmod("__qm_rank", F.lit(block_docs))).alias("mix_position"))
