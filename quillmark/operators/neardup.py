"""Hamming-radius joins over 64-bit fingerprints (signed longs), exact at every radius.

The bits are cut into parts, and the radius is shared out over them: of m parts with radius r = a m + b, either one of
the first b + 1 differs in a bits at most, or one of the others in a - 1. So one side stands once under each of
its parts' values, the other asks for all values within the part's radius, and an equi-join on (part, value) finds
every pair. How many parts pays depends on the number of fingerprints: many parts ask for little and meet much, few
parts the other way round; `best_parts` takes the least sum. With a part for each bit of radius and one more this is plain banding.
A pair is given by the first part that finds it, so nothing is made distinct afterwards. Copies of a fingerprint are
joined once: pairs are of distinct fingerprints, and membership tells the rows.

A row that a join meets costs as much as some ROW_COST comparisons of packed fingerprints. Where even the best parts would
cost more than all comparisons (few fingerprints, or a wide radius) both sides are cut into blocks of BLOCK fingerprints, and a
task compares one block with another at a time, as arrays. That is quadratic in the fingerprints, and bounded in memory;
what only counts or takes the least distance never makes rows of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.hashes import hamming
from quillmark.plans.sizing import shuffle_partitions
from quillmark.plans.staging import staged

#: Values that a fingerprint asks for under one part, at most.
MOST_ASKED = 1 << 13
#: Comparisons of packed fingerprints that cost as much as a row that a join meets.
ROW_COST = 50
#: Fingerprints of a block, rows of a block that are compared at once, and most tasks for the pairs of blocks.
BLOCK, ROWS, MOST_TASKS = 1 << 14, 16, 2048
Part = tuple[int, int, int]


def cut(radius: int, parts: int) -> list[Part]:
    """(first bit, bits, radius) of each part that is asked for."""
    own, more = divmod(radius, parts)
    out, at = [], 0
    for k in range(parts):
        width = (64 - at) // (parts - k)
        out.append((at, width, own if k <= more else own - 1))
        at += width
    return [p for p in out if p[2] >= 0]


def asked(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(min(radius, width) + 1))


def best_parts(radius: int, n: int, row_cost: int = 1) -> list[Part] | None:
    """The parts by which a fingerprint meets the fewest of `n` others; None if that, times `row_cost`, is more than all of them."""
    tried = [cut(radius, m) for m in range(1, min(radius + 1, 32) + 1)]
    cost = lambda parts: sum(asked(w, r) * (1 + n / 2.0**w) for _, w, r in parts)
    best = min((p for p in tried if all(asked(w, r) <= MOST_ASKED for _, w, r in p)), key=cost, default=None)
    return best if best and row_cost * cost(best) < max(n, 2) else None


def _value(fingerprint: str, part: Part) -> Column:
    at, width, _ = part
    value = F.shiftrightunsigned(fingerprint, at)
    return value.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else value


def _turned(width: int, radius: int) -> Column:
    """All numbers of `width` bits with `radius` ones at most, as one constant array."""
    numbers = (sum(1 << b for b in bits) for k in range(min(radius, width) + 1) for bits in combinations(range(width), k))
    return F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in numbers)), ",").cast("array<bigint>")


def _asked_values(k: int, part: Part) -> Column:
    return F.transform(_turned(part[1], part[2]), lambda m: F.struct(F.lit(k).alias("part"), _value("a", part).bitwiseXOR(m).alias("value")))


def _by_parts(a: DataFrame, b: DataFrame, radius: int, parts: list[Part]) -> DataFrame:
    asks = F.concat(*(_asked_values(k, p) for k, p in enumerate(parts)))
    stands = F.array(*(F.struct(F.lit(k).alias("part"), _value("b", p).alias("value")) for k, p in enumerate(parts)))
    x = a.select("a", F.explode(asks).alias("k")).select("a", "k.*")
    y = b.select("b", F.explode(stands).alias("k")).select("b", "k.*")
    met = x.join(y, ["part", "value"]).withColumn("distance", hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= radius)
    first = F.lit(len(parts))
    for k, p in reversed(list(enumerate(parts))):
        first = F.when(F.bit_count(_value("a", p).bitwiseXOR(_value("b", p))) <= p[2], k).otherwise(first)
    return met.where(F.col("part") == first).select("a", "b", "distance")


def _blocks(distinct: DataFrame, name: str, n: int) -> tuple[DataFrame, int]:
    """(block, values): fingerprints packed into arrays of some BLOCK, and how many blocks there are."""
    count = max(1, -(-n // BLOCK))
    return distinct.groupBy(F.pmod(F.xxhash64(name), F.lit(count).cast("long")).alias(f"_block_{name}")).agg(F.collect_list(name).alias(f"_all_{name}")), count


Work = Callable[[np.ndarray, np.ndarray], Iterator[list[np.ndarray]]]


def _by_tiles(a: DataFrame, b: DataFrame, n_a: int, n_b: int, work: Work, schema: str) -> DataFrame:
    """What `work` yields, column by column, of each pair of blocks of the distinct fingerprints `a` and `b`."""
    (x, across), (y, down) = _blocks(a, "a", n_a), _blocks(b, "b", n_b)
    spread = x.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("_block_b"))
    tiles = spread.join(y, "_block_b").select("_all_a", "_all_b").repartition(min(across * down, MOST_TASKS))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, others in zip(batch.column("_all_a"), batch.column("_all_b"), strict=True):
                for found in work(*(v.values.to_numpy().view(np.uint64) for v in (own, others))):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

    return tiles.mapInArrow(run, schema)


def _distances(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances of ROWS rows of `x` to all of `y`); the array is used again."""
    apart, bits = np.empty((ROWS, len(y)), np.uint64), np.empty((ROWS, len(y)), np.uint8)
    for at in range(0, len(x), ROWS):
        own = x[at : at + ROWS, None]
        yield at, np.bitwise_count(np.bitwise_xor(own, y, out=apart[: len(own)]), out=bits[: len(own)])


def _pairs_of(radius: int) -> Work:
    def work(x: np.ndarray, y: np.ndarray) -> Iterator[list[np.ndarray]]:
        for at, bits in _distances(x, y):
            i, j = np.nonzero(bits <= radius)
            if len(i):
                yield [x[at + i].view(np.int64), y[j].view(np.int64), bits[i, j].astype(np.int32)]

    return work


def _counts_of(radius: int) -> Work:
    """How many others are within the radius; a fingerprint isn't its own neighbour."""

    def work(x: np.ndarray, y: np.ndarray) -> Iterator[list[np.ndarray]]:
        near = [np.count_nonzero((bits <= radius) & (bits > 0), axis=1) for _, bits in _distances(x, y)]
        yield [x.view(np.int64), np.concatenate([np.zeros(0, np.int64), *near]).astype(np.int64)]

    return work


def _least(x: np.ndarray, y: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The least distance to another; 65 if there is none."""
    # 0, a fingerprint itself, wraps round to the largest
    near = [np.minimum((bits - np.uint8(1)).min(axis=1, initial=255), 64) + 1 for _, bits in _distances(x, y)]
    yield [x.view(np.int64), np.concatenate([np.zeros(0, np.int64), *near]).astype(np.int32)]


def _distinct(rows: DataFrame, fingerprint: str, name: str) -> DataFrame:
    return rows.select(F.col(fingerprint).alias(name)).where(F.col(name).isNotNull()).distinct()


def pairs_within(left: DataFrame, right: DataFrame, radius: int, fingerprint: str = "fp", parts: list[Part] | None = None) -> DataFrame:
    """(a, b, distance) of the distinct fingerprints of both sides within `radius`. `parts` overrules the choice by size."""
    a, b = _distinct(left, fingerprint, "a"), _distinct(right, fingerprint, "b")
    n = 0 if parts else b.count()
    parts = parts or best_parts(radius, n, ROW_COST)
    return _by_parts(a, b, radius, parts) if parts else _by_tiles(a, b, n if left is right else a.count(), n, _pairs_of(radius), "a long, b long, distance int")


def neighbours(rows: DataFrame, radius: int, fingerprint: str = "fp", parts: list[Part] | None = None) -> DataFrame:
    """(a, links): how many other distinct fingerprints are within `radius`, for those that have any."""
    if not parts:
        own = staged(_distinct(rows, fingerprint, "a"), "fingerprints")
        n = own.count()
        parts = best_parts(radius, n, ROW_COST)
        if not parts:
            counts = _by_tiles(own, own.withColumnRenamed("a", "b"), n, n, _counts_of(radius), "a long, near long")
            return counts.groupBy("a").agg(F.sum("near").alias("links")).where("links > 0")
    return pairs_within(rows, rows, radius, fingerprint, parts).where("a <> b").groupBy("a").agg(F.count(F.lit(1)).alias("links"))


def near_pairs(rows: DataFrame, radius: int, key: str, fingerprint: str = "fp") -> DataFrame:
    """(left, right, distance) of rows of one table, left < right, copies with distance 0."""
    found = pairs_within(rows, rows, radius, fingerprint).where("a <= b")
    own = rows.select(F.col(key).alias("k"), F.col(fingerprint).alias("f"))
    x = found.join(own.select(F.col("k").alias("x"), F.col("f").alias("a")), "a")
    y = x.join(own.select(F.col("k").alias("y"), F.col("f").alias("b")), "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return y.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "distance")


def near_classes(rows: DataFrame, radius: int, key: str, fingerprint: str = "fp", parts: list[Part] | None = None) -> DataFrame:
    """(key, class, links) of every row: the least key with its fingerprint, and how many other fingerprints are within `radius`.

    Nothing is expanded into pairs of rows, so copies cost one row each.
    """
    own = rows.select(F.col(key), F.col(fingerprint).alias("_f"))
    near = neighbours(rows, radius, fingerprint, parts).withColumnRenamed("a", "_a")
    classes = own.groupBy(F.col("_f").alias("_g")).agg(F.min(key).alias("class"))
    named = classes.join(near, F.col("_g") == F.col("_a"), "left").select("_g", "class", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return own.join(named, F.col("_f").eqNullSafe(F.col("_g")), "left").select(key, "class", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def without_near(rows: DataFrame, protected: DataFrame, radius: int, fingerprint: str = "fp") -> DataFrame:
    """Rows with no protected fingerprint within `radius`."""
    hit = pairs_within(rows, protected, radius, fingerprint).select(F.col("a").alias("_hit")).distinct()
    return rows.join(hit, F.col(fingerprint) == F.col("_hit"), "left_anti")


def nearest_distance(rows: DataFrame, key: str, fingerprint: str = "fp") -> DataFrame:
    """(key, nearest): the least distance to any other row, null for a row that is alone.

    Copies come first, then two narrow radii, where parts of them ask for little, each for the fingerprints that have found
    nothing yet. The rest meets all, block by block: wider radii ask for more than that.
    """
    own = rows.select(F.col(key), F.col(fingerprint).alias("_f"))
    counted = own.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    all_ = staged(counted.select(F.col("_f").alias("b")).where("b IS NOT NULL"), "nearest-all")
    n = all_.count()
    found = staged(counted.where("_n > 1 AND _f IS NOT NULL").select(F.col("_f").alias("a"), F.lit(0).alias("nearest")), "nearest")
    open_ = lambda: all_.withColumnRenamed("b", "a").join(found, "a", "left_anti")
    for radius in (2, 4):
        parts = best_parts(radius, n, ROW_COST)
        if parts:
            more = _by_parts(open_(), all_, radius, parts).where("a <> b").groupBy("a").agg(F.min("distance").cast("int").alias("nearest"))
            found = staged(found.unionByName(more), "nearest")
    left = staged(open_(), "nearest-open")
    m = left.count()
    if m:
        more = _by_tiles(left, all_, m, n, _least, "a long, least int").groupBy("a").agg(F.min("least").alias("nearest")).where("nearest <= 64")
        found = found.unionByName(more)
    return own.join(found, F.col("_f") == F.col("a"), "left").select(key, "nearest")


def quarantine(rows: DataFrame, radius: int, split: str = "split", fingerprint: str = "fp") -> DataFrame:
    """Adds `quarantined`: val near test, then train near test or what is left of val. Test stays fixed."""
    of = lambda s: rows.where(F.col(split) == s)
    val = without_near(of("val"), of("test"), radius, fingerprint)
    kept = of("test").unionByName(val)
    train = without_near(of("train"), kept, radius, fingerprint)
    left = kept.unionByName(train).withColumn("quarantined", F.lit(False))
    gone = of("val").join(_hits(of("val"), of("test"), radius, fingerprint), F.col(fingerprint) == F.col("_hit"), "left_semi").unionByName(of("train").join(_hits(of("train"), kept, radius, fingerprint), F.col(fingerprint) == F.col("_hit"), "left_semi"))
    return left.unionByName(gone.withColumn("quarantined", F.lit(True)))


def _hits(rows: DataFrame, protected: DataFrame, radius: int, fingerprint: str) -> DataFrame:
    return pairs_within(rows, protected, radius, fingerprint).select(F.col("a").alias("_hit")).distinct()
