"""SimHash near-duplicates with vantage-point trees.

Fingerprints: A-Z lower-cased, words between white space, shingles of `width` words with repeats
(fewer words: the whole sequence; none: zero), XXH64 with seed 42; a bit is set if more than half
of the hashes have it. Two documents are linked if their fingerprints differ in at most 2 bits.

Pairs are found among distinct fingerprints only, so copies cost one row. A single tree with radius
2 over all 64 bits prunes badly, since distances to any vantage point crowd around 32; so there is
one tree over each half of the bits. Of two fingerprints within 2 bits, one half is within 1, and
Hamming distance over a half is a metric of its own, so the triangle bound holds in each tree:

* A tree level is a vantage point, its branches the distances to it. The upper levels are dealt as
  shards: a fingerprint is stored in the shard of its distances to all `levels` vantage points.
* If halves are equal, so are all their distances: such pairs meet in the shard where both are
  stored. If halves differ by one bit, each distance differs by exactly one: a fingerprint is also
  sent as a query to the shards at -1 or +1 in each level, with +1 in the first, for each pair needs
  one direction only. All other shards are pruned.
* Inside a shard the tree goes on with vantage points of the shard's own until a branch is small
  enough to compare all of it. Every pair is verified over 64 bits. A crowd that no vantage point
  parts is searched by its neighbours, in time that grows with its size, not its square.

Each shard reduces its pairs to a spanning forest before it emits them, so a group of n near copies
sends fewer than n links for each tree, not n squared. `levels` grows with the logarithm of the
distinct fingerprints, so that a shard holds about `shard_rows`. Vantage points come from a sample
of `sample` fingerprints; they shape the shards, never the result.

Null and empty texts have fingerprint zero and are linked like any other. Null doc_ids belong to
their group but never name it. Extra columns don't matter.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.texts import map_rows, raw_text
from quillmark.plans.components import components
from quillmark.plans.staging import staged

SEED, WIDTH, RADIUS = 42, 3, 2
SHARD_ROWS, SAMPLE, LEAF = 20_000, 512, 1 << 20
#: Least levels that are dealt: the third parts a crowd of near copies that the first two leave in one shard.
LEVELS = 3
#: Pairs compared at once: in a crowd of near copies all of them are links, held as several arrays of this length.
CELLS = 1 << 18
#: Pairs of a branch beyond which looking up all 2,081 neighbours of each query costs less than comparing.
CROWD = 1 << 34
_KEPT, _TIE = "__quillmark_kept", "__quillmark_tie"
_BASE = 35  # distances over a half, 0 to 32, and one to either side


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of a text."""
    words = raw.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n, ones = 0, np.zeros(64, np.int64)
    hashed, one = xxhash.xxh64_intdigest, SEED
    while True:
        part = np.array([hashed(s, one) for s in itertools.islice(shingles, 1 << 16)] if len(words) >= width else [hashed(shingles[0], one)], "<u8")
        n += len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        if len(part) < 1 << 16:
            return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the same bits."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(x, width) if x else 0 for x in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(docs)), rows, "doc_id long, fp long")


# --- the part of a tree inside a shard


def _distance(a: np.ndarray, b, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


class _Forest:
    """Union-find over a shard's fingerprints, fed with blocks of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        p = self.parent
        up = p[at]
        while True:
            over = p[up]
            if (over == up).all():
                p[at] = up
                return up
            up = over

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            if not apart.any():
                return
            high, low = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
            self.parent[high] = low  # one of each high root's links wins; the rest go round again


def _compare(stored: np.ndarray, queries: np.ndarray, at_s: np.ndarray, at_q: np.ndarray, forest: _Forest) -> None:
    """All of a branch, in blocks of bounded size."""
    if not len(at_s) or not len(at_q):
        return
    if len(at_s) * len(at_q) > CROWD:
        return _look_up(stored, queries, at_s, at_q, forest)
    rows = max(1, CELLS // len(at_s))
    for k in range(0, len(at_q), rows):
        own = at_q[k : k + rows]
        i, j = np.nonzero(np.bitwise_count(queries[own][:, None] ^ stored[at_s][None, :]) <= RADIUS)
        if len(i):
            forest.join(own[i], at_s[j])


def _look_up(stored: np.ndarray, queries: np.ndarray, at_s: np.ndarray, at_q: np.ndarray, forest: _Forest) -> None:
    """A crowd that no vantage point parts: every fingerprint within the radius of a query is looked up among the sorted stored ones."""
    order = at_s[np.argsort(stored[at_s])]
    keys = stored[order]
    for bits in itertools.chain.from_iterable(itertools.combinations(range(64), k) for k in range(RADIUS + 1)):
        wanted = queries[at_q] ^ np.uint64(sum(1 << b for b in bits))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        forest.join(at_q[hit], order[at[hit]])


def _descend(values: np.ndarray, at_s: np.ndarray, at_q: np.ndarray, mask: np.uint64, forest: _Forest, depth: int = 0) -> None:
    """Pairs of stored and queries one bit apart over `mask`: branches by distance to a vantage point, queries to both neighbours."""
    if len(at_s) * len(at_q) <= LEAF or depth > 12:
        return _compare(values, values, at_s, at_q, forest)
    vantage = values[at_s[(depth * 7919) % len(at_s)]]
    ds, dq = _distance(values[at_s], vantage, mask), _distance(values[at_q], vantage, mask)
    branches = np.unique(ds)
    if len(branches) < 2:
        return _compare(values, values, at_s, at_q, forest)
    for d in branches:
        _descend(values, at_s[ds == d], at_q[(dq == d - 1) | (dq == d + 1)] if d else at_q[dq == 1], mask, forest, depth + 1)


def shard_links(values: np.ndarray, query: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, smaller fingerprint of its group) among a shard's stored ones and its queries."""
    values = values.view(np.uint64)
    mask = np.uint64(0xFFFFFFFF << (32 * half))
    forest = _Forest(len(values))
    stored, queries = np.flatnonzero(~query), np.flatnonzero(query)
    own = values[stored] & mask
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    sizes = np.diff(np.concatenate([[0], cuts, [len(order)]]))
    for start, size in zip(np.concatenate([[0], cuts])[sizes > 1], sizes[sizes > 1], strict=True):
        run = stored[order[start : start + size]]
        _compare(values, values, run, run, forest)
    _descend(values, stored, queries, mask, forest)
    roots = forest.roots(np.arange(len(values)))
    linked = np.flatnonzero(roots != np.arange(len(values)))
    return values[linked].view(np.int64), values[roots[linked]].view(np.int64)


# --- the part of a tree that is dealt


def vantage_points(sample: list[int], levels: int, half: int) -> list[int]:
    """From the sample: each next point splits the sample into the most even shards, given those before."""
    halves = np.array([(x >> (32 * half)) & 0xFFFFFFFF for x in sample], np.uint64)
    if not len(halves):
        return [0] * levels
    cells, chosen = np.zeros(len(halves), np.int64), []
    for _ in range(levels):
        best = None
        for candidate in halves[:64]:
            split = cells * _BASE + np.bitwise_count(halves ^ candidate)
            crowd = float((np.unique(split, return_counts=True)[1].astype(float) ** 2).sum())
            if best is None or crowd < best[0]:
                best = (crowd, candidate, split)
        chosen.append(int(best[1]))
        cells = np.unique(best[2], return_inverse=True)[1]
    return chosen


def _dealt(distinct: DataFrame, levels: int, points: list[list[int]]) -> DataFrame:
    """(half, shard, query, fp): where each fingerprint is stored and asked for."""
    copies = []
    for half in (0, 1):
        bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        shard = sum(((F.bit_count(bits.bitwiseXOR(F.lit(p))) + 1).cast("long") * F.lit(_BASE**k) for k, p in enumerate(points[half])), F.lit(0).cast("long"))
        steps = [(False, 0)] + [(True, 1 + sum(s * _BASE**k for k, s in enumerate(signs, 1))) for signs in itertools.product((-1, 1), repeat=levels - 1)]
        copies += [F.struct(F.lit(half).alias("half"), (shard + F.lit(step)).alias("shard"), F.lit(query).alias("query")) for query, step in steps]
    return distinct.select("fp", F.explode(F.array(*copies)).alias("c")).select("c.half", "c.shard", "c.query", "fp")


def links(distinct: DataFrame, n: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links that span every group of the `n` distinct fingerprints `fp`."""
    levels = max(LEVELS, math.ceil(math.log10(max(n, 1) / shard_rows) + 1))
    sample = [r.fp & 0xFFFFFFFFFFFFFFFF for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    dealt = _dealt(distinct.select("fp"), levels, [vantage_points(sample, levels, half) for half in (0, 1)])

    def shard(group: pa.Table) -> pa.Table:
        a, b = shard_links(group.column("fp").to_numpy(), group.column("query").to_numpy(zero_copy_only=False).astype(bool), group.column("half")[0].as_py())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("half", "shard").applyInArrow(shard, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs`; component_id is the smallest doc_id that links reach."""
    own = staged(fingerprints(docs, width), "fingerprints")
    distinct = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = components(links(distinct, distinct.count(), shard_rows), "a", "b")
    named = groups.join(distinct, groups.node == distinct.fp).select("component", "fp", "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    # staged, so that the last join stands alone and Spark can split a fingerprint that very many documents share
    labels = staged(distinct.join(linked, distinct.fp == F.col("_fp"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "labels")
    return own.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_named(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is in the one column of `kept`, one row each, and all rows without doc_id.

    Rows that share a doc_id are told apart by a hash of their columns: the least one stays, so a task run again keeps the same.
    """
    name = kept.columns[0]
    tie = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"))
    least = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias(name), tie.alias(_TIE)).groupBy(name).agg(F.min(_TIE).alias(_TIE)).join(kept, name, "left_semi")
    rows = docs.where(F.col("doc_id").isNotNull()).withColumns({f"{name}_": F.col("doc_id").cast("long"), f"{_TIE}_": tie})
    same = (F.col(f"{name}_") == F.col(name)) & (F.col(f"{_TIE}_") == F.col(_TIE))
    one = rows.join(least, same, "left_semi").dropDuplicates([f"{name}_", f"{_TIE}_"]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def keep_one(docs: DataFrame, **settings: int) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; rows without doc_id stay."""
    found = near_duplicates(docs, **settings)
    return keep_named(docs, found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(_KEPT)).distinct())
