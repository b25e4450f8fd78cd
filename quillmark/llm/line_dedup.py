"""Line de-duplication by a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
`min_chars` code points in at least `min_docs` documents lose all their lines except in the
largest doc_id that holds them.

1. Each document emits one 128-bit hash for each distinct long key: (h1, h2, doc_id).
2. Each key's distinct doc_ids are counted and the largest found, with partial sums; keys below
   `min_docs` can never drop a line and leave here.
3. The rest is dealt into shards by h1. Each shard becomes a minimal perfect hash: levels of bit
   arrays in which every key owns one bit, whose rank is the key's slot in the arrays of
   fingerprints (h2), counts and largest doc_ids.
4. Documents probe the arrays: a line goes if its fingerprint is right, its count reaches `min_docs`
   and the largest doc_id is another. Whatever h2 differs from the fingerprint isn't an indexed key.

The arrays are broadcast if they measure at most `broadcast_bytes`. Beyond it, probes (h1, h2,
doc_id; no texts) are dealt to the shards over salted partitions, where each task streams them
past its shard's arrays, and the drop lists are joined to the documents by doc_id.

Nulls and empty texts are one empty line. Rows that share a doc_id are one document when documents
are counted, and each loses its lines. Rows without doc_id are no document and keep all their lines.
Very long texts go whole.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.texts import SPACE, code_points, map_rows, raw_text
from quillmark.plans.sizing import shuffle_partitions
from quillmark.plans.staging import staged

MIN_CHARS, MIN_DOCS = 40, 5
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


# --- minimal perfect hash of one shard


def _positions(h1: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h1 ^ np.uint64((level + 1) * _MIX[0] & 0xFFFFFFFFFFFFFFFF)) * np.uint64(_MIX[1])
        x ^= x >> np.uint64(29)
        x *= np.uint64(_MIX[2])
        x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def build_shard(h1: np.ndarray, h2: np.ndarray, count: np.ndarray, largest: np.ndarray) -> bytes:
    """Serialises levels and arrays of keys; keys with equal h1 beyond the last level go to a sorted tail."""
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    left, levels, owners = np.arange(len(h1)), [], []
    for level in range(32):
        if not len(left):
            break
        size = max(64, -(-len(left) * 5 // 4 // 64) * 64)
        at = _positions(h1[left], level, size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        levels.append(np.packbits(bits, bitorder="little"))
        owners.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    tail = left[np.lexsort((h2[left], h1[left]))]
    order = np.concatenate([*owners, tail]).astype(np.int64) if len(h1) else np.zeros(0, np.int64)
    head = struct.pack(f"<qqq{len(levels)}q", len(levels), len(order), len(tail), *(len(x) * 8 for x in levels))
    return b"".join([head, *(x.tobytes() for x in levels), h1[tail].tobytes(), h2[order].tobytes(), count[order].astype(np.int64).tobytes(), largest[order].astype(np.int64).tobytes()])


class Shard:
    """The arrays of one shard, read in place."""

    def __init__(self, blob: bytes):
        n_levels, n, n_tail = struct.unpack_from("<qqq", blob)
        sizes = struct.unpack_from(f"<{n_levels}q", blob, 24)
        at, self.levels, rank = 24 + 8 * n_levels, [], 0
        for size in sizes:
            bits = np.unpackbits(np.frombuffer(blob, np.uint8, size // 8, at), bitorder="little")
            words = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(1, dtype=np.int64))])
            self.levels.append((size, bits, words[:-1] + rank))
            rank += int(words[-1])
            at += size // 8
        self.ranked = rank
        self.tail = np.frombuffer(blob, np.uint64, n_tail, at)
        at += 8 * n_tail
        self.fingerprint, self.count, self.largest = (np.frombuffer(blob, kind, n, at + 8 * n * k) for k, kind in enumerate((np.uint64, np.int64, np.int64)))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that aren't indexed."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, (size, bits, ranks) in enumerate(self.levels):
            if not len(left):
                return out
            at = _positions(h1[left], level, size)
            hit = bits[at] == 1
            found, at = left[hit], at[hit]
            word = at >> 6
            inside = (np.arange(64) < (at & 63)[:, None]) & (bits.reshape(-1, 64)[word] == 1)
            slot = ranks[word] + inside.sum(1)
            out[found] = np.where(self.fingerprint[slot] == h2[found], slot, -1)
            left = left[~hit]
        for i in left if len(self.tail) else ():
            for k in range(int(np.searchsorted(self.tail, h1[i], "left")), int(np.searchsorted(self.tail, h1[i], "right"))):
                if self.fingerprint[self.ranked + k] == h2[i]:
                    out[i] = self.ranked + k
        return out

    def drops(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which lines go: those of keys in enough documents, but in the largest of them."""
        slot = self.slots(h1, h2)
        return (slot >= 0) & (self.count[slot] >= min_docs) & (self.largest[slot] != ids) if len(self.count) else np.zeros(len(h1), bool)


# --- keys of lines


def line_keys(raw: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, 128-bit hash) of the lines whose key is long enough."""
    out = []
    for i, line in enumerate(raw.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(SPACE).lower()
            if len(key) >= min_chars and code_points(key) >= min_chars:
                out.append((i, xxhash.xxh3_128_digest(key)))
    return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)
    return pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.uint64)


def _emitted(min_chars: int):
    def rows(batch: pa.RecordBatch) -> dict:
        digests, ids = [], []
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if raw and doc_id is not None:
                own = {d for _, d in line_keys(raw, min_chars)}
                digests += own
                ids += [doc_id] * len(own)
        h1, h2 = _halves(digests)
        return {"h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64)), "doc_id": pa.array(ids, pa.int64())}

    return rows


def frequent_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n_docs, largest) of the keys that lose lines."""
    lines = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(docs)), _emitted(min_chars), "h1 long, h2 long, doc_id long")
    return lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("largest")).where(F.col("n_docs") >= min_docs)


def shard_table(keys: DataFrame, n_shards: int) -> DataFrame:
    """(shard, blob): the perfect hash of each shard. A shard holds about `keys_per_shard` keys, whatever the corpus."""

    def build(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_numpy() for c in ("h1", "h2", "n_docs", "largest")}
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "blob": pa.array([build_shard(*cols.values())], pa.binary())})

    return keys.withColumn("shard", F.pmod(F.shiftright("h1", 17), F.lit(n_shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, blob binary")


def _shard_of(h1: np.ndarray, n_shards: int) -> np.ndarray:
    return (h1.view(np.int64) >> np.int64(17)) % np.int64(n_shards)


class _Index:
    """Broadcast blobs, opened once in each Python worker."""

    def __init__(self, broadcast, n_shards: int, min_docs: int):
        self.broadcast, self.n_shards, self.min_docs, self.shards = broadcast, n_shards, min_docs, None

    def __getstate__(self):
        return self.__dict__ | {"shards": None}

    def dropping(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if self.shards is None:
            self.shards = {k: Shard(v) for k, v in self.broadcast.value.items()}
        out = np.zeros(len(h1), bool)
        where = _shard_of(h1, self.n_shards)
        for k in np.unique(where):
            shard = self.shards.get(int(k))
            if shard is not None:
                at = np.flatnonzero(where == k)
                out[at] = shard.drops(h1[at], h2[at], ids[at], self.min_docs)
        return out


def _kept(raw: bytes, drop: set[int]) -> tuple[int, bytes]:
    lines = raw.split(b"\n")
    return len(lines), b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else raw


def _probing(index: _Index, min_chars: int, digest: bool):
    def rows(batch: pa.RecordBatch) -> dict:
        ids, texts = batch.column("doc_id").to_pylist(), [x or b"" for x in batch.column("text").to_pylist()]
        digests, doc, line = [], [], []
        for k, raw in enumerate(texts):
            for i, d in line_keys(raw, min_chars) if ids[k] is not None else ():
                digests.append(d)
                doc.append(k)
                line.append(i)
        drops: dict[int, set[int]] = {}
        if digests:
            h1, h2 = _halves(digests)
            own = np.array([ids[k] for k in doc], np.int64)
            for j in np.flatnonzero(index.dropping(h1, h2, own)):
                drops.setdefault(doc[j], set()).add(line[j])
        return _result(batch, texts, drops, digest)

    return rows


def _result(batch: pa.RecordBatch, texts: list[bytes], drops: dict[int, set[int]], digest: bool) -> dict:
    out = {name: batch.column(name) for name in batch.schema.names}
    kept = [_kept(raw, drops.get(k, set())) for k, raw in enumerate(texts)]
    out["n_lines"], out["n_dropped"] = [n for n, _ in kept], [len(drops.get(k, ())) for k in range(len(kept))]
    if digest:
        out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for _, x in kept]
    else:
        was_null = batch.column("text").is_null().to_pylist()
        out["text"] = pa.array([None if null else x.decode("utf-8", "replace") for null, (_, x) in zip(was_null, kept, strict=True)], pa.string())
    return out


def _routed(docs: DataFrame, blobs: DataFrame, n_shards: int, min_chars: int, min_docs: int, salts: int) -> DataFrame:
    """(doc_id, drops): hashes of the lines that each document loses, by streaming probes past the shards."""
    lines = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(docs)), _emitted(min_chars), "h1 long, h2 long, doc_id long")
    probes = lines.select(F.pmod(F.shiftright("h1", 17), F.lit(n_shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "h2"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "h1", "h2", "doc_id", F.lit(None).cast("binary").alias("blob"))
    copies = blobs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("doc_id"), "blob")
    dealt = probes.unionByName(copies).repartition(max(n_shards * salts, shuffle_partitions(docs.sparkSession)), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    schema = pa.schema([("doc_id", pa.int64()), ("drop", pa.binary())])

    def stream(batches):
        name, shard = None, None
        for batch in batches:
            where, blob = batch.column("shard").to_numpy(), batch.column("blob")
            kind = batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(where)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(where)], strict=True):
                if hi == lo:
                    continue
                if where[lo] != name:
                    name, shard = where[lo], None
                opened = [i for i in range(lo, hi) if kind[i] == 0]
                if opened:
                    shard = Shard(blob[opened[0]].as_py())
                at = np.arange(lo, hi)[kind[lo:hi] == 1]
                if shard is None or not len(at):
                    continue
                h1, h2 = (batch.column(c).to_numpy()[at].view(np.uint64) for c in ("h1", "h2"))
                ids = batch.column("doc_id").to_numpy()[at]
                lost = np.flatnonzero(shard.drops(h1, h2, ids, min_docs))
                if len(lost):
                    keys = np.column_stack([h1[lost], h2[lost]]).astype(">u8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lost]), pa.array([keys[k : k + 16] for k in range(0, len(keys), 16)], pa.binary())], schema=schema)

    return dealt.mapInArrow(stream, "doc_id long, drop binary").groupBy("doc_id").agg(F.collect_set("drop").alias("__qm_drops"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digest: bool = False, keys_per_shard: int = 100_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Returns `docs` (doc_id and text first among its columns) with n_lines, n_dropped and the kept text, or kept_sha256 instead of text.

    Extra columns pass unchanged; columns named n_lines, n_dropped or kept_sha256 are replaced.
    """
    spark = docs.sparkSession
    keys = staged(frequent_keys(docs, min_chars, min_docs), "line-keys")
    n_shards = max(1, -(-keys.count() // keys_per_shard))
    blobs = staged(shard_table(keys, n_shards), "line-shards")
    measured = blobs.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0))).first()[0]
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped", "kept_sha256")] if not digest else []
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(docs), *extra)
    kinds = dict(docs.select(*extra).dtypes)
    schema = "doc_id long" + ("" if digest else ", text string") + "".join(f", `{c}` {kinds[c]}" for c in extra) + ", n_lines long, n_dropped long" + (", kept_sha256 string" if digest else "")
    if measured <= broadcast_bytes:
        index = _Index(spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in blobs.collect()}), n_shards, min_docs)
        return map_rows(wide, _probing(index, min_chars, digest), schema)
    drops = _routed(docs, blobs, n_shards, min_chars, min_docs, salts=8)
    joined = wide.join(drops.withColumnRenamed("doc_id", "__qm_drop_id"), F.col("doc_id") == F.col("__qm_drop_id"), "left").drop("__qm_drop_id")

    def rows(batch: pa.RecordBatch) -> dict:
        texts, lost = [x or b"" for x in batch.column("text").to_pylist()], batch.column("__qm_drops").to_pylist()
        gone = {}
        for k, (raw, keys) in enumerate(zip(texts, lost, strict=True)):
            if keys:
                own = set(keys)
                gone[k] = {i for i, d in line_keys(raw, min_chars) if d in own}
        return _result(batch, texts, gone, digest)

    return map_rows(joined, rows, schema)
