"""Near-duplicates by similarity of word shingles, exact, beside the links of SimHash.

Two documents are linked if their sets of `width`-word shingles (A-Z lower-cased, words between white
space; fewer words: the whole sequence; none: nothing) have a Jaccard similarity of 4/5 or more, or if
SimHash links them. One document of each group stays.

Vantage-point trees serve the links of SimHash. They can't find the similar sets: at 4/5 some 10 of 64 bits
differ, and at that radius a tree prunes nothing. So similar sets meet by keys:

* In any common order of the shingles, sets of n and m with that similarity share one among the first
  n - ceil(4n/5) + 1 of the one and the like of the other: only those are keys. The order is by frequency
  in a sample, rarest first, so that a passage of many documents is nobody's key. The sample is a third of a
  large table, not a fixed number of documents: else passages that it misses would have ever more documents, and
  their keys' comparisons would grow with the square. The sample shapes the keys, never the result.
* Equal sets are one row from the start, so copies cost nothing. A set is named by a 64-bit hash.
* Each set first meets the least and the largest set of each of its keys, so that a crowd meets a few; then,
  under keys that still join different groups, those outside a key's largest group meet the others.
* Pairs are left out where sizes or the parities of the shingles over 1,024 bits, and then over 4,096, rule the
  similarity out; all others are verified on their whole sets.

A key that very many sets share, most of them not similar, costs comparisons (not rows) in the number of its sets
times those outside its largest group.

Null and empty texts have no shingle and are linked by SimHash alone. Rows without doc_id stay and link
nothing. Rows that share a doc_id are one document; of different ones the same one stays whenever a task
runs again. Very long texts are read one at a time. Columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import simhash
from quillmark.llm.texts import map_rows, raw_text
from quillmark.plans.components import components
from quillmark.plans.staging import drop_staged, staged

WIDTH = 5
#: Shingles are counted for the order of keys in SAMPLE_DOCS documents, but in one of SAMPLE_SHARE at least; most shingles that the broadcast order holds.
SAMPLE_DOCS, SAMPLE_SHARE, MOST_COUNTED = 16_384, 3, 1 << 20
#: Most ranges of hashes that are counted apart.
MOST_RANGES = 4096
#: Most ids of candidates that are broadcast to pick their texts; beyond it they are joined.
BROADCAST_IDS = 1 << 20
#: Parities of the shingles over 1,024 bits, in longs.
_BITS = tuple(f"b{k}" for k in range(16))
_KEPT = "__quillmark_kept"


def shingle_hashes(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, simhash.SEED) for s in found), np.uint64))


def set_name(hashes: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), np.uint64).view(np.int64))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether an odd number of the hashes falls on each of `bits` bits; of two sets they differ at most where the sets do."""
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    """A list column of the arrays, without a Python object for each number."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), raw_text(docs))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(set, odd, hashes) of every text with a word: its name, parities over 4,096 bits, and the whole set."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = [own for x in batch.column("text") if len(own := shingle_hashes(x.as_py() or b"", width))]
        return {"set": [set_name(x) for x in found], "odd": _longs([parities(x, 4096).view(np.uint64) for x in found]), "hashes": _longs(found)}

    return map_rows(texts, rows, "set long, odd array<long>, hashes array<long>")


def _hash_ranges(texts: DataFrame, width: int, ranges: int) -> DataFrame:
    """(range, hashes): the shingles of each batch's texts, 8 bytes each, by `ranges` ranges of hashes; far less to shuffle than rows."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = np.sort(np.concatenate([np.zeros(0, np.uint64), *(shingle_hashes(x.as_py() or b"", width) for x in batch.column("text"))]))
        at = ((found >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        names, starts = np.unique(at, return_index=True)
        return {"range": pa.array(names.astype(np.int32)), "hashes": [x.tobytes() for x in np.split(found, starts[1:])] if len(names) else []}

    return map_rows(texts, rows, "range int, hashes binary")


def _repeated(group: pa.Table) -> pa.Table:
    """(h, times) of the hashes of one range that occur more than once."""
    found, times = np.unique(np.frombuffer(b"".join(group.column("hashes").to_pylist()), np.uint64), return_counts=True)
    return pa.table({"h": found[times > 1].view(np.int64), "times": times[times > 1].astype(np.int64)})


def counted(texts: DataFrame, width: int, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that occur most in a sample, sorted, and in how many of its documents."""
    docs = texts.count()
    step = min(SAMPLE_SHARE, max(1, docs // sample_docs))
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0)
    ranges = _hash_ranges(sample, width, min(MOST_RANGES, 16 + docs // 64))
    found = ranges.groupBy("range").applyInArrow(_repeated, "h long, times long").orderBy(F.desc("times"), "h").limit(MOST_COUNTED).toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], np.minimum(found.column("times").to_numpy()[order], np.iinfo(np.int32).max).astype(np.int32)


def marked(texts: DataFrame, width: int, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(id, fp, set, n, b0 to b15, keys): SimHash, name and size of the set, its parities over 1,024 bits, and its rarest shingles."""
    known = texts.sparkSession.sparkContext.broadcast(counted(texts, width, sample_docs))

    def rows(batch: pa.RecordBatch) -> dict:
        common, times = known.value
        fps, names, sizes, bits, keys = [], [], [], [], []
        for text in batch.column("text"):
            raw = text.as_py() or b""
            own = shingle_hashes(raw, width)
            at = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
            count = np.where(common[at] == own, times[at], 0) if len(common) else np.zeros(len(own), np.int64)
            fps.append(simhash.fingerprint(raw))
            names.append(set_name(own))
            sizes.append(len(own))
            bits.append(parities(own, 1024))
            keys.append(own[np.lexsort((own, count))[: prefix_length(len(own)) if len(own) else 0]])
        bits = np.array(bits, np.int64).reshape(-1, len(_BITS))
        return {"id": batch.column("id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "set": names, "n": sizes, **{b: pa.array(bits[:, k]) for k, b in enumerate(_BITS)}, "keys": _longs(keys)}

    return map_rows(texts, rows, "id long, fp long, set long, n long, " + "".join(f"{b} long, " for b in _BITS) + "keys array<long>")


def _near_sizes() -> tuple:
    """Conditions on columns x_n, y_n and their parities that every similar pair meets."""
    apart = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in _BITS), F.lit(0))
    return F.expr("5 * x_n >= 4 * y_n AND 5 * y_n >= 4 * x_n"), 9 * apart <= F.col("x_n") + F.col("y_n")


def _side(table: DataFrame, name: str, *more: str) -> DataFrame:
    return table.select(*(F.col(c).alias(f"{name}_{c}") for c in ("set", "n", *_BITS, *more)))


def _verified(texts: DataFrame, pairs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(a, b): the documents that stand for those pairs (x, y) of sets that are similar."""
    sizes, odd = _near_sizes()
    both = pairs.join(_side(sets, "x", "id"), F.col("x") == F.col("x_set")).join(_side(sets, "y", "id"), F.col("y") == F.col("y_set")).where(sizes & odd)
    wanted = staged(both.select("x", "y", "x_n", "y_n", "x_id", "y_id"), "similar-candidates")
    ids = staged(wanted.select(F.col("x_id").alias("id")).unionByName(wanted.select(F.col("y_id").alias("id"))).distinct(), "similar-ids")
    whole = staged(_sets(texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi"), width).dropDuplicates(["set"]), "similar-sets")
    far = F.aggregate(F.zip_with("p", "q", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    of = lambda column, name, end: whole.select(F.col("set").alias(end), F.col(column).alias(name))
    near = staged(wanted.join(of("odd", "p", "x"), "x").join(of("odd", "q", "y"), "y").where(9 * far <= F.col("x_n") + F.col("y_n")).drop("p", "q"), "similar-near")
    links = near.join(of("hashes", "p", "x"), "x").join(of("hashes", "q", "y"), "y").where(9 * F.size(F.array_intersect("p", "q")) >= 4 * (F.size("p") + F.size("q")))
    out = staged(links.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")), "similar-links")
    for done in (wanted, ids, whole, near):
        drop_staged(done)
    return out


def groups_of(docs: DataFrame, width: int = WIDTH, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(id, fp, set, group) of every distinct text; id is its least doc_id, group the least doc_id that links reach."""
    texts = _texts(docs)
    marks = staged(marked(texts, width, sample_docs), "similar-keys")
    own = staged(marks.groupBy("fp", "set").agg(F.min("id").alias("id"), *(F.min(c).alias(c) for c in ("n", *_BITS))), "similar-texts")
    sets = staged(own.groupBy("set").agg(F.min("id").alias("id"), *(F.min(c).alias(c) for c in ("n", *_BITS))), "similar-distinct")
    prints = staged(own.groupBy("fp").agg(F.min("id").alias("id")), "similar-fingerprints")
    held = marks.select("set", F.explode("keys").alias("key"))
    several = held.groupBy("key").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low < high")
    shared = staged(held.join(several, "key").distinct(), "similar-shared")
    meet = lambda end: shared.where(F.col("set") != F.col(end)).select(F.least("set", end).alias("x"), F.greatest("set", end).alias("y"))
    found = _verified(texts, meet("low").unionByName(meet("high")).distinct(), sets, width)
    trees = simhash.links(prints, prints.count())
    named = lambda end: prints.select(F.col("fp").alias(end), F.col("id").alias(f"{end}_id"))
    edges = (
        own.select("set", F.col("id").alias("a")).join(sets.select("set", F.col("id").alias("b")), "set").where("a <> b").select("a", "b")
        .unionByName(own.select("fp", F.col("id").alias("a")).join(prints.select("fp", F.col("id").alias("b")), "fp").where("a <> b").select("a", "b"))
        .unionByName(trees.join(named("a"), "a").join(named("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
        .unionByName(found)
    )
    edges = staged(edges, "similar-edges")
    linked = components(edges, "a", "b")
    group = F.coalesce("component", "id").alias("group")
    grouped = staged(sets.join(linked, F.col("id") == F.col("node"), "left").select("set", "id", "n", *_BITS, group), "similar-grouped")
    # what is left: keys of more than two sets, of which some are neither the least nor the largest and in different groups
    middle = shared.where("set <> low AND set <> high").select("key", "set").join(grouped.select("set", "group"), "set")
    counts = middle.groupBy("key", "group").agg(F.count(F.lit(1)).alias("times"))
    open_keys = counts.groupBy("key").agg(F.max_by("group", F.struct("times", "group")).alias("bulk"), F.count(F.lit(1)).alias("groups")).where("groups > 1").drop("groups")
    left = staged(middle.join(open_keys, "key").select("key", "set", "bulk").join(grouped, "set"), "similar-open")
    sizes, odd = _near_sizes()
    x, y = _side(left.where("group <> bulk"), "x", "key", "group"), _side(left, "y", "key", "group", "bulk")
    pairs = x.join(y, (F.col("x_key") == F.col("y_key")) & F.expr("x_group < y_group OR x_group > y_group AND y_group = y_bulk") & sizes & odd).select(F.least("x_set", "y_set").alias("x"), F.greatest("x_set", "y_set").alias("y")).distinct()
    more = _verified(texts, pairs, grouped, width)
    again = components(edges.unionByName(more), "a", "b") if more.head() else linked
    out = staged(own.join(again, F.col("id") == F.col("node"), "left").select("id", "fp", "set", group), "similar-groups")
    for done in (marks, own, sets, prints, shared, found, edges, grouped, left, more, linked, again):
        drop_staged(done)
    return out


def keep_one(docs: DataFrame, width: int = WIDTH, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; rows without doc_id stay."""
    groups = groups_of(docs, width, sample_docs)
    return simhash.keep_named(docs, groups.groupBy(F.col("id").alias(_KEPT)).agg(F.min("group").alias("group")).where(F.col(_KEPT) == F.col("group")).select(_KEPT))
