"""Repeated passages go: words covered by a window of 13 words that a document of a smaller doc_id has, too.

A window is an edge of the de Bruijn graph over 12-word nodes. As in graph builders for reads of DNA, a window is
dealt out by its minimizer, the 7-gram of least hash in it: neighbouring windows mostly share it, so a row carries
several edges (48 bits each beside the minimizer's 64) with their document and place.

1. Map side, over a million words at a time: where a batch has a window twice or more, all but the batch's least
   document are decided there and leave as spans; only that document's edges go on. So a passage that a third of all
   documents share costs one row a batch.
2. Rows meet by minimizer, sorted by document. The first to hold an edge is its source; an edge is repeated where its
   document is larger. Repeated edges of a row compact into a path while they follow their source word by word
   (so the path doesn't branch), kept as coordinates: document, start, edges, source document, source start.
3. Paths of one document that go on at the place where another ends, on the same source and distance, are joined.
4. Documents join their paths. There each path's words and its source's words are hashed anew (128 bits), and the
   two must agree for every path: if any pair differs, two edges have collided, and all is done again by other
   hashes. So results don't rest on 112 bits, and the loop ends after one turn but for such a case.

Memory: a batch of a million words (longer documents go in pieces that overlap by 12 words), and for one minimizer
the distinct edges seen. Texts are shuffled once, by doc_id.

Defined for odd rows: a null text has no words; a text of fewer than 13 words has no window and stays whole. Rows
without doc_id lose nothing, and nobody loses anything to them. Rows that share a doc_id are one document in that they lose
nothing to each other, but each is cut for itself. Repeated rows get the same result each; ties can't occur, for sources are of smaller doc_id. Extra columns are
neither read nor returned; very long texts go whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.texts import bound_batches, raw_text
from quillmark.plans.staging import drop_staged, staged

WINDOW, MINIMIZER = 13, 7
#: Words that one batch of the map side holds.
BATCH_WORDS = 1 << 20
#: Bytes of an edge's fingerprint beside its minimizer.
EDGE_BYTES = 6
#: Rows that a shard works on at once, so that a row's number fits beside an edge in 64 bits.
SLICE = 1 << 14

PATH = "doc long, part long, start long, n long, src long, spart long, sstart long"
ROW = f"key long, fps binary, {PATH}"
U64 = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row, from the words' own hashes."""
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), U64)
    for i in range(k if n > 0 else 0):
        h = h * U64(0x9E3779B97F4A7C15) + words[i : i + n]
    return _mixed(h)


class _Hashes(dict):
    """Hashes of words, by word."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


def edges(words: np.ndarray, window: int, minimizer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its hash, its minimizer's hash, and the place of the minimizer, the first if several are least."""
    grams, whole = _grams(words, minimizer), _grams(words, window)
    n = len(whole)
    least, place = grams[:n].copy(), np.arange(n)
    for k in range(1, window - minimizer + 1):
        other = grams[k : k + n]
        less = other < least
        least[less] = other[less]
        place[less] = np.flatnonzero(less) + k
    return whole, least, place


def _breaks(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any column; the first is True."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _paths(doc, part, start, src, spart, sstart, apart) -> dict[str, np.ndarray]:
    """Consecutive edges that follow their source, as paths; `apart` numbers what must not be joined."""
    at = np.flatnonzero(_breaks(apart, doc, part, src, spart, start - sstart) | np.r_[True, np.diff(start) != 1][: len(start)])
    n = np.diff(np.r_[at, len(start)])
    return {"doc": doc[at], "part": part[at], "start": start[at], "n": n, "src": src[at], "spart": spart[at], "sstart": sstart[at]}


class _Batch:
    """Pieces of documents, up to so many words."""

    def __init__(self, window: int, minimizer: int):
        self.window, self.minimizer = window, minimizer
        self.pieces: list[tuple[int, int, int, np.ndarray]] = []
        self.n = 0

    def add(self, doc: int, part: int, start: int, words: np.ndarray) -> None:
        self.pieces.append((doc, part, start, words))
        self.n += len(words)

    def rows(self) -> Iterator[dict]:
        """Paths decided here, then the edges that go on, as columns of ROW."""
        self.pieces.sort(key=lambda x: x[:3])
        sizes = np.array([len(x[3]) for x in self.pieces])
        words = np.concatenate([x[3] for x in self.pieces])
        whole, least, place = edges(words, self.window, self.minimizer)
        first = np.cumsum(sizes) - sizes
        inside = np.ones(len(words), bool)
        for k in range(1, self.window):
            inside[first + sizes - k] = False  # windows that would leave their piece
        at = np.flatnonzero(inside[: len(whole)])
        piece = np.repeat(np.arange(len(sizes)), sizes)[at]
        doc, part, offset = (np.array([x[k] for x in self.pieces], np.int64) for k in range(3))
        start, doc, part = at - first[piece] + offset[piece], doc[piece], part[piece]
        whole, least, place = whole[at], least[at], place[at]

        order = np.argsort(whole, kind="stable")  # and so by document
        run = np.cumsum(_breaks(whole[order], least[order])) - 1
        source = np.empty(len(at), np.int64)
        source[order] = order[np.flatnonzero(np.r_[True, np.diff(run) > 0])[run]] if len(at) else order
        here = doc[source] < doc
        k = np.flatnonzero(here)
        if len(k):
            s = source[k]
            paths = _paths(doc[k], part[k], start[k], doc[s], part[s], start[s], piece[k])
            yield paths | {"key": _mixed((paths["doc"] * 31 + paths["start"]).view(U64)).view(np.int64), "fps": None}
        k = np.flatnonzero(~here)
        if len(k):
            heads = np.flatnonzero(_breaks(piece[k], place[k]) | np.r_[True, np.diff(start[k]) != 1])
            ends = np.r_[heads[1:], len(k)]
            prints = (whole[k] >> U64(64 - 8 * EDGE_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :EDGE_BYTES]
            offsets = pa.array(np.r_[heads, len(k)] * EDGE_BYTES, pa.int32())
            fps = pa.Array.from_buffers(pa.binary(), len(heads), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(prints))])
            h = k[heads]
            yield {"key": least[h].view(np.int64), "fps": fps, "doc": doc[h], "part": part[h], "start": start[h], "n": ends - heads, "src": None, "spart": None, "sstart": None}


def _record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    n = len(columns["doc"])
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if columns[f.name] is None else columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _edge_rows(docs: DataFrame, window: int, minimizer: int, seed: int, batch_words: int) -> DataFrame:
    """docs: doc, part, text (bytes). Rows of ROW: edges by minimizer, and paths that are decided already (no fps)."""
    schema = pa.schema([("key", pa.int64()), ("fps", pa.binary()), *((c.split()[0], pa.int64()) for c in PATH.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrow in batches:
            hashes, now = _Hashes(seed), _Batch(window, minimizer)
            for doc, part, text in zip(arrow.column("doc").to_pylist(), arrow.column("part").to_pylist(), arrow.column("text"), strict=True):
                words = (text.as_py() or b"").split()
                for at in range(0, len(words) - window + 1, batch_words):
                    piece = words[at : at + batch_words + window - 1]
                    now.add(doc, part, at, np.fromiter(map(hashes.__getitem__, piece), U64, len(piece)))
                    if now.n >= batch_words:
                        yield from (_record_batch(x, schema) for x in now.rows())
                        now = _Batch(window, minimizer)
            if now.n:
                yield from (_record_batch(x, schema) for x in now.rows())

    return docs.mapInArrow(run, ROW)


def _shard_paths(rows: DataFrame) -> DataFrame:
    """Paths of rows that are together by key and sorted by key, doc, part, start."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PATH.split(", ")])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = None, [np.zeros(0, U64)] + [np.zeros(0, np.int64)] * 3  # edges of the last key so far, and their sources
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            decided = batch.filter(batch.column("fps").is_null())
            if decided.num_rows:
                yield decided.select(names).cast(schema)
            batch = batch.filter(batch.column("fps").is_valid())
            if not batch.num_rows:
                continue
            key, doc, part, start, n = (batch.column(c).to_numpy() for c in ("key", "doc", "part", "start", "n"))
            row = np.repeat(np.arange(len(n)), n)
            prints = np.zeros((len(row), 8), np.uint8)
            prints[:, :EDGE_BYTES] = np.frombuffer(b"".join(batch.column("fps").to_pylist()), np.uint8).reshape(-1, EDGE_BYTES)
            edge = prints.view("<u8").ravel()
            group = np.cumsum(_breaks(key)) - 1
            start = start[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
            old = state if known == key[0] else [x[:0] for x in state]
            name = np.r_[old[0], edge | (group[row].astype(U64) << U64(8 * EDGE_BYTES))]
            where = [np.r_[a, b] for a, b in zip(old[1:], (doc[row], part[row], start), strict=True)]
            order = np.argsort(name, kind="stable")  # and so by document
            begins = np.flatnonzero(_breaks(name[order]))
            source = np.empty(len(name), np.int64)
            source[order] = np.repeat(order[begins], np.diff(np.r_[begins, len(order)]))
            last = order[begins]
            last = last[(name[last] >> U64(8 * EDGE_BYTES)) == U64(group[-1])]
            known, state = key[-1], [name[last] & U64((1 << 8 * EDGE_BYTES) - 1), *(x[last] for x in where)]
            m = len(old[0])
            k = m + np.flatnonzero(where[0][source[m:]] < where[0][m:])
            if len(k):
                yield _record_batch(_paths(*(x[k] for x in where), *(x[source[k]] for x in where), row[k - m]), schema)

    return rows.mapInArrow(run, PATH)


def joined_paths(paths: DataFrame) -> DataFrame:
    """Paths that continue or overlap one another, on one source and distance, as one."""
    line = Window.partitionBy("doc", "part", "src", "spart", "_apart").orderBy("start", "n")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    dealt = paths.repartition("doc", "part").withColumn("_apart", F.col("start") - F.col("sstart"))
    begins = dealt.withColumn("_new", F.coalesce(F.col("start") > F.max(F.col("start") + F.col("n")).over(before), F.lit(True)).cast("long"))
    path = begins.withColumn("_path", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = path.groupBy("doc", "part", "src", "spart", "_apart", "_path").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("_end"))
    return one.select("doc", "part", "start", (F.col("_end") - F.col("start")).alias("n"), "src", "spart", (F.col("start") - F.col("_apart")).alias("sstart"))


def _named(docs: DataFrame) -> DataFrame:
    """doc, part, text (bytes). part tells rows apart that share a doc_id, by their text; it is zero where none do."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), raw_text(docs))
    shared = rows.where(F.col("doc").isNotNull()).groupBy("doc").count().where("count > 1").select("doc")
    if shared.isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("part"), "text")
    several = rows.join(shared.withColumn("_shared", F.lit(True)), "doc", "left")
    return several.select("doc", F.when(F.col("_shared"), F.xxhash64("text")).otherwise(F.lit(0)).alias("part"), "text")


def found_paths(named: DataFrame, window: int, minimizer: int, seed: int, batch_words: int) -> DataFrame:
    """Repeated paths of the rows of `_named`, staged; not yet held against their sources' words."""
    rows = _edge_rows(named.where(F.col("doc").isNotNull()), window, minimizer, seed, batch_words)
    together = rows.repartition("key").sortWithinPartitions("key", "doc", "part", "start")
    return staged(joined_paths(_shard_paths(together)), "repeated-paths")


def _cut(named: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """doc, n_words, n_removed, kept (bytes), and hashes of the words of the document's paths and of those it is the source of."""
    own = paths.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "n", "src", "spart", "sstart")).alias("own"))
    asked = paths.select("src", "spart", "sstart", "n").distinct().groupBy(F.col("src").alias("doc"), F.col("spart").alias("part")).agg(F.collect_list(F.struct("sstart", "n")).alias("asked"))
    rows = named.join(own, ["doc", "part"], "left").join(asked, ["doc", "part"], "left")
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("checks", pa.list_(pa.struct([("src", pa.int64()), ("spart", pa.int64()), ("sstart", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, part, text, mine, others in zip(*(batch.column(c) for c in ("doc", "part", "text", "own", "asked")), strict=True):
                words = (text.as_py() or b"").split()
                keep, checks = bytearray(b"\1") * len(words), []

                def digest(at: int, n: int, words=words) -> bytes:
                    return xxhash.xxh3_128_digest(b" ".join(words[at : at + n + window - 1]))

                for p in mine.as_py() or ():
                    keep[p["start"] : p["start"] + p["n"] + window - 1] = bytes(p["n"] + window - 1)
                    checks.append({k: p[k] for k in ("src", "spart", "sstart", "n")} | {"digest": digest(p["start"], p["n"])})
                for p in others.as_py() or ():
                    checks.append({"src": doc.as_py(), "spart": part.as_py(), "digest": digest(p["sstart"], p["n"])} | p)
                kept = [w for w, k in zip(words, keep, strict=True) if k] if checks else words
                for name, value in (("doc", doc.as_py()), ("n_words", len(words)), ("n_removed", len(words) - len(kept)), ("kept", b" ".join(kept)), ("checks", checks)):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return rows.mapInArrow(run, "doc long, n_words long, n_removed long, kept binary, checks array<struct<src: long, spart: long, sstart: long, n: long, digest: binary>>")


def _collided(cut: DataFrame) -> bool:
    """Whether any path's words differ from its source's."""
    checks = cut.select(F.explode("checks").alias("x")).select("x.*")
    return not checks.groupBy("src", "spart", "sstart", "n").agg((F.min("digest") != F.max("digest")).alias("apart")).where("apart").isEmpty()


def dedup_substrings(docs: DataFrame, digest: bool = False, window: int = WINDOW, minimizer: int = MINIMIZER, seed: int = 0, batch_words: int = BATCH_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space: `text`, or with `digest` their SHA-256, `kept_sha256`."""
    bound_batches(docs)
    named = _named(docs)
    kept = F.sha2("kept", 256).alias("kept_sha256") if digest else F.col("kept").cast("string").alias("text")
    while True:
        paths = found_paths(named, window, minimizer, seed, batch_words)
        cut = _cut(named, paths, window)
        out = staged(cut.select("doc", "n_words", "n_removed", kept, "checks"), "substrings-cut")
        drop_staged(paths)
        if not _collided(out):
            return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", out.columns[3])
        drop_staged(out)
        seed += 1


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER, seed: int = 0, batch_words: int = BATCH_WORDS) -> DataFrame:
    """doc_id, start, n_words of every repeated passage, with the doc_id and start of a smaller document that has the same words."""
    bound_batches(docs)
    paths = found_paths(_named(docs), window, minimizer, seed, batch_words)
    return paths.select(F.col("doc").alias("doc_id"), "start", (F.col("n") + window - 1).alias("n_words"), F.col("src").alias("source_doc_id"), F.col("sstart").alias("source_start"))
