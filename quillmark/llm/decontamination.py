"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Items form an inverted
index: postings in item order, in blocks that know their largest weight. A document's
distinct words are one query: verification counts the whole document, so an item whose pieces lie far apart
must be retrieved like any other.

A copy holds at least `similarity` of an item's distinct shingles of `width` words. If so, a word of the item can
be missing only where shingles are missing, and each missing position costs a shingle; the BM25 weight
that may be missing is at most that of the item's heaviest words, as many as shingles may miss. An
item's threshold is its own weight without those, so retrieving all items at or above it loses no
copy. Weights are divided by thresholds when the index is built: block-max WAND then leaves out
blocks of items whose largest weights sum to less than 1 and walks the rest pivot by pivot.

What it retrieves is verified: of the whole document, at least `similarity` of the item's shingles
must be there; so must the question (the words before the last sentence) and the answer (the last
sentence, or the last quarter of an item of one sentence): at least `PART_SIMILARITY` of its neighbouring words
must be neighbours in the document, too (of its words, where it has fewer than `PAIRED_FROM`). One edited word
costs a part two of its pairs at most, so no single edit hides a part of two words or more. An item with fewer words than a shingle counts as
one shingle.

The index is broadcast if the items measure at most `broadcast_bytes`; beyond that the items are
dealt into parts of that size, and each part has its own pass over the documents. Null and empty
texts match nothing, nor do items without a word. Repeated documents each give their rows. Very long
texts go whole: a document's distinct words are one query however long it is. Extra columns are neither
read nor returned, whatever their names; `without_contaminated` passes them unchanged.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.texts import filter_rows, map_rows, raw_text

WIDTH, SIMILARITY = 5, 0.8
#: Share of the question's and of the answer's pairs of words, and the words from which on a part has pairs enough.
PART_SIMILARITY, PAIRED_FROM = 0.5, 5
K1, B, BLOCK = 1.2, 0.75, 8
BROADCAST_BYTES = 32 << 20
_OTHER = bytes(b for b in range(128) if not chr(b).isalnum())
_TO_SPACE = bytes.maketrans(_OTHER, b" " * len(_OTHER))
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()


def shingles_of(words: list[bytes], width: int = WIDTH) -> set[bytes]:
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    cuts = _SENTENCE.split(text.strip())
    if len(cuts) > 1:
        return " ".join(cuts[:-1]), cuts[-1]
    words = text.split()
    k = len(words) - max(1, len(words) // 4)
    return " ".join(words[:k]), " ".join(words[k:])


def pairs_of(words: list[bytes]) -> list[bytes]:
    """Neighbouring words, one pair for each place."""
    return list(map(b" ".join, zip(words, words[1:], strict=False)))


class Item:
    __slots__ = ("answer", "item_id", "question", "shingles", "words")

    def __init__(self, item_id: int, text: str, width: int):
        self.item_id, self.words = item_id, words_of(text)
        self.shingles = shingles_of(self.words, width)
        self.question, self.answer = (self._part(words_of(p)) for p in parts_of(text))

    @staticmethod
    def _part(words: list[bytes]) -> tuple[bool, list[bytes]]:
        """Pairs of words, or single words where there are too few; repeats count."""
        return (True, pairs_of(words)) if len(words) >= PAIRED_FROM else (False, words)


class Index:
    """Inverted index of items with weights divided by each item's threshold."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, similarity: float = SIMILARITY):
        self.width, self.similarity = width, similarity
        self.items = [x for x in (Item(i, t, width) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))) if x.words]
        n = max(len(self.items), 1)
        mean = sum(len(x.words) for x in self.items) / n
        frequency: dict[bytes, int] = {}
        for x in self.items:
            for w in set(x.words):
                frequency[w] = frequency.get(w, 0) + 1
        self.postings: dict[bytes, list[tuple[int, float]]] = {}
        for k, x in enumerate(self.items):
            weights: dict[bytes, float] = {}
            for w, tf in Counter(x.words).items():
                weights[w] = math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x.words) / mean))
            missing = self._may_miss(x)
            threshold = sum(sorted(weights.values())[: max(1, len(weights) - missing)])
            for w, weight in weights.items():
                self.postings.setdefault(w, []).append((k, weight / threshold * (1 + 1e-9)))
        self.most = {w: max(v for _, v in p) for w, p in self.postings.items()}
        self.vocabulary = frozenset(self.postings)
        self.n_blocks = -(-len(self.items) // BLOCK)
        self.inside: list[dict[bytes, tuple[list, float]]] = [{} for _ in range(self.n_blocks)]
        for w, p in self.postings.items():
            for k, v in p:
                own, most = self.inside[k // BLOCK].get(w, ([], 0.0))
                own.append((k, v))
                self.inside[k // BLOCK][w] = (own, max(most, v))
        held: dict[bytes, list] = {}
        for block, own in enumerate(self.inside):
            for w, (_, most) in own.items():
                held.setdefault(w, []).append((block, most))
        self.blocks = {w: (np.array([k for k, _ in x], np.int64), np.array([v for _, v in x])) for w, x in held.items()}

    def _may_miss(self, item: Item) -> int:
        """Distinct words that may be absent while enough shingles are present: each takes at least one shingle with it."""
        return math.floor((1 - self.similarity) * len(item.shingles) + 1e-9)

    def open_blocks(self, terms: list[bytes]) -> list[int]:
        """Blocks of items whose largest weights for the terms sum to at least 1; no item of the others can."""
        if not terms:
            return []
        pairs = [self.blocks[t] for t in terms]
        bound = np.bincount(np.concatenate([i for i, _ in pairs]), np.concatenate([v for _, v in pairs]), self.n_blocks)
        return np.flatnonzero(bound >= 1.0).tolist()

    def retrieve(self, terms: list[bytes]) -> list[int]:
        """All items whose score for the query terms is at least 1, by block-max WAND."""
        own = set(terms)
        return [item for block in self.open_blocks(terms) for item in self._wand(own, block)]

    def _wand(self, terms: set[bytes], block: int) -> list[int]:
        """WAND over the postings inside one block: lists in the order of their items, up to the pivot that could reach 1."""
        here, out = self.inside[block], []
        lists = [[0, len(here[t][0]), *here[t]] for t in here.keys() & terms]
        while True:
            lists = sorted((x for x in lists if x[0] < x[1]), key=lambda x: x[2][x[0]][0])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[3]
                if bound >= 1.0:
                    pivot = x[2][x[0]][0]
                    break
            if pivot is None:
                return out
            if lists[0][2][lists[0][0]][0] == pivot:
                score = 0.0
                for x in lists:
                    if x[2][x[0]][0] != pivot:
                        break
                    score += x[2][x[0]][1]
                    x[0] += 1
                if score >= 1.0:
                    out.append(pivot)
            else:
                for x in lists:
                    if x[2][x[0]][0] >= pivot:
                        break
                    x[0] = bisect_left(x[2], (pivot,), x[0], x[1])

    def candidates(self, words: list[bytes]) -> set[int]:
        """Items that the words of the whole document retrieve, wherever in it they stand."""
        present = self.vocabulary.intersection(words)
        if sum(map(self.most.__getitem__, present)) < 1.0:
            return set()
        return set(self.retrieve(sorted(present)))

    def matches(self, text: str) -> list[tuple[int, float, float, float]]:
        """(item_id, similarity, question overlap, answer overlap) of every verified item."""
        words = words_of(text)
        found = self.candidates(words)
        if not found:
            return []
        own = shingles_of(words, self.width)
        single, paired, out = frozenset(words), frozenset(pairs_of(words)), []
        for k in sorted(found):
            item = self.items[k]
            if len(item.words) < self.width:  # one short shingle: look for it at every place
                m = len(item.words)
                whole = float(any(words[i : i + m] == item.words for i in range(len(words) - m + 1)))
            else:
                whole = len(item.shingles & own) / len(item.shingles)
            if whole < self.similarity:
                continue
            shares = [sum(unit in (paired if pairs else single) for unit in part) / len(part) if part else 1.0 for pairs, part in (item.question, item.answer)]
            if min(shares) >= PART_SIMILARITY:
                out.append((item.item_id, whole, *shares))
        return out


class _Worker:
    def __init__(self, broadcast, settings: tuple):
        self.broadcast, self.settings, self.own = broadcast, settings, None

    def __getstate__(self):
        return {"broadcast": self.broadcast, "settings": self.settings, "own": None}

    def matches(self, text: str) -> list:
        if self.own is None:
            self.own = Index(self.broadcast.value, *self.settings)
        return self.own.matches(text)


def _parts(items: DataFrame, broadcast_bytes: int) -> list[DataFrame]:
    clean = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    measured = clean.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-measured // broadcast_bytes))
    return [clean] if n == 1 else [clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n)) == k) for k in range(2 * n)]


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Returns one row (doc_id, item_id, similarity, question_overlap, answer_overlap) for each document and item that it holds."""
    sc = docs.sparkSession.sparkContext
    out = None
    for part in _parts(items, broadcast_bytes):
        worker = _Worker(sc.broadcast([(r.item_id, r.text) for r in part.collect()]), (width, similarity))

        def rows(batch: pa.RecordBatch, worker: _Worker = worker) -> dict:
            found = [(d, *m) for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if x for m in worker.matches(x.decode("utf-8", "replace"))]
            names = ("doc_id", "item_id", "similarity", "question_overlap", "answer_overlap")
            return {name: [f[k] for f in found] for k, name in enumerate(names)}

        own = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(docs)), rows, "doc_id long, item_id long, similarity double, question_overlap double, answer_overlap double")
        out = own if out is None else out.unionByName(own)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns. The texts are scanned where they lie; nothing is joined."""
    sc, out = docs.sparkSession.sparkContext, docs
    for part in _parts(items, broadcast_bytes):
        worker = _Worker(sc.broadcast([(r.item_id, r.text) for r in part.collect()]), (width, similarity))
        out = filter_rows(out, lambda text, worker=worker: not text or not worker.matches(text))
    return out
