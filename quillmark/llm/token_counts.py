"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string is encoded alone; those that come out as one token
are proven whole. A text is cut into pre-tokens as the library cuts it; proven pre-tokens count one
each, and only the rest are merged, by rank, with a heap. Merged counts are remembered in each
worker up to `memory` entries (and 64 characters for each), then forgotten.

Texts go whole; null counts as empty. Repeated rows are counted each, extra columns left out. Added special tokens are matched first and count one each, as
the library does by default. Where a text holds code points that this Python's Unicode tables don't
know, the library's own pre-tokenizer cuts it, since tables of another age may class them otherwise.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.texts import map_rows, raw_text

#: The pre-token pattern of byte-level BPE, a fixed value of the format.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The format's printable stand-in for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Merge ranks of a byte-level BPE, and the vocabulary strings proven to encode alone as one token."""

    def __init__(self, definition: str):
        model, back = json.loads(definition), _byte_letters()
        raw = lambda token: bytes(back[c] for c in token)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.ranks = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(a), raw(b)] = rank
        self.whole = {}
        for token in model["model"]["vocab"]:
            if token not in self.special and self.count(own := raw(token)) == 1:
                try:
                    self.whole[own.decode()] = 1
                except UnicodeDecodeError:  # part of a character; no pre-token equals it
                    pass

    def count(self, piece: bytes) -> int:
        """Tokens of a pre-token: the pair of least rank merges first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            left -= 1
            if (k := before[i]) >= 0 and (r := self.ranks.get((parts[k], parts[i]))) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[i]))
            if (k := after[i]) < n and (r := self.ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        return left


class _Memory(dict):
    """Counts by pre-token; what is missing is merged."""

    def __init__(self, merges: Merges, most: int):
        super().__init__(merges.whole)
        self.merges, self.most, self.held = merges, most, 0

    def __missing__(self, piece: str) -> int:
        if len(self) > self.most or self.held > 64 * self.most:
            self.clear()
            self.update(self.merges.whole)
            self.held = 0
        self[piece] = n = self.merges.count(piece.encode("utf-8", "replace"))
        self.held += len(piece)
        return n


class Counter:
    """Counts tokens of texts; built once in each worker."""

    def __init__(self, merges: Merges, definition: str, memory: int = 500_000):
        self.counts = _Memory(merges, memory)
        self.tokens = tuple(merges.special)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.cut = regex.compile(PRE_TOKEN)
        self.definition, self.library = definition, None

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                if any(unicodedata.category(c) == "Cn" for c in set(text)):
                    return self._library_pieces(text)
        return self.cut.findall(text)

    def _library_pieces(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.definition).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def __call__(self, text: str) -> int:
        total, at = 0, 0
        if self.special is not None and any(token in text for token in self.tokens):
            for found in self.special.finditer(text):
                total += 1 + sum(map(self.counts.__getitem__, self.pieces(text[at : found.start()])))
                at = found.end()
        return total + sum(map(self.counts.__getitem__, self.pieces(text[at:] if at else text)))


class _Worker:
    def __init__(self, broadcast):
        self.broadcast, self.counter = broadcast, None

    def __getstate__(self):
        return {"broadcast": self.broadcast, "counter": None}

    def __call__(self, text: str) -> int:
        if self.counter is None:
            self.counter = Counter(*self.broadcast.value)
        return self.counter(text)


def count_tokens(docs: DataFrame, definition: str, limit: int = 512) -> DataFrame:
    """Returns doc_id, n_bytes, n_tokens, over_limit of every row of `docs`. `definition` is the content of the tokenizer's JSON file, whose size the vocabulary fixes."""
    worker = _Worker(docs.sparkSession.sparkContext.broadcast((Merges(definition), definition)))

    def rows(batch: pa.RecordBatch) -> dict:
        texts = [x or b"" for x in batch.column("text").to_pylist()]
        counts = [worker(x.decode("utf-8", "replace")) for x in texts]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(x) for x in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(docs)), rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
