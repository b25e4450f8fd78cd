"""Periodic runs of words: a stretch that repeats itself, found by bit-parallel lags.

A text's words get numbers, and each bit of the numbers is one big integer with a bit for each word (a plane).
For a lag q a plane is XORed with itself shifted by q; the OR of all planes' results has a zero wherever the
words q apart are identical. Zero stretches that are long enough are isolated by AND of the zeros with
themselves, shifted by 1, 2, 4, ...: what is left are their first bits. A lag is given up as soon as nothing is
left, which for most lags the first plane alone shows.

A run has period q, at least `least` words and `times` periods, and no neighbour extends it. Lags rise, and a
stretch that a smaller lag has given already isn't given again: a stretch of three periods whose smallest period
is another has one that divides q (Fine and Wilf), and then both stretches are the same.

Every text is one row's work, and whole: n words cost n / `times` lags of n / 64 machine words, some 0.1 s for
20,000 words and 6 s for 200,000. No document meets another, so nothing is shuffled.

Defined for odd rows: a null text has no words and an empty result, so has a text without words; rows without
doc_id are worked on like others; repeated rows are given each; ties are settled by start, then by period; extra
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.texts import map_rows, raw_text

LEAST, TIMES = 24, 3
Run = tuple[int, int, int]


def bit_planes(words: list[bytes]) -> list[int]:
    """One integer for each bit of the words' numbers; bit i stands for word i."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    bits = max(1, (len(numbers) - 1).bit_length())
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(bool), bitorder="little").tobytes(), "little") for b in range(bits)]


def long_stretches(ones: int, need: int) -> int:
    """The bits at which `need` ones in a row begin."""
    have = 1
    while have < need and ones:
        step = min(have, need - have)
        ones &= ones >> step
        have += step
    return ones


def find_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < least:
        return []
    first, *rest = bit_planes(words)
    found: dict[tuple[int, int], int] = {}
    compared = (1 << n) - 1
    for q in range(1, n // times + 1):
        compared >>= 1  # the last q words have no partner
        need = max(least - q, (times - 1) * q, 1)
        mismatch = first ^ (first >> q)
        begins = long_stretches(compared & ~mismatch, need)
        if begins and rest:
            for plane in rest:
                mismatch |= plane ^ (plane >> q)
            begins = long_stretches(compared & ~mismatch, need)
        while begins:
            start = (begins & -begins).bit_length() - 1
            tail = begins >> start
            more = (~tail & (tail + 1)).bit_length() - 1
            found.setdefault((start, more + need - 1 + q), q)
            begins = (tail >> more) << (start + more)
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that lie in a run, past that run's first period."""
    keep = bytearray(b"\1") * len(words)
    for start, length, q in runs:
        keep[start + q : start + length] = bytes(length - q)
    return list(compress(words, keep))


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length / period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a loop planted in those documents that a hash of doc_id picks, one in ten."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def periodic_runs(docs: DataFrame, rebuild: Callable[[list[bytes], int | None], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Every row's runs (array of start, length, period) and its text without the repeats, words joined by one space.

    `rebuild` may give other words for a document's own and its doc_id.
    """
    return _worked(docs, rebuild, least, times, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string", _outputs)


def run_digests(docs: DataFrame, rebuild: Callable[[list[bytes], int | None], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Every row's number of runs, its strongest run, and digests of all runs and of the text without the repeats."""
    return _worked(docs, rebuild, least, times, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", _digests)


def _outputs(runs: list[Run], kept: bytes) -> dict:
    return {"runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": kept.decode("utf-8", "replace")}


def _digests(runs: list[Run], kept: bytes) -> dict:
    start, length, period = strongest(runs) or (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return {
        "n_runs": len(runs),
        "start": start,
        "length": length,
        "period": period,
        "exponent_milli": 1000 * length // period if runs else None,
        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
    }


def _worked(docs: DataFrame, rebuild, least: int, times: int, schema: str, result: Callable[[list[Run], bytes], dict]) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> dict:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = (text.as_py() or b"").split()
            if rebuild:
                words = rebuild(words, doc_id)
            runs = find_runs(words, least, times)
            out.append(result(runs, b" ".join(collapsed(words, runs))))
        return {"doc_id": batch.column("doc_id")} | {name: [x[name] for x in out] for name in out[0]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(docs)), rows, schema)
