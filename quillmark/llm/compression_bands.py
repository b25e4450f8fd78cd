"""Quality rules: base counts, then bands of zstandard ratios.

Base rules count words, symbols, repeated lines and words in repeated 8-word windows. The method
compresses the whole text, and every fixed chunk of it, and compares bytes out by bytes in with a
band that depends on the length in: under the band a text repeats itself, above it nothing
compresses. A document is kept if the base rules pass, its whole ratio is inside its band, and at
most `bad_chunks` of its chunks are outside theirs.

`fit_bands` finds the limits from labels: of all documents of good quality that pass the base rules it takes the ratios of
whole texts and chunks. Texts are measured once (`measured`); limits and verdicts both come from the measures. Bands
are half octaves of bytes. A band's lower limit leaves the share `lost` of its ratios below; its upper one stands a tenth
above the ratio that the same share exceeds, since good texts crowd far below noise. Bands with under `least_points` ratios, and
all without labels, have the fixed BANDS. Labels count by doc_id, a document with several by its worst; null ones don't count.

Null texts count as empty ones; empty texts fail the base rules. Very long texts go chunk by chunk and
whole; repeated rows get their verdict each; extra columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.texts import CONTINUATION, SPACE, map_rows, raw_text
from quillmark.plans.staging import staged

SYMBOLS = b"#*$%&|<>"
WINDOW, CHUNK, LEVEL = 8, 4096, 3
#: (bytes from, least ratio, largest ratio): the longer the input, the better prose compresses.
BANDS = ((0, 0.30, 1.25), (128, 0.35, 0.98), (512, 0.32, 0.85), (2048, 0.28, 0.75), (8192, 0.22, 0.68), (32768, 0.16, 0.62))
BAD_CHUNKS = 0.34
#: Share of good ratios under a lower limit; ratios that a band needs.
LOST, LEAST_POINTS = 0.005, 40
#: Ratios are counted in steps of this part.
STEPS = 4096
Bands = tuple[tuple[float, float, float], ...]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words (a power of two) found twice or more.

    Windows are named exactly: names of halves are paired and renumbered, so no hash can collide.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    names = np.fromiter(map(seen.setdefault, words, range(n)), np.int64, n)
    if len(seen) == n:
        return 0
    span = 1
    while span < window:
        pairs = names[:-span] * n + names[span:]
        _, names = np.unique(pairs, return_inverse=True)
        span *= 2
    repeated = np.flatnonzero(np.bincount(names)[names] > 1)
    if not len(repeated):
        return 0
    cover = np.zeros(n + 1, np.int64)
    cover[repeated] += 1
    cover[repeated + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    return len(words), len(raw.translate(None, SPACE + CONTINUATION)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def band(size: int, bands: Bands = BANDS) -> tuple[float, float]:
    return next((low, high) for at, low, high in reversed(bands) if size >= at)


def base_fails(words: int, repeated: int) -> bool:
    return words < 20 or 100 * repeated > 30 * words


def compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)


def ratios(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """Ratio of the whole text, and (bytes, ratio) of each chunk. A tail under half a chunk belongs to the chunk before."""
    whole = len(compressor.compress(raw)) / len(raw)
    cuts = list(range(0, max(len(raw) - CHUNK // 2, 1), CHUNK))
    if len(cuts) < 2:
        return whole, [(len(raw), whole)]
    return whole, [(b - a, len(compressor.compress(raw[a:b])) / (b - a)) for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def verdict(size: int, whole: float, chunks: list[tuple[int, float]], bands: Bands = BANDS) -> tuple[float, bool]:
    """Share of chunks outside their bands, and whether the method keeps the text."""
    low, high = band(size, bands)
    limits = [(*band(n, bands), r) for n, r in chunks]
    outside = sum(not a <= r <= b for a, b, r in limits) / len(chunks)
    return outside, low <= whole <= high and outside <= BAD_CHUNKS


def judged(raw: bytes, compressor: zstandard.ZstdCompressor, bands: Bands = BANDS) -> tuple[float | None, float, bool]:
    """Whole ratio, share of chunks outside their bands, and whether the method keeps the text."""
    if not raw:
        return None, 0.0, False
    whole, chunks = ratios(raw, compressor)
    return whole, *verdict(len(raw), whole, chunks, bands)


def half_octave(size: int) -> int:
    """floor(2 log2(size)), in whole numbers."""
    k = max(size, 1).bit_length() - 1
    return 2 * k + (size * size >> 2 * k + 1 > 0)


def first_size(half: int) -> int:
    """The least size of a half octave."""
    return 1 << half // 2 if half % 2 == 0 else math.isqrt((1 << half) - 1) + 1


def fitted(counts: Iterable[tuple[int, int, int]], lost: float = LOST, least_points: int = LEAST_POINTS) -> Bands:
    """Bands from how often good texts of a half octave have a ratio of so many STEPS; where they are few the fixed bands stay."""
    by_half: dict[int, list[tuple[int, int]]] = {}
    for half, step, n in counts:
        by_half.setdefault(half, []).append((step, n))
    own = {}
    for half, found in by_half.items():
        step, n = np.array(sorted(found)).T
        upto = np.cumsum(n)
        if upto[-1] >= least_points:
            at = lambda share: step[np.searchsorted(upto, share * upto[-1])] / STEPS  # noqa: B023, E731
            own[half] = float(at(lost)), float(1.1 * at(1 - lost))
    edges = sorted({at for at, _, _ in BANDS} | {first_size(j) for k in own for j in (k, k + 1)})
    return tuple((at, *(own.get(half_octave(at)) if at and half_octave(at) in own else band(at))) for at in edges)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, bytes, whole ratio, and the chunks' bytes and ratios of every row: each text is compressed once."""

    def rows(batch: pa.RecordBatch) -> dict:
        own = compressor()
        texts = [x or b"" for x in batch.column("text").to_pylist()]
        counts = [base_counts(x) for x in texts]
        found = [ratios(x, own) if x else (None, []) for x in texts]
        out = {name: [c[k] for c in counts] for k, name in enumerate(COUNTS)}
        return out | {"doc_id": batch.column("doc_id"), "size": list(map(len, texts)), "ratio": [w for w, _ in found], "sizes": [[n for n, _ in c] for _, c in found], "ratios": [[r for _, r in c] for _, c in found]}

    schema = "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "size long, ratio double, sizes array<long>, ratios array<double>"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(docs)), rows, schema)


def fit_measured(found: DataFrame, labels: DataFrame, lost: float = LOST, least_points: int = LEAST_POINTS) -> Bands:
    """Limits by length from the measures of all documents that `labels` (doc_id, quality) call good. The driver gets counts of ratios by half octave."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    good = known.where("_q = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    # of rows that share a doc_id one counts, the shortest
    measures = F.struct("size", *COUNTS, "ratio", "sizes", "ratios")
    one = found.join(good, "doc_id").groupBy("doc_id").agg(F.min(measures).alias("m")).select("m.*")
    sound = one.where("size > 0 AND n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words")
    own = F.array(F.struct("size", F.col("ratio").alias("r")))
    chunks = F.when(F.size("sizes") > 1, F.arrays_zip(F.col("sizes").alias("size"), F.col("ratios").alias("r"))).otherwise(F.array().cast("array<struct<size:bigint,r:double>>"))
    points = sound.select(F.explode(F.concat(own, chunks)).alias("p")).select("p.size", F.rint(F.col("p.r") * STEPS).cast("long").alias("step"))
    counted = points.groupBy(_half_octave("size").alias("half"), "step").agg(F.count(F.lit(1)).alias("n"))
    return fitted(map(tuple, counted.collect()), lost, least_points)


def _half_octave(size: str) -> Column:
    """`half_octave` as a column: the bounds are whole numbers, so no logarithm rounds."""
    bounds = F.array(*(F.lit(first_size(half)).cast("long") for half in range(1, 64)))
    return F.size(F.filter(bounds, lambda at: at <= F.col(size))).cast("long")


def fit_bands(docs: DataFrame, labels: DataFrame, lost: float = LOST, least_points: int = LEAST_POINTS) -> Bands:
    """Limits by length from `labels` (doc_id, quality) and all their documents."""
    return fit_measured(measured(docs), labels, lost, least_points)


def judge(found: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """Counts and verdicts of every row from its measures."""

    def rows(batch: pa.RecordBatch) -> dict:
        own = {name: batch.column(name).to_pylist() for name in ("size", "ratio", "sizes", "ratios", "n_words", "n_repeat_words")}
        failed = [base_fails(n, r) for n, r in zip(own["n_words"], own["n_repeat_words"], strict=True)]
        methods = [verdict(n, w, list(zip(s, r, strict=True)), bands) if n else (0.0, False) for n, w, s, r in zip(own["size"], own["ratio"], own["sizes"], own["ratios"], strict=True)]
        out = {name: batch.column(name) for name in ("doc_id", *COUNTS, "ratio")}
        return out | {"base_failed": failed, "kept": [not f and m[1] for f, m in zip(failed, methods, strict=True)], "chunks_outside": [m[0] for m in methods]}

    return map_rows(found, rows, "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, kept boolean, ratio double, chunks_outside double")


def quality(docs: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """Returns the counts and verdicts of every row of `docs`."""
    return judge(measured(docs), bands)


def fitted_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdicts by limits that are fitted to all labelled documents; the measures are staged, so texts are read once."""
    found = staged(measured(docs), "compression-measures")
    return judge(found, fit_measured(found, labels))
