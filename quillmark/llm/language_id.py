"""Language identification by compression.

Training takes, for each language, pieces of a bounded sample of labelled documents: those with
the least hashes of doc_id, `sample_docs` at most, and of each whole text a piece of `doc_bytes` from a place that another
hash of doc_id picks, so that headers and mastheads weigh no more than what follows, until `dict_bytes` are full. Each
language's bytes become a zstandard raw-content dictionary. Every language is learned; where there are
very many, their samples and dictionaries get smaller, so that all of them hold MOST_ROWS and MOST_BYTES at most.

A text is cut into blocks of `block` bytes (a whole number of characters is not needed: sizes are all
that counts); every block, with some filler, is compressed with each dictionary, and the language whose
sizes sum to the least wins, the first by name among equals. The margin is the relative gap to the second;
below `least_margin` the prediction is marked as rejected, and lang_pred stays the best guess.

Null texts and texts without a letter are `und` with score 0 and are rejected. Without any labelled
document every text is `und`. Very long texts go block by block. Repeated rows get their prediction each;
extra columns are neither read nor returned, but for those named in `keep`.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.texts import filter_rows, map_rows

SAMPLE_DOCS, DOC_BYTES, DICT_BYTES, BLOCK, LEVEL = 256, 448, 112 << 10, 4096, 6
#: Sampled documents and dictionary bytes of all languages together.
MOST_ROWS, MOST_BYTES = 1 << 17, 56 << 20
#: Languages whose sizes are broadcast; beyond it they are joined.
MOST_BROADCAST = 1 << 20
#: zstandard stores a block that hardly shrinks as it is, and all languages then tie; with this in every block short texts are coded, too.
FILLER = b"\n" * 128
LEAST_MARGIN = 0.004
#: Steepness of the score: a margin of 0.05 scores 0.92.
STEEP = 50.0
_LETTER = regex.compile(r"\p{L}")


def training_texts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, doc_bytes: int = DOC_BYTES, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary bytes by language. At most MOST_ROWS rows of `doc_bytes`, and one a language, reach the driver.

    Ids are chosen on narrow rows; only those below a hash bound of their language meet in its task.
    """
    docs = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = docs.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("_ids"))
    languages = sizes.count()
    if not languages:
        return {}
    sample_docs, dict_bytes = max(1, min(sample_docs, MOST_ROWS // languages)), max(64, min(dict_bytes, MOST_BYTES // languages))
    # the least hashes lie below a bound that some 8 x sample_docs ids of the language pass, however many partitions there are
    share = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    known = F.broadcast(sizes) if languages <= MOST_BROADCAST else sizes
    hashed = docs.select("doc_id", "lang").join(known, "lang").where(share <= 8.0 * sample_docs / F.greatest("_ids", F.lit(1))).select("doc_id", "lang", F.xxhash64("doc_id").alias("_h")).distinct()
    chosen = hashed.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_k") <= sample_docs)
    ids = chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "_k")
    # of rows that share a doc_id the least piece, so that a task run again learns the same
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.length("text") - doc_bytes, F.lit(0)) + 1)
    piece = F.substring(F.col("text"), start.cast("int"), F.lit(doc_bytes))
    found = docs.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).groupBy("_lang", "_k").agg(F.min(piece).alias("text"))
    by_lang: dict[str, list] = {}
    for row in found.toLocalIterator():
        by_lang.setdefault(row._lang, []).append((row._k, row.text))
    out = {}
    for lang in sorted(by_lang):
        pieces, total = [], 0
        for _, text in sorted(by_lang[lang]):
            raw = text.encode()[:doc_bytes]
            pieces.append(raw)
            total += len(raw)
            if total >= dict_bytes:
                break
        # zstandard finds recent bytes cheapest, and reads the whole dictionary
        out[lang] = b"\n".join(pieces)[:dict_bytes]
    return out


class Compressors:
    """One compressor for each language; built once in each worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        self.block, self.compressors = block, {}
        params = zstandard.ZstdCompressionParameters.from_level(level, source_size=block + len(FILLER), dict_size=max(map(len, dictionaries.values()), default=0), write_content_size=0, write_checksum=0, write_dict_id=0)
        for lang, raw in dictionaries.items():
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=params)
            self.compressors[lang] = zstandard.ZstdCompressor(dict_data=own, compression_params=params)

    def sizes(self, raw: bytes) -> list[tuple[int, str]]:
        """Bytes out for each language, least first; equal sizes go by name."""
        blocks = [raw[i : i + self.block] + FILLER for i in range(0, len(raw), self.block)]
        return sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.compressors.items())

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score and margin."""
        if not self.compressors or not _LETTER.search(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text.lower().encode())
        if len(sizes) < 2:
            return sizes[0][1], 1.0, 1.0
        margin = 1.0 - sizes[0][0] / max(sizes[1][0], 1)
        return sizes[0][1], 1.0 / (1.0 + math.exp(-STEEP * margin)), margin


class _Worker:
    def __init__(self, broadcast):
        self.broadcast, self.own = broadcast, None

    def __getstate__(self):
        return {"broadcast": self.broadcast, "own": None}

    def predict(self, text: str) -> tuple[str, float, float]:
        if self.own is None:
            self.own = Compressors(self.broadcast.value)
        return self.own.predict(text)


def learn(docs: DataFrame, **bounds: int) -> dict[str, bytes]:
    """Dictionaries from the labelled `docs`; texts are lower-cased as they are when predicted."""
    return {lang: raw.decode("utf-8", "ignore").lower().encode() for lang, raw in training_texts(docs, **bounds).items()}


def decided(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """The rows of `docs` whose language isn't rejected, with all their columns, whatever their names."""
    worker = _Worker(docs.sparkSession.sparkContext.broadcast(dictionaries))

    def keep(text: str | None) -> bool:
        lang, _, margin = worker.predict(text or "")
        return lang != "und" and margin >= least_margin

    return filter_rows(docs, keep)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Returns the columns `keep` of every row of `docs` with lang_pred, score, margin and rejected. Only text is read for the prediction."""
    worker = _Worker(docs.sparkSession.sparkContext.broadcast(dictionaries))
    kinds = dict(docs.dtypes)

    def rows(batch: pa.RecordBatch) -> dict:
        texts = (x.as_py() for x in batch.column("text"))
        found = [worker.predict(x or "") for x in texts]
        out = {name: batch.column(name) for name in keep}
        return out | {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "margin": [f[2] for f in found], "rejected": [f[0] == "und" or f[2] < least_margin for f in found]}

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "lang_pred string, score double, margin double, rejected boolean"
    text = [] if "text" in keep else [F.col("text").cast("string").alias("text")]
    return map_rows(docs.select(*keep, *text), rows, schema)
