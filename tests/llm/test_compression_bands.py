import random
import re
from collections import Counter, defaultdict

from quillmark.llm import compression_bands as cb


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    repeated = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_base_counts_equal_brute_force():
    rng = random.Random(4)
    texts = ["", " \n", "é " * 9, "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "a\na\n\n \na\nb"]
    texts += [" ".join(rng.choice("ab") if rng.random() < 0.8 else "\n#é" for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for t in texts:
        assert cb.base_counts(t.encode()) == brute(t)


def test_repetition_and_noise_fall_outside_the_bands_and_prose_inside():
    import zstandard

    z = zstandard.ZstdCompressor(level=cb.LEVEL)
    rng = random.Random(1)
    syllables = ["ta", "re", "mi", "son", "der", "ing", "po", "lu", "ven", "st", "qua", "ble"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    for n in (30, 200, 2000, 20_000):
        prose = " ".join(rng.choice(vocabulary) for _ in range(n)).encode()
        assert cb.judged(prose, z)[2], n
    assert not cb.judged(b"same words again " * 400, z)[2]
    assert not cb.judged(rng.randbytes(5000), z)[2]
    half = " ".join(rng.choice(vocabulary) for _ in range(2000)).encode() + b"z" * 12_000
    assert cb.judged(half, z)[1] > cb.BAD_CHUNKS


def plain_verdict(raw):
    """Whole ratio and share of chunks outside their bands, by the module's written rule and the fixed bands."""
    import zstandard

    size = lambda x: len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(x))

    def inside(part, n):
        low, high = {0: (0.30, 1.25), 128: (0.35, 0.98), 512: (0.32, 0.85), 2048: (0.28, 0.75), 8192: (0.22, 0.68), 32768: (0.16, 0.62)}[max(k for k in (0, 128, 512, 2048, 8192, 32768) if k <= n)]
        return low <= part <= high

    chunks = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
    if len(chunks) > 1 and len(chunks[-1]) <= 2048:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    share = sum(not inside(size(c) / len(c), len(c)) for c in chunks) / len(chunks)
    return inside(size(raw) / len(raw), len(raw)) and share <= 0.34


def test_verdicts_equal_brute_force(spark, small):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {r.doc_id: r for r in cb.quality(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert set(found) == set(rows) and 0 < sum(r.kept for r in found.values()) < len(rows)
    for d, text in rows.items():
        n, *_, repeated = brute(text)
        failed = n < 20 or 100 * repeated > 30 * n
        assert found[d].base_failed == failed and found[d].kept == (not failed and plain_verdict((text or "").encode()))


def test_chunks_cover_the_whole_text():
    import zstandard

    z = zstandard.ZstdCompressor(level=cb.LEVEL)
    for n in (1, 100, 4096, 6143, 6144, 6145, 50_000):
        assert sum(size for size, _ in cb.ratios(b"ab" * n, z)[1]) == 2 * n


def test_odd_rows(spark, odd, empty):
    found = cb.quality(odd).collect()
    assert len(found) == odd.count() and cb.quality(empty).count() == 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_half_octaves_are_whole_numbers():
    for half in range(3, 80):
        at = cb.first_size(half)
        assert cb.half_octave(at) == half and cb.half_octave(at - 1) == half - 1
    assert cb.half_octave(4096) == 24 and cb.half_octave(0) == cb.half_octave(1) == 0


def test_limits_are_quantiles_and_the_rest_keeps_fixed_bands():
    counts = [(20, 2000 + k, 1) for k in range(200)] + [(30, 1000, 39)]
    bands = cb.fitted(counts)
    assert cb.band(1024, bands) == cb.band(1448, bands) == ((2000 + 0) / 4096, 1.1 * 2198 / 4096)
    for size in (0, 127, 1023, 1449, 2048, 32768, 40_000, 10**7):
        assert cb.band(size, bands) == cb.band(size)
    assert cb.fitted([]) == cb.BANDS


def test_fitted_limits_part_junk_from_good_text_on_held_out_labels(spark):
    """Limits from the labels of half of the documents, judged on the other half."""
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    bands = cb.fit_bands(docs, labels.where(~held))
    assert len(bands) > len(cb.BANDS)
    found = cb.quality(docs.join(labels.where(held).select("doc_id"), "doc_id", "left_semi"), bands).join(labels.select("doc_id", "quality"), "doc_id").where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert n[1, False] < 0.02 * n[1, True] and n[0, False] > 3 * n[0, True]


def test_labels_with_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (6, 1), (6, 1), (7, 1), (7, 0), (None, 1), (8, None), (99, 1)], "doc_id long, quality int")
    assert cb.fit_bands(odd, labels.limit(0)) == cb.fit_bands(empty, labels) == cb.BANDS
    # all that is labelled fails the base rules, or has a worse label, too
    assert cb.fit_bands(odd, labels, least_points=1) == cb.BANDS
    text = " ".join(f"{k * k:x}" for k in range(5000))
    docs = odd.unionByName(spark.createDataFrame([(99, text), (99, text + " more")], "doc_id long, text string"), allowMissingColumns=True)
    bands = cb.fit_bands(docs, labels, least_points=1)
    z = cb.compressor()
    whole, chunks = cb.ratios(text.encode(), z)
    assert {cb.band(size, bands)[0] for size in (len(text), 4096)} == {min(round(r * cb.STEPS) for s, r in [(len(text), whole), *chunks] if cb.half_octave(s) == cb.half_octave(size)) / cb.STEPS for size in (len(text), 4096)}
    assert cb.quality(docs, bands).count() == docs.count()


def test_junk_with_low_and_high_ratios_goes_at_each_length():
    rng = random.Random(9)
    syllables = ["ta", "re", "mi", "son", "der", "ing", "po", "lu", "ven", "st", "qua", "ble"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    z, counts = cb.compressor(), Counter()
    for n in (100, 400, 1500, 6000, 25_000):
        for _ in range(120):
            raw = " ".join(rng.choices(vocabulary, k=n))[: 5 * n].encode()
            whole, chunks = cb.ratios(raw, z)
            counts.update((cb.half_octave(size), round(r * cb.STEPS)) for size, r in [(len(raw), whole), *(chunks if len(chunks) > 1 else [])])
    bands = cb.fitted((*k, v) for k, v in counts.items())
    for n in (100, 400, 1500, 6000, 25_000):
        good = " ".join(rng.choices(vocabulary, k=n))[: 5 * n].encode()
        few = " ".join(rng.choices(vocabulary[:12], k=n))[: 5 * n].encode()
        noise = bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=5 * n))
        assert cb.judged(good, z, bands)[2] and not cb.judged(few, z, bands)[2] and not cb.judged(noise, z, bands)[2], n


def test_limits_come_from_every_labelled_document(spark):
    """More good documents than any sample held before: one ratio in each counts, and the sum of the counts is all of them."""
    texts = [" ".join(f"{(k + 1) * (j + 7):x}" for j in range(30)) for k in range(64)]
    docs = spark.range(1 << 15).selectExpr("id AS doc_id", "cast(id % 64 AS int) AS k").join(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k").drop("k")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    seen = []
    real, cb.fitted = cb.fitted, lambda counts, *more: seen.append(list(counts)) or cb.BANDS
    try:
        cb.fit_bands(docs, labels)
    finally:
        cb.fitted = real
    z, want = cb.compressor(), Counter()
    for x in texts:
        want[cb.half_octave(len(x)), round(cb.ratios(x.encode(), z)[0] * cb.STEPS)] += 1 << 9
    assert {(h, s): n for h, s, n in seen[0]} == want and sum(want.values()) == 1 << 15
