import zlib

from quillmark.llm import language_id as li
from quillmark.llm.queries import op3_language_id


def test_held_out_accuracy_and_columns(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in op3_language_id(spark, folder).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(found) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in found.items())
    held = [d for d, r in found.items() if r.held_out]
    assert sum(found[d].lang_pred == truth[d] for d in held) / len(held) > 0.98


def test_prediction_ignores_all_but_text(spark):
    rows = [(1, "the cat and the dog are here", "en", "a"), (2, "le chat et le chien sont ici", "fr", "b")]
    df = spark.createDataFrame([(d + 10 * k, t + f" {k}", lang, s) for k in range(20) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string")
    dictionaries = li.learn(df)
    assert set(dictionaries) == {"en", "fr"}
    got = lambda x: sorted((r.doc_id, r.lang_pred, r.score) for r in li.identify(x, dictionaries).collect())
    from pyspark.sql import functions as F

    changed = df.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz"))
    assert got(df) == got(changed)
    assert all(p == ("en" if d % 10 == 1 else "fr") for d, p, _ in got(df))


def test_sample_is_bounded(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text", "'en' AS lang")
    found = li.training_texts(df, sample_docs=8, doc_bytes=100)
    assert len(found["en"]) <= 8 * 101


def test_pieces_come_from_all_of_a_text(spark):
    """Texts that begin alike, and differ only behind their first kilobyte."""
    df = spark.range(400).selectExpr("id AS doc_id", "concat(repeat('masthead ', 120), repeat(if(id % 2 = 0, 'katze hund ', 'chien chats '), 300)) AS text", "if(id % 2 = 0, 'de', 'fr') AS lang")
    found = li.training_texts(df, sample_docs=64)
    assert found["de"].count(b"katze") > 500 and found["fr"].count(b"chien") > 500 and b"masthead" in found["de"]
    assert found == li.training_texts(df.repartition(7), sample_docs=64)


def test_odd_rows(spark, odd, empty):
    dictionaries = {"en": b"one two three four the line that is long enough of its own", "ja": "日本語 です".encode()}
    by = {(r.doc_id): r for r in li.identify(odd, dictionaries).collect()}
    assert {by[d].lang_pred for d in (2, 4, 5, 14)} == {"und"} and by[2].score == 0 and by[2].rejected
    assert by[8].lang_pred == "en" and len(by) == odd.select("doc_id").distinct().count()
    assert li.identify(empty, dictionaries).count() == 0
    assert li.learn(empty) == {}
    assert {r.lang_pred for r in li.identify(odd, {}).collect()} == {"und"}
    kept = li.decided(odd, dictionaries)
    assert kept.columns == odd.columns and 2 not in {r.doc_id for r in kept.collect()}


def test_predictions_equal_plain_compression():
    import random

    import zstandard

    rng = random.Random(4)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(60)] for lang, letters in {"a": "abcdefg", "b": "defghij", "c": "éèaebcd"}.items()}
    made = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    dictionaries = {lang: made(lang, 900).encode() for lang in words}
    own = li.Compressors(dictionaries)
    params = zstandard.ZstdCompressionParameters.from_level(li.LEVEL, source_size=li.BLOCK + len(li.FILLER), dict_size=max(map(len, dictionaries.values())), write_content_size=0, write_checksum=0, write_dict_id=0)
    for n in (1, 3, 30, 150, 170, 200, 700, 3000):  # on both sides of a kilobyte and of a block
        for lang in words:
            text = made(lang, n)
            raw, sizes = text.lower().encode(), {}
            for name, content in dictionaries.items():
                sizes[name] = 0
                for k in range(0, len(raw), li.BLOCK):
                    plain = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    plain.precompute_compress(compression_params=params)
                    sizes[name] += len(zstandard.ZstdCompressor(dict_data=plain, compression_params=params).compress(raw[k : k + li.BLOCK] + li.FILLER))
            best, second = sorted((size, name) for name, size in sizes.items())[:2]
            found, score, margin = own.predict(text)
            assert found == best[1] and abs(margin - (1 - best[0] / second[0])) < 1e-12 and 0 <= score <= 1
            if n >= 30:
                assert found == lang


def test_every_language_is_learned(spark):
    df = spark.range(1400).selectExpr("id AS doc_id", "concat('l', id % 700) AS lang", "concat_ws(' ', transform(sequence(1, 20), k -> sha2(concat(id % 700, ':', k), 256))) AS text")
    dictionaries = li.learn(df)
    assert len(dictionaries) == 700
    wanted = {r.doc_id: r.lang for r in df.where("doc_id < 40").collect()}
    assert all(r.lang_pred == wanted[r.doc_id] for r in li.identify(df.where("doc_id < 40"), dictionaries).collect())


def test_samples_get_smaller_with_many_languages(spark, monkeypatch):
    monkeypatch.setattr(li, "MOST_BYTES", 3000)
    df = spark.range(900).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text", "concat('l', id % 9) AS lang")
    assert all(len(raw) <= 333 for raw in li.training_texts(df).values())
