import random

import numpy as np

from quillmark.llm import simhash, similar_texts
from tests.llm.test_simhash import brute_fingerprint, brute_groups


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(texts):
    """The smallest doc_id of each document's group: SimHash links and 5-word similarity of 0.8 or more."""
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    near, own = brute_groups(set(fps.values())), {d: shingles(t) for d, t in texts.items()}
    group = {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (near[fps[a]] == near[fps[b]] or (own[a] and own[b] and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]))):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return group


def made(seed=1):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, out = text(150), []
    for _ in range(25):
        base = text(rng.randint(5, 300))
        out.append(base)
        for edits in (1, 2, 4, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(copy)
    out += [text(20) + passage + text(60) for _ in range(15)]  # a common passage alone is no similarity
    base = text(120)
    for _ in range(60):  # a crowd of near copies
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        out.append(copy)
    rng.shuffle(out)
    return {k: " ".join(w) for k, w in enumerate([*out, [], ["one"], ["One"], ["one", "two"]])}


def test_groups_equal_brute_force(spark):
    texts = made()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert len(set(want.values())) < len(set(brute_groups({brute_fingerprint(t) for t in texts.values()}).values()))
    for sample in (similar_texts.SAMPLE_DOCS, 20):  # the sample never shapes the result
        groups = {(r.fp, r.set): r.group for r in similar_texts.groups_of(df, sample_docs=sample).collect()}
        of = lambda t: tuple(np.array([simhash.fingerprint(t.encode())], np.uint64).view(np.int64).tolist()) + (similar_texts.set_name(similar_texts.shingle_hashes(t.encode())),)
        assert {d: groups[of(t)] for d, t in texts.items()} == want
    assert sorted(r.doc_id for r in similar_texts.keep_one(df).collect()) == sorted(set(want.values()))


def test_stage_leaves_no_near_copy(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, small).collect()}
    assert kept == set(brute({r.doc_id: r.text or "" for r in docs.collect()}).values())


def test_odd_rows(spark, odd, empty):
    kept = similar_texts.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NULL").count() == 1
    assert similar_texts.keep_one(empty).count() == 0


def test_keys_stay_rare_however_small_the_sample(spark):
    """A passage of one document in ten is nobody's key, though the wanted sample is a small part of the table."""
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    passages = [text(40) for _ in range(10)]
    texts = [(k, " ".join(text(100) + passages[k % 10] + text(40))) for k in range(400)]
    marks = similar_texts.marked(similar_texts._texts(spark.createDataFrame(texts, "doc_id long, text string")), 5, sample_docs=4)
    most = marks.selectExpr("set", "explode(keys) AS key").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert most <= 2
