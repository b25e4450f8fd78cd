import hashlib
import random

import numpy as np
import pytest

from quillmark.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string"


def brute(rows, window=13):
    split = lambda text: (text or "").encode().split()
    first = {}
    for d, text in rows:
        w = split(text)
        for k in range(len(w) - window + 1 if d is not None else 0):
            gram = tuple(w[k : k + window])
            first[gram] = min(d, first.get(gram, d))
    out = []
    for d, text in rows:
        w = split(text)
        gone = set()
        for k in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digests(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def made(rng, n=80):
    shared = [[f"s{k}w{rng.randint(0, 40)}" for _ in range(rng.randint(10, 60))] for k in range(8)]
    rows = []
    for d in rng.sample(range(500), n):
        words = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(shared)
            a = rng.randint(0, 8)
            words += rng.choice([p, p[a:], p[: len(p) - a], [rng.choice("abc") for _ in range(20)], [f"own{d}x{k}" for k in range(15)], ["la"] * rng.randint(5, 40)])
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA)
    assert digests(sd.dedup_substrings(df, digest=True)) == brute(rows)
    # small batches: documents in pieces, edges that meet in the shards
    assert digests(sd.dedup_substrings(df.repartition(7), digest=True, batch_words=40)) == brute(rows)
    assert digests(sd.dedup_substrings(df, digest=True, window=8, minimizer=3, batch_words=100)) == brute(rows, 8)


def test_shards_keep_sources_over_batches(spark):
    rows = made(random.Random(5))
    df = spark.createDataFrame(rows, SCHEMA)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        assert digests(sd.dedup_substrings(df, digest=True)) == brute(rows)
    finally:
        spark.conf.set(name, before)


def test_collisions_are_seen_and_done_again(spark, monkeypatch):
    rows = made(random.Random(3))
    df = spark.createDataFrame(rows, SCHEMA)
    tried, search = [], sd.found_paths

    def weak(named, window, minimizer, seed, batch_words):
        """A path between words that differ, in the first turn."""
        tried.append(seed)
        found = search(named, window, minimizer, seed, batch_words)
        wrong = spark.createDataFrame([(max(r[0] for r in rows), 0, 0, 1, min(r[0] for r in rows), 0, 0)], sd.PATH)
        return sd.staged(found.unionByName(wrong), "wrong") if seed == 0 else found

    monkeypatch.setattr(sd, "found_paths", weak)
    assert digests(sd.dedup_substrings(df, digest=True)) == brute(rows)
    assert tried == [0, 1]


def test_spans_have_their_sources_words(spark):
    rows = made(random.Random(4))
    words = {d: t.split() for d, t in rows}
    found = sd.repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert found
    for r in found:
        assert r.source_doc_id < r.doc_id and r.n_words >= 13
        assert words[r.doc_id][r.start : r.start + r.n_words] == words[r.source_doc_id][r.source_start : r.source_start + r.n_words]
    assert max(r.n_words for r in found) > 40  # paths go on over shards


def test_minimizers_are_the_first_least():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 5, 300).astype(np.uint64)
    whole, least, place = sd.edges(words, 13, 7)
    grams = sd._grams(words, 7)
    for i in range(288):
        own = grams[i : i + 7]
        assert least[i] == own.min() and place[i] == i + own.argmin()
    names = {}
    for i in range(288):
        assert names.setdefault(tuple(words[i : i + 13]), whole[i]) == whole[i]


def test_odd_rows(spark, odd, empty):
    assert sd.dedup_substrings(empty, digest=True).count() == 0
    got = digests(sd.dedup_substrings(odd, digest=True))
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(5, text), (5, text), (5, f"x {text}"), (5, None), (None, text), (3, "y"), (9, f"{text} z"), (-1, f"{text} q")]
    for some in (rows, rows[:-1]):
        assert digests(sd.dedup_substrings(spark.createDataFrame(some, SCHEMA), digest=True)) == brute(some)
    kept = {r.doc_id: r.text for r in sd.dedup_substrings(spark.createDataFrame(rows[4:], SCHEMA)).collect()}
    assert kept == {None: text, 3: "y", 9: "z", -1: f"{text} q"}
