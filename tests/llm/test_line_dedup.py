import hashlib
import random

import numpy as np

from quillmark.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = {}
    for d, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars and d is not None:
                holders.setdefault(k, set()).add(d)
    largest = {k: max(h) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if d is None or not (key(x) in largest and largest[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(rng, n=120):
    shared = [f"shared line number {k} which is long enough to count {'é' * k}" for k in range(12)] + ["x" * 39, "y" * 40, "é" * 40]
    return [(d, "\n".join(rng.choice([rng.choice(shared), rng.choice(shared).upper(), f" {rng.choice(shared)}\t", f"own {d}", "", f"line of document {d} alone that nobody else has ever had"]) for _ in range(rng.randint(0, 9)))) for d in range(n)]


def digests(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=repr)


def test_equals_brute_force_both_ways(spark):
    rows = made(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(ld.dedup_lines(df, digest=True)) == brute(rows)
    assert digests(ld.dedup_lines(df, digest=True, keys_per_shard=3)) == brute(rows)
    assert digests(ld.dedup_lines(df, digest=True, keys_per_shard=3, broadcast_bytes=0)) == brute(rows)


def test_rows_that_share_a_doc_id_are_one_document(spark):
    line = "a line that is long enough to be a key of its own, surely"
    for rows in ([(1, line)] * 4 + [(2, line)], [(1, line), (1, f"{line}\nx")] + [(k, line) for k in range(2, 6)] + [(5, f"y\n{line}"), (None, line)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for limit in (64 << 20, 0):
            assert digests(ld.dedup_lines(df, digest=True, broadcast_bytes=limit)) == brute(rows)


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 5000):
        h1, h2 = (rng.integers(0, 1 << 63, n, dtype=np.int64) for _ in range(2))
        shard = ld.Shard(ld.build_shard(h1, h2, np.arange(n), np.arange(n) * 3))
        slots = shard.slots(h1.view(np.uint64), h2.view(np.uint64))
        assert sorted(slots) == list(range(n))
        assert (shard.count[slots] == np.arange(n)).all() and (shard.largest[slots] == np.arange(n) * 3).all()
        other = rng.integers(0, 1 << 63, 1000, dtype=np.int64).view(np.uint64)
        assert (shard.slots(other, other) == -1).all()


def test_keys_with_equal_first_halves_stay_apart():
    h1 = np.full(40, 7, np.int64)
    h2 = np.arange(40, dtype=np.int64)
    shard = ld.Shard(ld.build_shard(h1, h2, h2, h2))
    slots = shard.slots(h1.view(np.uint64), h2.view(np.uint64))
    assert (shard.largest[slots] == h2).all()


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert digests(ld.dedup_lines(odd.select("doc_id", "text"), digest=True)) == brute(rows)
    assert digests(ld.dedup_lines(odd.select("doc_id", "text"), digest=True, broadcast_bytes=0)) == brute(rows)
    kept = ld.dedup_lines(odd)
    assert {"block", "score", "component_id", "lang"} <= set(kept.columns)
    by = {r.doc_id: r for r in kept.collect()}
    assert by[2].text is None and by[4].text == "" and by[12].text == "x\na line that is long enough to be a key of its own, surely\ny" and by[8].text == ""
    assert ld.dedup_lines(empty).count() == 0
