import random
import re

import numpy as np
import xxhash

from quillmark.llm import simhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(values, radius=2):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_fingerprints_equal_brute_force():
    rng = random.Random(3)
    for text in ["", " ", "One", "one TWO", "É é A", "a b c", *(" ".join(rng.choice("abcde") for _ in range(n)) for n in range(3, 40))]:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_long_text_is_counted_in_parts_without_loss():
    text = " ".join(str(k % 991) for k in range(70_000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def near_values(rng, n=300):
    base = [rng.getrandbits(64) for _ in range(n)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))) for b in base for _ in range(2)]
    crowd = [base[0] ^ sum(1 << (7 * k) for k in range(9) if rng.random() < 0.4) for _ in range(150)]
    return sorted({*base, *near, *crowd})


def test_links_span_exactly_the_groups_of_brute_force(spark):
    values = near_values(random.Random(5))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = brute_groups(values)
    for shard_rows in (20_000, 40):  # two levels, and more of them
        found = simhash.links(df, len(values), shard_rows).collect()
        parent = {v: v for v in values}

        def root(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        for r in found:
            a, b = (x & 0xFFFFFFFFFFFFFFFF for x in (r.a, r.b))
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        assert {v: root(v) for v in values} == want
        assert len(found) < 2 * len(values)  # forests, not all pairs of the crowd


def test_descent_prunes_nothing_it_needs(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    values = np.array(near_values(random.Random(9), 60), np.uint64)
    pairs = {(i, j) for i in range(len(values)) for j in range(len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 2 and ((int(values[i]) ^ int(values[j])) & 0xFFFFFFFF).bit_count() == 1}
    forest = simhash._Forest(len(values))
    every = np.arange(len(values))
    simhash._descend(values, every, every, np.uint64(0xFFFFFFFF), forest)
    assert all(forest.roots(np.array([i]))[0] == forest.roots(np.array([j]))[0] for i, j in pairs)


def test_a_crowd_looked_up_gives_the_groups_of_a_crowd_compared(monkeypatch):
    values = np.array(near_values(random.Random(11), 80), np.uint64)
    roots = []
    for most in (1 << 34, 0):
        monkeypatch.setattr(simhash, "CROWD", most)
        forest = simhash._Forest(len(values))
        every = np.arange(len(values))
        simhash._compare(values, values, every, every, forest)
        roots.append(forest.roots(every).tolist())
    assert roots[0] == roots[1]
    assert roots[0] == [values.tolist().index(v) for v in map(brute_groups(values.tolist()).get, values.tolist())]


def test_query_equals_brute_force_on_the_smallest_tables(spark, small):
    from quillmark.llm.queries import op1_simhash

    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    group = brute_groups(set(fps.values()))
    least = {}
    for d, f in fps.items():
        least[group[f]] = min(d, least.get(group[f], d))
    want = {(d, f"{f:016x}", least[group[f]]) for d, f in fps.items()}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in op1_simhash(spark, small).collect()} == want


def test_odd_rows(spark, odd, empty):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found}
    assert by[2].fp == by[4].fp == by[5].fp == 0 and by[4].component_id == by[5].component_id == 2
    assert by[6].component_id == by[7].component_id == 6 and by[11].component_id == 8
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({r.component_id for r in found if r.component_id is not None})
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.keep_one(empty).count() == 0
