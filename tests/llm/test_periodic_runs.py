import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from quillmark.llm import periodic_runs as pr
from quillmark.llm.queries import op12_periodic_runs


def brute(words, least=24, times=3):
    """Every stretch by its smallest period, from the borders of the words that begin at each start."""
    n, out = len(words), []
    for s in range(n):
        border = [0] * (n - s)
        for i in range(1, n - s):
            k = border[i - 1]
            while k and words[s + i] != words[s + k]:
                k = border[k - 1]
            border[i] = k + (words[s + i] == words[s + k])
        for i in range(n - s):
            length, e = i + 1, s + i + 1
            q = length - border[i]
            if length >= max(least, times * q) and (s == 0 or words[s - 1] != words[s - 1 + q]) and (e == n or words[e] != words[e - q]):
                out.append((s, length, q))
    return sorted(out)


def brute_digests(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        own, n, g = list(words), len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    s, length, q = best[0] if best else (None,) * 3
    return (doc_id, len(runs), s, length, q, 1000 * length // q if best else None, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def made(rng):
    words = []
    for _ in range(rng.randint(1, 5)):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        words += (unit * rng.randint(1, 12))[: rng.randint(1, 90)] + [rng.choice("abcdef") for _ in range(rng.randint(0, 3))]
    return [w.encode() for w in words]


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        words = made(rng)
        assert pr.find_runs(words) == brute(words)
        assert pr.find_runs(words, 6, 2) == brute(words, 6, 2)


def test_a_run_is_given_by_its_smallest_period():
    assert pr.find_runs([b"a"] * 100) == [(0, 100, 1)]
    assert pr.find_runs([b"a", b"b"] * 50) == [(0, 100, 2)]
    assert pr.find_runs([b"x"] + [b"a", b"b", b"b"] * 8 + [b"a"]) == [(1, 25, 3)]
    assert pr.find_runs([b"a"] * 23) == []


def test_plane_edges_and_long_texts():
    loop = [f"w{k}".encode() for k in range(1000)]
    assert pr.find_runs([b"begin", *loop * 3, b"end"]) == [(1, 3000, 1000)]
    assert pr.find_runs(loop * 2 + loop[:999]) == []
    words = [f"u{k}".encode() for k in range(30_000)]
    assert pr.find_runs(words) == []
    words[17_000:17_300] = [b"tick", b"tock"] * 150
    assert pr.find_runs(words) == [(17_000, 300, 2)]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(d, b" ".join(made(rng)).decode()) for d in range(120)] + [(None, "a " * 40), (7, None), (8, ""), (9, "\x1c \t\n x"), (9, "é " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = op12_periodic_runs(spark, str(tmp_path))
    order = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == sorted((brute_digests(*r) for r in rows), key=repr)


def test_operator_gives_runs_and_texts(spark):
    df = spark.createDataFrame([(1, "x " + "a b " * 15 + "y"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pr.periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 30, 2)] and got[1].collapsed == "x a b y"
    assert got[2].runs == [] and got[2].collapsed == ""


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_odd_rows(request, name):
    docs = request.getfixturevalue(name)
    assert pr.run_digests(docs, pr.looped).count() == docs.count()
    assert {"n_runs", "collapsed_sha256"} <= set(pr.run_digests(docs).columns)
