import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quillmark.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[-1] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - c % 20, [])[: h[c]] + own_turns[h[c] :] for c, own_turns in turns.items()}
    members = defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    words = lambda text: len(re.findall("[^\x20\x09-\x0d]+", text))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (words(node[-1][1]) if node else 0) + sum(saved[x] for x in children[node])
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(turns[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(rng, n=150):
    said = [f"{'word ' * rng.randint(0, 5)}{k}" for k in range(3)] + ["", None]
    rows = []
    for c in rng.sample(range(400), n):
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, t, t, 1, None]), rng.choice(["user", "assistant", None]), rng.choice(said)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(pt.conversation_trie(df, rebuild=True)) == brute(rows)
    assert found(pt.conversation_trie(df)) == brute(rows, rebuild=False)


def test_deep_combs_take_few_rounds(spark, monkeypatch):
    """A comb (each conversation leaves the common one a turn later) and its nested prefixes: a tree as deep as it is long."""
    rows = []
    for c in range(60):
        rows += [(c, t, "user", f"turn {t}") for t in range(c)] + ([(c, c, "user", f"own {c}")] if c % 2 else [])
    rows += [(100 + k, 0, "user", "alone") for k in range(5)]
    rounds, step = [], pt._round
    monkeypatch.setattr(pt, "_round", lambda *a: rounds.append(1) or step(*a))
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(pt.conversation_trie(df)) == brute(rows, rebuild=False)
    assert len(rounds) <= 8


def test_many_ends_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 16)
    rows = [(c, 0, "user", "the same first turn") for c in range(-70, 900, 3)] + [(2000, 0, "user", "other")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(pt.conversation_trie(df)) == brute(rows, rebuild=False)


def test_odd_rows(spark):
    long = "many words " * 50_000
    rows = [(1, 0, None, None), (1, 0, None, None), (2, None, "user", ""), (None, 0, "user", "nobody's"), (20, 0, "user", long), (21, 1, "user", "x"), (23, 0, "user", "y"), (40, 2, "a", "12:b"), (41, 2, "a1", "2:b")]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA + ", depth string, place long")
    assert found(pt.conversation_trie(df, rebuild=True)) == brute(rows)
    assert found(pt.conversation_trie(spark.createDataFrame([], SCHEMA), rebuild=True)) == []
