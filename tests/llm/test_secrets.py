import hashlib
import random
import re

from quillmark.llm import secrets as s

BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m))


def samples(n):
    rng = random.Random(8)
    parts = ["password", "TOKEN", "secret : ", "api_key=", "ApiKey", "AKIA", "0123456789abcdef", "ghp_", "a" * 12, "B" * 20, "'", '"', " = ", "://u:p@", "-----BEGIN RSA PRIVATE KEY-----", "é"]
    return ["".join(rng.choice(parts) if rng.random() < 0.5 else rng.choice("pasworde:=='\"AKI0f_. \né") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_base_spans_equal_brute_force():
    texts = samples(4000)
    found = s.Scanner().spans([t.encode() for t in texts])
    for t, own in zip(texts, found, strict=True):
        assert [x for x in own if x[1] < 3] == brute(t)


def test_one_pass_finds_what_each_rule_alone_finds():
    texts = [t.encode() for t in samples(800)]
    every = s.Scanner().automaton.scan(texts)
    for k, rule in enumerate(s.RULES):
        alone = re.compile(rule.trigger.encode())
        assert [bool(e >> k & 1) for e in every.tolist()] == [bool(alone.search(t)) for t in texts], rule.kind


def test_every_match_holds_its_trigger():
    for t in samples(3000):
        for rule in s.RULES:
            for m in re.finditer(rule.spans, t):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    assert re.search(rule.trigger, t), (rule.kind, t)


def every_rule(text):
    return sorted((m.start(), k, m.end()) for k, r in enumerate(s.RULES) for m in re.finditer(r.spans, text) if m.end(r.group) - m.start(r.group) >= r.least)


def test_spans_of_all_rules_equal_brute_force():
    rng, own = random.Random(12), s.Scanner()
    words = ["eyJ", "eyJ", ".", "aB3_-xY9", "ghp_", "gho_", "xoxb-", "AIza", "Z" * 33, "q" * 9, "a1B2" * 9, "https", "+", "://", "me", ":", "pw", "@", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", " ", "é", "token=", "AKIA", "deadbeef" * 2, '"', "\n"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    for t, found in zip(texts, own.spans([t.encode() for t in texts]), strict=True):
        assert found == every_rule(t), t


def test_lanes_change_nothing(monkeypatch):
    monkeypatch.setattr(s, "LANE", 80)
    own, texts = s.Scanner(), ["".join(samples(60)) for _ in range(20)]
    texts += ["a://" + "u" * 700 + ":p@ " + "f" * 500 + " eyJ" + "k" * 300 + ".eyJ" + "k" * 300 + "." + "k" * 300, "", "é" * 300 + " secret:" + " " * 200 + "abcdefghijklmnop"]
    for t, found in zip(texts, own.spans([t.encode() for t in texts]), strict=True):
        assert found == every_rule(t)
    assert own.automaton.slow is not None  # some lanes found their state too late


def test_a_long_text_costs_what_short_ones_cost():
    import time

    own, n = s.Scanner(), 10 << 20
    long = (" ".join(samples(2000)) * 1000).encode()[:n].decode("utf-8", "ignore").encode()
    short = [long[k : k + 4096] for k in range(0, len(long), 4096)]
    times = []
    for texts in (short, [long], short, [long]):
        began = time.perf_counter()
        own.spans(texts)
        times.append(time.perf_counter() - began)
    assert min(times[1], times[3]) < 3 * min(times[0], times[2])


def test_minimal_automaton_keeps_the_language():
    a = s.Automaton(("ab", "b[ab]{2}c"))
    assert a.states <= a.subsets
    assert a.scan([b"xab", b"bbabc", b"bbbc", b"", b"a"]).tolist() == [1, 3, 2, 0, 0]


def test_more_kinds():
    text = "x eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM ghp_" + "a1" * 18 + " xoxb-1234567890ab AIza" + "Z" * 35 + " https://me:pw@host"
    kinds = {s.RULES[k].kind for _, k, _ in s.Scanner().spans([text.encode()])[0]}
    assert {"web_token", "forge_token", "chat_token", "map_key", "url_login"} <= kinds


def test_odd_rows(spark, odd, empty):
    more = odd.select("doc_id", "text").union(spark.createDataFrame([(20, "é token = abcdefghijkl 0123456789abcdef0"), (21, "é" * 9 + "AKIA" + "Q" * 20)], "doc_id long, text string"))
    found = s.digest(s.find_secrets(more)).collect()
    texts = {r.doc_id: r.text or "" for r in more.collect()}
    assert len(found) == more.count()
    for r in found:
        want = brute(texts[r.doc_id])
        text = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
    assert s.digest(s.find_secrets(empty)).count() == 0
