import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import token_counts as tc
from quillmark.llm.queries import tokenizer_definition


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    definition = tokenizer_definition()
    library = Tokenizer.from_str(definition)
    return tc.Counter(tc.Merges(definition), definition, memory=60_000), lambda t: len(library.encode(t, add_special_tokens=False).ids)


def test_equals_the_library(both):
    ours, library = both
    rng = random.Random(2)
    texts = ["", " ", "\n\n  x", "don't we'll I'VE", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "x" * 3000, "12345" * 500, "日本語テスト　です", "\x1c\x1d\x85 ", "é‍", "🙂👍🏽", "՘౜ a"]
    texts += ["".join(rng.choice(" \n\tabcé日'1.,!") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    for t in texts:
        assert ours(t) == library(t), repr(t[:60])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    ours, library = test_any_text_equals_the_library.pair
    assert ours(text) == library(text)


@pytest.fixture(autouse=True)
def _pair(both):
    test_any_text_equals_the_library.pair = both


def test_proven_strings_are_single_tokens_of_the_library(both):
    ours, library = both
    for token in random.Random(1).sample(sorted(ours.counts.merges.whole), 2000):
        assert ours.counts.merges.count(token.encode()) == 1


def test_added_tokens_of_any_form():
    import json

    from tokenizers import Tokenizer

    model = json.loads(tokenizer_definition())
    model["added_tokens"] += [dict(model["added_tokens"][0], id=60_000, content="[SEP]"), dict(model["added_tokens"][0], id=60_001, content="[SEP]]")]
    definition = json.dumps(model)
    ours, library = tc.Counter(tc.Merges(definition), definition), Tokenizer.from_str(definition)
    for text in ("a[SEP]b", "[SEP]] [SEP] x", "no special <", "<|endoftext|>[SEP]"):
        assert ours(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_memory_is_bounded_by_length(both):
    counts = tc._Memory(both[0].counts.merges, 60_000)
    counts["abc" * 3000]
    assert counts.held == 9000
    counts.held = 64 * 60_000 + 1
    counts["cba" * 2000]
    assert counts.held == 6000 and "abc" * 3000 not in counts


def test_odd_rows(spark, odd, empty, both):
    found = tc.count_tokens(odd, tokenizer_definition()).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(found) == odd.count()
    for r in found:
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), both[1](t), both[1](t) > 512)
    assert tc.count_tokens(empty, tokenizer_definition()).count() == 0
