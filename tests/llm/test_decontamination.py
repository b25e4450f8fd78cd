import random
from collections import Counter

from quillmark.llm import decontamination as d

VOCABULARY = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(600)]


def made(seed=3, n_items=60, n_docs=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(VOCABULARY[:60] if rng.random() < 0.6 else VOCABULARY)
    items = [(k, " ".join(word() for _ in range(rng.randint(3, 60))).capitalize() + ". " + " ".join(word() for _ in range(rng.randint(1, 9)))) for k in range(n_items)]
    docs = []
    for k in range(n_docs):
        words = [word() for _ in range(rng.randint(0, 900))]
        if k % 3 == 0:
            copy = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if k % 2 else w for w in copy]
        docs.append((k, " ".join(words)))
    return items, docs


def held_share(part, joined):
    """Share of a part's places whose word and its follower stand side by side in the text; of its words, below five."""
    units = [b" ".join(part[k : k + 2]) for k in range(len(part) - 1)] if len(part) >= 5 else part
    return sum(b" " + u + b" " in joined for u in units) / len(units) if units else 1.0


def brute(items, docs):
    own = [d.Item(i, t, d.WIDTH) for i, t in items]
    out, texts = set(), dict(items)
    for doc_id, text in docs:
        words = d.words_of(text or "")
        shingles = d.shingles_of(words)
        joined = b" " + b" ".join(words) + b" "
        for item in own:
            if not item.words:
                continue
            short = len(item.words) < d.WIDTH
            whole = float(b" " + b" ".join(item.words) + b" " in joined) if short else len(item.shingles & shingles) / len(item.shingles)
            if whole >= d.SIMILARITY and all(held_share(d.words_of(p), joined) >= 0.5 for p in d.parts_of(texts[item.item_id])):
                out.add((doc_id, item.item_id))
    return out


def test_no_copy_is_lost_and_none_invented(spark):
    for seed in (3, 4):
        items, docs = made(seed)
        want = brute(items, docs)
        assert len(want) > 15
        index = d.Index(items)
        assert {(k, m[0]) for k, t in docs for m in index.matches(t)} == want
    di, dd = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (1 << 20, 900):  # one index, and many parts
        assert {(r.doc_id, r.item_id) for r in d.contaminated(dd, di, broadcast_bytes=limit).collect()} == want
        kept = {r.doc_id for r in d.without_contaminated(dd, di, broadcast_bytes=limit).collect()}
        assert kept == {k for k, _ in docs} - {k for k, _ in want}


def test_wand_retrieves_exactly_the_items_above_the_threshold():
    items, _ = made(7, n_items=200)
    index = d.Index(items)
    rng = random.Random(1)
    vocabulary = sorted(index.vocabulary)
    for _ in range(300):
        base = rng.choice(index.items).words
        terms = sorted(set(rng.sample(base, rng.randint(1, len(base)))) | set(rng.sample(vocabulary, rng.randint(0, 60))))
        score = Counter()
        for t in terms:
            for k, w in index.postings[t]:
                score[k] += w
        assert sorted(index.retrieve(terms)) == sorted(k for k, v in score.items() if v >= 1)


def test_items_across_passages_are_found():
    words = [f"u{k}" for k in range(2000)]
    item = " ".join(words[700:760])
    index = d.Index([(1, item)])
    for shift in range(0, 130, 13):
        assert index.matches(" ".join(words[shift:]))


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (None, "A line that is long enough to be a key of its own, surely"), (3, ""), (4, "!!!"), (5, "Two")], "item_id long, text string")
    found = d.contaminated(odd, items).collect()
    assert {r.doc_id for r in found if r.item_id is None} == {8, 9, 10, 11, 12} and {r.doc_id for r in found if r.item_id == 5} == {1}
    kept = d.without_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 6
    assert d.contaminated(empty, items).count() == 0 and d.contaminated(odd, items.limit(0)).count() == 0
    assert d.without_contaminated(odd, items.limit(0)).count() == odd.count()


def test_query_equals_brute_force(spark, small):
    from quillmark.llm.queries import op2_decontamination

    read = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{small}/{t}.parquet").collect()]
    want = brute(read("benchmark", "item_id"), read("documents", "doc_id"))
    assert {(r.doc_id, r.item_id) for r in op2_decontamination(spark, small).collect()} == want


def edited(items, index):
    """(item_id, text, length of the edited part) of every one-word edit that keeps at least 0.8 of an item's shingles."""
    of = {x.item_id: x for x in index.items}
    for i, text in items:
        words = text.split()
        question, answer = map(d.words_of, d.parts_of(text))
        for k, w in enumerate(words):
            copy = " ".join([*words[:k], "zzchanged" + (w[-1] if w[-1] in ".!?" else ""), *words[k + 1 :]])
            if len(of[i].shingles & d.shingles_of(d.words_of(copy))) >= d.SIMILARITY * len(of[i].shingles):
                at = len(d.words_of(" ".join(words[:k])))
                yield i, f"and so {copy} and more", len(question if at < len(question) else answer)


def test_one_word_edits_at_every_place_are_found(spark, small):
    """By the query's operator and by the pipeline's stage alike."""
    import corpus_pipeline

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    index = d.Index(items)
    every = list(edited(items, index))
    # a part of one word is all gone when that word is changed
    missed = [n for i, text, n in every if i not in {m[0] for m in index.matches(text)}]
    assert len(every) > 500 and set(missed) <= {1}
    rows = [(k, text) for k, (_, text, n) in enumerate(every) if n > 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in d.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {k for k, _ in rows}
    assert corpus_pipeline.benchmark_stage(spark, docs, small).count() == 0


def test_an_edit_beside_repeated_words_hides_no_part():
    question = " ".join(f"q{k}" for k in range(60)) + ". "
    for answer in ("a a a b a", "a b a b a", "a a a a a", "a b c d e", "a b"):
        index, words = d.Index([(1, question + answer)]), answer.split()
        for k in range(len(words)):
            assert index.matches(question + " ".join([*words[:k], "other", *words[k + 1 :]])), (answer, k)


def test_another_answer_is_no_copy():
    question = " ".join(f"q{k}" for k in range(60)) + ". "
    index = d.Index([(1, question + "red green blue white black.")])
    assert index.matches(question + "red green blue white brown.")
    assert not index.matches(question + "red other green words stand here. " + "one two three four five.")
    assert not index.matches(question + "black white blue green red.")


def test_pieces_far_apart_are_found():
    question, answer = ([f"{c}{k}" for k in range(n)] for c, n in (("q", 30), ("a", 30)))
    item = " ".join(question) + ". " + " ".join(answer)
    text = " ".join([*question, *(f"u{k}" for k in range(3000)), *answer])
    for others in ([], [(2, " ".join(f"o{k}" for k in range(900)))]):  # the longest item decides nothing
        assert [m[0] for m in d.Index([(1, item), *others]).matches(text)] == [1]
