import hashlib
from fractions import Fraction

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quillmark.llm import mixing


def fluid(weights, blocks, t):
    """Service of each source by time t, by serving all that have blocks left in their proportions."""
    left, now, had = {s: Fraction(n) for s, n in blocks.items()}, Fraction(0), dict.fromkeys(blocks, Fraction(0))
    while now < t and any(left.values()):
        live = {s: Fraction(weights[s]) for s, x in left.items() if x}
        total = sum(live.values())
        step = min(t - now, *(left[s] * total / w for s, w in live.items()))
        for s, w in live.items():
            had[s] += step * w / total
            left[s] -= step * w / total
        now += step
    return had


def check(weights, blocks, slots, times):
    assert {s: len(own) for s, own in slots.items()} == blocks
    assert sorted(x for own in slots.values() for x in own) == list(range(sum(blocks.values())))
    for t in times:
        had = fluid(weights, blocks, t)
        assert all(abs(sum(x < t for x in own) - had[s]) < 1 for s, own in slots.items())


@settings(max_examples=400, deadline=None)
@example([(1, 1), (1, 1), (32, 13), (48, 17)], 1)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 40)), min_size=1, max_size=7), st.integers(1, 50))
def test_schedule_deviates_by_less_than_one_block_from_the_fluid_mix(parts, segment):
    weights, blocks = {f"s{k}": w for k, (w, _) in enumerate(parts)}, {f"s{k}": n for k, (_, n) in enumerate(parts)}
    slots = mixing.exact_slots(weights, blocks, segment)
    check(weights, blocks, slots, range(sum(blocks.values()) + 1))


def test_floats_and_integers_give_the_same_whole_blocks():
    for weights in ({"a": 1 / 3, "b": 2 / 3 / 7, "c": 0.1}, {"a": 3, "b": 5, "c": 1}):
        own = mixing.plan(weights, {"a": 300, "b": 90, "c": 10})
        for t in (0, 1, 17, 200, 399, 400):
            had = fluid(weights, {"a": 300, "b": 90, "c": 10}, t)
            assert own.whole(range(t, t + 1))[0].tolist() == [had[s].__floor__() for s in "abc"]


def test_one_segment_is_earliest_deadline_first():
    weights, blocks = {"a": 0.5, "b": 0.3, None: 0.2}, {"a": 30, "b": 9, None: 14}
    total = sum(blocks.values())
    window = {s: [] for s in blocks}
    for s, n in blocks.items():
        for j in range(n):
            at = lambda x, s=s: sum(min(Fraction(weights[k]) * x / Fraction(weights[s]), m) for k, m in blocks.items())
            window[s].append((at(j).__floor__(), at(j + 1).__ceil__()))
    done, want = dict.fromkeys(blocks, 0), {s: [] for s in blocks}
    for slot in range(total):
        free = [(window[s][done[s]][1], s is None, s or "", s) for s in blocks if done[s] < blocks[s] and window[s][done[s]][0] <= slot]
        s = min(free, key=lambda x: x[:3])[3]
        assert slot < window[s][done[s]][1]
        want[s].append(slot)
        done[s] += 1
    assert mixing.exact_slots(weights, blocks) == want


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.1999, "d": 0.0001}, {"hot": 1 / 3, **{str(k): 2 / 3 / 99 for k in range(99)}}])
def test_a_million_slots_stay_within_a_block_of_the_target_weights(weights):
    total = sum(map(Fraction, weights.values()))
    blocks = {s: int(10**6 * Fraction(w) / total) + 2 for s, w in weights.items()}
    own = mixing.plan(weights, blocks)
    marks = mixing.boundaries(own, mixing.SEGMENT)
    seen = dict.fromkeys(weights, 0)
    for i in (0, 1, len(marks) // 2, len(marks) - 3):  # segments on their own, as tasks schedule them
        seen = dict(zip(own.names, marks[i], strict=True))
        at = {x: s for s, slots in zip(own.names, mixing.fill(own, i * mixing.SEGMENT, marks[i], marks[i + 1]), strict=True) for x in slots}
        for slot in range(i * mixing.SEGMENT, (i + 1) * mixing.SEGMENT):
            s = at[slot]
            seen[s] += 1
            t = slot + 1
            if slot % 17 == 0:
                assert all(abs(seen[x] - Fraction(w) * t / total) < 1 for x, w in weights.items())
            assert abs(seen[s] - Fraction(weights[s]) * t / total) < 1


def test_every_document_has_one_place_and_its_slot(spark):
    rows = [(k, "hot" if k % 3 == 0 else None if k % 4 == 3 else f"s{k % 4}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"hot": 0.4, "s0": 0.3, "s1": 0.1, "s2": 0.1, None: 0.1}
    blocks = {s: -(-sum(x == s for _, x in rows) // 4) for s in weights}
    found = mixing.mix(df, weights, block_docs=4, bucket_rows=100, segment=100).orderBy("mix_position").collect()
    assert sorted(r.doc_id for r in found) == list(range(3000)) and len({r.mix_position for r in found}) == 3000
    slots = mixing.exact_slots(weights, blocks, 100)
    assert all(r.mix_slot == slots[r.source][r.block] for r in found)
    again = mixing.mix(df.repartition(7), weights, block_docs=4, bucket_rows=100, segment=100).orderBy("mix_position").collect()
    assert [r.doc_id for r in again] == [r.doc_id for r in found]


def test_many_sources_have_no_bound(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "concat('s', id % 2000) AS source")
    found = mixing.mix(df, block_docs=2).collect()
    assert len({r.mix_position for r in found}) == 6000


def test_ranks_equal_brute_force(spark):
    df = spark.createDataFrame([(k, f"s{k % 2}") for k in range(500)], "doc_id long, source string")
    order = sorted(range(0, 500, 2), key=lambda d: hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest())
    found = mixing.mix(df, block_docs=8, bucket_rows=30).where("source = 's0'").orderBy("mix_position").collect()
    assert [r.doc_id for r in found] == order and [r.block for r in found] == [k // 8 for k in range(len(order))]


def test_odd_rows(spark, odd, empty):
    found = mixing.mix(odd, block_docs=2)
    assert set(odd.columns) <= set(found.columns)
    rows = found.collect()
    assert len(rows) == odd.count() and len({r.mix_position for r in rows}) == len(rows)
    assert mixing.mix(empty).count() == 0
    with pytest.raises((KeyError, ValueError)):
        mixing.mix(odd, {"s": 1.0})
    with pytest.raises(ValueError):
        mixing.exact_slots({"a": 0, "b": 1}, {"a": 1, "b": 1})
