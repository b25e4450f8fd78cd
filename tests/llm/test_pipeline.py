"""The pipeline held against plain versions of its stages."""

from collections import Counter

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark, small):
    import corpus_pipeline
    from quillmark.plans.staging import staged

    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], small), f"test-{name}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert all(a.count() >= b.count() for a, b in zip(stages, stages[1:], strict=False))


def test_language_stage_keeps_texts_with_a_clear_language(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert all(after[d] == before[d] for d in after)
    gone = [before[d] for d in set(before) - set(after)]
    assert all(len(r.text) < 200 for r in gone)


def test_line_stage_equals_brute_force(stages):
    from tests.llm.test_line_dedup import brute

    before, after = rows(stages[1]), rows(stages[2])
    want = {d: (n, k) for d, n, k, _ in brute([(r.doc_id, r.text) for r in before.values()])}
    import hashlib

    digests = {d: h for d, _, _, h in brute([(r.doc_id, r.text) for r in before.values()])}
    assert set(after) == set(before)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == digests[d] and r.n_chars == len(r.text) for d, r in after.items())
    assert want


def test_near_duplicate_stage_equals_brute_force(stages):
    """The stage's own rule: SimHash links, and a similarity of 0.8 or more over five-word shingles."""
    from tests.llm.test_similar_texts import brute

    before, after = rows(stages[2]), rows(stages[3])
    assert set(after) == set(brute({d: r.text or "" for d, r in before.items()}).values())


def test_benchmark_stage_equals_brute_force(spark, small, stages):
    from tests.llm.test_decontamination import brute

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    before, after = rows(stages[3]), rows(stages[4])
    bad = {d for d, _ in brute(items, [(d, r.text) for d, r in before.items()])}
    assert set(after) == set(before) - bad


def test_mixing_stage_places_every_document(stages):
    last = stages[5].collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in stages[4].collect())
    assert len({r.mix_position for r in last}) == len(last)


def test_run_equals_the_stages(spark, small, stages):
    import corpus_pipeline

    assert {(r.doc_id, r.mix_position) for r in corpus_pipeline.run(spark, small).collect()} == {(r.doc_id, r.mix_position) for r in stages[5].collect()}


def test_stages_bear_odd_rows(spark, small, odd, empty):
    import corpus_pipeline

    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, small).count()


def test_extra_columns_pass_whatever_their_names(spark, small, odd):
    import corpus_pipeline

    names = ["kept_sha256", "n_lines", "n_dropped", "block", "mix_slot", "mix_position", "a.b", "__qm_h", "extra_0", "digest", "`q`", "fp"]
    values = [F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for k in range(len(names))]
    docs = odd.select("doc_id", *(v.alias(n) for v, n in zip(values, names, strict=True)), "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        mixed = name == "mixing"
        held = [f"{c}_input" if mixed and c in ("block", "mix_slot", "mix_position") else c for c in names]
        assert out.columns == ["doc_id", *held, "text", "lang", "source", "n_chars"] + (["block", "mix_slot", "mix_position"] if mixed else [])
        for r in out.collect():
            assert list(r[1 : 1 + len(names)]) == [f"{k}:{'none' if r.doc_id is None else r.doc_id}" for k in range(len(names))]
