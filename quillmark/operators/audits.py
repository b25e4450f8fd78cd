"""Whole audits of finished tables, each one report of violating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import neardup
from quillmark.operators.quality import _report, broken_pairs, duplicates


def manifest(rows: DataFrame, targets: dict[str, int], cells: list[str], unique: list[str], fingerprint: str = "dhash", radius: int = 4, split: str = "split", key: str = "sample_id") -> DataFrame:
    """Cells of the wrong size, values that must be unique and aren't, and near-duplicates across splits."""
    counts = rows.groupBy(split, *cells).agg(F.count(F.lit(1)).alias("n"))
    want = F.try_element_at(F.create_map(*[F.lit(x) for p in targets.items() for x in p]), F.col(split))
    sizes = _report(counts.where(~F.col("n").eqNullSafe(want)), "cell_size", F.concat_ws("/", split, *cells), F.col("n"))
    copies = [duplicates(rows, [c], f"duplicate_{c}") for c in unique]
    near = neardup.pairs_within(rows, rows, radius, fingerprint).where("a <= b")
    own = rows.select(F.col(fingerprint).alias("f"), split).distinct()
    crossed = near.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b").where("sa <> sb")
    across = _report(crossed, "near_across_splits", F.concat_ws("/", "a", "b"), F.col("distance"))
    return reduce(DataFrame.unionByName, [sizes, *copies, across])


def origin(rows: DataFrame, expected: dict[str, str], member: str, label_parts: dict[int, str], split: str = "split", source_split: str = "source_split", label: str = "label", key: str = "sample_id") -> DataFrame:
    """Rows whose source split, or whose member path, contradicts their split or label."""
    want = F.try_element_at(F.create_map(*[F.lit(x) for p in expected.items() for x in p]), F.col(split))
    part = F.try_element_at(F.create_map(*[F.lit(x) for p in label_parts.items() for x in p]), F.col(label))
    wrong = F.when(~F.col(source_split).eqNullSafe(want), F.lit("source_split")).when(~F.coalesce(F.col(member).contains(F.concat(F.lit("/"), want, F.lit("/"))), F.lit(False)), F.lit("member_split")).when(~F.coalesce(F.col(member).contains(part), F.lit(False)), F.lit("member_label"))
    return _report(rows.withColumn("_p", wrong).where("_p IS NOT NULL"), "origin", F.col(key), F.col("_p"))


def new_pairs(rows: DataFrame, protected: DataFrame, keys: list[str], fingerprint: str = "dhash", radius: int = 4, key: str = "sample_id", caption: str = "caption_id", image: str = "image_id", scenario: str = "scenario", text: str = "text") -> DataFrame:
    """A new set of caption pairs: their structure, ids that agree exactly on genuine rows, and no value or near image of the protected set."""
    wrong = (F.col(caption) == F.col(image)) != (F.col(scenario) == 4)
    ids = _report(rows.where(F.coalesce(wrong, F.lit(True))), "pair_ids", F.col(key), F.col(scenario))
    shared = [_report(rows.join(protected.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_semi"), f"shared_{k}", F.col(key), F.col(k)) for k in keys]
    near = neardup.pairs_within(rows, protected, radius, fingerprint).select(F.col("a").alias("_near"), "distance")
    close = _report(rows.join(near, F.col(fingerprint) == F.col("_near")), "near_protected", F.col(key), F.col("distance"))
    return reduce(DataFrame.unionByName, [broken_pairs(rows, caption, scenario, text), ids, *shared, close])


def coverage(rows: DataFrame, boxes: str, target: str, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For the first k boxes of a row: rows whose target box lies outside all of them, and rows with less than half of it inside any."""
    from quillmark.functions.arrays import overlap_area

    size = (F.col(target)[2] - F.col(target)[0]) * (F.col(target)[3] - F.col(target)[1])
    shares = rows.select(F.transform(boxes, lambda b: overlap_area(b, F.col(target)) / size).alias("s"))
    best = lambda k: F.coalesce(F.array_max(F.slice("s", 1, k)), F.lit(0.0))
    found = shares.agg(*(F.struct(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n"), F.count_if(best(k) == 0).alias("outside"), F.count_if(best(k) < 0.5).alias("under_half")).alias(f"k{k}") for k in ks))
    return found.select(F.explode(F.array(*(F.col(f"k{k}") for k in ks))).alias("r")).select("r.*")


def by_suffix(wanted: DataFrame, members: DataFrame, key: str = "path", member: str = "member") -> DataFrame:
    """(key, member, problem): the one member that ends in the wanted path; none or several are a problem."""
    parts = F.split(member, "/")
    tails = members.select(member, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias(key))
    found = wanted.join(tails, key, "left").groupBy(key).agg(F.count(member).alias("n"), F.min(member).alias(member))
    return found.select(key, F.when(F.col("n") == 1, F.col(member)).alias(member), F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").alias("problem"))


def reused_vectors(rows: DataFrame, asset: str, vector: str, ordinal: str, tolerance: float = 1e-4) -> DataFrame:
    """One vector an asset, its first; another vector of the asset that differs by more than `tolerance` is an error."""
    first = rows.groupBy(F.col(asset).alias("_asset")).agg(F.min_by(vector, ordinal).alias("_first"))
    gap = F.array_max(F.zip_with(vector, "_first", lambda x, y: F.abs(x - y)))
    checked = F.when(gap > tolerance, F.raise_error(F.concat(F.lit("vectors differ at "), F.col(asset).cast("string"))).cast("boolean")).otherwise(True)
    return rows.join(first, F.col(asset) == F.col("_asset")).where(checked).groupBy(asset).agg(F.count(F.lit(1)).alias("n"), F.first("_first").alias(vector))


def promotion(baseline: DataFrame, candidate: DataFrame, key: str, value: str, most_drop: float, low_bound: float | None = None) -> DataFrame:
    """(key, difference, passes, promote): no key may drop by more than `most_drop`, and the interval's low bound, if given, is above 0."""
    joined = baseline.select(key, F.col(value).alias("_b")).join(candidate.select(key, F.col(value).alias("_c")), key, "full_outer")
    rows = joined.select(key, (F.col("_c") - F.col("_b")).alias("difference")).withColumn("passes", F.coalesce(F.col("difference") >= -most_drop - 1e-12, F.lit(False)))
    gate = F.every("passes") & F.lit(low_bound is None or low_bound > 0)
    return rows.crossJoin(F.broadcast(rows.agg(gate.alias("promote"))))


def release_gates(before: DataFrame, after: DataFrame, most_drop: dict[str, float], intervals: DataFrame) -> DataFrame:
    """(gate, key, value, passes, promote): all gates of a release, joined.

    `before` and `after` are (kind, key, value); no value may drop by more than its kind's `most_drop`, and one that stands on
    one side only fails. Of `intervals` (metric, low, high) each low end must be above 0. Without any gate nothing is promoted.
    """
    limit = F.try_element_at(F.create_map(*[F.lit(x) for p in most_drop.items() for x in p]), F.col("kind"))
    both = before.select("kind", "key", F.col("value").alias("_b")).join(after.select("kind", "key", F.col("value").alias("_a")), ["kind", "key"], "full_outer")
    drops = both.select(F.col("kind").alias("gate"), "key", (F.col("_a") - F.col("_b")).alias("value"), limit.alias("_limit"))
    drops = drops.select("gate", "key", "value", F.coalesce(F.col("value") >= -F.col("_limit") - 1e-12, F.lit(False)).alias("passes"))
    ends = intervals.select(F.lit("interval").alias("gate"), F.col("metric").alias("key"), F.col("low").alias("value"), F.coalesce(F.col("low") > 0, F.lit(False)).alias("passes"))
    rows = drops.unionByName(ends)
    return rows.crossJoin(F.broadcast(rows.agg(F.coalesce(F.every("passes"), F.lit(False)).alias("promote"))))
