"""Data-quality checks: each returns the rows that violate it, (check, key, detail); no rows mean it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.labels import CONTROL_TOTALS, GROUPS
from quillmark.operators.selection import FRACTIONS

SPLITS = ("train", "val", "test")


def _report(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def required(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A row for each required column that isn't there, and one if there is no row."""
    found = [("missing_column", c, None) for c in missing_columns(df, list(columns))] + ([("no_rows", None, None)] if df.isEmpty() else [])
    return df.sparkSession.createDataFrame(found, "`check` string, key string, detail string")


def duplicates(df: DataFrame, keys: list[str], check: str = "duplicate") -> DataFrame:
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _report(found, check, F.concat_ws("|", *keys), F.col("n"))


def group_sizes(df: DataFrame, group: str = "group", balance: str = "equal_scenarios") -> DataFrame:
    """Unknown groups, fake groups of unequal size, and a genuine group of the wrong size."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    known = F.broadcast(spark.createDataFrame([(g,) for g in GROUPS], "g string"))
    unknown = _report(counts.join(known, "g", "left_anti"), "unknown_group", F.col("g"), F.col("n"))
    sizes = known.join(counts, "g", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    fake = F.col("g") != "genuine"
    ends = sizes.agg(F.min(F.when(fake, F.col("n"))).alias("low"), F.max(F.when(fake, F.col("n"))).alias("high"), F.max(F.when(~fake, F.col("n"))).alias("genuine"))
    want = F.col("low") * (4 if balance == "real_fake" else 1)
    unequal = _report(ends.where("low <> high"), "fake_groups_unequal", F.col("low"), F.col("high"))
    genuine = _report(ends.where(F.col("genuine") != want), "genuine_size", F.col("genuine"), want)
    return unknown.unionByName(unequal).unionByName(genuine)


def outside(df: DataFrame, column: str, allowed: tuple, check: str) -> DataFrame:
    found = df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return _report(found, check, F.coalesce(F.col(column).cast("string"), F.lit("null")), F.col("n"))


def leaks(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Values of `columns`, blanks aside, in more than one split: all columns in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    long = df.select(F.explode(pairs).alias("p"), split).select("p.*", split).where("value IS NOT NULL AND value <> ''")
    found = long.groupBy("column", "value").agg(F.min(split).alias("low"), F.max(split).alias("high")).where("low <> high")
    return _report(found, "leak", F.concat_ws("=", "column", "value"), F.concat_ws(",", "low", "high"))


def split_shares(df: DataFrame, group: str = "group", split: str = "split", fractions: dict[str, float] | None = None, tolerance: float = 0.03) -> DataFrame:
    """Splits whose share of a group differs from the wanted one by more than `tolerance`."""
    spark, fractions = df.sparkSession, fractions or FRACTIONS
    counts = df.groupBy(F.col(group).alias("g"), F.col(split).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("g").agg(F.sum("n").alias("all"))
    wanted = F.broadcast(spark.createDataFrame(list(fractions.items()), "s string, want double"))
    shares = whole.crossJoin(wanted).join(counts, ["g", "s"], "left").withColumn("share", F.coalesce("n", F.lit(0)) / F.greatest("all", F.lit(1)))
    return _report(shares.where(F.abs(F.col("share") - F.col("want")) > tolerance), "split_share", F.concat_ws("/", "g", "s"), F.round("share", 6))


def label_mismatch(df: DataFrame, key: str, group: str = "group", label: str = "label_binary", scenario: str = "scenario") -> DataFrame:
    """Rows whose binary label or scenario number isn't that of their group."""
    number = F.array_position(F.array(*map(F.lit, GROUPS)), F.col(group)).cast("int")
    want = F.when(F.col(group) == "genuine", 0).otherwise(1)
    problem = F.when(~F.col(label).cast("int").eqNullSafe(want), F.lit("label_binary")).when(~F.col(scenario).cast("int").eqNullSafe(number), F.lit("scenario"))
    return _report(df.withColumn("_p", problem).where("_p IS NOT NULL"), "label_mismatch", F.col(key), F.col("_p"))


def files_missing(df: DataFrame, key: str, listing: DataFrame, path: str = "image_path", ok: str = "image_ok") -> DataFrame:
    bad = _report(df.where(~F.coalesce(F.col(ok).cast("string") == "1", F.lit(False))), "image_ok", F.col(key), F.col(ok))
    absent = df.join(listing.select(F.col("path").alias(path)).distinct(), path, "left_anti")
    return bad.unionByName(_report(absent, "file_missing", F.col(key), F.col(path)))


def control_totals(df: DataFrame, column: str = "fake_cls", totals: dict[str, int] | None = None) -> DataFrame:
    """Classes whose count isn't the published one, on either side."""
    wanted = df.sparkSession.createDataFrame(list((totals or CONTROL_TOTALS).items()), "c string, want long")
    counts = df.groupBy(F.col(column).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.join(F.broadcast(wanted), "c", "full_outer").where(~F.col("n").eqNullSafe(F.col("want")))
    return _report(found, "control_total", F.col("c"), F.concat_ws("/", F.coalesce("n", F.lit(0)), F.coalesce("want", F.lit(0))))


def unchanged(before: DataFrame, after: DataFrame, splits: tuple[str, ...] = ("val", "test"), split: str = "split", key: str = "sample_id") -> DataFrame:
    """Rows of frozen splits that were removed, changed or added, copies counted."""
    a, b = (df.where(F.col(split).isin(*splits)).select(*before.columns) for df in (before, after))
    return _report(a.exceptAll(b), "removed", F.col(key), F.col(split)).unionByName(_report(b.exceptAll(a), "added", F.col(key), F.col(split)))


def fake_balance(df: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Fake scenarios 1, 2, 3 and 5 that are absent or smaller than the largest."""
    wanted = F.broadcast(df.sparkSession.createDataFrame([(s,) for s in (1, 2, 3, 5)], "s int"))
    counts = wanted.join(df.groupBy(F.col(scenario).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n")), "s", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return _report(counts.crossJoin(counts.agg(F.max("n").alias("most"))).where("n < most OR n = 0"), "fake_balance", F.col("s"), F.col("n"))


def broken_pairs(df: DataFrame, caption: str = "caption_id", scenario: str = "scenario", text: str | None = None) -> DataFrame:
    """Captions without exactly one genuine and one OOC row, or whose two rows have different texts."""
    same = F.lit(True) if text is None else F.min(text).eqNullSafe(F.max(text))
    found = df.groupBy(caption).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(scenario) == 4).alias("g"), F.count_if(F.col(scenario) == 1).alias("o"), same.alias("same"))
    return _report(found.where("n <> 2 OR g <> 1 OR o <> 1 OR NOT same"), "broken_pair", F.col(caption), F.concat_ws("/", "n", "g", "o"))


def conflicting_labels(df: DataFrame, content: str, label: str) -> DataFrame:
    """Equal contents with different labels."""
    found = df.groupBy(content).agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low <> high")
    return _report(found, "conflicting_label", F.col(content), F.concat_ws(",", "low", "high"))


def value_gap(expected: DataFrame, actual: DataFrame, key: str, column: str, tolerance: float) -> DataFrame:
    """Keys whose values differ by more than `tolerance`, or that are on one side alone."""
    joined = expected.select(key, F.col(column).alias("_e")).join(actual.select(key, F.col(column).alias("_a")), key, "full_outer")
    gap = F.abs(F.col("_e") - F.col("_a"))
    return _report(joined.where(gap.isNull() | (gap > tolerance)), "value_gap", F.col(key), gap)


def bad_vectors(df: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """Vectors of another size, or with a value that isn't finite."""
    v = F.col(column)
    fine = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return _report(df.where(~F.coalesce(fine, F.lit(False))), "bad_vector", F.col(key), F.size(v))


def verified(df: DataFrame, key: str = "sample_id", balance: str = "equal_scenarios", contents: tuple[str, ...] = ("text_key", "image_key"), tolerance: float = 0.03) -> DataFrame:
    """All checks of a finished data set as one report."""
    checks = [
        duplicates(df, [key], "duplicate_id"),
        group_sizes(df, balance=balance),
        outside(df, "split", SPLITS, "unknown_split"),
        duplicates(df, list(contents), "duplicate_pair"),
        leaks(df, list(contents)),
        split_shares(df, tolerance=tolerance),
        label_mismatch(df, key),
    ]
    return reduce(DataFrame.unionByName, checks)
