"""Feature tables: statistics of training rows, z-scores, named concatenations, moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.arrays import doubles, pair_features, total
from quillmark.plans.prefix import bucketed


def column_stats(df: DataFrame, features: str, population: bool = False) -> DataFrame:
    """One row (mu, sd) of arrays, in one pass that keeps one sum a position in each task."""
    found = df.select(Summarizer.metrics("mean", "std", "count").summary(array_to_vector(doubles(F.col(features)))).alias("s"))
    shrink = F.sqrt(F.greatest(F.col("s.count") - 1, F.lit(0)) / F.greatest(F.col("s.count"), F.lit(1))) if population else F.lit(1.0)
    return found.select(vector_to_array("s.mean").alias("mu"), F.transform(vector_to_array("s.std"), lambda x: x * shrink).alias("sd"))


def zscored(df: DataFrame, train: DataFrame, features: str, least: float = 1e-6, population: bool = False) -> DataFrame:
    """Features standardised by the training rows' means and deviations, deviations at least `least`."""
    stats = F.broadcast(column_stats(train, features, population))
    z = F.transform(F.arrays_zip(doubles(F.col(features)).alias("x"), F.col("mu").alias("m"), F.col("sd").alias("s")), lambda r: (r["x"] - r["m"]) / F.greatest(F.coalesce(r["s"], F.lit(0.0)), F.lit(least)))
    return df.crossJoin(stats).withColumn(features, z).drop("mu", "sd")


def moments(df: DataFrame, value: str, where: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, deviation): one pass of sums over the rows of `where`; the population variance is at least 0."""
    sums = df.where(where).groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(*by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("deviation"))


# Fixed names: the feature kinds and their parts, in order.
KINDS = {
    "v1_only": ("v1_hidden", "v1_logit"),
    "clip_large_only": ("pair",),
    "blip": ("blip_hidden",),
    "blip_with_score": ("blip_hidden", "blip_logit"),
    "scores": ("blip_logit", "v1_logit"),
    "blip_v1_score": ("blip_hidden", "v1_logit"),
    "blip_v1_features": ("blip_hidden", "v1_hidden", "blip_logit", "v1_logit"),
    "blip_v1_clip_large": ("blip_hidden", "v1_hidden", "blip_logit", "v1_logit", "pair"),
    "blip_v1_clip_large_match": ("blip_hidden", "v1_hidden", "blip_logit", "v1_logit", "match"),
    "blip_v1_clip_large_score": ("blip_hidden", "v1_hidden", "blip_logit", "v1_logit", "cosine"),
}


def feature_kind(kind: str, image: str = "clip_image", text: str = "clip_text") -> Column:
    """The named concatenation of array and scalar columns."""
    if kind not in KINDS:
        raise ValueError(f"unknown feature kind {kind!r}")
    a, b = doubles(F.col(image)), doubles(F.col(text))
    product, gap = F.zip_with(a, b, lambda x, y: x * y), F.zip_with(a, b, lambda x, y: F.abs(x - y))
    made = {"pair": lambda: pair_features(F.col(image), F.col(text)), "match": lambda: F.concat(product, gap, F.array(total(product))), "cosine": lambda: F.array(total(product))}
    parts = [made[p]() if p in made else F.array(F.col(p).cast("double")) if p.endswith("_logit") else doubles(F.col(p)) for p in KINDS[kind]]
    return F.concat(*parts)


def exponential_moments(df: DataFrame, key: str, step: str, mean: str, variance: str, momentum: float = 0.1, buckets: int | None = None) -> DataFrame:
    """(key, mean, variance): running moments folded in the order of `step` (a number), from 0 and 1.

    A step is the map s -> (1 - momentum) s + momentum x, and maps of steps in a row compose to one such map. Steps are dealt into
    buckets of their order; inside a bucket a key's steps become one map, by their ranks from the bucket's end, and a key's maps, as
    many as buckets, are applied in order. So a key's history is no row of its own and lies in many tasks.
    """
    keep = 1 - momentum
    dealt = bucketed(df.where(F.col(step).isNotNull()), step, buckets)
    back = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(F.col(step).desc(), mean, variance)) - 1
    shares = dealt.withColumn("_share", F.lit(momentum) * F.pow(F.lit(keep), back))
    maps = shares.groupBy(key, "_bucket").agg(F.pow(F.lit(keep), F.count(F.lit(1))).alias("a"), F.sum(F.col("_share") * F.col(mean)).alias("m"), F.sum(F.col("_share") * F.col(variance)).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("_bucket", "a", "m", "v")))
    folded = F.aggregate(ordered, F.struct(F.lit(0.0).alias("m"), F.lit(1.0).alias("v")), lambda s, x: F.struct((s["m"] * x["a"] + x["m"]).alias("m"), (s["v"] * x["a"] + x["v"]).alias("v")))
    return maps.groupBy(key).agg(folded.alias("r")).select(key, F.col("r.m").alias("mean"), F.col("r.v").alias("variance"))


def length_stats(rows: DataFrame, length: str, by: str, limit: int) -> DataFrame:
    """(by, longest, mean, truncated, truncated_share) of token lengths; longer ones than `limit` are truncated."""
    n = F.col(length)
    return rows.groupBy(by).agg(F.max(n).alias("longest"), F.round(F.avg(n), 2).alias("mean"), F.count_if(n > limit).alias("truncated"), F.round(F.avg((n > limit).cast("double")), 4).alias("truncated_share"))


def early_stop(history: DataFrame, run: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """(run, best_epoch, best, stopped): the best epoch before `patience` epochs bring nothing better, by windows over each run's history."""
    past = Window.partitionBy(run).orderBy(epoch)
    so_far = F.max(metric).over(past.rowsBetween(Window.unboundedPreceding, -1))
    better = history.withColumn("_up", so_far.isNull() | (F.col(metric) > so_far))
    since = better.withColumn("_last", F.max(F.when(F.col("_up"), F.col(epoch))).over(past)).withColumn("_out", F.col(epoch) - F.col("_last") >= patience)
    stop = since.groupBy(run).agg(F.min(F.when(F.col("_out"), F.col(epoch))).alias("_stop"), F.max(epoch).alias("_end"))
    seen = since.join(stop, run).where(F.col(epoch) <= F.coalesce("_stop", "_end"))
    return seen.groupBy(run).agg(F.max(F.when(F.col("_up"), F.col(epoch))).alias("best_epoch"), F.max(metric).alias("best"), F.max("_stop").alias("stopped"))
