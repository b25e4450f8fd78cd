"""Running sums over a global order, without a global window.

Keys are dealt into buckets by approximate quantiles, at most a few hundred bounds. Sums run inside
each bucket; what stands in the buckets before it is a running sum over the buckets' totals, a table
as long as there are bounds. So no task sees more than its bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.plans.sizing import shuffle_partitions


STRIDE = 16


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Adds `_bucket`: rows of a lower bucket have lower keys."""
    n = buckets or min(256, 2 * shuffle_partitions(df.sparkSession))
    bounds = df.agg(F.percentile_approx(F.col(key), [k / n for k in range(1, n)], 1000)).first()[0] if n > 1 else None
    bounds = sorted(set(bounds or []))
    if not bounds:
        return df.withColumn("_bucket", F.lit(0))
    # every STRIDE-th bound tells the block, the bounds of that block the rest: two short walks instead of one over all
    below = lambda found: F.aggregate(found, F.lit(0), lambda s, b: s + F.when(F.col(key) > b, 1).otherwise(0))
    array = lambda values: F.array(*map(F.lit, values))
    if len(bounds) < 2 * STRIDE:
        return df.withColumn("_bucket", below(array(bounds)))
    block = df.withColumn("_block", below(array(bounds[STRIDE - 1 :: STRIDE])) * STRIDE)
    return block.withColumn("_bucket", F.col("_block") + below(F.slice(array(bounds), F.col("_block") + 1, F.lit(STRIDE)))).drop("_block")


def running(df: DataFrame, key: str, sums: Sequence[str], follow: bool = False, buckets: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """`df` has one row for each value of the number `key` (in each group `by`). Adds `<s>_before` for each of `sums`: the sum over lower keys.

    With `follow`, also `<key>_next`, the next higher key, null for the last.
    """
    by = list(by)
    dealt = bucketed(df, key, buckets)
    totals = dealt.groupBy(*by, "_bucket").agg(*(F.sum(s).alias(f"_{s}_all") for s in sums), F.min(key).alias("_least"))
    over = Window.partitionBy(*by).orderBy("_bucket")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_bucket", *(F.coalesce(F.sum(f"_{s}_all").over(before), F.lit(0)).alias(f"_{s}_base") for s in sums), F.lead("_least").over(over).alias("_after"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(key)
    joined = dealt.join(totals if by else F.broadcast(totals), [*by, "_bucket"])
    out = joined.withColumns({f"{s}_before": F.col(f"_{s}_base") + F.coalesce(F.sum(s).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for s in sums})
    if follow:
        out = out.withColumn(f"{key}_next", F.coalesce(F.lead(key).over(inside), F.col("_after")))
    return out.drop("_bucket", "_after", *(f"_{s}_base" for s in sums))


def hashed_rank(df: DataFrame, group: Sequence[str], major: Sequence[Column], mark: Column, key: str, digits: int = 3, name: str = "rank") -> DataFrame:
    """Adds `name`, a rank from 1 in each group, by `major`, then the hex string `mark`, then `key`.

    A group's rows are dealt by `major` and the first `digits` of `mark`, so that no task holds a group; ranks of
    the parts are running counts over a table with one row for each part. Where groups are small, parts are as many
    as rows: they are merged, never broadcast. Rows are moved once, by the part as one struct, in which nulls are equal.
    """
    group, names = list(group), [f"_m{k}" for k in range(len(major))]
    marked = df.withColumn("_mark", mark)
    majors = [m.alias(n) for m, n in zip(major, names, strict=True)]
    dealt = marked.withColumn("_at", F.struct(*group, *majors, F.substring("_mark", 1, digits).alias("_part")))
    field = lambda names: [F.col("_at")[n] for n in names]
    before = Window.partitionBy(*field(group)).orderBy(*field([*names, "_part"])).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = dealt.join(counts.hint("merge"), "_at")
    ranked = joined.withColumn(name, F.col("_base") + F.row_number().over(Window.partitionBy("_at").orderBy("_mark", key)))
    return ranked.drop("_base", "_mark", "_at")


def quantiles(distinct: DataFrame, key: str, count: str, steps: int) -> DataFrame:
    """(i, q): the `steps` + 1 evenly spaced quantiles, linear between ranks, of a table of distinct keys and their counts."""
    n = distinct.agg(F.sum(count)).first()[0]
    ranked = running(distinct, key, [count])
    first, last = F.col(f"{count}_before"), F.col(f"{count}_before") + F.col(count) - 1
    steps_, top = F.lit(steps).cast("long"), F.lit(max(n - 1, 1)).cast("long")

    def held(low: bool):
        """The grid points whose lower (upper) rank lies in this row."""
        if low:  # floor(i top / steps) in [first, last]
            a = F.ceil(first * steps_ / top.cast("double"))
            b = F.ceil((last + 1) * steps_ / top.cast("double")) - 1
        else:  # ceil(i top / steps) in [first, last]
            a = F.floor((first - 1) * steps_ / top.cast("double")) + 1
            b = F.floor(last * steps_ / top.cast("double"))
        a, b = F.greatest(a, F.lit(0)), F.least(b, steps_)
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    points = lambda low, name: ranked.select(F.explode(held(low)).alias("i"), F.col(key).alias(name))
    share = F.pmod(F.col("i") * top, steps_) / steps_.cast("double")
    return points(True, "_low").join(points(False, "_high"), "i").select("i", (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("q"))
