"""Fixed quotas: rows reserved for test, then validation, then training, each cell its target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators.neardup import without_near
from quillmark.operators.selection import shuffled
from quillmark.plans.prefix import bucketed, running
from quillmark.plans.sizing import shuffle_partitions
from quillmark.plans.staging import staged


def quota(rows: DataFrame, cells: list[str], target: int, key: str, seed: int) -> DataFrame:
    """The first `target` rows of each cell in a keyed random order. Spark cuts each partition to the target before it shuffles."""
    order = Window.partitionBy(*cells).orderBy(shuffled(key, seed), key)
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= target).drop("_k")


def reserved(rows: DataFrame, targets: dict[str, int], key: str, cells: list[str], content: str, fingerprint: str | None = None, radius: int = 4, source_split: str | None = None, origin: dict[str, str] | None = None, identity: str | None = None, seed: int = 7) -> DataFrame:
    """Adds `split`: for each split in the order of `targets`, `targets[split]` rows of each cell.

    A row is open to a split if its content and (where given) its identity are in no earlier split, and no
    row of an earlier split is within `radius` of its fingerprint; near ones in the same split are fine. A content
    counts once. `origin` names the source split that a split draws from. Too few rows for a cell is an error.
    """
    every = [r.asDict() for r in rows.select(*cells).distinct().collect()]
    rows = rows.groupBy(content).agg(F.min_by(F.struct(*rows.columns), F.struct(shuffled(key, seed), key)).alias("r")).select("r.*")
    taken = None
    for split, target in targets.items():
        open_ = rows if not origin else rows.where(F.col(source_split) == origin[split])
        if taken is not None:
            open_ = open_.join(taken.select(content), content, "left_anti")
            if identity:
                open_ = open_.join(taken.select(identity).where(F.col(identity).isNotNull()).distinct(), identity, "left_anti")
            if fingerprint:
                open_ = without_near(open_, taken, radius, fingerprint)
        own = staged(quota(open_, cells, target, key, seed).select(*rows.columns).withColumn("split", F.lit(split)), f"reserved-{split}")
        found = {tuple(r[c] for c in cells): r["count"] for r in own.groupBy(*cells).count().collect()}
        short = [c for c in every if found.get(tuple(c[k] for k in cells), 0) < target]
        if short:
            raise ValueError(f"too few rows for {split}: {short[:3]}")
        taken = own if taken is None else taken.unionByName(own)
    return taken


def uniform_draws(spark: SparkSession, n: int, seed: int, epoch: int = 0) -> DataFrame:
    """(draw, u): `n` keyed uniform numbers of 52 bits, the same whenever a task runs again."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("id").cast("string")).cast("binary"))
    return spark.range(n).select(F.col("id").alias("draw"), F.conv(F.substring(text, 1, 13), 16, 10).cast("long").alias("u"))


#: Weights are whole parts of the largest one, so that sums don't depend on their order.
PARTS = 1 << 30


def weighted_draws(rows: DataFrame, weight: str, draws: int, key: str, seed: int, epoch: int = 0, cells: int | None = None) -> DataFrame:
    """`draws` rows drawn with replacement by their weights, exactly so many; adds `draw`, from 0. An epoch draws anew.

    Every row has an interval of the line from 0 to the weights' sum, in the order of `key` (a unique number), and each
    draw is a keyed uniform point on it. Interval starts are running sums over buckets of rows. The line is also cut
    into cells of one width; a row that covers several stands at the beginning of each. Draws meet the rows of their
    bucket and cell by a sort and take the last row that starts before them: no pairs are made, a bucket has about
    as many rows as any other and a cell as many draws, also where one row has most of the weight. Rows of weight null, zero
    or less are never drawn; without any other row, draws are an error.
    """
    largest = rows.agg(F.max(weight)).first()[0]
    if not draws:
        return rows.limit(0).withColumn("draw", F.lit(None).cast("long"))
    if not largest or largest <= 0:
        raise ValueError("no row has a weight")
    n = cells or 2 * shuffle_partitions(rows.sparkSession)
    parts = rows.where(F.col(weight) > 0).select(F.col(key).alias("_key"), F.greatest(F.floor(F.col(weight) / F.lit(float(largest)) * PARTS), F.lit(1)).cast("long").alias("_parts"))
    placed = staged(bucketed(running(parts, "_key", ["_parts"]), "_key"), "draw-intervals")
    starts = [(r[0], r[1], r[2]) for r in placed.groupBy("_bucket").agg(F.min("_parts_before"), F.max(F.col("_parts_before") + F.col("_parts"))).orderBy("_bucket").collect()]
    whole = starts[-1][2]
    width = F.lit(-(-whole // n))
    cell = lambda at: F.expr(f"{at} div {-(-whole // n)}")
    end = placed.withColumn("_end", F.col("_parts_before") + F.col("_parts") - 1)
    held = end.withColumn("_cell", F.explode(F.sequence(cell("_parts_before"), cell("_end")))).select("_bucket", "_cell", F.greatest("_parts_before", F.col("_cell") * width).alias("_at"), F.lit(0).alias("_kind"), "_key", F.lit(None).cast("long").alias("draw"))
    point = F.expr(f"(cast(u as decimal(18,0)) * cast({whole} as decimal(20,0))) div cast({1 << 52} as decimal(18,0))")
    points = uniform_draws(rows.sparkSession, draws, seed, epoch).select("draw", point.alias("_at"))
    bucket = F.element_at(F.array(*(F.lit(b) for b, _, _ in starts)), F.greatest(F.size(F.filter(F.array(*(F.lit(s).cast("long") for _, s, _ in starts)), lambda s: s <= F.col("_at"))), F.lit(1)))
    thrown = points.withColumn("_bucket", bucket).withColumn("_cell", cell("_at")).select("_bucket", "_cell", "_at", F.lit(1).alias("_kind"), F.lit(None).cast(placed.schema["_key"].dataType).alias("_key"), "draw")
    line = Window.partitionBy("_bucket", "_cell").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = held.unionByName(thrown).withColumn("_key", F.last("_key", ignorenulls=True).over(line)).where("_kind = 1").select("_key", "draw")
    return met.join(rows, met["_key"] == rows[key]).select(*(rows[c] for c in rows.columns), "draw")


def draw_audit(drawn: DataFrame, keys: list[str]) -> DataFrame:
    """What an epoch drew: rows by `keys`."""
    return drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("drawn"))


def draw_report(rows: DataFrame, weight: str, draws: int, key: str, seed: int, epochs: int, keys: list[str]) -> DataFrame:
    """The audit of several epochs: (epoch, keys, drawn, distinct rows drawn)."""
    every = None
    for epoch in range(epochs):
        own = weighted_draws(rows, weight, draws, key, seed, epoch).withColumn("epoch", F.lit(epoch))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("epoch", *keys).agg(F.count(F.lit(1)).alias("drawn"), F.count_distinct(key).alias("distinct_rows"))
