"""Nine selections of a decision threshold. A row counts as fake where its score is at least the threshold.

All build on one frame: distinct scores with the counts below each (a running sum, no global window),
and on one final aggregate, `max_by` over a struct of the objective and its tie-breaks. They differ in
candidates, objective and ties, and are not interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.metrics import by_score, ranked, rate
from quillmark.plans.prefix import quantiles, running

#: Cells whose recalls the seven-cell rules weigh: (domain, scenario, weight in the utility).
CELLS = (("v1_five_scenarios", 1, 0.0625), ("v1_five_scenarios", 2, 0.0625), ("v1_five_scenarios", 3, 0.0625), ("v1_five_scenarios", 4, 0.25), ("v1_five_scenarios", 5, 0.0625), ("paired_news", 1, 0.25), ("paired_news", 4, 0.25))


def above(score: Column) -> Column:
    """The next double after a positive or zero score: a threshold at which nothing is fake."""
    return score + F.greatest(F.abs(score), F.lit(2.0**-1022)) * F.lit(2.0**-52)


def _best(candidates: DataFrame, keys: Sequence[Column], extra: Sequence = ()) -> DataFrame:
    """The candidate whose keys are the largest, the first key first."""
    order = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    kept = F.struct("threshold", *extra)
    return candidates.agg(F.max_by(kept, order).alias("b")).select("b.*")


def _near_half() -> Column:
    return -F.abs(F.col("threshold") - 0.5)


def _totals(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))


def balanced(scored: DataFrame, label: str, score: str, metric: str = "balanced_accuracy") -> DataFrame:
    """Candidates 0, .5, mid-points and above the largest; ties go nearest to .5, then to the larger. Both classes are needed."""
    frame = ranked(scored, label, score, follow=True)
    whole = _totals(frame)
    mid = frame.select(F.coalesce((F.col("score") + F.col("score_next")) / 2, above(F.col("score"))).alias("threshold"), (F.col("pos_before") + F.col("pos")).alias("fn"), (F.col("neg_before") + F.col("neg")).alias("tn"))
    half = scored.agg(F.count_if((F.col(label) == 1) & (F.col(score) < 0.5)).alias("fn"), F.count_if((F.col(label) == 0) & (F.col(score) < 0.5)).alias("tn")).select(F.lit(0.5).alias("threshold"), "fn", "tn")
    zero = scored.sparkSession.range(1).select(F.lit(0.0).alias("threshold"), F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("tn"))
    every = mid.unionByName(half).unionByName(zero).crossJoin(whole)
    tp, fp = F.col("P") - F.col("fn"), F.col("N") - F.col("tn")
    if metric == "balanced_accuracy":
        value = (rate(tp, F.col("P")) + rate(F.col("tn"), F.col("N"))) / 2
    elif metric == "f1_macro":
        value = (rate(2 * tp, 2 * tp + fp + F.col("fn")) + rate(2 * F.col("tn"), 2 * F.col("tn") + fp + F.col("fn"))) / 2
    else:
        raise ValueError("the metric must weigh both classes")
    value = F.when((F.col("P") == 0) | (F.col("N") == 0), F.raise_error(F.lit("both classes are needed")).cast("double")).otherwise(value)
    return _best(every.withColumn("value", value), [F.col("value"), _near_half(), F.col("threshold")], ["value"])


def youden(scored: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """Candidates are the scores; the largest tpr - fpr (12 digits), then the larger of the lesser recall, then nearest to .5. `weight` weighs rows."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = scored.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("neg"))
    frame = running(own, "score", ["pos", "neg"])
    tpr, tnr = 1 - F.col("pos_before") / F.col("P"), F.col("neg_before") / F.col("N")
    every = frame.crossJoin(_totals(own)).select(F.col("score").alias("threshold"), tpr.alias("tpr"), (1 - tnr).alias("fpr"))
    return _best(every, [F.round(F.col("tpr") - F.col("fpr"), 12), F.round(F.least(F.col("tpr"), 1 - F.col("fpr")), 12), _near_half(), -F.col("threshold")], ["tpr", "fpr"])


def with_validation_weight(rows: DataFrame, name: str, group: str = "evaluation_group", label: str = "label_binary") -> DataFrame:
    """Adds the weight that makes each of the four cells of domain and class a quarter; other numbers of cells are an error."""
    cells = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    number = F.broadcast(cells.agg(F.count(F.lit(1)).alias("_cells")))
    weight = F.when(F.col("_cells") != 4, F.raise_error(F.lit("both classes of two domains are needed")).cast("double")).otherwise(F.lit(0.25) / F.col("_n"))
    return rows.join(F.broadcast(cells.limit(5)), [group, label]).crossJoin(number).withColumn(name, weight).drop("_n", "_cells")


def recall_constrained(scored: DataFrame, scenario: str, score: str, minimum: dict[int, float]) -> DataFrame:
    """The largest threshold that leaves each listed scenario its least recall: the least of the scenarios' ceilings."""
    out = None
    for s, least in minimum.items():
        if not 0 < least <= 1:
            raise ValueError("a recall target lies in (0, 1]")
        own = scored.where(F.col(scenario) == s).groupBy(F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("c"))
        frame = running(own, "score", ["c"]).crossJoin(F.broadcast(own.agg(F.sum("c").alias("n"))))
        needed = F.ceil(F.col("n") * F.lit(float(least)) - 1e-10)
        at = F.col("n") - needed  # rank of the ceiling, from 0
        ceiling = frame.where((F.col("c_before") <= at) & (at < F.col("c_before") + F.col("c"))).select(F.col("score").alias("threshold"))
        out = ceiling if out is None else out.unionByName(ceiling)
    return out.agg(F.min("threshold").alias("threshold"))


def _cell_recalls(scored: DataFrame, group: str, scenario: str, score: str) -> DataFrame:
    """For every score, and one threshold above all, the recall of each of the seven cells."""
    cell = [F.count_if((F.col(group) == g) & (F.col(scenario) == s)).alias(f"c{k}") for k, (g, s, _) in enumerate(CELLS)]
    own = scored.groupBy(F.col(score).cast("double").alias("score")).agg(*cell)
    top = scored.agg(F.max(F.col(score).cast("double")).alias("m")).select(above(F.col("m")).alias("score"), *(F.lit(0).cast("long").alias(f"c{k}") for k in range(len(CELLS))))
    names = [f"c{k}" for k in range(len(CELLS))]
    frame = running(own.unionByName(top), "score", names)
    totals = F.broadcast(own.agg(*(F.sum(n).alias(f"{n}_all") for n in names)))
    recalls = []
    for k, (_, s, _) in enumerate(CELLS):
        below = F.col(f"c{k}_before").cast("double") / F.col(f"c{k}_all")
        below = F.when(F.col(f"c{k}_all") == 0, F.raise_error(F.lit(f"cell {k} has no rows")).cast("double")).otherwise(below)
        recalls.append((below if s == 4 else 1 - below).alias(f"r{k}"))
    rows = frame.crossJoin(totals).select(F.col("score").alias("threshold"), *recalls)
    utility = sum((F.col(f"r{k}") * w for k, (_, _, w) in enumerate(CELLS)), F.lit(0.0))
    return rows.withColumns({"utility": utility, "minimum": F.least(*(F.col(f"r{k}") for k in range(len(CELLS))))})


def _eligible_first(rows: DataFrame, eligible: Column) -> DataFrame:
    """Eligible candidates, or all of them where none is."""
    marked = rows.withColumn("eligible", eligible)
    some = F.broadcast(marked.agg(F.max("eligible").alias("some")))
    return marked.crossJoin(some).where(F.col("eligible") | ~F.col("some"))


def recall_floor(scored: DataFrame, group: str, scenario: str, score: str, utility_floor: float) -> DataFrame:
    """Of the thresholds with enough utility the largest least recall, then utility; without any, utility first. Ties nearest to .5."""
    rows = _eligible_first(_cell_recalls(scored, group, scenario, score), F.col("utility") >= utility_floor - 1e-12)
    m, u = F.round("minimum", 12), F.round("utility", 12)
    first, second = F.when(F.col("some"), m).otherwise(u), F.when(F.col("some"), u).otherwise(m)
    return _best(rows, [first, second, _near_half(), -F.col("threshold")], ["minimum", "utility", F.col("some").alias("eligible")])


def protected(scored: DataFrame, group: str, scenario: str, score: str, reference_recalls: Sequence[float], reference_utility: float, drop: float = 0.02, utility_drop: float = 0.005) -> DataFrame:
    """As `recall_floor`, where the five first cells may lose `drop` against a reference and utility `utility_drop`."""
    fits = F.col("utility") >= reference_utility - utility_drop - 1e-12
    for k, r in enumerate(reference_recalls[:5]):
        fits = fits & (F.col(f"r{k}") >= r - drop - 1e-12)
    rows = _eligible_first(_cell_recalls(scored, group, scenario, score), fits)
    return _best(rows, [F.round("minimum", 12), F.round("utility", 12), _near_half(), -F.col("threshold")], ["minimum", "utility", F.col("some").alias("eligible")])


def grid(scored: DataFrame, label: str, score: str) -> DataFrame:
    """.05 to .95 by .05; the best balanced accuracy, the lowest of equals; .5 with fewer than two classes. One pass of counts."""
    steps = [k / 100 for k in range(5, 100, 5)]
    y, p = F.col(label), F.col(score)
    found = scored.agg(F.count_if(y == 1).alias("P"), F.count_if(y == 0).alias("N"), *(F.struct(F.lit(t).alias("threshold"), F.count_if((y == 1) & (p >= t)).alias("tp"), F.count_if((y == 0) & (p < t)).alias("tn")).alias(f"t{k}") for k, t in enumerate(steps)))
    rows = found.select("P", "N", F.explode(F.array(*(F.col(f"t{k}") for k in range(len(steps))))).alias("t")).select("P", "N", "t.*")
    rows = rows.withColumn("value", (rate(F.col("tp"), F.col("P")) + rate(F.col("tn"), F.col("N"))) / 2)
    best = _best(rows, [F.col("value"), -F.col("threshold")], ["value", "P", "N"])
    return best.select(F.when((F.col("P") == 0) | (F.col("N") == 0), 0.5).otherwise(F.col("threshold")).alias("threshold"), "value")


def _midpoints(distinct: DataFrame) -> DataFrame:
    frame = running(distinct.select("score").distinct().withColumn("one", F.lit(1).cast("long")), "score", ["one"], follow=True)
    return frame.where("score_next IS NOT NULL").select(((F.col("score") + F.col("score_next")) / 2).alias("threshold"))


def _with_half(thresholds: DataFrame) -> DataFrame:
    return thresholds.unionByName(thresholds.sparkSession.range(1).select(F.lit(0.5).alias("threshold"))).distinct()


def _worst_recall(scored: DataFrame, thresholds: DataFrame, label: str, score: str, condition: str | None) -> DataFrame:
    """The threshold with the largest least recall over all conditions and classes, then the largest mean, then nearest to .5."""
    names = [r[0] for r in scored.select(condition).distinct().orderBy(condition).collect()] if condition else [None]
    cells = [(c, y) for c in names for y in (1, 0)]
    is_ = lambda c, y: (F.col(label) == y) & (F.lit(True) if c is None else F.col(condition) == c)
    own = scored.groupBy(F.col(score).cast("double").alias("score")).agg(*(F.count_if(is_(c, y)).alias(f"c{k}") for k, (c, y) in enumerate(cells)))
    names_ = [f"c{k}" for k in range(len(cells))]
    marks = thresholds.select(F.col("threshold").alias("score"), *(F.lit(0).cast("long").alias(n) for n in names_), F.lit(1).alias("mark"))
    both = own.withColumn("mark", F.lit(0)).unionByName(marks).groupBy("score").agg(*(F.sum(n).alias(n) for n in names_), F.max("mark").alias("mark"))
    frame = running(both, "score", names_).where("mark = 1").crossJoin(F.broadcast(own.agg(*(F.sum(n).alias(f"{n}_all") for n in names_))))
    recalls = []
    for k, (_, y) in enumerate(cells):
        below = F.col(f"c{k}_before").cast("double") / F.col(f"c{k}_all")
        recalls.append(1 - below if y else below)
    worst = F.least(*recalls) if len(recalls) > 1 else recalls[0]
    rows = frame.select(F.col("score").alias("threshold"), worst.alias("worst"), (sum(recalls, F.lit(0.0)) / len(recalls)).alias("mean"))
    return _best(rows, [F.round("worst", 12), F.round("mean", 12), _near_half(), -F.col("threshold")], ["worst", "mean"])


def worst_recall(scored: DataFrame, label: str, score: str, most: int = 2001) -> DataFrame:
    """.5 and the mid-points, thinned to `most` quantiles of them where there are more."""
    mids = _with_half(_midpoints(by_score(scored, label, score)))
    if mids.count() > most:
        grid_ = quantiles(mids.select("threshold", F.lit(1).cast("long").alias("c")), "threshold", "c", most - 1)
        mids = _with_half(grid_.select(F.col("q").alias("threshold")).distinct())
    return _worst_recall(scored, mids, label, score, None)


def robust(scored: DataFrame, label: str, score: str, condition: str, steps: int = 1000) -> DataFrame:
    """.5 and 1001 quantiles of each condition's scores."""
    out = None
    for r in scored.select(condition).distinct().collect():
        own = scored.where(F.col(condition) == r[0]).groupBy(F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("c"))
        q = quantiles(own, "score", "c", steps).select(F.col("q").alias("threshold"))
        out = q if out is None else out.unionByName(q)
    return _worst_recall(scored, _with_half(out.distinct()), label, score, condition)


def operating(scored: DataFrame, label: str, score: str, condition: str) -> DataFrame:
    """.5 and the mid-points of all conditions' scores together."""
    return _worst_recall(scored, _with_half(_midpoints(by_score(scored, label, score))), label, score, condition)
