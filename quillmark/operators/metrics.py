"""Classification metrics: one pass of conditional counts, ranks by running sums, rates that are 0 where nothing was counted."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.plans.prefix import running
from quillmark.plans.sizing import shuffle_partitions
from quillmark.plans.staging import staged

Z95 = 1.959963984540054


def rate(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def counts(label: str, fake: Column) -> list[Column]:
    y = F.col(label)
    cell = lambda name, c: F.count_if(c).alias(name)
    return [F.count(F.lit(1)).alias("n"), cell("tp", (y == 1) & fake), cell("tn", (y == 0) & ~fake), cell("fp", (y == 0) & fake), cell("fn", (y == 1) & ~fake)]


def derived() -> dict[str, Column]:
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return {
        "accuracy": rate(tp + tn, F.greatest(F.col("n"), F.lit(1))),
        "precision": rate(tp, tp + fp),
        "recall": rate(tp, tp + fn),
        "f1": rate(2 * tp, 2 * tp + fp + fn),
        "real_recall": rate(tn, tn + fp),
        "real_precision": rate(tn, tn + fn),
        "real_f1": rate(2 * tn, 2 * tn + fp + fn),
    }


def binary_counts(scored: DataFrame, label: str, score: str, threshold: float | Column = 0.5, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of the decision score >= threshold, in one aggregation."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    found = scored.groupBy(*(by or [])).agg(*counts(label, F.col(score) >= limit)).withColumns(derived())
    return found.withColumns({"balanced_accuracy": (F.col("recall") + F.col("real_recall")) / 2, "f1_macro": (F.col("f1") + F.col("real_f1")) / 2})


def by_score(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) for each distinct score."""
    return scored.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def ranked(scored: DataFrame, label: str, score: str, follow: bool = False) -> DataFrame:
    return running(by_score(scored, label, score), "score", ["pos", "neg"], follow=follow)


def auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(auc): share of pairs that the score orders rightly, ties half; NaN if a class is empty."""
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked(scored, label, score).agg(wins.alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(F.coalesce(F.try_divide(F.col("w"), F.col("p").cast("double") * F.col("n")), F.lit(float("nan"))).alias("auc"))


def average_precision(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(ap): precision at each distinct score, weighted by the recall it adds."""
    frame = ranked(scored, label, score)
    whole = F.broadcast(frame.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    tp, fp = F.col("P") - F.col("pos_before"), F.col("N") - F.col("neg_before")
    gain = F.sum(F.col("pos") * F.try_divide(tp.cast("double"), (tp + fp).cast("double")))
    return frame.crossJoin(whole).agg(gain.alias("g"), F.sum("pos").alias("p")).select(F.coalesce(F.try_divide(F.col("g"), F.col("p").cast("double")), F.lit(float("nan"))).alias("ap"))


def binary_metrics(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """All fields of the standard binary report, with AUC."""
    return binary_counts(scored, label, score, threshold).crossJoin(F.broadcast(auc(scored, label, score)))


def forensic_metrics(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """The report with average precision; an error unless both labels are there."""
    both = F.when((F.col("tp") + F.col("fn") == 0) | (F.col("tn") + F.col("fp") == 0), F.raise_error(F.lit("both labels are needed")).cast("double")).otherwise(F.col("balanced_accuracy"))
    found = binary_counts(scored, label, score, threshold).withColumn("balanced_accuracy", both)
    return found.crossJoin(F.broadcast(average_precision(scored, label, score))).crossJoin(F.broadcast(auc(scored, label, score)))


def confusion_cells(predicted: DataFrame, truth: str, guess: str, classes: int) -> DataFrame:
    """(truth, predicted, n) for every pair of the fixed classes, empty ones with 0."""
    spark = predicted.sparkSession
    grid = spark.range(classes).select(F.col("id").cast("int").alias("truth")).crossJoin(F.broadcast(spark.range(classes).select(F.col("id").cast("int").alias("predicted"))))
    found = predicted.groupBy(F.col(truth).cast("int").alias("truth"), F.col(guess).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(found, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_report(predicted: DataFrame, truth: str, guess: str, classes: int) -> DataFrame:
    """(class, n, recall, f1) for every fixed class; an absent class counts 0."""
    cells = confusion_cells(predicted, truth, guess, classes)
    rows = cells.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    columns = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("guessed"))
    return rows.join(columns, "class").select("class", "n", "hit", "guessed", rate(F.col("hit"), F.col("n")).alias("recall"), rate(2 * F.col("hit"), F.col("n") + F.col("guessed")).alias("f1"))


def multiclass_metrics(predicted: DataFrame, truth: str, guess: str, classes: int) -> DataFrame:
    report = class_report(predicted, truth, guess, classes)
    return report.agg(F.sum("n").alias("n"), rate(F.sum("hit"), F.greatest(F.sum("n"), F.lit(1))).alias("accuracy"), (F.sum("f1") / classes).alias("f1_macro"))


def group_accuracy(predicted: DataFrame, key: str, truth: str, guess: str) -> DataFrame:
    return predicted.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))


def grouped_auc_ap(scored: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """(key, auc, ap) for each group with both labels; a group's scores are dealt over buckets, so a hot one isn't one task."""
    own = scored.groupBy(F.col(key).alias("k"), F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    frame = running(own, "score", ["pos", "neg"], by=["k"])
    whole = own.groupBy("k").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).where((F.col("P") > 0) & (F.col("N") > 0))
    tp, fp = F.col("P") - F.col("pos_before"), F.col("N") - F.col("neg_before")
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    gain = F.sum(F.col("pos") * (tp.cast("double") / (tp + fp)))
    found = frame.join(whole, "k").groupBy("k", "P", "N").agg(wins.alias("w"), gain.alias("g"))
    return found.select(F.col("k").alias(key), (F.col("w") / (F.col("P").cast("double") * F.col("N"))).alias("auc"), (F.col("g") / F.col("P").cast("double")).alias("ap"))


def generator_report(scored: DataFrame, key: str, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Metrics of each generator with both labels."""
    rows = binary_counts(scored, label, score, threshold, by=[key]).where((F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0))
    return rows.join(grouped_auc_ap(scored, key, label, score), key)


def family_averages(report: DataFrame, key: str, families: dict[str, tuple[str, ...]]) -> DataFrame:
    """Averages over all generators and over families, and the population deviation of AP."""
    member = F.filter(F.array(*[F.when(F.col(key).isin(*names), F.lit(f)) for f, names in families.items()], F.lit("all_generators")), lambda f: f.isNotNull())
    averaged = ("ap", "accuracy", "auc", "real_recall", "recall", "balanced_accuracy")
    return report.select("*", F.explode(member).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("generators"), *(F.avg(m).alias(m) for m in averaged), F.stddev_pop("ap").alias("ap_deviation"))


def category_accuracy(scored: DataFrame, categories: str, label: str, score: str, threshold: float, blank: str) -> DataFrame:
    """A row counts in each of its `|`-joined categories; none at all is the category `blank`."""
    names = F.transform(F.split(F.coalesce(F.col(categories), F.lit("")), "[|]"), lambda c: F.when(c == "", F.lit(blank)).otherwise(c))
    rows = scored.select(F.explode(names).alias("category"), F.col(label).alias("y"), (F.col(score) >= threshold).cast("int").alias("p"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"), F.array_sort(F.collect_set("y")).alias("labels"))


def scenario_image_accuracy(scored: DataFrame, scenarios: str, label: str, score: str, threshold: float) -> DataFrame:
    """Image accuracy by scenario of `|`-joined scenarios; the image is fake in 3 and 5 alone, else it is an error."""
    rows = scored.select(F.explode(F.array_distinct(F.split(scenarios, "[|]")).cast("array<int>")).alias("scenario"), F.col(label).alias("y"), (F.col(score) >= threshold).cast("int").alias("p"))
    rows = rows.where(F.col("scenario").between(1, 5)).withColumn("want", F.col("scenario").isin(3, 5).cast("int"))
    want = F.when(F.col("y") != F.col("want"), F.raise_error(F.lit("label contradicts scenario")).cast("int")).otherwise(F.col("want"))
    return rows.withColumn("want", want).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.max("want").alias("image_label"), F.avg((F.col("p") == F.col("want")).cast("double")).alias("image_accuracy"))


AREA_BOUNDS = (0.0, 0.01, 0.05, 0.15, 1.01)


def area_recall(scored: DataFrame, area: str, label: str, score: str, threshold: float, bounds: tuple = AREA_BOUNDS) -> DataFrame:
    """Recall of fakes by half-open buckets of area; empty buckets don't appear."""
    a, bucket = F.col(area), F.lit(None).cast("int")
    for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        bucket = F.when((a >= low) & (a < high), F.lit(k)).otherwise(bucket)
    rows = scored.where(F.col(label) == 1).withColumn("bucket", bucket).where("bucket IS NOT NULL")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(score) >= threshold).cast("double")).alias("fake_recall"))


def method_report(scored: DataFrame, method: str, authentic: str, label: str, score: str, threshold: float) -> DataFrame:
    """Accuracy and mean score by method; for each method but `authentic`, also the metrics of it with all authentic rows."""
    fake = F.col(score) >= threshold
    own = scored.groupBy(method).agg(F.count(F.lit(1)).alias("n"), F.avg((fake.cast("int") == F.col(label)).cast("double")).alias("accuracy"), F.avg(score).alias("mean_score"), F.count_if(fake & (F.col(label) == 1)).alias("tp"), F.count_if(~fake & (F.col(label) == 1)).alias("fn"))
    base = scored.where(F.col(label) == 0).agg(F.count_if(~fake).alias("tn"), F.count_if(fake).alias("fp"))
    with_real = own.crossJoin(F.broadcast(base)).withColumn("real_recall", rate(F.col("tn"), F.col("tn") + F.col("fp"))).withColumn("fake_recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))
    balanced = F.when(F.col(method) != authentic, (F.col("real_recall") + F.col("fake_recall")) / 2)
    return with_real.select(method, "n", "accuracy", "mean_score", balanced.alias("balanced_with_authentic"))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share, inside [0, 1]."""
    s, n = successes.cast("double"), n.cast("double")
    p, z2 = F.try_divide(s, n), F.lit(Z95 * Z95)
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(Z95) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


# --- caption pairs

PAIR_METRICS = ("genuine_recall", "ooc_recall", "balanced_accuracy", "both_correct", "within_caption_ranking", "mean_probability_gap")


def caption_pairs(rows: DataFrame, caption: str = "caption_id", scenario: str = "scenario", score: str = "prob", ranking: str | None = None) -> DataFrame:
    """(caption, genuine, ooc, genuine_rank, ooc_rank): one row for each caption with exactly one genuine and one OOC row."""
    r = ranking or score
    of = lambda s, c: F.max(F.when(F.col(scenario) == s, F.col(c)))
    grouped = rows.groupBy(caption).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(scenario) == 4).alias("_g"), F.count_if(F.col(scenario) == 1).alias("_o"), of(4, score).alias("genuine"), of(1, score).alias("ooc"), of(4, r).alias("genuine_rank"), of(1, r).alias("ooc_rank"))
    return grouped.where("_n = 2 AND _g = 1 AND _o = 1").drop("_n", "_g", "_o")


def incomplete_pairs(rows: DataFrame, caption: str = "caption_id", scenario: str = "scenario") -> DataFrame:
    """Captions that aren't exactly one genuine and one OOC row."""
    return rows.groupBy(caption).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(scenario) == 4).alias("genuine"), F.count_if(F.col(scenario) == 1).alias("ooc")).where("n <> 2 OR genuine <> 1 OR ooc <> 1")


def pair_values(pairs: DataFrame, threshold: float) -> DataFrame:
    real, ooc = (F.col("genuine") < threshold).cast("double"), (F.col("ooc") >= threshold).cast("double")
    order = F.when(F.col("ooc_rank") > F.col("genuine_rank"), 1.0).when(F.col("ooc_rank") == F.col("genuine_rank"), 0.5).otherwise(0.0)
    values = (real, ooc, (real + ooc) / 2, real * ooc, order, F.col("ooc") - F.col("genuine"))
    return pairs.select("*", *(v.alias(m) for v, m in zip(values, PAIR_METRICS, strict=True)))


def paired_summary(pairs: DataFrame, threshold: float) -> DataFrame:
    return pair_values(pairs, threshold).agg(F.count(F.lit(1)).alias("caption_pairs"), *(F.avg(m).alias(m) for m in PAIR_METRICS))


def paired_interval(differences: DataFrame, names: Sequence[str]) -> DataFrame:
    """(metric, n, mean, low, high): the normal 95 % interval of each mean of paired differences, in one pass of sums."""
    one = lambda c: F.struct(F.lit(c).alias("metric"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.try_divide(F.stddev_samp(c), F.sqrt(F.count(c))).alias("error"))
    found = differences.agg(*(one(c).alias(c) for c in names)).select(F.explode(F.array(*(F.col(c) for c in names))).alias("r")).select("r.*")
    return found.select("metric", "n", "mean", (F.col("mean") - Z95 * F.col("error")).alias("low"), (F.col("mean") + Z95 * F.col("error")).alias("high"))


def validation_bundle(rows: DataFrame, domains: Sequence[str], paired: str, threshold: float, domain: str = "evaluation_group", label: str = "label", score: str = "prob", caption: str = "caption_id", scenario: str = "scenario") -> DataFrame:
    """One row for a model: each domain's rows, balanced accuracy and AUC, the caption pairs of the domain `paired`, and `utility`, the mean of the balanced accuracies."""
    out = None
    for name in domains:
        own = binary_metrics(rows.where(F.col(domain) == name), label, score, threshold).select(F.col("n").alias(f"{name}_n"), F.col("balanced_accuracy").alias(f"{name}_balanced_accuracy"), F.col("auc").alias(f"{name}_auc"))
        out = own if out is None else out.crossJoin(F.broadcast(own))
    pairs = caption_pairs(rows.where(F.col(domain) == paired), caption, scenario, score)
    out = out.crossJoin(F.broadcast(paired_summary(pairs, threshold).withColumnRenamed("balanced_accuracy", "pair_balanced_accuracy")))
    return out.withColumn("utility", sum((F.col(f"{n}_balanced_accuracy") for n in domains), F.lit(0.0)) / len(domains))


def source_recall(rows: DataFrame, threshold: float, source: str = "source", subcategory: str = "subcategory", score: str = "prob", scenario: str = "scenario") -> DataFrame:
    """Recall of genuine rows by sub-category, or source where that is blank."""
    name = F.coalesce(F.nullif(F.col(subcategory), F.lit("")), F.col(source))
    return rows.where(F.col(scenario) == 4).groupBy(name.alias("origin")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(score) < threshold).cast("double")).alias("genuine_recall"))


#: Distinct values of a bootstrap that are drawn from together, and repetitions that are drawn at once.
BOOTSTRAP_VALUES, BOOTSTRAP_CHUNK = 256, 500


def block_draws(n: int, weights: np.ndarray, block: int, repetitions: int, seed: list[int]) -> np.ndarray:
    """How many of each repetition's n draws fall into one block of all, by weights.

    Draws go down a tree over the blocks, at each fork by one keyed binomial for every repetition, so all blocks' numbers sum to n
    and each block finds its own without the others.
    """
    upto, low, high, here = np.r_[0, np.cumsum(weights)], 0, len(weights), np.full(repetitions, n)
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(here, (upto[middle] - upto[low]) / (upto[high] - upto[low]))
        here, low, high = (left, low, middle) if block < middle else (here - left, middle, high)
    return here


def drawn_sums(values: np.ndarray, counts: np.ndarray, draws: np.ndarray, seed: list[int]) -> np.ndarray:
    """The sum of the values drawn, for each repetition; a value is drawn by its count."""
    out = np.empty(len(draws))
    for k in range(0, len(draws), BOOTSTRAP_CHUNK):
        times = np.random.default_rng([*seed, k]).multinomial(draws[k : k + BOOTSTRAP_CHUNK], counts / counts.sum())
        out[k : k + BOOTSTRAP_CHUNK] = times @ values
    return out


def bootstrap_difference(values: DataFrame, key: str, metrics: list[str], repetitions: int = 5000, seed: int = 7) -> DataFrame:
    """(metric, difference, low, high): 95 % percentile intervals of means; each repetition draws n of the n rows with replacement.

    An interval needs only how often each value of its metric is drawn, so equal values are counted first: most metrics have a
    few. Distinct values are dealt into blocks whose number grows with theirs; a block is one row, works by itself, and only
    sums leave a task. Generators are of seed, metric and block, so the result doesn't depend on partitions. Rows whose
    value is null don't count for that metric.
    """
    long = values.select(F.explode(F.array(*(F.struct(F.lit(i).alias("metric"), F.col(m).cast("double").alias("value")) for i, m in enumerate(metrics)))).alias("x")).select("x.*").where("value IS NOT NULL")
    counted = staged(long.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n")), "bootstrap-values")
    sizes = {r[0]: r[1] for r in counted.groupBy("metric").count().collect()}
    if len(sizes) < len(metrics):
        raise ValueError("no rows to draw from")
    blocks = F.element_at(F.array(*(F.lit(-(-sizes[i] // BOOTSTRAP_VALUES)) for i in range(len(metrics)))), F.col("metric") + 1)
    dealt = counted.withColumn("block", F.pmod(F.xxhash64("value"), blocks)).groupBy("metric", "block").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("rows"), F.sum("n").alias("weight"))
    held = staged(dealt, "bootstrap-blocks")
    weights = {i: np.zeros(-(-sizes[i] // BOOTSTRAP_VALUES), np.int64) for i in range(len(metrics))}
    for r in held.select("metric", "block", "weight").collect():
        weights[r["metric"]][r["block"]] = r["weight"]
    shared = values.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for metric, block, rows in zip(*(batch.column(c).to_pylist() for c in ("metric", "block", "rows")), strict=True):
                of = shared.value[metric]
                draws = block_draws(int(of.sum()), of, block, repetitions, [seed, metric])
                found = drawn_sums(np.array([x["value"] for x in rows]), np.array([x["n"] for x in rows]), draws, [seed, metric, block])
                sums[metric] = sums.get(metric, 0.0) + found
        for metric, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(repetitions, metric), pa.int32()), pa.array(np.arange(repetitions)), pa.array(total)], names=["metric", "rep", "total"])

    parts = held.repartition(shuffle_partitions(values.sparkSession), "metric", "block").mapInArrow(run, "metric int, rep long, total double")
    named = F.element_at(F.array(*map(F.lit, metrics)), F.col("metric") + 1).alias("metric")
    n = F.element_at(F.array(*(F.lit(int(weights[i].sum())) for i in range(len(metrics)))), F.col("metric") + 1)
    means = parts.groupBy("metric", "rep").agg(F.sum("total").alias("total")).withColumn("mean", F.col("total") / n)
    bounds = means.groupBy("metric").agg(F.percentile("mean", [0.025, 0.975]).alias("b"))
    whole = counted.groupBy("metric").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("difference"))
    return whole.join(bounds, "metric").select(named, "difference", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))


def enriched_metrics(scored: DataFrame, label: str, score: str, threshold: float, breakdown: DataFrame | None = None, part: str = "part") -> DataFrame:
    """(part, n, accuracy, recall, recall_low, recall_high, real_recall, real_low, real_high): the whole and each row of `breakdown`.

    `breakdown` names the part of each row in column `part` (a method, an area, a category, as its data set has them);
    recalls come with their Wilson intervals, null where a part has no such row.
    """
    every = scored.withColumn(part, F.lit("all"))
    rows = every if breakdown is None else every.unionByName(breakdown.select(*every.columns))
    found = binary_counts(rows, label, score, threshold, by=[part])
    fake, real = wilson(F.col("tp"), F.col("tp") + F.col("fn")), wilson(F.col("tn"), F.col("tn") + F.col("fp"))
    bound = lambda ends, n, name: [F.when(n > 0, e).alias(f"{name}_{w}") for e, w in zip(ends, ("low", "high"), strict=True)]
    share = lambda name, n: F.when(n > 0, F.col(name)).alias(name)
    fakes, reals = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return found.select(part, "n", "accuracy", share("recall", fakes), *bound(fake, fakes, "recall"), share("real_recall", reals), *bound(real, reals, "real"))


def majority_baseline(train: DataFrame, test: DataFrame, label: str, classes: int) -> DataFrame:
    """(majority_class, majority_accuracy, random_expected); of classes of equal size the least is the majority."""
    sizes = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    major = F.broadcast(sizes.agg(F.max_by(label, F.struct("n", -F.col(label))).alias("majority_class")))
    right = F.avg((F.col(label) == F.col("majority_class")).cast("double")).alias("majority_accuracy")
    return test.crossJoin(major).groupBy("majority_class").agg(right).withColumn("random_expected", F.lit(1.0 / classes))


def rate_spread(rows: DataFrame, label: str, part: str, most: float = 0.05) -> DataFrame:
    """(low, high, spread, note): the positive rate's range over parts; `note` where it is wider than `most`."""
    rates = rows.groupBy(part).agg(F.avg(F.col(label).cast("double")).alias("rate"))
    return rates.agg(F.min("rate").alias("low"), F.max("rate").alias("high"), (F.max("rate") - F.min("rate")).alias("spread")).withColumn("note", F.col("spread") > most)
