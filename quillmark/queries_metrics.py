"""Queries over scored rows: metrics and thresholds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import metrics as m
from quillmark.operators import thresholds as t
from quillmark.plans.fixtures import SCORED_SQL, scored
from quillmark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _rounded(df, digits: int = 9):
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


_COUNTS = """count(*) AS n, count(*) FILTER (WHERE label = 1 AND {d}) AS tp, count(*) FILTER (WHERE label = 0 AND NOT {d}) AS tn,
 count(*) FILTER (WHERE label = 0 AND {d}) AS fp, count(*) FILTER (WHERE label = 1 AND NOT {d}) AS fn"""


def _rates(digits: int = 9) -> str:
    r = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"
    p = {
        "accuracy": r("tp + tn", "n"),
        "precision": r("tp", "tp + fp"),
        "recall": r("tp", "tp + fn"),
        "f1": r("2 * tp", "2 * tp + fp + fn"),
        "real_recall": r("tn", "tn + fp"),
        "real_precision": r("tn", "tn + fn"),
        "real_f1": r("2 * tn", "2 * tn + fp + fn"),
    }
    p["balanced_accuracy"] = f"({p['recall']} + {p['real_recall']}) / 2"
    p["f1_macro"] = f"({p['f1']} + {p['real_f1']}) / 2"
    return ", ".join(f"round({v}, {digits}) AS {k}" for k, v in p.items())


_AUC = "SELECT (sum(CASE WHEN label = 1 THEN rk END) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS auc FROM (SELECT label, CAST(rank() OVER (ORDER BY prob) AS DOUBLE) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS rk FROM {src})"
_AP = "SELECT sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / sum(pos) AS ap FROM (SELECT pos, sum(pos) OVER (ORDER BY prob DESC) AS tp, sum(neg) OVER (ORDER BY prob DESC) AS fp FROM (SELECT prob, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {src} GROUP BY prob))"


@query("binary_metrics", f"WITH {SCORED_SQL}, c AS (SELECT {_COUNTS.format(d='prob >= 0.5')} FROM scored) SELECT n, tp, tn, fp, fn, {_rates()}, round((SELECT auc FROM ({_AUC.format(src='scored')})), 9) AS auc FROM c")
def binary_metrics(spark, folder):
    return _rounded(m.binary_metrics(scored(spark, folder), "label", "prob"))


@query("auc", f"WITH {SCORED_SQL} SELECT round(auc, 9) AS auc FROM ({_AUC.format(src='scored')})")
def auc(spark, folder):
    return _rounded(m.auc(scored(spark, folder), "label", "prob"))


@query("average_precision", f"WITH {SCORED_SQL} SELECT round(ap, 9) AS ap FROM ({_AP.format(src='scored')})")
def average_precision(spark, folder):
    return _rounded(m.average_precision(scored(spark, folder), "label", "prob"))


@query("forensic_metrics", f"WITH {SCORED_SQL}, c AS (SELECT {_COUNTS.format(d='prob >= 0.6')} FROM scored) SELECT n, tp, tn, fp, fn, {_rates()}, round((SELECT ap FROM ({_AP.format(src='scored')})), 9) AS ap, round((SELECT auc FROM ({_AUC.format(src='scored')})), 9) AS auc FROM c")
def forensic_metrics(spark, folder):
    return _rounded(m.forensic_metrics(scored(spark, folder), "label", "prob", 0.6))


def _classes(spark, folder):
    """Five classes, with a guess that is off by one for every seventh document and never says 3."""
    s = scored(spark, folder)
    truth = F.col("scenario") - 1
    return s.select(truth.alias("truth"), F.when(F.pmod("doc_id", F.lit(7)) == 0, F.pmod(truth + 1, F.lit(5))).when(truth == 3, F.lit(4)).otherwise(truth).cast("int").alias("guess"), "lang", "scenario")


_CLASSES = f"WITH {SCORED_SQL}, c AS (SELECT scenario - 1 AS truth, CASE WHEN doc_id % 7 = 0 THEN scenario % 5 WHEN scenario = 4 THEN 4 ELSE scenario - 1 END AS guess, lang, scenario FROM scored), k AS (SELECT CAST(range AS INTEGER) AS class FROM range(5))"
_REPORT = ", r AS (SELECT class, (SELECT count(*) FROM c WHERE truth = class) AS n, (SELECT count(*) FROM c WHERE truth = class AND guess = class) AS hit, (SELECT count(*) FROM c WHERE guess = class) AS guessed FROM k)"


@query("confusion_matrix", f"{_CLASSES} SELECT a.class AS truth, b.class AS predicted, (SELECT count(*) FROM c WHERE truth = a.class AND guess = b.class) AS n FROM k a, k b")
def confusion_matrix(spark, folder):
    return m.confusion_cells(_classes(spark, folder), "truth", "guess", 5)


@query("class_report", f"{_CLASSES}{_REPORT} SELECT class, n, hit, guessed, round(coalesce(hit / nullif(CAST(n AS DOUBLE), 0), 0), 9) AS recall, round(coalesce(2 * hit / nullif(CAST(n + guessed AS DOUBLE), 0), 0), 9) AS f1 FROM r")
def class_report(spark, folder):
    return _rounded(m.class_report(_classes(spark, folder), "truth", "guess", 5))


@query("multiclass_report", f"{_CLASSES}{_REPORT} SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(hit) / CAST(sum(n) AS DOUBLE), 9) AS accuracy, round(sum(coalesce(2 * hit / nullif(CAST(n + guessed AS DOUBLE), 0), 0)) / 5, 9) AS f1_macro FROM r")
def multiclass_report(spark, folder):
    return _rounded(m.multiclass_metrics(_classes(spark, folder), "truth", "guess", 5))


@query("per_scenario_accuracy", f"{_CLASSES} SELECT scenario, count(*) AS n, round(avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM c GROUP BY scenario")
def per_scenario_accuracy(spark, folder):
    return _rounded(m.group_accuracy(_classes(spark, folder), "scenario", "truth", "guess"))


@query("per_group_accuracy", f"{_CLASSES} SELECT lang, count(*) AS n, round(avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM c GROUP BY lang")
def per_group_accuracy(spark, folder):
    return _rounded(m.group_accuracy(_classes(spark, folder), "lang", "truth", "guess"))


@query("score_bundle", f"WITH {SCORED_SQL}, c AS (SELECT {_COUNTS.format(d='prob >= 0.45')} FROM scored), ooc AS (SELECT * FROM scored WHERE scenario IN (1, 4)) SELECT n, tp, tn, fp, fn, {_rates()}, round((SELECT auc FROM ({_AUC.format(src='scored')})), 9) AS auc, round((SELECT auc FROM ({_AUC.format(src='ooc')})), 9) AS ooc_auc FROM c")
def score_bundle(spark, folder):
    s = scored(spark, folder)
    ooc = m.auc(s.where("scenario IN (1, 4)"), "label", "prob").withColumnRenamed("auc", "ooc_auc")
    return _rounded(m.binary_metrics(s, "label", "prob", 0.45).crossJoin(F.broadcast(ooc)))


_GENERATOR = f"""WITH {SCORED_SQL}, c AS (SELECT lang, {_COUNTS.format(d='prob >= 0.5')} FROM scored GROUP BY lang),
a AS (SELECT lang, (sum(CASE WHEN label = 1 THEN rk END) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS auc
 FROM (SELECT lang, label, CAST(rank() OVER (PARTITION BY lang ORDER BY prob) AS DOUBLE) + (count(*) OVER (PARTITION BY lang, prob) - 1) / 2.0 AS rk FROM scored) GROUP BY lang),
p AS (SELECT lang, sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / sum(pos) AS ap FROM (SELECT lang, pos, sum(pos) OVER (PARTITION BY lang ORDER BY prob DESC) AS tp, sum(neg) OVER (PARTITION BY lang ORDER BY prob DESC) AS fp
 FROM (SELECT lang, prob, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY lang, prob)) GROUP BY lang)"""


@query("per_generator_report", f"{_GENERATOR} SELECT lang, n, tp, tn, fp, fn, {_rates()}, round(auc, 9) AS auc, round(ap, 9) AS ap FROM c JOIN a USING (lang) JOIN p USING (lang) WHERE tp + fn > 0 AND tn + fp > 0")
def per_generator_report(spark, folder):
    return _rounded(m.generator_report(scored(spark, folder), "lang", "label", "prob"))


_FAMILIES = {"romance": ("fr", "es"), "germanic": ("en", "de")}


@query("generator_families", f"""{_GENERATOR}, r AS (SELECT lang, {_rates(15)}, auc, ap FROM c JOIN a USING (lang) JOIN p USING (lang)), f AS (SELECT 'all_generators' AS family, * FROM r UNION ALL SELECT 'romance', * FROM r WHERE lang IN ('fr', 'es') UNION ALL SELECT 'germanic', * FROM r WHERE lang IN ('en', 'de'))
SELECT family, count(*) AS generators, round(avg(ap), 9) AS ap, round(avg(accuracy), 9) AS accuracy, round(avg(auc), 9) AS auc, round(avg(real_recall), 9) AS real_recall, round(avg(recall), 9) AS recall, round(avg(balanced_accuracy), 9) AS balanced_accuracy, round(stddev_pop(ap), 9) AS ap_deviation FROM f GROUP BY family""")
def generator_families(spark, folder):
    return _rounded(m.family_averages(m.generator_report(scored(spark, folder), "lang", "label", "prob"), "lang", _FAMILIES))


@query("per_category_exploded", f"""WITH {SCORED_SQL}, e AS (SELECT label, prob, unnest(CASE WHEN doc_id % 11 = 0 THEN ['supplemental'] ELSE [lang, source] END) AS category FROM scored)
SELECT category, count(*) AS n, round(avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS labels FROM e GROUP BY category""")
def per_category_exploded(spark, folder):
    s = scored(spark, folder).withColumn("categories", F.when(F.pmod("doc_id", F.lit(11)) == 0, "").otherwise(F.concat_ws("|", "lang", "source")))
    found = m.category_accuracy(s, "categories", "label", "prob", 0.5, "supplemental")
    return _rounded(found).withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


@query("scenario_images", f"""WITH {SCORED_SQL}, i AS (SELECT scenario, CASE WHEN scenario IN (3, 5) THEN 1 ELSE 0 END AS y, prob FROM scored)
SELECT scenario, count(*) AS n, max(y) AS image_label, round(avg(CASE WHEN (prob >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS image_accuracy FROM i GROUP BY scenario""")
def scenario_images(spark, folder):
    s = scored(spark, folder).select(F.col("scenario").cast("string").alias("scenarios"), F.col("scenario").isin(3, 5).cast("int").alias("y"), "prob")
    return _rounded(m.scenario_image_accuracy(s, "scenarios", "y", "prob", 0.5))


@query("bucket_recall", f"""WITH {SCORED_SQL}, b AS (SELECT prob, CASE WHEN a < 0.01 THEN 0 WHEN a < 0.05 THEN 1 WHEN a < 0.15 THEN 2 WHEN a < 1.01 THEN 3 END AS bucket FROM (SELECT prob, CAST(n_chars % 500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS a FROM scored WHERE label = 1))
SELECT bucket, count(*) AS n, round(avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS fake_recall FROM b WHERE bucket IS NOT NULL GROUP BY bucket""")
def bucket_recall(spark, folder):
    s = scored(spark, folder).withColumn("area", F.pmod("n_chars", F.lit(500)).cast("double") / 1000.0)
    return _rounded(m.area_recall(s, "area", "label", "prob", 0.5))


@query("method_report", f"""WITH {SCORED_SQL}, x AS (SELECT CASE WHEN label = 0 THEN 'authentic' ELSE lang END AS method, label, prob FROM scored),
r AS (SELECT avg(CASE WHEN prob < 0.5 THEN 1.0 ELSE 0.0 END) AS real_recall FROM x WHERE label = 0)
SELECT method, count(*) AS n, round(avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(prob), 9) AS mean_score,
 CASE WHEN method <> 'authentic' THEN round((avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END) + (SELECT real_recall FROM r)) / 2, 9) END AS balanced_with_authentic FROM x GROUP BY method""")
def method_report(spark, folder):
    s = scored(spark, folder).withColumn("method", F.when(F.col("label") == 0, "authentic").otherwise(F.col("lang")))
    return _rounded(m.method_report(s, "method", "authentic", "label", "prob", 0.5))


_PAIRS = f"WITH {SCORED_SQL}, p AS (SELECT caption_id, max(CASE WHEN pair_scenario = 4 THEN prob END) AS genuine, max(CASE WHEN pair_scenario = 1 THEN prob END) AS ooc FROM scored GROUP BY caption_id HAVING count(*) = 2 AND count(DISTINCT pair_scenario) = 2)"


def _pairs(spark, folder):
    return m.caption_pairs(scored(spark, folder), scenario="pair_scenario")


@query("caption_pairs", f"{_PAIRS} SELECT caption_id, genuine, ooc, genuine AS genuine_rank, ooc AS ooc_rank FROM p")
def caption_pairs(spark, folder):
    return _pairs(spark, folder)


@query("paired_summary", f"""{_PAIRS}, v AS (SELECT CASE WHEN genuine < 0.5 THEN 1.0 ELSE 0.0 END AS g, CASE WHEN ooc >= 0.5 THEN 1.0 ELSE 0.0 END AS o, CASE WHEN ooc > genuine THEN 1.0 WHEN ooc = genuine THEN 0.5 ELSE 0.0 END AS r, ooc - genuine AS gap FROM p)
SELECT count(*) AS caption_pairs, round(avg(g), 9) AS genuine_recall, round(avg(o), 9) AS ooc_recall, round(avg((g + o) / 2), 9) AS balanced_accuracy, round(avg(g * o), 9) AS both_correct, round(avg(r), 9) AS within_caption_ranking, round(avg(gap), 9) AS mean_probability_gap FROM v""")
def paired_summary(spark, folder):
    return _rounded(m.paired_summary(_pairs(spark, folder), 0.5))


@query("source_recall", f"WITH {SCORED_SQL} SELECT CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS origin, count(*) AS n, round(avg(CASE WHEN prob < 0.5 THEN 1.0 ELSE 0.0 END), 9) AS genuine_recall FROM scored WHERE scenario = 4 GROUP BY 1")
def source_recall(spark, folder):
    s = scored(spark, folder).withColumn("subcategory", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("lang")).otherwise(""))
    return _rounded(m.source_recall(s, 0.5))


@query("bootstrap_diff")
def bootstrap_diff(spark, folder):
    s = scored(spark, folder)
    base = m.pair_values(_pairs(spark, folder), 0.5)
    other = m.pair_values(m.caption_pairs(s.withColumn("prob", F.col("rough")), scenario="pair_scenario"), 0.45)
    names = list(m.PAIR_METRICS)
    joined = base.select("caption_id", *(F.col(n).alias(f"_{n}") for n in names)).join(other, "caption_id").select("caption_id", *((F.col(n) - F.col(f"_{n}")).alias(n) for n in names))
    return _rounded(m.bootstrap_difference(joined, "caption_id", names))


_Z = "CAST(1.959963984540054 AS DOUBLE)"


@query("wilson_interval", f"""WITH {SCORED_SQL}, g AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE prob >= 0.5) AS DOUBLE) AS s FROM scored WHERE label = 1 GROUP BY lang), w AS (SELECT lang, n, s / n AS p, {_Z} * {_Z} AS z2 FROM g),
v AS (SELECT lang, (p + z2 / (2 * n)) / (1 + z2 / n) AS middle, {_Z} * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n) AS half FROM w)
SELECT lang, round(greatest(0, middle - half), 9) AS low, round(least(1, middle + half), 9) AS high FROM v""")
def wilson_interval(spark, folder):
    g = scored(spark, folder).where("label = 1").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prob") >= 0.5).alias("s"))
    low, high = m.wilson(F.col("s"), F.col("n"))
    return _rounded(g.select("lang", low.alias("low"), high.alias("high")))


@query("promotion_gates", f"""WITH {SCORED_SQL}, s AS (SELECT scenario, avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN (rough >= 0.45) = (label = 1) THEN 1.0 ELSE 0.0 END) AS b FROM scored GROUP BY scenario)
SELECT scenario, round(b - a, 9) AS difference, b - a >= -0.02 AS passes, bool_and(b - a >= -0.02) OVER () AS promote FROM s""")
def promotion_gates(spark, folder):
    s = scored(spark, folder)
    right = lambda score, limit: F.avg(((F.col(score) >= limit).cast("int") == F.col("label")).cast("double"))
    g = s.groupBy("scenario").agg((right("rough", 0.45) - right("prob", 0.5)).alias("difference")).withColumn("passes", F.col("difference") >= -0.02)
    return _rounded(g.crossJoin(F.broadcast(g.agg(F.every("passes").alias("promote")))))


# --- thresholds

_STEP = "d AS (SELECT prob AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY prob), t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM d)"


def _balanced_sql(value: str) -> str:
    return f"""WITH {SCORED_SQL}, {_STEP}, k AS (SELECT coalesce((s + lead(s) OVER (ORDER BY s)) / 2, s + s * CAST(2.220446049250313e-16 AS DOUBLE)) AS threshold FROM d UNION ALL SELECT CAST(0.5 AS DOUBLE) UNION ALL SELECT CAST(0 AS DOUBLE)),
c AS (SELECT threshold, coalesce((SELECT sum(pos) FROM d WHERE s < threshold), 0) AS fn, coalesce((SELECT sum(neg) FROM d WHERE s < threshold), 0) AS tn, P, N FROM k, t),
v AS (SELECT threshold, {value} AS value FROM c)
SELECT round(threshold, 9) AS threshold, round(value, 9) AS value FROM v ORDER BY v.value DESC, abs(v.threshold - 0.5), v.threshold DESC LIMIT 1"""


@query("thr_balanced", _balanced_sql("(CAST(P - fn AS DOUBLE) / P + CAST(tn AS DOUBLE) / N) / 2"))
def thr_balanced(spark, folder):
    return _rounded(t.balanced(scored(spark, folder), "label", "prob"))


@query("thr_f1", _balanced_sql("(CAST(2 * (P - fn) AS DOUBLE) / (2 * (P - fn) + N - tn + fn) + CAST(2 * tn AS DOUBLE) / (2 * tn + N - tn + fn)) / 2"))
def thr_f1(spark, folder):
    return _rounded(t.balanced(scored(spark, folder), "label", "prob", "f1_macro"))


@query("thr_youden_weighted", f"""WITH {SCORED_SQL}, w AS (SELECT label, prob, CAST(0.25 AS DOUBLE) / count(*) OVER (PARTITION BY evaluation_group, label) AS w FROM scored), q AS (SELECT sum(w) FILTER (WHERE label = 1) AS P, sum(w) FILTER (WHERE label = 0) AS N FROM w),
r AS (SELECT threshold, (SELECT coalesce(sum(w), 0) FROM w WHERE label = 1 AND prob >= threshold) / P AS tpr, (SELECT coalesce(sum(w), 0) FROM w WHERE label = 0 AND prob >= threshold) / N AS fpr FROM (SELECT DISTINCT prob AS threshold FROM w), q)
SELECT threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM r ORDER BY round(r.tpr - r.fpr, 12) DESC, round(least(r.tpr, 1 - r.fpr), 12) DESC, abs(threshold - 0.5), threshold LIMIT 1""")
def thr_youden_weighted(spark, folder):
    weighted = t.with_validation_weight(scored(spark, folder), "w", label="label")
    return _rounded(t.youden(weighted, "label", "prob", "w"))


@query("thr_constrained", f"""WITH {SCORED_SQL}, m AS (SELECT * FROM (VALUES (1, 0.9), (2, 0.95), (3, 0.8)) AS m(scenario, least)), r AS (SELECT scenario, prob, row_number() OVER (PARTITION BY scenario ORDER BY prob) - 1 AS k, count(*) OVER (PARTITION BY scenario) AS n FROM scored)
SELECT min(prob) AS threshold FROM r JOIN m USING (scenario) WHERE k = n - CAST(ceil(n * CAST(least AS DOUBLE) - 1e-10) AS BIGINT)""")
def thr_constrained(spark, folder):
    return t.recall_constrained(scored(spark, folder), "scenario", "prob", {1: 0.9, 2: 0.95, 3: 0.8})


def _cells_sql(eligible: str, order: str) -> str:
    cells = [f"{'' if s == 4 else '1 - '}(SELECT CAST(count(*) FILTER (WHERE prob < threshold) AS DOUBLE) / count(*) FROM scored WHERE evaluation_group = '{g}' AND scenario = {s}) AS r{k}" for k, (g, s, _) in enumerate(t.CELLS)]
    utility = " + ".join(f"r{k} * {w}" for k, (_, _, w) in enumerate(t.CELLS))
    names = ", ".join(f"r{k}" for k in range(7))
    return f"""WITH {SCORED_SQL}, k AS (SELECT DISTINCT prob AS threshold FROM scored UNION ALL SELECT max(prob) + max(prob) * CAST(2.220446049250313e-16 AS DOUBLE) FROM scored),
c AS (SELECT threshold, {", ".join(cells)} FROM k), u AS (SELECT *, CAST({utility} AS DOUBLE) AS utility, least({names}) AS minimum FROM c), e AS (SELECT *, {eligible} AS fits FROM u), f AS (SELECT *, bool_or(fits) OVER () AS any_fits FROM e)
SELECT round(threshold, 9) AS threshold, round(minimum, 9) AS minimum, round(utility, 9) AS utility, any_fits AS eligible FROM f WHERE fits OR NOT any_fits ORDER BY {order}, abs(f.threshold - 0.5), f.threshold LIMIT 1"""


@query("thr_recall_floor", _cells_sql("utility >= 0.7 - 1e-12", "CASE WHEN any_fits THEN round(f.minimum, 12) ELSE round(f.utility, 12) END DESC, CASE WHEN any_fits THEN round(f.utility, 12) ELSE round(f.minimum, 12) END DESC"))
def thr_recall_floor(spark, folder):
    return _rounded(t.recall_floor(scored(spark, folder), "evaluation_group", "scenario", "prob", 0.7))


_REFERENCE = (0.8, 0.8, 0.8, 0.6, 0.8)


@query("thr_protected", _cells_sql("utility >= 0.7 - 0.005 - 1e-12 AND " + " AND ".join(f"r{k} >= {r} - 0.02 - 1e-12" for k, r in enumerate(_REFERENCE)), "round(f.minimum, 12) DESC, round(f.utility, 12) DESC"))
def thr_protected(spark, folder):
    return _rounded(t.protected(scored(spark, folder), "evaluation_group", "scenario", "prob", _REFERENCE, 0.7))


@query("thr_grid", f"""WITH {SCORED_SQL}, k AS (SELECT CAST(range AS DOUBLE) / CAST(100 AS DOUBLE) AS threshold FROM range(5, 100, 5)), v AS (SELECT threshold, ((SELECT avg(CASE WHEN prob >= threshold THEN 1.0 ELSE 0.0 END) FROM scored WHERE label = 1) + (SELECT avg(CASE WHEN prob < threshold THEN 1.0 ELSE 0.0 END) FROM scored WHERE label = 0)) / 2 AS value FROM k)
SELECT threshold, round(value, 9) AS value FROM v ORDER BY v.value DESC, threshold LIMIT 1""")
def thr_grid(spark, folder):
    return _rounded(t.grid(scored(spark, folder), "label", "prob"))


def _worst_sql(candidates: str, condition: str | None, values: tuple = ()) -> str:
    cells = [(c, y) for c in (values or (None,)) for y in (1, 0)]
    own = [f"(SELECT avg(CASE WHEN prob {'>=' if y else '<'} threshold THEN 1.0 ELSE 0.0 END) FROM scored WHERE label = {y}" + (f" AND {condition} = '{c}'" if condition else "") + f") AS r{k}" for k, (c, y) in enumerate(cells)]
    names = [f"r{k}" for k in range(len(cells))]
    return f"""WITH {SCORED_SQL}, k AS (SELECT DISTINCT threshold FROM ({candidates} UNION ALL SELECT CAST(0.5 AS DOUBLE))), c AS (SELECT threshold, {", ".join(own)} FROM k), v AS (SELECT threshold, least({", ".join(names)}) AS worst, ({" + ".join(names)}) / {len(names)} AS mean FROM c)
SELECT round(threshold, 9) AS threshold, round(worst, 9) AS worst, round(mean, 9) AS mean FROM v ORDER BY round(v.worst, 12) DESC, round(v.mean, 12) DESC, abs(v.threshold - 0.5), v.threshold LIMIT 1"""


_MIDS = "SELECT threshold FROM (SELECT (s + lead(s) OVER (ORDER BY s)) / 2 AS threshold FROM (SELECT DISTINCT prob AS s FROM scored)) WHERE threshold IS NOT NULL"


@query("thr_worst_recall", _worst_sql(_MIDS, None))
def thr_worst_recall(spark, folder):
    return _rounded(t.worst_recall(scored(spark, folder), "label", "prob"))


@query("thr_quantile", _worst_sql("SELECT unnest(quantile_cont(prob, list_transform(range(1001), lambda i: i / 1000.0))) AS threshold FROM scored GROUP BY evaluation_group", "evaluation_group", ("paired_news", "v1_five_scenarios")))
def thr_quantile(spark, folder):
    return _rounded(t.robust(scored(spark, folder), "label", "prob", "evaluation_group"))


@query("thr_operating", _worst_sql(_MIDS, "evaluation_group", ("paired_news", "v1_five_scenarios")))
def thr_operating(spark, folder):
    return _rounded(t.operating(scored(spark, folder), "label", "prob", "evaluation_group"))


def _wilson_sql(s: str, n: str, low: bool) -> str:
    z2 = "3.841458820694124"
    middle, half = f"({s} / {n} + {z2} / (2 * {n})) / (1 + {z2} / {n})", f"sqrt({z2}) * sqrt({s} / {n} * (1 - {s} / {n}) / {n} + {z2} / (4 * {n} * {n})) / (1 + {z2} / {n})"
    return f"CASE WHEN {n} > 0 THEN round(" + (f"greatest(0, {middle} - {half})" if low else f"least(1, {middle} + {half})") + ", 6) END"


@query("enriched_metrics", f"""WITH {SCORED_SQL}, x AS (SELECT 'all' AS part, * FROM scored UNION ALL SELECT lang, * FROM scored), c AS (SELECT part, count(*) AS n, CAST(count(*) FILTER (WHERE label = 1 AND prob >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE label = 0 AND prob < 0.5) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS f, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS r FROM x GROUP BY part)
SELECT part, n, round((tp + tn) / n, 6) AS accuracy, round(tp / f, 6) AS recall, {_wilson_sql('tp', 'f', True)} AS recall_low, {_wilson_sql('tp', 'f', False)} AS recall_high, round(tn / r, 6) AS real_recall, {_wilson_sql('tn', 'r', True)} AS real_low, {_wilson_sql('tn', 'r', False)} AS real_high FROM c""")
def enriched_metrics(spark, folder):
    s = scored(spark, folder)
    found = m.enriched_metrics(s, "label", "prob", 0.5, s.withColumn("part", F.col("lang")))
    return found.select("part", "n", *(F.round(c, 6).alias(c) for c in found.columns[2:]))


@query("positive_weight", f"WITH {SCORED_SQL} SELECT round(count(*) FILTER (WHERE label = 0) / CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE), 9) AS weight, NULL AS one_class FROM scored")
def positive_weight(spark, folder):
    from quillmark.operators.selection import positive_weight as weight

    s = scored(spark, folder)
    return spark.createDataFrame([(round(weight(s, "label"), 9), weight(s.where("label = 1"), "label"))], "weight double, one_class double")


@query("probe_grid")
def probe_grid(spark, folder):
    """Kinds of features and C, on whole vectors; the best by balanced accuracy, then AUC."""
    from quillmark.functions import arrays
    from quillmark.operators.linear import grid_search

    v = arrays.doubles(F.col("embedding"))
    e = table(spark, folder, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))
    kinds = {"vector": v, "absolute": F.transform(v, F.abs)}
    return grid_search(e.where("vec_id % 4 <> 0"), e.where("vec_id % 4 = 0"), kinds, "y", (0.01, 1.0))[0].select("kind", "c", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("auc", 6).alias("auc"), "chosen")
