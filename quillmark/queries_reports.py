"""Queries of releases, bundles, image files and whole audits, and of models whose results SQL can work out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillmark.functions import arrays
from quillmark.operators import audits, linear, quality
from quillmark.operators import metrics as m
from quillmark.plans.fixtures import SCORED_SQL, scored
from quillmark.plans.staging import new_path
from quillmark.queries_files import _GREY_SQL, _HASH_SQL
from quillmark.queries_metrics import _AUC, _rounded
from quillmark.sources import bundles, images, sinks, stores
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


# --- releases and reports

_BOTH_PAIRS = """w AS (SELECT caption_id, max(CASE WHEN pair_scenario = 4 THEN prob END) AS g1, max(CASE WHEN pair_scenario = 1 THEN prob END) AS o1, max(CASE WHEN pair_scenario = 4 THEN rough END) AS g2, max(CASE WHEN pair_scenario = 1 THEN rough END) AS o2 FROM scored GROUP BY caption_id HAVING count(*) = 2 AND count(DISTINCT pair_scenario) = 2),
v AS (SELECT ((g2 < 0.45)::INTEGER + (o2 >= 0.45)::INTEGER - (g1 < 0.5)::INTEGER - (o1 >= 0.5)::INTEGER) / 2.0::DOUBLE AS balanced_accuracy, (CASE WHEN o2 > g2 THEN 1.0 WHEN o2 = g2 THEN 0.5 ELSE 0.0 END - CASE WHEN o1 > g1 THEN 1.0 WHEN o1 = g1 THEN 0.5 ELSE 0.0 END)::DOUBLE AS within_caption_ranking, (o2 - g2) - (o1 - g1) AS mean_probability_gap FROM w),
l AS (UNPIVOT v ON balanced_accuracy, within_caption_ranking, mean_probability_gap INTO NAME metric VALUE d),
i AS (SELECT metric, count(*) AS n, avg(d) AS mean, 1.959963984540054::DOUBLE * stddev_samp(d) / sqrt(count(*)) AS half FROM l GROUP BY metric)"""


def _differences(spark, folder):
    """Differences of the pairs' metrics between two heads, a row for each caption."""
    s, names = scored(spark, folder), list(m.PAIR_METRICS)
    base = m.pair_values(m.caption_pairs(s, scenario="pair_scenario"), 0.5).select("caption_id", *(F.col(n).alias(f"_{n}") for n in names))
    other = m.pair_values(m.caption_pairs(s, scenario="pair_scenario", score="rough"), 0.45)
    return base.join(other, "caption_id").select("caption_id", *((F.col(n) - F.col(f"_{n}")).alias(n) for n in names))


_JUDGED = ("balanced_accuracy", "within_caption_ranking", "mean_probability_gap")


@query("paired_interval", f"WITH {SCORED_SQL}, {_BOTH_PAIRS} SELECT metric, n, round(mean, 9) AS mean, round(mean - half, 9) AS low, round(mean + half, 9) AS high FROM i")
def paired_interval(spark, folder):
    return _rounded(m.paired_interval(_differences(spark, folder), _JUDGED))


@query("release_gates", f"""WITH {SCORED_SQL}, {_BOTH_PAIRS}, s AS (SELECT scenario, label, CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS b, CASE WHEN (rough >= 0.45) = (label = 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS a FROM scored),
d AS (SELECT 'scenario' AS gate, CAST(scenario AS VARCHAR) AS key, avg(a) - avg(b) AS value, 0.02::DOUBLE AS most FROM s GROUP BY scenario UNION ALL SELECT 'class', CAST(label AS VARCHAR), avg(a) - avg(b), 0.01::DOUBLE FROM s GROUP BY label),
r AS (SELECT gate, key, value, value >= -most - 1e-12 AS passes FROM d UNION ALL SELECT 'interval', metric, mean - half, mean - half > 0 FROM i)
SELECT gate, key, round(value, 9) AS value, passes, bool_and(passes) OVER () AS promote FROM r""")
def release_gates(spark, folder):
    """A head against the one before: recall by class and by scenario, and the low ends of three paired differences."""
    s = scored(spark, folder)

    def recalls(score: str, limit: float):
        right = F.avg(((F.col(score) >= limit).cast("int") == F.col("label")).cast("double")).alias("value")
        of = lambda kind, c: s.groupBy(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key")).agg(right)
        return of("scenario", "scenario").unionByName(of("class", "label"))

    ends = m.paired_interval(_differences(spark, folder), _JUDGED)
    return _rounded(audits.release_gates(recalls("prob", 0.5), recalls("rough", 0.45), {"scenario": 0.02, "class": 0.01}, ends))


_DOMAINS = ("v1_five_scenarios", "paired_news")


def _domain_sql(name: str) -> str:
    return f"""{name}_r AS (SELECT * FROM scored WHERE evaluation_group = '{name}'), {name}_m AS (SELECT count(*) AS n, (CAST(count(*) FILTER (WHERE label = 1 AND prob >= 0.5) AS DOUBLE) / count(*) FILTER (WHERE label = 1) + CAST(count(*) FILTER (WHERE label = 0 AND prob < 0.5) AS DOUBLE) / count(*) FILTER (WHERE label = 0)) / 2 AS ba, (SELECT auc FROM ({_AUC.format(src=f'{name}_r')})) AS auc FROM {name}_r)"""


@query("validation_bundle", f"""WITH {SCORED_SQL}, {_domain_sql(_DOMAINS[0])}, {_domain_sql(_DOMAINS[1])},
p AS (SELECT max(CASE WHEN pair_scenario = 4 THEN prob END) AS genuine, max(CASE WHEN pair_scenario = 1 THEN prob END) AS ooc FROM paired_news_r GROUP BY caption_id HAVING count(*) = 2 AND count(DISTINCT pair_scenario) = 2),
v AS (SELECT CASE WHEN genuine < 0.5 THEN 1.0 ELSE 0.0 END AS g, CASE WHEN ooc >= 0.5 THEN 1.0 ELSE 0.0 END AS o, CASE WHEN ooc > genuine THEN 1.0 WHEN ooc = genuine THEN 0.5 ELSE 0.0 END AS r, ooc - genuine AS gap FROM p),
s AS (SELECT count(*) AS caption_pairs, round(avg(g), 9) AS genuine_recall, round(avg(o), 9) AS ooc_recall, round(avg((g + o) / 2), 9) AS pair_balanced_accuracy, round(avg(g * o), 9) AS both_correct, round(avg(r), 9) AS within_caption_ranking, round(avg(gap), 9) AS mean_probability_gap FROM v)
SELECT a.n AS v1_five_scenarios_n, round(a.ba, 9) AS v1_five_scenarios_balanced_accuracy, round(a.auc, 9) AS v1_five_scenarios_auc, b.n AS paired_news_n, round(b.ba, 9) AS paired_news_balanced_accuracy, round(b.auc, 9) AS paired_news_auc, s.*, round((a.ba + b.ba) / 2, 9) AS utility FROM v1_five_scenarios_m a, paired_news_m b, s""")
def validation_bundle(spark, folder):
    """Both domains, the pairs and the utility of a head in one row."""
    return _rounded(m.validation_bundle(scored(spark, folder), _DOMAINS, "paired_news", 0.5, scenario="pair_scenario"))


@query("markdown_report", f"""WITH {SCORED_SQL}, a AS (SELECT 0 AS part, lang AS k, '| ' || coalesce(lang, '') || ' | ' || count(*) || ' | ' || printf('%.1f%%', 100 * avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END::DOUBLE)) || ' | ' || printf('%.4f', avg(prob)) || ' |' AS line FROM scored GROUP BY lang),
b AS (SELECT 1 AS part, CAST(scenario AS VARCHAR) AS k, '| ' || scenario || ' | ' || count(*) || ' | ' || printf('%.1f%%', 100 * avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END::DOUBLE)) || ' | ' || printf('%.4f', avg(prob)) || ' |' AS line FROM scored GROUP BY scenario),
h AS (SELECT * FROM (VALUES (1, '## By language'), (2, ''), (3, '| lang | n | accuracy | mean_score |'), (4, '|---|---|---|---|')) x(i, line)), g AS (SELECT * FROM (VALUES (1, '## By scenario'), (2, ''), (3, '| scenario | n | accuracy | mean_score |'), (4, '|---|---|---|---|')) x(i, line)),
o AS (SELECT 0 AS s, i, line FROM h UNION ALL SELECT 1, row_number() OVER (ORDER BY k NULLS FIRST), line FROM a UNION ALL SELECT 2, 1, '' UNION ALL SELECT 3, i, line FROM g UNION ALL SELECT 4, row_number() OVER (ORDER BY k), line FROM b)
SELECT row_number() OVER (ORDER BY s, i) AS number, line FROM o""")
def markdown_report(spark, folder):
    """Accuracy by language and by scenario as a Markdown file, read back line by line."""
    s, path = scored(spark, folder), new_path(spark, "report")
    right = ((F.col("prob") >= 0.5).cast("int") == F.col("label")).cast("double")
    by = lambda c: s.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg("prob").alias("mean_score"))
    sinks.write_report(spark, [sinks.markdown_lines("By language", by("lang"), ("accuracy",)), sinks.markdown_lines("By scenario", by("scenario"), ("accuracy",))], path)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("number", "line"))
    return lines.select((F.col("number") + 1).cast("long").alias("number"), "line")


# --- bundles


@query("bundle_predictions", """WITH z AS (SELECT vec_id, list_transform(range(1, 4), lambda c: list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * sin(CAST(i * c AS DOUBLE)))) + c / 10.0::DOUBLE) AS z FROM embeddings), e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), p AS (SELECT vec_id, 1 - e[1] / list_sum(e) AS p, e[2] / list_sum(e) AS q FROM e)
SELECT vec_id, round(p, 5) + 0.0 AS prob, round(q, 5) + 0.0 AS second, CASE WHEN p >= 0.6 THEN 1 ELSE 0 END AS pred FROM p""")
def bundle_predictions(spark, folder):
    """All vectors scored by a classifier of three classes that was written as a bundle and read back against its hash."""
    path = new_path(spark, "bundle")
    coefficients = np.array([[np.sin(i * c) for i in range(1, 65)] for c in (1, 2, 3)])
    bundles.write_bundle(spark, path, coefficients, np.array([0.1, 0.2, 0.3]), ("genuine", "ooc", "edited"), 0.6, {"encoder": "whole vectors"})
    found = bundles.predicted(table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding", bundles.read_bundle(spark, path))
    return found.select("vec_id", (F.round("prob", 5) + 0.0).alias("prob"), (F.round(F.col("probabilities")[1], 5) + 0.0).alias("second"), "pred")


# --- image files


def _image_files(spark, folder):
    """(rows, place): documents that share an image with those of the same ten ids. Each ninth file is no image, each ninth after them is missing."""
    d = table(spark, folder, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("group"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("doc_id") / 10).alias("k"))
    digest = F.sha2(F.min_by("text", "doc_id").cast("binary"), 256)
    grey = F.concat(F.lit("P5\n9 8\n255\n"), "h", F.substring("h", 1, 8))
    content = F.when(F.col("k") % 9 == 0, F.lit("no image")).when(F.col("k") % 9 == 1, F.lit(None)).otherwise(grey).cast("binary")
    name = F.concat(F.lit("img-"), F.col("k").cast("string"), F.lit(".pgm"))
    place = new_path(spark, "images")
    stores.write_files(d.groupBy("k").agg(digest.alias("h")).select(name.alias("name"), content.alias("content")), place)
    return d.select("doc_id", "group", name.alias("image_path")), place


_FILE_STATE = "CASE WHEN doc_id // 10 % 9 = 0 THEN 'corrupt' WHEN doc_id // 10 % 9 = 1 THEN 'missing' END"


@query("image_table_scan", f"WITH f AS (SELECT doc_id // 10 AS k, sha256(arg_min(coalesce(text, ''), doc_id)) AS h FROM documents GROUP BY 1), p AS (SELECT k, list_transform(range(1, 73), lambda i: ascii((h || h)[i])) AS v FROM f), g AS (SELECT k, {_HASH_SQL.format(sign='>')} AS dhash FROM p) SELECT doc_id, {_FILE_STATE} IS NULL AS ok, {_FILE_STATE} AS error, CASE WHEN {_FILE_STATE} IS NULL THEN 9 END AS width, CASE WHEN {_FILE_STATE} IS NULL THEN dhash END AS dhash FROM documents JOIN g ON doc_id // 10 = k")
def image_table_scan(spark, folder):
    """Every document's image by its path; a file that ten documents name is decoded once."""
    rows, place = _image_files(spark, folder)
    return images.image_table(rows, place).select("doc_id", "info.ok", "info.error", F.col("info.width").cast("long").alias("width"), "info.dhash")


@query("usable_image_files", f"SELECT coalesce(lang, 'none') AS \"group\", {_FILE_STATE} || '_image' AS reason, count(*) AS n FROM documents WHERE {_FILE_STATE} IS NOT NULL GROUP BY 1, 2")
def usable_image_files(spark, folder):
    """Why rows are left out, by what their files hold."""
    rows, place = _image_files(spark, folder)
    return images.usable(images.image_table(rows, place))[1].withColumnRenamed("count", "n")


@query("dq_image_files", f"SELECT 'image_ok' AS \"check\", CAST(doc_id AS VARCHAR) AS key FROM documents WHERE {_FILE_STATE} IS NOT NULL UNION ALL SELECT 'file_missing', CAST(doc_id AS VARCHAR) FROM documents WHERE {_FILE_STATE} = 'missing'")
def dq_image_files(spark, folder):
    """Rows whose image isn't usable, and rows whose file isn't in the folder's listing."""
    rows, place = _image_files(spark, folder)
    marked = images.image_table(rows, place).withColumn("image_ok", F.col("info.ok").cast("int"))
    listing = spark.read.format("binaryFile").load(place).select(F.regexp_extract("path", r"[^/]+$", 0).alias("path"))
    return quality.files_missing(marked, "doc_id", listing).select("check", "key")


# --- whole audits, with near copies

_FP_SQL = "fp AS (SELECT vec_id, label, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INTEGER) ELSE CAST(0 AS HUGEINT) END))::HUGEINT AS fp FROM embeddings)"


@query("dq_new_pairs_near", f"""WITH {_FP_SQL}, r AS (SELECT vec_id, vec_id - vec_id % 2 AS caption_id, CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 1 END AS scenario, (vec_id % 2 = 0) <> (vec_id % 23 = 0) AS same_id, CASE WHEN vec_id % 31 = 0 THEN 'changed' ELSE 'caption ' || (vec_id - vec_id % 2) END AS text, fp FROM fp WHERE vec_id % 37 <> 5),
b AS (SELECT caption_id FROM r GROUP BY caption_id HAVING count(*) <> 2 OR count(*) FILTER (WHERE scenario = 4) <> 1 OR count(*) FILTER (WHERE scenario = 1) <> 1 OR min(text) <> max(text))
SELECT 'broken_pair' AS "check", CAST(caption_id AS VARCHAR) AS key FROM b UNION ALL SELECT 'pair_ids', CAST(vec_id AS VARCHAR) FROM r WHERE same_id <> (scenario = 4)
UNION ALL SELECT 'shared_text', CAST(vec_id AS VARCHAR) FROM r WHERE text IN (SELECT 'caption ' || vec_id FROM fp WHERE vec_id % 40 = 0)
UNION ALL SELECT DISTINCT 'near_protected', CAST(r.vec_id AS VARCHAR) FROM r JOIN fp p ON p.vec_id % 50 = 0 AND bit_count(xor(r.fp, xor(p.fp, CAST(7 AS HUGEINT)))) <= 4""")
def dq_new_pairs_near(spark, folder):
    """A new set with broken pairs, wrong ids, shared captions, and images within four bits of protected ones."""
    k = F.col("vec_id")
    e = table(spark, folder, "embeddings").select("vec_id", (k - k % 2).alias("caption_id"), F.when(k % 2 == 0, 4).otherwise(1).alias("scenario"), arrays.sign_bits(F.col("embedding")).alias("dhash"))
    caption = F.concat(F.lit("caption "), F.col("caption_id").cast("string"))
    image = F.when((k % 2 == 0) != (k % 23 == 0), F.col("caption_id")).otherwise(F.col("caption_id") + 1_000_000)
    rows = e.where("vec_id % 37 <> 5").withColumns({"image_id": image, "text": F.when(k % 31 == 0, "changed").otherwise(caption), "sample_id": k})
    shared = e.where("vec_id % 40 = 0").select(caption.alias("text"), F.lit(None).cast("long").alias("dhash"))
    near = e.where("vec_id % 50 = 0").select(F.lit(None).cast("string").alias("text"), F.col("dhash").bitwiseXOR(F.lit(7)).alias("dhash"))
    return audits.new_pairs(rows, shared.unionByName(near), ["text"], radius=4).select("check", "key").distinct()


@query("dq_manifest_near", f"""WITH {_FP_SQL}, r AS (SELECT vec_id AS sample_id, CASE WHEN vec_id % 2 = 0 THEN 'test' ELSE 'val' END AS split, label, 'm/' || vec_id AS member, 'd' || (vec_id - CASE WHEN vec_id % 70 = 1 THEN 1 ELSE 0 END) AS digest, 'u' || vec_id AS url, fp FROM fp
 UNION ALL SELECT vec_id + 1000000, CASE WHEN vec_id % 2 = 0 THEN 'val' ELSE 'test' END, label, 'm/' || vec_id, 'e' || vec_id, 'v' || vec_id, xor(fp, CAST(7 AS HUGEINT)) FROM fp WHERE vec_id % 50 = 0), o AS (SELECT DISTINCT fp, split FROM r)
SELECT 'cell_size' AS "check", (SELECT count(*) FROM (SELECT split, label FROM r GROUP BY ALL HAVING count(*) <> 20)) AS n UNION ALL SELECT 'duplicate_sample_id', (SELECT count(*) FROM (SELECT sample_id FROM r GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'duplicate_member', (SELECT count(*) FROM (SELECT member FROM r GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_digest', (SELECT count(*) FROM (SELECT digest FROM r GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'duplicate_url', (SELECT count(*) FROM (SELECT url FROM r GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'near_across_splits', (SELECT count(*) FROM o a JOIN o b ON a.fp <= b.fp AND a.split <> b.split AND bit_count(xor(a.fp, b.fp)) <= 4)""")
def dq_manifest_near(spark, folder):
    """Findings of each check of a manifest with four unique columns, and copies within four bits across its splits."""
    k = F.col("vec_id")
    text = lambda prefix, x=k: F.concat(F.lit(prefix), x.cast("string"))
    e = table(spark, folder, "embeddings").select("vec_id", "label", arrays.sign_bits(F.col("embedding")).alias("dhash"))
    own = e.select(k.alias("sample_id"), F.when(k % 2 == 0, "test").otherwise("val").alias("split"), "label", text("m/").alias("member"), text("d", k - (k % 70 == 1).cast("int")).alias("digest"), text("u").alias("url"), "dhash")
    copies = e.where("vec_id % 50 = 0").select((k + 1_000_000).alias("sample_id"), F.when(k % 2 == 0, "val").otherwise("test").alias("split"), "label", text("m/").alias("member"), text("e").alias("digest"), text("v").alias("url"), F.col("dhash").bitwiseXOR(F.lit(7)).alias("dhash"))
    unique = ["sample_id", "member", "digest", "url"]
    report = audits.manifest(own.unionByName(copies), {"test": 20, "val": 20}, ["label"], unique)
    checks = spark.createDataFrame([("cell_size",), *((f"duplicate_{c}",) for c in unique), ("near_across_splits",)], "check string")
    return checks.join(report.groupBy("check").agg(F.count(F.lit(1)).alias("n")), "check", "left").select("check", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# --- models that SQL can work out


@query("logistic_weighted", """WITH RECURSIVE l AS (SELECT list({'x': CAST(embedding[1] AS DOUBLE), 'y': CASE WHEN label >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 'w': 0.5::DOUBLE * (1 + vec_id % 3)}) AS r FROM embeddings WHERE label IS NOT NULL),
t AS (SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
 SELECT k + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
  SELECT k, a, b, list_sum(list_transform(q, lambda s: s.w * (s.p - s.y) * s.x)) + a AS g1, list_sum(list_transform(q, lambda s: s.w * (s.p - s.y))) AS g2, list_sum(list_transform(q, lambda s: s.w * s.p * (1 - s.p) * s.x * s.x)) + 1 AS h11, list_sum(list_transform(q, lambda s: s.w * s.p * (1 - s.p) * s.x)) AS h12, list_sum(list_transform(q, lambda s: s.w * s.p * (1 - s.p))) AS h22
  FROM (SELECT t.k, t.a, t.b, list_transform(l.r, lambda s: {'x': s.x, 'y': s.y, 'w': s.w, 'p': 1 / (1 + exp(-(t.a * s.x + t.b)))}) AS q FROM t, l WHERE t.k < 20)))
SELECT round(a, 4) + 0.0 AS coefficient, round(b, 4) + 0.0 AS intercept FROM t WHERE k = 20""")
def logistic_weighted(spark, folder):
    """A weighted regression of the label on a vector's first value, C = 0.5; SQL finds the same point by Newton's steps."""
    k = F.col("vec_id")
    e = table(spark, folder, "embeddings").where("label IS NOT NULL").select(F.array(arrays.doubles(F.col("embedding"))[0]).alias("x"), (F.col("label") >= 5).cast("int").alias("y"), (1 + k % 3).cast("double").alias("w"))
    model = linear.fit_logistic(e, "x", "y", c=0.5, weight="w")
    return spark.createDataFrame([(round(float(model.coefficients[0]), 4) + 0.0, round(float(model.intercept), 4) + 0.0)], "coefficient double, intercept double")


@query("midpoint_ridge_pair", """WITH d AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS DOUBLE) AS m FROM embeddings), s AS (SELECT count(*) AS n, avg(x) AS ax, avg(y) AS ay, avg(m) AS am, var_pop(x) * count(*) + 10 AS xx, var_pop(y) * count(*) + 10 AS yy, covar_pop(x, y) * count(*) AS xy, covar_pop(x, m) * count(*) AS xm, covar_pop(y, m) * count(*) AS ym FROM d),
c AS (SELECT *, (yy * xm - xy * ym) / (xx * yy - xy * xy) AS a, (xx * ym - xy * xm) / (xx * yy - xy * xy) AS b FROM s) SELECT round(a, 6) + 0.0 AS first, round(b, 6) + 0.0 AS second, round(am - a * ax - b * ay, 6) + 0.0 AS intercept FROM c""")
def midpoint_ridge_pair(spark, folder):
    """Ridge regression on two values of a vector; SQL solves its two equations."""
    e = table(spark, folder, "embeddings").select(F.slice(arrays.doubles(F.col("embedding")), 1, 2).alias("x"), F.col("label").cast("double").alias("m"))
    (a, b), intercept = linear.midpoint_correction(e, "x", "m", 10.0)
    return spark.createDataFrame([tuple(round(float(v), 6) + 0.0 for v in (a, b, intercept))], "first double, second double, intercept double")


@query("projection_logits", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * sin(CAST(i AS DOUBLE)))), 4) + 0.0 AS first, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * cos(CAST(2 * (i - 1) AS DOUBLE)))), 4) + 0.0 AS second FROM embeddings")
def projection_logits(spark, folder):
    """A classifier's two scores of every vector, worked out from its projection on 16 rows; SQL takes them from whole vectors."""
    e = table(spark, folder, "embeddings").select("vec_id", arrays.doubles(F.col("embedding")).alias("x"))
    w = np.array([[np.sin(k + 1), np.cos(2 * k)] for k in range(64)]).T
    basis = linear.preserving_projection(e, "x", w, 16)
    score = lambda row: F.round(arrays.dot(F.col("x"), F.array(*map(F.lit, map(float, row)))), 4) + 0.0
    first, second = w @ basis.T
    return linear.projected_batches(e, "x", basis).select("vec_id", score(first).alias("first"), score(second).alias("second"))
