"""Queries of sources, streams and plug-ins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import arrays, text
from quillmark.operators import filters
from quillmark.plans.fixtures import SCORED_SQL, scored
from quillmark.queries_metrics import _rounded
from quillmark.queries_records import _EDGES, _PLACED, _RECORDS, _chosen_sql
from quillmark.sources.tables import table
from quillmark.streaming.requests import verdict_rates, verdicts

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _requests(spark, folder):
    """All events; three that follow each other share a request_id, so requests come up to three times, with other texts and scores."""
    e = table(spark, folder, "events")
    return e.select(F.floor(F.col("event_id") / 3).cast("string").alias("request_id"), "ts", F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.col("event_type")).alias("text"), (F.col("value") / 100.0).alias("score"))


_FIRST_REQUEST = "r AS (SELECT CAST(event_id // 3 AS VARCHAR) AS request_id, ts, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE event_type END AS text, value / 100.0 AS score FROM events), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, text, score) AS k FROM r) WHERE k = 1)"
_VERDICT = "CASE WHEN trim(text) = '' THEN 'rejected' WHEN score >= 0.5 THEN 'fake' ELSE 'genuine' END"


@query("request_verdicts", f"WITH {_FIRST_REQUEST} SELECT request_id, {_VERDICT} AS verdict, CASE WHEN trim(text) = '' THEN 'empty_text' END AS reason FROM f")
def request_verdicts(spark, folder):
    return verdicts(_requests(spark, folder), 0.5).select("request_id", "verdict", "reason")


@query("verdict_rates", f"WITH {_FIRST_REQUEST} SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, {_VERDICT} AS verdict, count(*) AS n FROM f GROUP BY 1, 2")
def rates(spark, folder):
    return verdict_rates(verdicts(_requests(spark, folder), 0.5))


def _all_requests(spark, folder):
    """Every event as a request, and each fifth sent twice."""
    e = table(spark, folder, "events")
    once = e.select(F.col("event_id").cast("string").alias("request_id"), "ts", F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.col("event_type")).alias("text"), (F.col("value") / 100.0).alias("score"))
    return once.unionByName(once.where(F.col("request_id").cast("long") % 5 == 0))


@query("request_verdicts_all", "SELECT CAST(event_id AS VARCHAR) AS request_id, CASE WHEN event_id % 7 = 0 THEN 'rejected' WHEN value / 100.0 >= 0.5 THEN 'fake' ELSE 'genuine' END AS verdict, CASE WHEN event_id % 7 = 0 THEN 'empty_text' END AS reason FROM events")
def request_verdicts_all(spark, folder):
    return verdicts(_all_requests(spark, folder), 0.5).select("request_id", "verdict", "reason")


@query("verdict_rates_all", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, CASE WHEN event_id % 7 = 0 THEN 'rejected' WHEN value / 100.0 >= 0.5 THEN 'fake' ELSE 'genuine' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2")
def rates_all(spark, folder):
    return verdict_rates(verdicts(_all_requests(spark, folder), 0.5))


@query("served_verdicts", """WITH r AS (SELECT event_id, ts, event_type AS text, value / 100.0 AS score FROM events UNION ALL SELECT event_id, ts - INTERVAL '90 seconds', event_type, 1.0 - value / 100.0 FROM events WHERE event_id % 5 = 0),
f AS (SELECT event_id, arg_min(CASE WHEN event_id % 7 = 0 THEN '  ' ELSE text END, ts) AS text, arg_min(score, ts) AS score, min(ts) AS ts FROM r GROUP BY event_id)
SELECT CAST(event_id AS VARCHAR) AS request_id, ts, CASE WHEN trim(text) = '' THEN 'rejected' WHEN score >= 0.5 THEN 'fake' ELSE 'genuine' END AS verdict, CASE WHEN trim(text) = '' THEN 'empty_text' END AS reason FROM f""")
def served_verdicts(spark, folder):
    """All events as requests, answered by a stream that is stopped in the middle and started again.

    Each fifth request comes a second time, 90 seconds earlier by its own time but in a later file.
    """
    from quillmark.plans.staging import new_path
    from quillmark.streaming.serving import answers, serve

    e = table(spark, folder, "events")
    text = F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.col("event_type"))
    once = e.select(F.col("event_id").cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), text.alias("text"), (F.col("value") / 100.0).alias("score"), F.col("ts").cast("timestamp").alias("_come"))
    again = once.where(F.col("request_id").cast("long") % 5 == 0).withColumns({"ts": F.col("ts") - F.expr("INTERVAL 90 SECONDS"), "score": 1.0 - F.col("score")})
    sent = once.withColumn("_turn", F.lit(0)).unionByName(again.withColumn("_turn", F.lit(1)))
    halves = e.agg(F.expr("percentile_approx(cast(ts as timestamp), 0.5)")).first()[0]
    requests, out, checkpoint = (new_path(spark, n) for n in ("requests", "answers", "stream-checkpoint"))
    for half in (F.col("_come") <= F.lit(halves), F.col("_come") > F.lit(halves)):
        for turn in (0, 1):
            sent.where(half & (F.col("_turn") == turn)).drop("_come", "_turn").repartitionByRange(2, "ts").write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(requests)
        serve(spark, requests, out, checkpoint, lateness_minutes=60 * 24 * 400).awaitTermination()
    return answers(spark, out, 0.5).drop("revision")


@query("split_scan", f"WITH {SCORED_SQL} SELECT doc_id, lang FROM scored WHERE evaluation_group = 'paired_news' AND scenario IN (1, 4)")
def split_scan(spark, folder):
    paired = filters.of_splits(scored(spark, folder), ("paired_news",), split="evaluation_group")
    return filters.mismatch_population(paired).select("doc_id", "lang")


@query("known_labels", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL")
def known_labels(spark, folder):
    both = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return filters.known(both, "toxic")


@query("json_props", "SELECT event_id, length(props) AS n, md5(props) AS digest, len(json_keys(props)) AS keys, props ->> json_keys(props)[1] AS first FROM events")
def json_props(spark, folder):
    """The properties of events as text, and parsed: how many there are, and the first one's value."""
    keys = F.json_object_keys("props")
    return table(spark, folder, "events").select("event_id", F.length("props").cast("long").alias("n"), F.md5(F.col("props").cast("binary")).alias("digest"), F.size(keys).cast("long").alias("keys"), F.expr("get_json_object(props, concat('$.', json_object_keys(props)[0]))").alias("first"))


@query("first_turns", "SELECT conv_id, min(turn) AS first_turn, count(*) AS turns, min_by(role, turn) AS role FROM conversations GROUP BY conv_id")
def first_turns(spark, folder):
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("turns"), F.min_by("role", "turn").alias("role"))


@query("presentation_rounding", f"WITH {SCORED_SQL} SELECT doc_id, round(rough, 4) AS shown, round(ln(1 + CAST(n_chars AS DOUBLE)), 9) AS log_chars FROM scored")
def presentation_rounding(spark, folder):
    return scored(spark, folder).select("doc_id", F.round("rough", 4).alias("shown"), F.round(F.log1p("n_chars"), 9).alias("log_chars"))


@query("box_geometry", "SELECT doc_id, round(CAST((10 + doc_id % 7) * (20 + doc_id % 5) AS DOUBLE) / (200 * 100), 9) AS share, CAST(greatest(0, least(10 + doc_id % 7, 30) - 5) * greatest(0, least(20 + doc_id % 5, 15) - 5) AS DOUBLE) AS overlap FROM documents")
def box_geometry(spark, folder):
    d = table(spark, folder, "documents").select("doc_id")
    a = F.array(F.lit(0.0), F.lit(0.0), (10 + F.col("doc_id") % 7).cast("double"), (20 + F.col("doc_id") % 5).cast("double"))
    b = F.array(*(F.lit(x) for x in (5.0, 5.0, 30.0, 15.0)))
    return d.select("doc_id", F.round(arrays.box_area_share(a, F.lit(200), F.lit(100)), 9).alias("share"), arrays.overlap_area(a, b).alias("overlap"))


@query("masked_mean", "SELECT vec_id, " + ", ".join(f"round((" + " + ".join(f"CAST(embedding[{4 * k + c}] AS DOUBLE)" for k in range(16) if k % 3 != 2) + f") / 11, 9) AS m{c}" for c in range(1, 5)) + " FROM embeddings")
def masked_mean(spark, folder):
    """Whole vectors as 16 tokens of four values, of which each third is masked."""
    e = table(spark, folder, "embeddings").select("vec_id", F.array(*(F.slice(arrays.doubles(F.col("embedding")), 4 * k + 1, 4) for k in range(16))).alias("tokens"))
    mean = arrays.masked_mean(F.col("tokens"), F.array(*(F.lit(int(k % 3 != 2)) for k in range(16))))
    return _rounded(e.select("vec_id", mean.alias("m")).select("vec_id", *(F.col("m")[c - 1].alias(f"m{c}") for c in range(1, 5))))


def _total_encoder():
    return lambda x: x.sum(axis=1, keepdims=True)


@query("label_isolation", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 3) + 0.0 AS score, true AS same, true AS refused FROM embeddings")
def label_isolation(spark, folder):
    """Scores of an encoder over whole vectors: the same when labels move, and an encoder that asks for a label is refused."""
    from quillmark.functions.models import encoded

    e = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<float>").alias("image"))
    score = lambda df: encoded(df, _total_encoder, ["image"], shapes=[[64]]).select("vec_id", F.col("features")[0].cast("double").alias("p"))
    try:
        encoded(e, _total_encoder, ["image", "label"])
        refused = False
    except ValueError:
        refused = True
    moved = score(e.withColumn("label", 9 - F.col("label"))).withColumnRenamed("p", "q")
    return score(e).join(moved, "vec_id").select("vec_id", (F.round("p", 3) + 0.0).alias("score"), (F.col("p") == F.col("q")).alias("same"), F.lit(refused).alias("refused"))


@query("image_keys", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'sha1:' || sha1(text) ELSE 'path:' || lower(source || '/Img' || doc_id || '.PNG') END AS image_key FROM documents")
def image_keys(spark, folder):
    d = table(spark, folder, "documents")
    path = F.concat(F.col("source"), F.lit("\\Img"), F.col("doc_id").cast("string"), F.lit(".PNG"))
    return d.select("doc_id", text.image_key(F.col("doc_id") % 4 != 0, F.sha1(F.col("text").cast("binary")), path).alias("image_key"))


# --- builds, reservations, audits


def _build_sql() -> str:
    """Selection, components of what is selected and the greedy split, in one; ids are text, as in the build."""
    candidates = _RECORDS.replace("SELECT doc_id,", "SELECT CAST(doc_id AS VARCHAR) AS doc_id,", 1).replace("doc_id % 5", "CAST(documents.doc_id AS BIGINT) % 5")
    links, placed = (sql.replace("FROM records", "FROM picked").replace("JOIN records", "JOIN picked") for sql in (_EDGES, _PLACED))
    picked = "picked AS MATERIALIZED (SELECT r.* FROM records r JOIN chosen USING (doc_id))"
    return f"""WITH RECURSIVE {candidates}, {_chosen_sql()}, {picked}, {links}, {placed}
SELECT c.doc_id AS sample_id, r."group", c.cluster, p.split FROM comp c JOIN placed p ON p.cluster = c.cluster JOIN picked r ON r.doc_id = c.doc_id"""


@query("dataset_build", _build_sql())
def dataset_build(spark, folder):
    from quillmark.plans.build import build_dataset
    from quillmark.queries_records import _records

    rows = _records(spark, folder).withColumn("sample_id", F.col("doc_id").cast("string"))
    return build_dataset(rows)[0].select("sample_id", "group", "cluster", "split")


@query("dataset_build_leaks", "SELECT 'x' AS \"check\", 'x' AS key, 'x' AS detail WHERE false")
def dataset_build_leaks(spark, folder):
    """The build's own checks: identity, balance, copies, labels, leaks and the groups' shares of the splits."""
    from quillmark.plans.build import build_dataset
    from quillmark.queries_records import _records

    rows = _records(spark, folder).withColumn("sample_id", F.col("doc_id").cast("string"))
    return build_dataset(rows)[1]


@query("dataset_build_planted", f"""SELECT 'leak' AS "check", c || '=' || v AS key, min(split) || ',' || max(split) AS detail FROM (
 WITH b AS MATERIALIZED ({_build_sql()}), r AS (SELECT k.text_key, k.image_key, CASE WHEN CAST(b.sample_id AS BIGINT) % 9 = 4 THEN 'test' ELSE b.split END AS split FROM b JOIN (WITH {_RECORDS} SELECT * FROM records) k ON k.doc_id = CAST(b.sample_id AS BIGINT))
 SELECT 'text_key' AS c, text_key AS v, split FROM r UNION ALL SELECT 'image_key', image_key, split FROM r) GROUP BY c, v HAVING min(split) <> max(split)""")
def dataset_build_planted(spark, folder):
    """A built data set of which every ninth row is moved to test: its checks find each content that then stands in two splits."""
    from quillmark.operators.quality import verified
    from quillmark.plans.build import build_dataset
    from quillmark.queries_records import _records

    rows = _records(spark, folder).withColumn("sample_id", F.col("doc_id").cast("string"))
    built = build_dataset(rows)[0]
    moved = built.withColumn("split", F.when(F.col("doc_id") % 9 == 4, "test").otherwise(F.col("split")))
    return verified(moved).where("check = 'leak'").select("check", "key", "detail")


@query("reserved_quotas", """WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents)
SELECT doc_id, lang, CASE WHEN k <= 3 THEN 'test' WHEN k <= 5 THEN 'val' ELSE 'train' END AS split FROM o WHERE k <= 10""")
def reserved_quotas(spark, folder):
    from quillmark.operators.reservation import reserved

    d = table(spark, folder, "documents").select("doc_id", "lang", F.col("doc_id").alias("content"))
    return reserved(d, {"test": 3, "val": 2, "train": 5}, "doc_id", ["lang"], "content").select("doc_id", "lang", "split")


@query("suffix_lookup", "SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'archive/' || lang || '/doc/' || doc_id END AS member, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'ambiguous' END AS problem FROM documents")
def suffix_lookup(spark, folder):
    """Each fifth member is missing, each seventh of the others there twice."""
    from quillmark.operators.audits import by_suffix

    d = table(spark, folder, "documents")
    tail = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    there = d.where("doc_id % 5 <> 0")
    twice = there.where("doc_id % 7 = 0").select(F.concat(F.lit("copy/"), tail).alias("member"))
    return by_suffix(d.select(tail.alias("path")), there.select(F.concat(F.lit("archive/"), "lang", F.lit("/"), tail).alias("member")).unionByName(twice))


@query("region_coverage", """WITH b AS (SELECT doc_id, doc_id % 9 AS a, doc_id % 6 AS c FROM documents), s AS (SELECT greatest(0, least(a, 4)) * 1.0 / 4 AS s1, greatest(greatest(0, least(a, 4)), greatest(0, least(c, 4))) * 1.0 / 4 AS s2 FROM b)
SELECT 1 AS k, count(*) AS n, count(*) FILTER (WHERE s1 = 0) AS outside, count(*) FILTER (WHERE s1 < 0.5) AS under_half FROM s UNION ALL SELECT 2, count(*), count(*) FILTER (WHERE s2 = 0), count(*) FILTER (WHERE s2 < 0.5) FROM s""")
def region_coverage(spark, folder):
    from quillmark.operators.audits import coverage

    box = lambda w: F.array(F.lit(0.0), F.lit(0.0), w.cast("double"), F.lit(1.0))
    d = table(spark, folder, "documents").select(F.array(box(F.col("doc_id") % 9), box(F.col("doc_id") % 6)).alias("boxes"), box(F.lit(4)).alias("target"))
    return coverage(d, "boxes", "target", (1, 2))


@query("gate_by_scenario", f"""WITH {SCORED_SQL}, b AS (SELECT scenario, avg(prob) AS v FROM scored GROUP BY scenario), c AS (SELECT scenario, avg(prob) AS v FROM scored WHERE doc_id % 3 <> 0 GROUP BY scenario)
SELECT scenario, round(c.v - b.v, 9) AS difference, c.v - b.v >= -0.01 AS passes, bool_and(c.v - b.v >= -0.01) OVER () AS promote FROM b JOIN c USING (scenario)""")
def gate_by_scenario(spark, folder):
    from quillmark.operators.audits import promotion

    s = scored(spark, folder)
    mean = lambda df: df.groupBy("scenario").agg(F.avg("prob").alias("v"))
    return _rounded(promotion(mean(s), mean(s.where("doc_id % 3 <> 0")), "scenario", "v", 0.01))


@query("holdout_sizes", "SELECT count(*) FILTER (WHERE doc_id % 4 <> 0 AND lang <> 'fr') AS training, count(*) FILTER (WHERE doc_id % 4 = 0 AND (lang = 'fr' OR doc_id % 5 = 3)) AS target FROM documents")
def holdout_sizes(spark, folder):
    from quillmark.operators.filters import source_holdout

    s = scored(spark, folder).withColumn("split", F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train"))
    train, target = source_holdout(s, "fr", category="lang")
    return train.agg(F.count(F.lit(1)).alias("training")).crossJoin(target.agg(F.count(F.lit(1)).alias("target")))


_DRAWN = f"""WITH {SCORED_SQL}, w AS (SELECT doc_id, label, CAST(CASE WHEN label = 0 THEN 4 ELSE 1 END AS DOUBLE) AS w FROM scored), p AS (SELECT doc_id, label, greatest(CAST(floor(w / (SELECT max(w) FROM w) * 1073741824) AS BIGINT), 1) AS parts FROM w),
c AS (SELECT doc_id, label, CAST(sum(parts) OVER (ORDER BY doc_id) AS HUGEINT) AS upto FROM p), e AS (SELECT unnest([0, 1, 2]) AS epoch), d AS (SELECT epoch, i AS draw, md5('3:' || epoch || ':' || i) AS h FROM e, range((SELECT count(*) FROM documents)) t(i)),
t AS (SELECT epoch, draw, (list_reduce(list_transform(range(1, 14), lambda k: CAST(strpos('0123456789abcdef', h[k]) - 1 AS HUGEINT)), lambda x, y: x * 16 + y) * (SELECT CAST(sum(parts) AS HUGEINT) FROM p)) // 4503599627370496 AS at FROM d),
drawn AS (SELECT t.epoch, t.draw, c.doc_id, c.label FROM t ASOF JOIN c ON t.at < c.upto)"""


def _weighted(spark, folder):
    return scored(spark, folder).withColumn("w", F.when(F.col("label") == 0, 4.0).otherwise(1.0))


@query("weighted_draws", f"{_DRAWN} SELECT label, count(*) AS drawn FROM drawn WHERE epoch = 0 GROUP BY label")
def weighted_draws(spark, folder):
    """An epoch as long as the table."""
    from quillmark.operators.reservation import draw_audit
    from quillmark.operators.reservation import weighted_draws as draws

    s = _weighted(spark, folder)
    return draw_audit(draws(s, "w", s.count(), "doc_id", 3), ["label"])


@query("weighted_draw_rows", f"{_DRAWN} SELECT draw, doc_id, label FROM drawn WHERE epoch = 1")
def weighted_draw_rows(spark, folder):
    from quillmark.operators.reservation import weighted_draws as draws

    s = _weighted(spark, folder)
    return draws(s, "w", s.count(), "doc_id", 3, epoch=1).select("draw", "doc_id", "label")


@query("draw_report", f"{_DRAWN} SELECT epoch, label, count(*) AS drawn, count(DISTINCT doc_id) AS distinct_rows FROM drawn GROUP BY epoch, label")
def draw_report(spark, folder):
    from quillmark.operators import reservation

    s = _weighted(spark, folder)
    return reservation.draw_report(s, "w", s.count(), "doc_id", 3, 3, ["label"])


@query("midpoint_ridge")
def midpoint_ridge(spark, folder):
    from quillmark.operators.linear import midpoint_correction

    e = table(spark, folder, "embeddings").select(arrays.doubles(F.col("embedding")).alias("x"), F.col("label").cast("double").alias("m"))
    coefficients, intercept = midpoint_correction(e, "x", "m", 10.0)
    return spark.createDataFrame([(k, round(float(c), 4)) for k, c in enumerate([*coefficients, intercept])], "position int, coefficient double")


def _labelled_vectors(spark, folder):
    return table(spark, folder, "embeddings").where("label IS NOT NULL").select("vec_id", arrays.doubles(F.col("embedding")).alias("x"), F.pmod("label", F.lit(3)).alias("y"))


@query("head_training")
def head_training(spark, folder):
    """Loss of each epoch of the residual head over three of four vectors, and the share of the others that it gets right."""
    from quillmark.functions.models import residual_head
    from quillmark.operators.heads import train_head

    e = _labelled_vectors(spark, folder)
    parameters, curve = train_head(e.where("vec_id % 4 <> 0"), "x", "y", "vec_id", 3)
    held = e.where("vec_id % 4 = 0").withColumn("p", residual_head(parameters)("x"))
    right = held.agg(F.lit("held_out_accuracy").alias("measure"), F.lit(-1).alias("epoch"), F.round(F.avg((arrays.argmax(F.col("p")) == F.col("y")).cast("double")), 6).alias("value"))
    losses = spark.createDataFrame([("loss", k, round(x, 6)) for k, x in enumerate(curve)], "measure string, epoch int, value double")
    return losses.unionByName(right)


@query("kernel_machine")
def kernel_machine(spark, folder):
    """Scores of a kernel machine for every fourth vector, fitted to the others."""
    from quillmark.operators.kernel import fit_kernel, kernel_scored

    e = _labelled_vectors(spark, folder).withColumn("y", (F.col("y") == 0).cast("int"))
    machine = fit_kernel(e.where("vec_id % 4 <> 0"), "x", "y", "vec_id", c=0.5)
    return kernel_scored(e.where("vec_id % 4 = 0"), machine, "x").select("vec_id", "y", F.round("score", 3).alias("score"))


@query("shortcut_forest")
def shortcut_forest(spark, folder):
    from quillmark.operators.linear import fake_probability, random_forest
    from quillmark.operators.metrics import binary_counts

    s = scored(spark, folder).select("doc_id", "label", F.array(F.log1p("n_chars"), (F.col("lang") == "en").cast("double")).alias("x"))
    model = random_forest(s.where("doc_id % 4 <> 0"), "x", "label")
    return binary_counts(fake_probability(model, s.where("doc_id % 4 = 0"), "x"), "label", "prob").select("n", "tp", "tn", "fp", "fn")
