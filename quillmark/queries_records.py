"""Queries over records: keys, labels, joins, near-duplicates, selection, splits, checks, features; most with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import arrays, labels, text
from quillmark.operators import features, filters, joins, linear, metrics, neardup, quality, selection
from quillmark.plans.components import components
from quillmark.plans.fixtures import SCORED_SQL, scored
from quillmark.queries_metrics import _rounded
from quillmark.plans.sizing import spread
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


#: The normal form in SQL; the test tables' texts are in NFKC already.
_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_GROUPS_SQL = "['ooc', 'fake_text_real_image', 'real_text_fake_image', 'genuine', 'fake_text_fake_image']"


def _records(spark, folder):
    """doc_id, text_key, image_key, group, scenario, label_binary, source, lang."""
    d = spread(table(spark, folder, "documents"))
    scenario = (F.pmod("doc_id", F.lit(5)) + 1).cast("int")
    image = F.concat(F.lit("sha1:"), F.md5(F.concat_ws(":", "lang", F.col("n_chars").cast("string")).cast("binary")))
    return d.select("doc_id", text.text_key(text.normalize_text(F.col("text"), nfkc=False)).alias("text_key"), image.alias("image_key"), labels.scenario_group(scenario).alias("group"), scenario.alias("scenario"), labels.binary_label(scenario).alias("label_binary"), "source", "lang")


_RECORDS = f"""records AS (SELECT doc_id, substr(sha1({_NORM.format(c="text")}), 1, 16) AS text_key, 'sha1:' || md5(lang || ':' || CAST(n_chars AS VARCHAR)) AS image_key,
 {_GROUPS_SQL}[CAST(doc_id % 5 + 1 AS INTEGER)] AS "group", CAST(doc_id % 5 + 1 AS INTEGER) AS scenario, CASE WHEN doc_id % 5 = 3 THEN 0 ELSE 1 END AS label_binary, source, lang FROM documents)"""


@query("text_key_dedup", f"""WITH {_RECORDS}, k AS (SELECT *, doc_id = min(doc_id) OVER (PARTITION BY text_key) AS kept FROM records)
SELECT "group", count(*) AS n, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS duplicates, count(l.doc_id) AS labelled FROM k LEFT JOIN labels l ON k.doc_id = l.doc_id GROUP BY "group" """)
def text_key_dedup(spark, folder):
    d = spread(table(spark, folder, "documents").select("doc_id", "text"))
    keyed = d.select("doc_id", text.text_key(text.normalize_text(F.col("text"))).alias("text_key"), labels.scenario_group((F.pmod("doc_id", F.lit(5)) + 1).cast("int")).alias("group"))
    seen = selection.first_seen(keyed, ["text_key"], ["doc_id"], "doc_id")
    known = table(spark, folder, "labels").select("doc_id", F.lit(1).alias("known"))
    kept = F.col("doc_id") == F.col("keeper")
    return seen.join(known, "doc_id", "left").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("duplicates"), F.count("known").alias("labelled"))


@query("first_seen_keepers", f"WITH {_RECORDS} SELECT doc_id, min(doc_id) OVER (PARTITION BY text_key, image_key) AS keeper FROM records")
def first_seen_keepers(spark, folder):
    return selection.first_seen(_records(spark, folder).select("doc_id", "text_key", "image_key"), ["text_key", "image_key"], ["doc_id"], "doc_id").select("doc_id", "keeper")


@query("normalized_text", f"SELECT doc_id, {_NORM.format(c='text')} AS normalized FROM documents")
def normalized_text(spark, folder):
    return spread(table(spark, folder, "documents")).select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query("provenance_key", "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS key_md5 FROM documents")
def provenance_key(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(text.provenance_key(F.col("text")).cast("binary")).alias("key_md5"))


@query("digests", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def digests(spark, folder):
    raw = F.col("text").cast("binary")
    return table(spark, folder, "documents").select("doc_id", F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"))


@query("url_subcategory", r"SELECT page_id, regexp_replace(nullif(split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '^/+|/+$', '', 'g'), '/', 2), ''), '_(val|test)_[0-9]+$', '') AS subcategory FROM pages")
def url_subcategory(spark, folder):
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, folder, "pages").select("page_id", F.nullif(text.subcategory(path), F.lit("")).alias("subcategory"))


@query("short_labels", f"WITH {_RECORDS}, g AS (SELECT doc_id, \"group\" AS g FROM records) SELECT doc_id, g AS name, CASE WHEN len(string_split(g, '_')) >= 4 THEN string_split(g, '_')[1][1] || string_split(g, '_')[2][1] || '_' || string_split(g, '_')[3][1] || string_split(g, '_')[4][1] ELSE g END AS label FROM g")
def short_labels(spark, folder):
    return _records(spark, folder).select("doc_id", F.col("group").alias("name"), text.short_label(F.col("group")).alias("label"))


@query("flags_to_group", "SELECT doc_id, CASE WHEN t = 0 AND i = 0 AND o = 1 THEN 'ooc' WHEN t = 1 AND i = 0 AND o = 0 THEN 'fake_text_real_image' WHEN t = 0 AND i = 1 AND o = 0 THEN 'real_text_fake_image' WHEN t = 0 AND i = 0 AND o = 0 THEN 'genuine' WHEN t = 1 AND i = 1 AND o = 0 THEN 'fake_text_fake_image' END AS \"group\" FROM (SELECT doc_id, doc_id % 2 AS t, doc_id // 2 % 2 AS i, doc_id // 4 % 2 AS o FROM documents)")
def flags_to_group(spark, folder):
    bit = lambda k: F.pmod(F.floor(F.col("doc_id") / k), F.lit(2))
    return table(spark, folder, "documents").select("doc_id", labels.group_of_flags(bit(1), bit(2), bit(4)).alias("group"))


@query("scenario_recode", "SELECT doc_id, CASE doc_id % 5 + 1 WHEN 4 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS three_class, CASE doc_id % 5 + 1 WHEN 4 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS five_class_fit, CASE doc_id % 5 + 1 WHEN 4 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS five_class_fusion FROM documents")
def scenario_recode(spark, folder):
    s = scored(spark, folder)
    return s.select("doc_id", *(labels.recode(F.col("scenario"), c).alias(c) for c in labels.RECODINGS))


def _folder_of(key: str = "doc_id"):
    names = sorted(f for group in labels.FOLDERS.values() for f in group)
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(key, F.lit(len(names))) + 1).cast("int"))


# Folders in order, and what each one says. The SQL states them itself, so that it can find a wrong table.
_FOLDER_SQL = "['DGM4_text_edit_senti', 'Fakeddit_photo_edit', 'Newsclipings_person', 'Newsclipings_scene', 'Newsclipings_semantic', 'antifact_image_generation', 'bbc', 'chatgpt_match', 'coco', 'coco_image_edit', 'coco_text_edit', 'fakeddit', 'fever_AI', 'gossipcop_match', 'gossipcop_midjourney', 'guardian', 'llm_gossip_md_generation', 'llm_rewrite', 'llm_science_md_generation', 'politicat_match', 'rumor_match', 'usa_today', 'wash'][CAST(doc_id % 23 + 1 AS INTEGER)]"
_FOLDER_GROUP_SQL = "CASE WHEN folder IN ('bbc', 'guardian', 'usa_today', 'wash', 'coco', 'fakeddit') THEN 'genuine' WHEN folder IN ('Newsclipings_person', 'Newsclipings_scene', 'Newsclipings_semantic') THEN 'ooc' WHEN folder IN ('rumor_match', 'politicat_match', 'gossipcop_match', 'chatgpt_match', 'DGM4_text_edit_senti') THEN 'fake_text_real_image' WHEN folder IN ('Fakeddit_photo_edit', 'antifact_image_generation', 'coco_image_edit') THEN 'real_text_fake_image' WHEN folder IN ('fever_AI', 'llm_rewrite', 'llm_gossip_md_generation', 'llm_science_md_generation', 'gossipcop_midjourney', 'coco_text_edit') THEN 'fake_text_fake_image' END"
_AUTHOR_SQL = "CASE WHEN folder IN ('chatgpt_match', 'fever_AI', 'llm_rewrite', 'llm_gossip_md_generation', 'llm_science_md_generation') THEN 1 WHEN folder NOT IN ('DGM4_text_edit_senti', 'coco_text_edit') THEN 0 END"
_DOMAIN_SQL = "CASE WHEN folder IN ('gossipcop_match', 'gossipcop_midjourney', 'llm_gossip_md_generation') THEN 'gossip' WHEN folder = 'llm_science_md_generation' THEN 'science' WHEN folder = 'fever_AI' THEN 'fact' WHEN folder = 'politicat_match' THEN 'politics' WHEN folder = 'rumor_match' THEN 'rumour' WHEN folder IN ('bbc', 'guardian', 'usa_today', 'wash', 'Newsclipings_person', 'Newsclipings_scene', 'Newsclipings_semantic', 'DGM4_text_edit_senti') THEN 'news' WHEN folder IN ('coco', 'coco_image_edit', 'coco_text_edit') THEN 'captions' WHEN folder IN ('fakeddit', 'Fakeddit_photo_edit') THEN 'social' WHEN folder IN ('chatgpt_match', 'llm_rewrite', 'antifact_image_generation') THEN 'mixed' ELSE 'other' END"


@query("folder_classify", f"SELECT doc_id, folder, {_FOLDER_GROUP_SQL} AS \"group\" FROM (SELECT doc_id, {_FOLDER_SQL} AS folder FROM documents)")
def folder_classify(spark, folder):
    return labels.classify_folders(table(spark, folder, "documents").select("doc_id", _folder_of().alias("folder")), "folder").select("doc_id", "folder", "group")


@query("authorship_domain", f"SELECT doc_id, {_AUTHOR_SQL} AS ai_text, {_DOMAIN_SQL} AS domain FROM (SELECT doc_id, {_FOLDER_SQL} AS folder FROM documents)")
def authorship_domain(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", _folder_of().alias("f"))
    return d.select("doc_id", labels.authorship(F.col("f")).alias("ai_text"), labels.domain(F.col("f")).alias("domain"))


# --- joins


@query("ambiguous_key_lookup", f"""WITH k AS (SELECT doc_id, {_NORM.format(c='text')} AS key, source FROM documents), u AS (SELECT key, min(source) AS found FROM k GROUP BY key HAVING count(DISTINCT source) = 1) SELECT doc_id, found FROM k LEFT JOIN u USING (key)""")
def ambiguous_key_lookup(spark, folder):
    d = spread(table(spark, folder, "documents")).select("doc_id", F.sha2(text.normalize_text(F.col("text"), nfkc=False).cast("binary"), 256).alias("key"), "source")
    known = joins.unambiguous(d, "key", "source").withColumnRenamed("source", "found")
    return d.join(known, "key", "left").select("doc_id", "found")


_REASON = f"""d AS (SELECT doc_id, {_NORM.format(c='text')} AS norm, source, lang FROM documents), protected AS (SELECT * FROM d WHERE doc_id % 10 = 0)"""


@query("exclusion_cascade", f"""WITH {_REASON} SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) THEN 'source_id' WHEN norm = '' THEN 'empty_caption' WHEN doc_id % 10 = 0 THEN 'sample_id' WHEN norm IN (SELECT norm FROM protected) OR norm IN (SELECT {_NORM.format(c='text')} FROM benchmark) THEN 'caption' END AS reason FROM d""")
def exclusion_cascade(spark, folder):
    d = spread(table(spark, folder, "documents")).select("doc_id", text.normalize_text(F.col("text"), nfkc=False).alias("norm"))
    protected = d.where("doc_id % 10 = 0")
    captions = protected.select("norm").unionByName(table(spark, folder, "benchmark").select(text.normalize_text(F.col("text"), nfkc=False).alias("norm")))
    toxic = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    out = joins.exclusion_reason(d, {"source_id": (toxic, "doc_id", "doc_id"), "sample_id": (protected, "doc_id", "doc_id"), "caption": (captions, "norm", "norm")}, empty=F.col("norm") == "")
    return out.select("doc_id", "reason")


@query("exclusion_counts", f"""WITH {_REASON}, r AS (SELECT source, CASE WHEN doc_id % 10 = 0 THEN 'sample_id' WHEN norm IN (SELECT norm FROM protected) THEN 'caption' END AS reason FROM d) SELECT source, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY source, reason""")
def exclusion_counts(spark, folder):
    d = spread(table(spark, folder, "documents")).select("doc_id", "source", text.normalize_text(F.col("text"), nfkc=False).alias("norm"))
    protected = d.where("doc_id % 10 = 0")
    out = joins.exclusion_reason(d, {"sample_id": (protected, "doc_id", "doc_id"), "caption": (protected, "norm", "norm")})
    return out.where("reason IS NOT NULL").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("caption_anti_join", f"WITH {_REASON} SELECT doc_id FROM d WHERE norm NOT IN (SELECT norm FROM protected)")
def caption_anti_join(spark, folder):
    d = spread(table(spark, folder, "documents")).select("doc_id", F.sha2(text.normalize_text(F.col("text"), nfkc=False).cast("binary"), 256).alias("norm"))
    return d.join(d.where("doc_id % 10 = 0").select("norm"), "norm", "left_anti").select("doc_id")


@query("transitive_exclusion", f"WITH {_REASON} SELECT DISTINCT source, lang FROM d WHERE norm IN (SELECT norm FROM protected)")
def transitive_exclusion(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source", "lang", F.sha2(text.normalize_text(F.col("text"), nfkc=False).cast("binary"), 256).alias("norm"))
    return d.join(d.where("doc_id % 10 = 0").select("norm"), "norm", "left_semi").select("source", "lang").distinct()


@query("prediction_mismatches", f"WITH {SCORED_SQL}, a AS (SELECT doc_id, label FROM scored WHERE doc_id % 17 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 1 - label ELSE label END AS label FROM scored WHERE doc_id % 19 <> 0) SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'only right' WHEN b.doc_id IS NULL THEN 'only left' ELSE 'label' END AS problem FROM a FULL JOIN b USING (doc_id) WHERE a.label IS DISTINCT FROM b.label")
def prediction_mismatches(spark, folder):
    s = scored(spark, folder)
    a = s.where("doc_id % 17 <> 0").select("doc_id", "label")
    b = s.where("doc_id % 19 <> 0").select("doc_id", F.when(F.col("doc_id") % 13 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"))
    return joins.mismatches(a, b, "doc_id", ["label"])


@query("feature_align_concat", "SELECT vec_id, label, len(e) AS size, round(CAST(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE))) AS DOUBLE), 6) AS total FROM (SELECT vec_id, label, list_concat(embedding, list_reverse(embedding)) AS e FROM embeddings)")
def feature_align_concat(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "label", arrays.doubles(F.col("embedding")).alias("features"))
    both = joins.concatenated([e, e.withColumn("features", F.reverse("features"))], "vec_id", agree=("label",))
    return both.select("vec_id", "label", F.size("features").cast("long").alias("size"), F.round(arrays.total(F.col("features")), 6).alias("total"))


@query("aligned_join", f"WITH {SCORED_SQL} SELECT l.doc_id, quality, scenario FROM labels l JOIN scored s ON l.doc_id = s.doc_id")
def aligned_join(spark, folder):
    return joins.aligned(table(spark, folder, "labels").select("doc_id", "quality"), scored(spark, folder).select("doc_id", "scenario"), "doc_id").select("doc_id", "quality", "scenario")


@query("asset_agreement", "SELECT label, count(*) AS n, min(vec_id) AS first_vec, min_by(round(CAST(embedding[1] AS DOUBLE), 6), vec_id) AS first_value FROM embeddings GROUP BY label")
def asset_agreement(spark, folder):
    e = table(spark, folder, "embeddings").select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("value"), F.col("label").alias("same"))
    return joins.one_of(e, "label", ["same"], ["vec_id", "value"], "vec_id").select("label", "n", F.col("vec_id").alias("first_vec"), F.col("value").alias("first_value"))


@query("candidate_paths", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a/' || doc_id WHEN doc_id % 5 = 0 THEN 'b/' || doc_id ELSE 'a/' || doc_id END AS path, doc_id % 3 = 0 OR doc_id % 5 = 0 AS \"exists\" FROM documents")
def candidate_paths(spark, folder):
    d = table(spark, folder, "documents").select("doc_id")
    at = lambda root: F.concat(F.lit(f"{root}/"), F.col("doc_id").cast("string"))
    listing = d.where("doc_id % 3 = 0").select(at("a").alias("path")).unionByName(d.where("doc_id % 5 = 0").select(at("b").alias("path")))
    return joins.resolved(d, listing, [at("a"), at("b"), at("c")], "doc_id")


# --- near-duplicates

_BITS = "fp AS (SELECT vec_id, label, list_sum(list_transform(range({n}), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST({n} - 1 - i AS INTEGER) ELSE CAST(0 AS HUGEINT) END))::HUGEINT AS fp FROM embeddings)"


#: Each third fingerprint again with one to four bits turned, as a row of its own.
_COPIED = """own AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INTEGER) ELSE CAST(0 AS HUGEINT) END))::HUGEINT AS fp FROM embeddings),
fp AS (SELECT vec_id, fp FROM own UNION ALL SELECT vec_id + 1000000, xor(fp, list_reduce([CAST(1 AS HUGEINT) << CAST(vec_id * (7 * k + 1) % 64 AS INTEGER) for k in range(CAST(vec_id % 4 + 1 AS BIGINT))], lambda x, y: xor(x, y))) FROM own WHERE vec_id % 3 = 0)"""


def _fingerprints(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "label", arrays.sign_bits(F.col("embedding")).alias("fp"))


def _with_near_copies(spark, folder):
    f = _fingerprints(spark, folder).select("vec_id", "fp")
    bit = lambda k: F.expr(f"shiftleft(1L, cast(pmod(vec_id * {7 * k + 1}, 64) as int))")
    turned = F.col("fp")
    for k in range(4):
        turned = F.when(F.col("vec_id") % 4 >= k, turned.bitwiseXOR(bit(k))).otherwise(turned)
    return f.unionByName(f.where("vec_id % 3 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), turned.alias("fp")))


@query("hamming_pairs", f"WITH {_BITS.format(n=64)} SELECT a.vec_id AS \"left\", b.vec_id AS \"right\", CAST(bit_count(xor(a.fp, b.fp)) AS INTEGER) AS distance FROM fp a JOIN fp b ON a.vec_id < b.vec_id AND bit_count(xor(a.fp, b.fp)) <= 18")
def hamming_pairs(spark, folder):
    return neardup.near_pairs(_fingerprints(spark, folder), 18, "vec_id")


@query("hamming_banded", f"WITH {_COPIED} SELECT a.vec_id AS \"left\", b.vec_id AS \"right\", CAST(bit_count(xor(a.fp, b.fp)) AS INTEGER) AS distance FROM fp a JOIN fp b ON a.vec_id < b.vec_id AND bit_count(xor(a.fp, b.fp)) <= 4")
def hamming_banded(spark, folder):
    return neardup.near_pairs(_with_near_copies(spark, folder), 4, "vec_id")


def _classes_sql(fingerprints, radius):
    """One row a vector: the least id with its fingerprint, and how many other fingerprints are within the radius."""
    return f"""WITH {fingerprints}, g AS (SELECT fp, min(vec_id) AS class FROM fp GROUP BY fp), l AS (SELECT a.fp, count(*) AS links FROM g a JOIN g b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {radius} GROUP BY a.fp)
SELECT fp.vec_id, g.class, coalesce(l.links, 0) AS links FROM fp JOIN g ON g.fp = fp.fp LEFT JOIN l ON l.fp = fp.fp"""


@query("hamming_classes_4", _classes_sql(_COPIED, 4))
def hamming_classes_4(spark, folder):
    return neardup.near_classes(_with_near_copies(spark, folder), 4, "vec_id")


@query("hamming_classes_18", _classes_sql(_BITS.format(n=64), 18))
def hamming_classes_18(spark, folder):
    """A radius that parts ask for too much under: counts of neighbours, block by block."""
    return neardup.near_classes(_fingerprints(spark, folder), 18, "vec_id")


@query("hamming_min_cross", f"WITH {_BITS.format(n=64)} SELECT a.vec_id, CAST(min(bit_count(xor(a.fp, b.fp))) AS INTEGER) AS nearest FROM fp a JOIN fp b ON a.vec_id <> b.vec_id GROUP BY a.vec_id")
def hamming_min_cross(spark, folder):
    return neardup.nearest_distance(_fingerprints(spark, folder), "vec_id")


@query("cross_split_quarantine", f"""WITH {_COPIED}, s AS (SELECT vec_id, fp, CASE vec_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM fp),
v AS (SELECT *, EXISTS (SELECT 1 FROM s t WHERE t.split = 'test' AND bit_count(xor(s.fp, t.fp)) <= 3) AS q FROM s WHERE split = 'val'),
k AS (SELECT fp FROM s WHERE split = 'test' UNION ALL SELECT fp FROM v WHERE NOT q),
t AS (SELECT *, EXISTS (SELECT 1 FROM k WHERE bit_count(xor(s.fp, k.fp)) <= 3) AS q FROM s WHERE split = 'train')
SELECT vec_id, split, false AS quarantined FROM s WHERE split = 'test' UNION ALL SELECT vec_id, split, q FROM v UNION ALL SELECT vec_id, split, q FROM t""")
def cross_split_quarantine(spark, folder):
    split = F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "val").otherwise("train")
    return neardup.quarantine(_with_near_copies(spark, folder).withColumn("split", split), 3).select("vec_id", "split", "quarantined")


# --- vectors


@query("pair_features", "SELECT vec_id, len(embedding) * 4 + 1 AS size, round(CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS DOUBLE), 6) AS last FROM embeddings")
def pair_features(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", arrays.pair_features(F.col("embedding"), F.col("embedding")).alias("p"))
    return e.select("vec_id", F.size("p").cast("long").alias("size"), F.round(F.element_at("p", -1), 6).alias("last"))


@query("l2_normalize", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(n), 9) AS first_value, round(CAST(embedding[64] AS DOUBLE) / sqrt(n), 9) AS last_value FROM (SELECT vec_id, embedding, CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS DOUBLE) AS n FROM embeddings)")
def l2_normalize(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", arrays.l2_normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.col("v")[0], 9).alias("first_value"), F.round(F.element_at("v", -1), 9).alias("last_value"))


@query("zscore_train", "WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[64] AS DOUBLE) AS b FROM embeddings), s AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM x WHERE vec_id % 4 <> 0) SELECT vec_id, round((a - ma) / greatest(sa, 1e-6), 6) AS first_value, round((b - mb) / greatest(sb, 1e-6), 6) AS last_value FROM x, s")
def zscore_train(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    z = features.zscored(e, e.where("vec_id % 4 <> 0"), "embedding")
    return z.select("vec_id", F.round(F.col("embedding")[0], 6).alias("first_value"), F.round(F.element_at("embedding", -1), 6).alias("last_value"))


@query("softmax_decision", "SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS predicted, round(1 / CAST(list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS DOUBLE), 9) AS confidence FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)")
def softmax_decision(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", arrays.softmax(arrays.doubles(F.col("embedding"))).alias("p"))
    return e.select("vec_id", arrays.argmax(F.col("p")).alias("predicted"), F.round(F.array_max("p"), 9).alias("confidence"))


@query("fake_margin", "SELECT vec_id, round(ln(CAST(list_sum(list_transform(l[2:], lambda x: exp(x))) AS DOUBLE)) - l[1], 9) AS margin FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)")
def fake_margin(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", arrays.doubles(F.col("embedding")).alias("z"))
    return e.select("vec_id", F.round(arrays.fake_margin(F.col("z")), 9).alias("margin"))


@query("feature_kinds", "SELECT 'blip_v1_features' AS kind, 34 AS size UNION ALL SELECT 'clip_large_only', 65 UNION ALL SELECT 'blip_v1_clip_large_score', 35 UNION ALL SELECT 'scores', 2")
def feature_kinds(spark, folder):
    e = table(spark, folder, "embeddings")
    parts = e.select(F.slice("embedding", 1, 16).alias("blip_hidden"), F.slice("embedding", 17, 16).alias("v1_hidden"), F.col("embedding")[0].alias("blip_logit"), F.col("embedding")[1].alias("v1_logit"), F.slice("embedding", 33, 16).alias("clip_image"), F.slice("embedding", 49, 16).alias("clip_text"))
    sizes = parts.agg(*(F.max(F.size(features.feature_kind(k))).alias(k) for k in ("blip_v1_features", "clip_large_only", "blip_v1_clip_large_score", "scores")))
    return sizes.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("size")) for c in sizes.columns))).alias("s")).select("s.*")


_PARTS_SQL = """p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT vec_id, e[1:16] AS bh, e[17:32] AS vh, [e[1]] AS bl, [e[2]] AS vl, e[33:48] AS a, e[49:64] AS b FROM p),
m AS (SELECT *, list_transform(range(1, 17), lambda i: a[i] * b[i]) AS prod, list_transform(range(1, 17), lambda i: abs(a[i] - b[i])) AS gap FROM q), o AS (SELECT *, [CAST(list_sum(prod) AS DOUBLE)] AS dot FROM m),
k AS (SELECT vec_id, unnest([
  {'kind': 'v1_only', 'v': vh || vl}, {'kind': 'clip_large_only', 'v': a || b || prod || gap || dot}, {'kind': 'blip', 'v': bh}, {'kind': 'blip_with_score', 'v': bh || bl}, {'kind': 'scores', 'v': bl || vl},
  {'kind': 'blip_v1_score', 'v': bh || vl}, {'kind': 'blip_v1_features', 'v': bh || vh || bl || vl}, {'kind': 'blip_v1_clip_large', 'v': bh || vh || bl || vl || a || b || prod || gap || dot},
  {'kind': 'blip_v1_clip_large_match', 'v': bh || vh || bl || vl || prod || gap || dot}, {'kind': 'blip_v1_clip_large_score', 'v': bh || vh || bl || vl || dot}]) AS x FROM o)"""


@query("feature_kind_values", f"WITH {_PARTS_SQL} SELECT vec_id, x.kind AS kind, len(x.v) AS size, round(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: i * x.v[i])), 5) AS mark FROM k")
def feature_kind_values(spark, folder):
    """All ten kinds of every vector: their sizes, and a sum that weighs each value by its place."""
    e = table(spark, folder, "embeddings")
    parts = e.select("vec_id", F.slice("embedding", 1, 16).alias("blip_hidden"), F.slice("embedding", 17, 16).alias("v1_hidden"), F.col("embedding")[0].alias("blip_logit"), F.col("embedding")[1].alias("v1_logit"), F.slice("embedding", 33, 16).alias("clip_image"), F.slice("embedding", 49, 16).alias("clip_text"))
    kinds = parts.select("vec_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), features.feature_kind(k).alias("v")) for k in features.KINDS))).alias("x")).select("vec_id", "x.*")
    mark = arrays.total(F.transform("v", lambda x, i: x * (i + 1)))
    return kinds.select("vec_id", "kind", F.size("v").cast("long").alias("size"), F.round(mark, 5).alias("mark"))


@query("train_moments", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events WHERE event_id % 4 <> 0 GROUP BY event_type")
def train_moments(spark, folder):
    """Moments of every type's training rows; each fourth row is held out."""
    found = features.moments(table(spark, folder, "events"), "value", F.col("event_id") % 4 != 0, ["event_type"])
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


# --- weights and baselines


@query("class_weights", f"WITH {SCORED_SQL}, c AS (SELECT scenario - 1 AS class, count(*) AS n FROM scored GROUP BY 1) SELECT class, round((SELECT count(*) FROM scored) / (5.0 * n), 9) AS weight FROM c")
def class_weights(spark, folder):
    return _rounded(selection.class_weights(scored(spark, folder).withColumn("c", F.col("scenario") - 1), "c", 5))


@query("stratum_weights", f"WITH {SCORED_SQL} SELECT doc_id, round((SELECT count(*) FROM scored) * (CASE WHEN scenario = 4 THEN 0.5 ELSE 0.125 END) / count(*) OVER (PARTITION BY scenario), 9) AS weight FROM scored")
def stratum_weights(spark, folder):
    weighed = selection.stratum_weights(scored(spark, folder), "scenario", {4: 0.5, 1: 0.125, 2: 0.125, 3: 0.125, 5: 0.125})
    return weighed.select("doc_id", F.round("weight", 9).alias("weight"))


@query("positive_rate_spread", f"WITH {SCORED_SQL}, r AS (SELECT source, avg(CAST(label AS DOUBLE)) AS rate FROM scored GROUP BY source) SELECT round(min(rate), 9) AS low, round(max(rate), 9) AS high, round(max(rate) - min(rate), 9) AS spread, max(rate) - min(rate) > 0.05 AS note FROM r")
def positive_rate_spread(spark, folder):
    return _rounded(metrics.rate_spread(scored(spark, folder), "label", "source"))


@query("baselines", f"WITH {SCORED_SQL}, m AS (SELECT scenario FROM scored WHERE doc_id % 4 <> 0 GROUP BY scenario ORDER BY count(*) DESC, scenario LIMIT 1) SELECT (SELECT scenario FROM m) AS majority_class, round(avg(CASE WHEN scenario = (SELECT scenario FROM m) THEN 1.0 ELSE 0.0 END), 9) AS majority_accuracy, 0.2 AS random_expected FROM scored WHERE doc_id % 4 = 0")
def baselines(spark, folder):
    s = scored(spark, folder)
    return _rounded(metrics.majority_baseline(s.where("doc_id % 4 <> 0"), s.where("doc_id % 4 = 0"), "scenario", 5))


@query("length_stats", "SELECT lang, max(n) AS longest, round(avg(n), 2) AS mean, count(*) FILTER (WHERE n > 96) AS truncated, round(avg(CASE WHEN n > 96 THEN 1.0 ELSE 0.0 END), 4) AS truncated_share FROM (SELECT lang, len(string_split(text, ' ')) AS n FROM documents) GROUP BY lang")
def length_stats(spark, folder):
    d = table(spark, folder, "documents").select("lang", F.size(F.split("text", " ")).cast("long").alias("n"))
    return features.length_stats(d, "n", "lang", 96)


@query("value_coverage", "SELECT count(*) AS n, count(*) FILTER (WHERE value > 50) AS over_50, round(median(value), 6) AS median, round(avg(value), 6) AS mean FROM events")
def value_coverage(spark, folder):
    from quillmark.plans.prefix import quantiles

    e = table(spark, folder, "events")
    middle = quantiles(e.where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")), "value", "n", 2).where("i = 1")
    whole = e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("over_50"), F.round(F.avg("value"), 6).alias("mean"))
    return whole.crossJoin(middle.select(F.round("q", 6).alias("median"))).select("n", "over_50", "median", "mean")


# --- selection


@query("candidate_order", f"""WITH {_RECORDS} SELECT doc_id, row_number() OVER (PARTITION BY "group" ORDER BY source, md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM records""")
def candidate_order(spark, folder):
    r = _records(spark, folder).select("doc_id", "group", "source")
    return selection.candidate_order(r, "group", "source", "doc_id", 42).select("doc_id", F.col("rank").cast("long").alias("rank"))


def _chosen_sql() -> str:
    """CTEs over `records`: the five groups in turn, each without the pairs taken before and cut at the common goal; `chosen` is their union."""
    ctes, groups = [], list(labels.GROUPS)
    for k, g in enumerate(groups):
        earlier = " AND ".join(f"NOT EXISTS (SELECT 1 FROM t{j} x WHERE x.text_key = o.text_key AND x.image_key = o.image_key)" for j in range(k)) or "true"
        ctes.append(f"t{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_key, image_key ORDER BY rank) AS copy FROM o WHERE \"group\" = '{g}' AND {earlier}) WHERE copy = 1 ORDER BY rank LIMIT (SELECT n FROM goal))")
    union = " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, \"group\", rank FROM t{k} ORDER BY rank LIMIT (SELECT n FROM final))" for k in range(5))
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY source, md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM records), goal AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM o GROUP BY "group")),
{", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in ctes)}, final AS (SELECT least({", ".join(f"(SELECT count(*) FROM t{k})" for k in range(5))}) AS n), chosen AS MATERIALIZED ({union})"""


@query("balanced_select", f"WITH {_RECORDS}, {_chosen_sql()} SELECT * FROM chosen")
def balanced_select(spark, folder):
    chosen = selection.select_balanced(_records(spark, folder), "group", "text_key", "image_key", "doc_id", "source")
    return chosen.select("doc_id", "group", F.col("rank").cast("long").alias("rank"))


@query("round_robin", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS turn FROM documents")
def round_robin(spark, folder):
    return selection.round_robin(table(spark, folder, "documents").select("doc_id", "source"), "source", "doc_id", 7).withColumn("turn", F.col("turn").cast("long"))


@query("first_k_per_stratum", "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents) WHERE k <= 4")
def first_k_per_stratum(spark, folder):
    return selection.first_k(table(spark, folder, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 4)


@query("evenly_spaced", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id FROM o WHERE k IN (SELECT CAST(floor(i * CAST((SELECT count(*) FROM documents) AS DOUBLE) / 128) AS BIGINT) FROM range(128) t(i))")
def evenly_spaced(spark, folder):
    return selection.evenly_spaced(selection.dense_ordinal(table(spark, folder, "documents").select("doc_id"), "doc_id"), "ordinal", 128).select("doc_id")


@query("weighted_expand", f"WITH {SCORED_SQL} SELECT doc_id, unnest(range(1, CASE WHEN scenario = 4 THEN 5 ELSE 2 END)) AS copy FROM scored")
def weighted_expand(spark, folder):
    s = scored(spark, folder).select("doc_id", "scenario")
    return selection.expanded(s, F.when(F.col("scenario") == 4, F.lit(4)).otherwise(F.lit(1)).cast("long")).select("doc_id", "copy")


@query("prefix_captions", f"WITH {SCORED_SQL}, k AS (SELECT caption_id, row_number() OVER (ORDER BY caption_id) - 1 AS k FROM (SELECT DISTINCT caption_id FROM scored)) SELECT doc_id, caption_id FROM scored WHERE caption_id IN (SELECT caption_id FROM k WHERE k < CAST(floor((SELECT count(*) FROM k) * 0.5) AS BIGINT))")
def prefix_captions(spark, folder):
    return selection.prefix_fraction(scored(spark, folder).select("doc_id", "caption_id"), "caption_id", 0.5).select("doc_id", "caption_id")


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('3:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def seeded_sample(spark, folder):
    return selection.sampled(table(spark, folder, "documents").select("doc_id"), "doc_id", 100, 3)


@query("top_runs", f"WITH {SCORED_SQL} SELECT source, round(avg(prob), 9) AS score, count(*) AS n FROM scored GROUP BY source ORDER BY avg(prob) DESC, source LIMIT 8")
def top_runs(spark, folder):
    return _rounded(scored(spark, folder).groupBy("source").agg(F.avg("prob").alias("score"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("score"), "source").limit(8))


@query("best_by_purpose", f"WITH {SCORED_SQL}, r AS (SELECT lang, source, round(avg(prob), 9) AS worst, count(*) AS n FROM scored GROUP BY lang, source) SELECT lang, source, worst, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY worst DESC, n DESC, source) AS k FROM r) WHERE k = 1")
def best_by_purpose(spark, folder):
    r = scored(spark, folder).groupBy("lang", "source").agg(F.round(F.avg("prob"), 9).alias("worst"), F.count(F.lit(1)).alias("n"))
    return r.groupBy("lang").agg(F.min_by(F.struct("source", "worst", "n"), F.struct(-F.col("worst"), -F.col("n"), F.col("source"))).alias("b")).select("lang", "b.*")


@query("early_stopping", "WITH h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value AS metric FROM events), u AS (SELECT *, coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM h), l AS (SELECT *, epoch - max(CASE WHEN up THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) >= 3 AS stopped FROM u), s AS (SELECT run, min(CASE WHEN stopped THEN epoch END) AS stop, max(epoch) AS last FROM l GROUP BY run) SELECT run, max(CASE WHEN up THEN epoch END) AS best_epoch, round(max(metric), 9) AS best, max(stop) AS stopped FROM l JOIN s USING (run) WHERE epoch <= coalesce(stop, last) GROUP BY run")
def early_stopping(spark, folder):
    from pyspark.sql import Window

    e = table(spark, folder, "events").select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("epoch"), F.col("value").alias("metric"))
    return _rounded(features.early_stop(e, "run", "epoch", "metric", 3))


@query("running_moments", """WITH e AS (SELECT event_type, user_id % 20 AS step, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1, 2),
o AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY step) AS k FROM e)
SELECT event_type, round(sum(0.1 * pow(0.9, n - k) * m), 9) AS mean, round(pow(0.9, max(n)) + sum(0.1 * pow(0.9, n - k) * v), 9) AS variance FROM o GROUP BY event_type""")
def running_moments(spark, folder):
    e = table(spark, folder, "events").groupBy("event_type", F.pmod("user_id", F.lit(20)).alias("step")).agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return _rounded(features.exponential_moments(e, "event_type", "step", "m", "v"))


@query("greedy_accept", f"""WITH RECURSIVE {_COPIED}, o AS (SELECT vec_id, fp, row_number() OVER (ORDER BY md5('5:' || CAST(vec_id AS VARCHAR)), vec_id) AS k FROM fp),
g(k, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, f HUGEINT)[]) UNION ALL
  SELECT o.k, CASE WHEN len(list_filter(g.taken, lambda x: bit_count(xor(x.f, o.fp)) <= 3)) = 0 THEN list_append(g.taken, {{'i': o.vec_id, 'f': o.fp}}) ELSE g.taken END FROM g JOIN o ON o.k = g.k + 1)
SELECT unnest(taken).i AS vec_id FROM g WHERE k = (SELECT count(*) FROM o)""")
def greedy_accept(spark, folder):
    f = _with_near_copies(spark, folder).withColumn("rank", selection.shuffled("vec_id", 5))
    edges = neardup.near_pairs(f, 3, "vec_id").toDF("a", "b", "distance")
    return selection.independent(f.select("vec_id", "rank"), edges, "vec_id", "rank").select("vec_id")


# --- components and splits

_EDGES = "e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY text_key) AS b FROM records UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY image_key) FROM records), two AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), walk AS (SELECT doc_id AS node, doc_id AS seen FROM records UNION SELECT w.node, t.b FROM walk w JOIN two t ON w.seen = t.a), comp AS (SELECT node AS doc_id, min(seen) AS cluster FROM walk GROUP BY node)"


def _clusters(spark, folder):
    r = _records(spark, folder)
    edge = lambda k: r.groupBy(k).agg(F.min("doc_id").alias("b")).join(r.select(k, F.col("doc_id").alias("a")), k).select("a", "b")
    found = components(edge("text_key").unionByName(edge("image_key")), "a", "b")
    return r.join(found, r.doc_id == found.node, "left").withColumn("cluster", F.coalesce("component", "doc_id")).drop("node", "component")


@query("components", f"WITH RECURSIVE {_RECORDS}, {_EDGES} SELECT doc_id, cluster FROM comp")
def components_(spark, folder):
    return _clusters(spark, folder).select("doc_id", "cluster")


@query("cluster_stats", f"WITH RECURSIVE {_RECORDS}, {_EDGES}, s AS (SELECT cluster, count(*) AS n FROM comp GROUP BY cluster) SELECT count(*) AS clusters, count(*) FILTER (WHERE n > 1) AS multi, max(n) AS largest FROM s")
def cluster_stats(spark, folder):
    s = _clusters(spark, folder).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("largest"))


#: One cluster after another, each where the largest share of a quota is least; then kinds of clusters are dealt by ranks.
_PLACED = """cl AS (SELECT c.cluster, r."group" AS g, count(*) AS n FROM comp c JOIN records r ON r.doc_id = c.doc_id GROUP BY 1, 2),
prof AS (SELECT cluster, string_agg(g || '=' || n, ',' ORDER BY g) AS profile, CAST(sum(n) AS BIGINT) AS size FROM cl GROUP BY cluster),
ord AS (SELECT *, row_number() OVER (ORDER BY size DESC, profile, md5('42:' || CAST(cluster AS VARCHAR)), cluster) AS i, row_number() OVER (PARTITION BY profile ORDER BY md5('42:' || CAST(cluster AS VARCHAR)), cluster) AS k FROM prof),
gs AS (SELECT "group" AS g, CAST(count(*) AS DOUBLE) AS n FROM records GROUP BY 1),
vec AS (SELECT o.i, o.size, list(CAST(coalesce(cl.n, 0) AS DOUBLE) ORDER BY gs.g) AS c FROM ord o CROSS JOIN gs LEFT JOIN cl ON cl.cluster = o.cluster AND cl.g = gs.g GROUP BY o.i, o.size),
quo AS (SELECT [list(0.7::DOUBLE * n ORDER BY g), list(0.15::DOUBLE * n ORDER BY g), list(0.15::DOUBLE * n ORDER BY g)] AS q FROM gs),
walked(i, have, total, pick) AS (
  SELECT CAST(0 AS BIGINT), list_transform(q, lambda x: list_transform(x, lambda y: CAST(0 AS DOUBLE))), [CAST(0 AS BIGINT), 0, 0], CAST(0 AS BIGINT) FROM quo
  UNION ALL
  SELECT i + 1, list_transform([1, 2, 3], lambda p: CASE WHEN p = best THEN list_transform(range(1, len(c) + 1), lambda g: have[p][g] + c[g]) ELSE have[p] END),
         list_transform([1, 2, 3], lambda p: total[p] + CASE WHEN p = best THEN size ELSE 0 END), CAST(best AS BIGINT)
  FROM (SELECT w.i, w.have, w.total, v.c, v.size, list_min(list_transform([1, 2, 3], lambda p: {'f': list_max(list_transform(range(1, len(v.c) + 1), lambda g: CASE WHEN v.c[g] > 0 THEN (w.have[p][g] + v.c[g]) / quo.q[p][g] END)), 't': w.total[p], 'p': p})).p AS best
        FROM walked w JOIN vec v ON v.i = w.i + 1, quo)
), given AS (SELECT o.profile, count(*) FILTER (WHERE w.pick = 1) AS a, count(*) FILTER (WHERE w.pick <= 2) AS b FROM ord o JOIN walked w ON w.i = o.i GROUP BY o.profile),
placed AS (SELECT o.cluster, CASE WHEN o.k <= n.a THEN 'train' WHEN o.k <= n.b THEN 'val' ELSE 'test' END AS split FROM ord o JOIN given n ON n.profile = o.profile)"""
_GREEDY = f"{_RECORDS}, {_EDGES}, {_PLACED}"


@query("cluster_split", f"WITH RECURSIVE {_GREEDY} SELECT c.doc_id, c.cluster, p.split FROM comp c JOIN placed p ON p.cluster = c.cluster")
def cluster_split(spark, folder):
    return selection.split_clusters(_clusters(spark, folder), "cluster", "group").select("doc_id", "cluster", "split")


@query("cluster_split_leaks", f"""WITH RECURSIVE {_GREEDY}, moved AS (SELECT r.text_key, r.image_key, c.cluster, CASE WHEN c.doc_id % 9 = 4 THEN 'test' ELSE p.split END AS split FROM comp c JOIN placed p ON p.cluster = c.cluster JOIN records r ON r.doc_id = c.doc_id),
l AS (SELECT 'text_key' AS c, text_key AS v, split FROM moved UNION ALL SELECT 'image_key', image_key, split FROM moved UNION ALL SELECT 'cluster', CAST(cluster AS VARCHAR), split FROM moved)
SELECT 'leak' AS "check", c || '=' || v AS key, min(split) || ',' || max(split) AS detail FROM l GROUP BY c, v HAVING min(split) <> max(split)""")
def cluster_split_leaks(spark, folder):
    """Every ninth row is moved to test, whatever its cluster, so that the check has something to find: leaks there, and none besides."""
    split = selection.split_clusters(_clusters(spark, folder), "cluster", "group")
    moved = split.withColumn("split", F.when(F.col("doc_id") % 9 == 4, "test").otherwise(F.col("split")))
    return quality.leaks(moved, ["text_key", "image_key", "cluster"])


# --- checks; `split` by the id, so that they have something to find

_SPLIT = "CASE WHEN md5('42:' || CAST(doc_id AS VARCHAR)) < 'b3' THEN 'train' WHEN md5('42:' || CAST(doc_id AS VARCHAR)) < 'd9' THEN 'val' ELSE 'test' END"


def _split(spark, folder):
    h = F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")).cast("binary"))
    return _records(spark, folder).withColumn("split", F.when(h < "b3", "train").when(h < "d9", "val").otherwise("test"))


_WITH_SPLIT = f"WITH {_RECORDS}, r AS (SELECT *, {_SPLIT} AS split FROM records)"


@query("dq_duplicate_pair", f"{_WITH_SPLIT} SELECT 'duplicate_pair' AS \"check\", text_key || '|' || image_key AS key, CAST(count(*) AS VARCHAR) AS detail FROM r GROUP BY text_key, image_key HAVING count(*) > 1")
def dq_duplicate_pair(spark, folder):
    return quality.duplicates(_split(spark, folder), ["text_key", "image_key"], "duplicate_pair")


@query("dq_duplicate_id", "SELECT 'duplicate_id' AS \"check\", CAST(doc_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id HAVING count(*) > 1")
def dq_duplicate_id(spark, folder):
    both = table(spark, folder, "documents").select("doc_id").unionByName(table(spark, folder, "labels").where("toxic = 1").select("doc_id"))
    return quality.duplicates(both, ["doc_id"], "duplicate_id")


@query("dq_leaks", f"{_WITH_SPLIT}, l AS (SELECT 'text_key' AS c, text_key AS v, split FROM r UNION ALL SELECT 'image_key', image_key, split FROM r) SELECT 'leak' AS \"check\", c || '=' || v AS key, min(split) || ',' || max(split) AS detail FROM l GROUP BY c, v HAVING min(split) <> max(split)")
def dq_leaks(spark, folder):
    return quality.leaks(_split(spark, folder), ["text_key", "image_key"])


@query("dq_split_share", f"{_WITH_SPLIT}, w AS (SELECT * FROM (VALUES ('train', 0.7), ('val', 0.15), ('test', 0.15)) AS w(s, want)), c AS (SELECT \"group\" AS g, s, want, count(*) FILTER (WHERE split = s) / CAST(count(*) AS DOUBLE) AS share FROM r, w GROUP BY \"group\", s, want) SELECT 'split_share' AS \"check\", g || '/' || s AS key, CAST(round(share, 6) AS VARCHAR) AS detail FROM c WHERE abs(share - want) > 0.03")
def dq_split_share(spark, folder):
    return quality.split_shares(_split(spark, folder))


@query("dq_group_sizes", f"{_WITH_SPLIT}, s AS (SELECT \"group\" AS g, count(*) AS n FROM r WHERE doc_id % 11 <> 1 GROUP BY 1), e AS (SELECT min(n) FILTER (WHERE g <> 'genuine') AS low, max(n) FILTER (WHERE g <> 'genuine') AS high, max(n) FILTER (WHERE g = 'genuine') AS gen FROM s) SELECT 'fake_groups_unequal' AS \"check\", CAST(low AS VARCHAR) AS key, CAST(high AS VARCHAR) AS detail FROM e WHERE low <> high UNION ALL SELECT 'genuine_size', CAST(gen AS VARCHAR), CAST(low AS VARCHAR) FROM e WHERE gen <> low")
def dq_group_sizes(spark, folder):
    return quality.group_sizes(_records(spark, folder).where("doc_id % 11 <> 1"))


@query("dq_split_domain", f"{_WITH_SPLIT} SELECT 'unknown_split' AS \"check\", split AS key, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT CASE WHEN doc_id % 50 = 0 THEN 'dev' ELSE split END AS split FROM r) WHERE split = 'dev' GROUP BY split")
def dq_split_domain(spark, folder):
    r = _split(spark, folder).withColumn("split", F.when(F.col("doc_id") % 50 == 0, "dev").otherwise(F.col("split")))
    return quality.outside(r, "split", quality.SPLITS, "unknown_split")


@query("dq_label_mismatch", f"{_WITH_SPLIT} SELECT 'label_mismatch' AS \"check\", CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 31 = 0 THEN 'label_binary' ELSE 'scenario' END AS detail FROM r WHERE doc_id % 31 = 0 OR doc_id % 37 = 0")
def dq_label_mismatch(spark, folder):
    r = _records(spark, folder).withColumn("label_binary", F.when(F.col("doc_id") % 31 == 0, 1 - F.col("label_binary")).otherwise(F.col("label_binary"))).withColumn("scenario", F.when(F.col("doc_id") % 37 == 0, F.col("scenario") % 5 + 1).otherwise(F.col("scenario")))
    return quality.label_mismatch(r, "doc_id")


@query("dq_control_totals", "SELECT 'control_total' AS \"check\", lang AS key, CAST(count(*) AS VARCHAR) || '/' || '100' AS detail FROM documents GROUP BY lang HAVING count(*) <> 100")
def dq_control_totals(spark, folder):
    return quality.control_totals(table(spark, folder, "documents"), "lang", dict.fromkeys(("en", "de", "fr", "es"), 100))


@query("dq_fake_balance", f"{_WITH_SPLIT}, c AS (SELECT scenario, count(*) AS n FROM r WHERE doc_id % 10 <> 2 AND scenario <> 4 GROUP BY scenario) SELECT 'fake_balance' AS \"check\", CAST(scenario AS VARCHAR) AS key, CAST(n AS VARCHAR) AS detail FROM c WHERE n < (SELECT max(n) FROM c)")
def dq_fake_balance(spark, folder):
    return quality.fake_balance(_records(spark, folder).where("doc_id % 10 <> 2"))


@query("dq_broken_pairs", f"WITH {SCORED_SQL}, x AS (SELECT * FROM scored WHERE doc_id % 29 <> 0) SELECT 'broken_pair' AS \"check\", CAST(caption_id AS VARCHAR) AS key, count(*) || '/' || count(*) FILTER (WHERE pair_scenario = 4) || '/' || count(*) FILTER (WHERE pair_scenario = 1) AS detail FROM x GROUP BY caption_id HAVING count(*) <> 2")
def dq_broken_pairs(spark, folder):
    return quality.broken_pairs(scored(spark, folder).where("doc_id % 29 <> 0"), scenario="pair_scenario")


@query("dq_conflicting_label", f"{_WITH_SPLIT} SELECT 'conflicting_label' AS \"check\", text_key AS key, CAST(min(label_binary) AS VARCHAR) || ',' || CAST(max(label_binary) AS VARCHAR) AS detail FROM r GROUP BY text_key HAVING min(label_binary) <> max(label_binary)")
def dq_conflicting_label(spark, folder):
    return quality.conflicting_labels(_records(spark, folder), "text_key", "label_binary")


@query("dq_unchanged", f"{_WITH_SPLIT} SELECT 'removed' AS \"check\", CAST(doc_id AS VARCHAR) AS key, split AS detail FROM r WHERE split IN ('val', 'test') AND doc_id % 40 = 0")
def dq_unchanged(spark, folder):
    r = _split(spark, folder)
    return quality.unchanged(r, r.where("doc_id % 40 <> 0 OR split = 'train'"), key="doc_id")


@query("dq_value_gap", f"WITH {SCORED_SQL} SELECT 'value_gap' AS \"check\", CAST(doc_id AS VARCHAR) AS key, NULL AS detail FROM scored WHERE abs(prob - rough) > 0.0009")
def dq_value_gap(spark, folder):
    s = scored(spark, folder)
    return quality.value_gap(s.select("doc_id", F.col("rough").alias("p")), s.select("doc_id", F.col("prob").alias("p")), "doc_id", "p", 0.0009).withColumn("detail", F.lit(None).cast("string"))


@query("dq_bad_vectors", "SELECT 'bad_vector' AS \"check\", CAST(vec_id AS VARCHAR) AS key, CAST(len(embedding) AS VARCHAR) AS detail FROM embeddings WHERE len(embedding) <> 64")
def dq_bad_vectors(spark, folder):
    return quality.bad_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", 64)


@query("dq_verified", f"""{_WITH_SPLIT}, s AS (SELECT "group" AS g, count(*) AS n FROM r GROUP BY 1), e AS (SELECT min(n) FILTER (WHERE g <> 'genuine') AS low, max(n) FILTER (WHERE g <> 'genuine') AS high, max(n) FILTER (WHERE g = 'genuine') AS gen FROM s),
l AS (SELECT 'text_key' AS c, text_key AS v, split FROM r UNION ALL SELECT 'image_key', image_key, split FROM r),
w AS (SELECT * FROM (VALUES ('train', 0.7), ('val', 0.15), ('test', 0.15)) AS w(s, want)), c AS (SELECT "group" AS g, s, want, count(*) FILTER (WHERE split = s) / CAST(count(*) AS DOUBLE) AS share FROM r, w GROUP BY "group", s, want)
SELECT 'fake_groups_unequal' AS "check", CAST(low AS VARCHAR) AS key, CAST(high AS VARCHAR) AS detail FROM e WHERE low <> high UNION ALL SELECT 'genuine_size', CAST(gen AS VARCHAR), CAST(low AS VARCHAR) FROM e WHERE gen <> low
UNION ALL SELECT 'duplicate_pair', text_key || '|' || image_key, CAST(count(*) AS VARCHAR) FROM r GROUP BY text_key, image_key HAVING count(*) > 1
UNION ALL SELECT 'leak', c || '=' || v, min(split) || ',' || max(split) FROM l GROUP BY c, v HAVING min(split) <> max(split)
UNION ALL SELECT 'split_share', g || '/' || s, CAST(round(share, 6) AS VARCHAR) FROM c WHERE abs(share - want) > 0.03""")
def dq_verified(spark, folder):
    return quality.verified(_split(spark, folder), "doc_id")


# --- sets


@query("union_by_name", "SELECT doc_id, lang, NULL AS quality FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, quality FROM labels")
def union_by_name(spark, folder):
    return table(spark, folder, "documents").where("doc_id % 2 = 0").select("doc_id", "lang").unionByName(table(spark, folder, "labels").select("doc_id", "quality"), allowMissingColumns=True)


@query("train_val_overlap", f"{_WITH_SPLIT} SELECT text_key FROM r WHERE split = 'train' INTERSECT SELECT text_key FROM r WHERE split = 'val'")
def train_val_overlap(spark, folder):
    r = _split(spark, folder)
    of = lambda s: r.where(F.col("split") == s).select("text_key")
    return of("train").intersect(of("val"))


@query("missing_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_ids(spark, folder):
    return filters.not_in(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id").distinct()


@query("symmetric_difference", "(SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 EXCEPT SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def symmetric_difference(spark, folder):
    a = table(spark, folder, "documents").where("doc_id % 3 <> 0").select("doc_id")
    b = table(spark, folder, "labels").select("doc_id")
    return joins.mismatches(a.distinct(), b.distinct(), "doc_id", []).select("doc_id")


@query("distinct_first", "SELECT source, min(doc_id) AS first_seen FROM documents GROUP BY source")
def distinct_first(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.min("doc_id").alias("first_seen"))


@query("pipe_sets", "SELECT lang, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM documents GROUP BY lang")
def pipe_sets(spark, folder):
    return table(spark, folder, "documents").groupBy("lang").agg(text.joined_set(F.col("source")).alias("sources"))


@query("nested_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def nested_counts(spark, folder):
    return table(spark, folder, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


# --- models


@query("logistic_c")
def logistic_c(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", arrays.doubles(F.col("embedding")).alias("x"), (F.col("label") >= 5).cast("int").alias("y"))
    model = linear.fit_logistic(e, "x", "y", c=0.1)
    return linear.fake_probability(model, e, "x").select("vec_id", "y", F.round("prob", 4).alias("prob"))


@query("projection_invariant")
def projection_invariant(spark, folder):
    import numpy as np

    e = table(spark, folder, "embeddings").select("vec_id", arrays.doubles(F.col("embedding")).alias("x"))
    w = np.array([[np.sin(k + 1), np.cos(2 * k)] for k in range(64)]).T
    basis = linear.preserving_projection(e, "x", w, 16)
    logits = lambda c, m: F.array(*(arrays.dot(F.col(c), F.array(*map(F.lit, map(float, row)))) for row in m))
    small = linear.projected_batches(e.withColumn("z", F.col("x")), "z", basis)
    gap = F.zip_with(logits("x", w), logits("z", w @ basis.T), lambda a, b: F.abs(a - b))
    return small.select("vec_id", F.size("z").alias("size"), (F.array_max(gap) < 1e-6).alias("kept"))
