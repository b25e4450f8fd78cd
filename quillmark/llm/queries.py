"""Queries opN_<name> of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans.sizing import spread
from quillmark.sources import tables

TOKENIZER = "byte_bpe_50k.json"
#: Spark redacts settings with "secret" in their names. Where it is unset each application has a random key that nobody learns.
PII_KEY = "spark.quillmark.pii.secret"
_RANDOM_KEYS: dict[str, str] = {}


def pii_key(spark: SparkSession) -> str:
    """The key of the setting. Without it pseudonyms link within one application, and to nothing after it."""
    return spark.conf.get(PII_KEY, None) or _RANDOM_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(tables.table(spark, sf_dir, name))


def tokenizer_definition(name: str = TOKENIZER) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def held_out(doc_id: str = "doc_id"):
    """The documents that language identification never learns from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.language_id import identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = learn(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.compression_bands import fitted_quality

    return fitted_quality(table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.mixing import mix

    return mix(tables.table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_definition())


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.secrets import digest, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.periodic_runs import looped, run_digests

    return run_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), looped)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm.substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def _words(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower(coalesce({text}, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _shingles(words: str) -> str:
    return f"list_distinct(list_transform(range(greatest(len({words}) - 4, 0)), lambda k: array_to_string({words}[k + 1 : k + 5], ' ')))"


def _pairs(words: str) -> str:
    return f"list_transform(range(greatest(len({words}) - 1, 0)), lambda k: array_to_string({words}[k + 1 : k + 2], ' '))"


OP2_SQL = rf"""
WITH raw AS (
  SELECT item_id, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t, string_split_regex(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '\s+') AS s FROM benchmark
), cut AS (
  SELECT item_id, t, CASE WHEN regexp_matches(t, '(?s)[.!?]\s+\S') THEN regexp_extract(t, '(?s)^(.*[.!?])\s+(\S.*)$', 1) ELSE array_to_string(s[1 : len(s) - greatest(1, len(s) // 4)], ' ') END AS q,
         CASE WHEN regexp_matches(t, '(?s)[.!?]\s+\S') THEN regexp_extract(t, '(?s)^(.*[.!?])\s+(\S.*)$', 2) ELSE array_to_string(s[len(s) - greatest(1, len(s) // 4) + 1 :], ' ') END AS a FROM raw
), item AS (
  SELECT item_id, {_words("t")} AS w, {_words("q")} AS q, {_words("a")} AS a FROM cut
), units AS (
  SELECT item_id, 'whole' AS part, 'shingle' AS kind, unnest({_shingles("w")}) AS unit FROM item WHERE len(w) >= 5
  UNION ALL SELECT item_id, 'question', 'pair', unnest({_pairs("q")}) FROM item WHERE len(q) >= 5
  UNION ALL SELECT item_id, 'question', 'word', unnest(q) FROM item WHERE len(q) < 5
  UNION ALL SELECT item_id, 'answer', 'pair', unnest({_pairs("a")}) FROM item WHERE len(a) >= 5
  UNION ALL SELECT item_id, 'answer', 'word', unnest(a) FROM item WHERE len(a) < 5
), sizes AS (
  SELECT item_id, part, count(*) AS n FROM units GROUP BY item_id, part
), doc AS (
  SELECT doc_id, {_words("text")} AS w FROM documents
), held AS (
  SELECT doc_id, 'shingle' AS kind, unnest({_shingles("w")}) AS unit FROM doc
  UNION ALL SELECT doc_id, 'pair', unnest(list_distinct({_pairs("w")})) FROM doc
  UNION ALL SELECT doc_id, 'word', unnest(list_distinct(w)) FROM doc
), found AS (
  SELECT h.doc_id, u.item_id, count(*) FILTER (WHERE u.part = 'whole') AS whole, count(*) FILTER (WHERE u.part = 'question') AS question, count(*) FILTER (WHERE u.part = 'answer') AS answer
  FROM held h JOIN units u ON h.kind = u.kind AND h.unit = u.unit GROUP BY h.doc_id, u.item_id
), long_items AS (
  SELECT f.doc_id, f.item_id, f.whole / CAST(w.n AS DOUBLE) AS similarity, coalesce(f.question / CAST(q.n AS DOUBLE), 1) AS question_overlap, coalesce(f.answer / CAST(a.n AS DOUBLE), 1) AS answer_overlap
  FROM found f JOIN sizes w ON f.item_id = w.item_id AND w.part = 'whole'
  LEFT JOIN sizes q ON f.item_id = q.item_id AND q.part = 'question' LEFT JOIN sizes a ON f.item_id = a.item_id AND a.part = 'answer'
), short_items AS (
  SELECT d.doc_id, i.item_id, CAST(1 AS DOUBLE) AS similarity, CAST(1 AS DOUBLE) AS question_overlap, CAST(1 AS DOUBLE) AS answer_overlap
  FROM doc d JOIN item i ON len(i.w) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')
)
SELECT * FROM long_items WHERE similarity >= 0.8 AND least(question_overlap, answer_overlap) >= 0.5 UNION ALL SELECT * FROM short_items
"""

#: Windows from the weights themselves: fluid time of a unit of service is a sum over the sources, in 128-bit integers.
OP5_SQL = """
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n, CAST(ceil(count(*) / 64) AS HUGEINT) AS b, CAST(pow(count(*), 0.5) * 4503599627370496 AS HUGEINT) AS w FROM documents GROUP BY source
), j AS (
  SELECT source, w, unnest(range(CAST(b AS BIGINT) + 1)) AS j FROM c
), f AS (
  SELECT j.source, j.j, j.w, sum(least(c.w * j.j, c.b * j.w)) AS num FROM j, c GROUP BY j.source, j.j, j.w
), g AS (
  SELECT source, j, CAST(CAST(num AS HUGEINT) // w AS BIGINT) AS low, CAST((CAST(num AS HUGEINT) + w - 1) // w AS BIGINT) AS high FROM f
), wins AS (
  SELECT source, list(low ORDER BY j) AS release, list(high ORDER BY j)[2:] AS due FROM g GROUP BY source
), o AS (
  SELECT list(source ORDER BY source NULLS LAST) AS names, list(release ORDER BY source NULLS LAST) AS release, list(due ORDER BY source NULLS LAST) AS due FROM wins
), s(t, given, pick) AS (
  SELECT CAST(0 AS BIGINT), list_transform(names, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM o
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(given) + 1), lambda i: given[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (SELECT s.t, s.given, list_min(list_transform(range(1, len(s.given) + 1), lambda i: CASE WHEN s.given[i] < len(o.due[i]) AND o.release[i][s.given[i] + 1] <= s.t
                 THEN o.due[i][s.given[i] + 1] * 1000000 + i ELSE 9000000000000000000 END)) % 1000000 AS pick
        FROM s, o WHERE s.t < list_sum(list_transform(o.due, lambda d: len(d))))
), slots AS (
  SELECT names[pick] AS source, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM s, o WHERE pick IS NOT NULL
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('17:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents
)
SELECT d.doc_id, d.source, CAST(d.r // 64 AS BIGINT) AS block, CAST(x.slot AS BIGINT) AS mix_slot, CAST(x.slot * 64 + d.r % 64 AS BIGINT) AS mix_position
FROM ranked d JOIN slots x ON x.source IS NOT DISTINCT FROM d.source AND x.k = d.r // 64
"""


def _op7_sql() -> str:
    """Spans by every rule's expression, from the lengths of matches and of the pieces between them."""
    from quillmark.llm.secrets import BASE, RULES

    parts = []
    for k, rule in enumerate(RULES):
        pattern = "'" + rule.spans.replace("'", "''") + "'"
        parts.append(f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, {pattern}) AS pieces, regexp_extract_all(t, {pattern}) AS found, regexp_extract_all(t, {pattern}, {rule.group}) AS part FROM d WHERE regexp_matches(t, {pattern})")
    counts = ", ".join(f"count(s.kind) FILTER (WHERE s.kind = '{kind}') AS n_{kind}" for kind in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}), i AS (
  SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m
), s AS (
  SELECT doc_id, k, kind, CAST(list_sum(list_transform(pieces[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(found[i]) AS n FROM i WHERE length(part[i]) >= least
), j AS (
  SELECT doc_id, k, kind, a, kind || ':' || a || ':' || (a + n) AS span FROM s
)
SELECT d.doc_id, {counts.replace("s.kind", "j.kind")}, sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents
), keyed AS (
  SELECT doc_id, k, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT d.doc_id, d.k, d.line, f.key IS NOT NULL AND d.doc_id <> f.largest AS dropped
  FROM keyed d LEFT JOIN frequent f ON d.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def _crc32(number: str) -> str:
    """CRC-32 of a number's decimal digits, bit by bit."""
    step = "list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {digits}), lambda c, b: {step}), CAST(4294967295 AS BIGINT))"


#: Prefixes as lists of digests; a node's sums go to all the prefixes of its least member.
OP11_SQL = rf"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, {_crc32("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)
), built AS (
  SELECT c.conv_id, 0 AS mine, o.place, o.digest, o.words FROM conv c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.place <= c.h
  UNION ALL SELECT o.conv_id, 1, o.place, o.digest, o.words FROM own o JOIN conv c ON c.conv_id = o.conv_id AND o.place > c.h
), turned AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY mine, place) AS depth FROM built
), chained AS (
  SELECT conv_id, depth, words, sha256(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM turned
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv
), sizes AS (
  SELECT conv_id, max(depth) AS n_turns FROM chained GROUP BY conv_id
), node AS (
  SELECT c.depth, c.prefix, min(c.conv_id) AS conv_id, count(*) AS n_convs, any_value(c.words) AS words,
         sha256(coalesce(string_agg(CAST(c.conv_id AS VARCHAR), ',' ORDER BY c.conv_id) FILTER (WHERE s.n_turns = c.depth), '')) AS ends_sha256
  FROM chained c JOIN sizes s ON s.conv_id = c.conv_id GROUP BY c.depth, c.prefix
), placed AS (
  SELECT c.conv_id AS member, c.depth, n.conv_id FROM chained c JOIN node n ON n.depth = c.depth AND n.prefix = c.prefix
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM node n LEFT JOIN placed p ON p.member = n.conv_id AND p.depth = n.depth - 1
), kids AS (
  SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2
), counted AS (
  SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.depth = l.depth AND k.conv_id = l.conv_id
), summed AS (
  SELECT p.depth, p.conv_id, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
  FROM counted x JOIN placed p ON p.member = x.conv_id AND p.depth <= x.depth GROUP BY p.depth, p.conv_id
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent_conv_id, c.n_convs, c.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN summed s ON s.depth = c.depth AND s.conv_id = c.conv_id
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d
), windows AS (
  SELECT doc_id, k, CASE WHEN k + 12 <= len(w) THEN array_to_string(w[k : k + 12], ' ') END AS grams, word FROM words
), least AS (
  SELECT grams, min(doc_id) AS first_doc FROM windows WHERE grams IS NOT NULL GROUP BY grams
), marked AS (
  SELECT w.doc_id, w.k, w.word, max(CASE WHEN l.first_doc < w.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.k ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM windows w LEFT JOIN least l ON l.grams = w.grams
), kept AS (
  SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_compression_bands": op4_compression_bands,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_secrets": op7_secrets,
    "op8_html_extraction": op8_html_extraction,
    "op9_pii": op9_pii,
    "op10_line_dedup": op10_line_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLES = {"op2_decontamination": OP2_SQL, "op5_mixing": OP5_SQL, "op7_secrets": _op7_sql(), "op10_line_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_substring_dedup": OP13_SQL}
