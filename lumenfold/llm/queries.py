"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, byte_bpe, importance, language_id, near_dedup, quality_cascade, secret_scan, source_mix, suffix_dedup, token_files, warc, whitening
from .shared import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each vector whose id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by shingles of four words."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the model never sees the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out()
    model = language_id.fit(docs, ~out)
    found = language_id.predict(docs.select("doc_id", "text"), model, drop_text=True)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "lang_bits")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mix, in words."""
    mixed = source_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log ratio and verdict of every document; the target is text of good quality that is not toxic."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings that repeat."""
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).drop("kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secret_spans", lambda x: x["kind"] < len(secret_scan.BASE))
    of = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    return docs.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secret_scan.described(base).cast("binary"), 256).alias("base_sha256"), secret_scan.described(F.col("secret_spans")).alias("spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cascade.run(docs, quality_cascade.plan(docs), drop_text=True)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = byte_bpe.decode(byte_bpe.encode(docs, VOCABULARY, PATTERN, drop_text=True), VOCABULARY)
    return ids.select("doc_id", F.floor(F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, tokens and digest of ids, from token files; each document ends with id 1."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), WORD_TOKENIZER, 1)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every whole vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens over every document."""
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_TOKENIZER, PIECE_TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The numbered queries by name."""
    own = [op1_nearest_neighbours, op2_near_dedup, op3_language_id, op4_source_mix, op5_importance_resampling, op6_suffix_dedup, op7_secret_scan, op8_quality_rules, op9_warc_round_trip, op10_byte_bpe, op11_token_files, op12_embedding_whitening, op13_cross_tokenizer_alignment]
    return {f.__name__: f for f in own}


#: Sizes, water-filled targets and the systematic sample along (size class, hash of the id).
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 2 * source_size AS cap, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w
), t AS (
  SELECT source, source_size, CASE WHEN cap < level * weight OR free IS NULL THEN cap::DOUBLE ELSE least(free * weight, cap::DOUBLE) END AS target
  FROM (SELECT *, max(CASE WHEN NOT cap < level * weight THEN level END) OVER () AS free FROM l)
), r AS (
  SELECT d.*, source_size, target, least(CASE WHEN source_size > 0 THEN floor(target / source_size * 1048576)::BIGINT ELSE 0 END, 2097152)::BIGINT AS e,
    length(size::VARCHAR) * 100 + rpad((size::VARCHAR)[1:2], 2, '0')::INT AS class, md5(coalesce(doc_id::VARCHAR, '|' || size)) AS h,
    ('0x' || md5('lumenfold|' || coalesce(d.source, ''))[1:8])::BIGINT % 1048576 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, (sum(e) OVER (PARTITION BY source ORDER BY class, h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT + u AS e1 FROM r
)
SELECT doc_id, size, source_size, target, ((e1 // 1048576 - (e1 - e) // 1048576) * size)::BIGINT AS taken FROM p
"""

OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM g
"""

#: The measures, and the rules in any order.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], chr(1)))) AS gram, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d
), often AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM often, range(5) AS r(k) GROUP BY doc_id
), f AS (
  SELECT doc_id, t, w, lines, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines
  FROM d
), m AS (
  SELECT f.*, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM f LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR NOT (2 * n_words <= word_chars AND word_chars <= 16 * n_words) OR n_symbols > n_words OR 2 * n_dup_lines > len(lines)
    OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) < n_words
    OR (n_words >= 50 AND 3 * list_max(map_values(list_histogram(w))) > n_words)
    OR (len(lines) >= 5 AND 10 * len(list_filter(full_lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 9 * len(lines))
    OR (len(lines) >= 5 AND 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(lines))) AS kept
FROM b
"""


#: Exact sets, pairs by shared shingles, and components by transitive closure.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) BETWEEN 1 AND 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS grams FROM d
), k AS (
  SELECT doc_id, grams, len(grams)::BIGINT AS n, CASE WHEN len(grams) > 0 THEN md5(array_to_string(grams, chr(10))) END AS class FROM s
), c AS (
  SELECT class, min(doc_id) AS first, any_value(n) AS n, any_value(grams) AS grams FROM k WHERE class IS NOT NULL GROUP BY class
), g AS (
  SELECT class, n, unnest(grams) AS gram FROM c
), l AS (
  SELECT a.class AS a, b.class AS b FROM g a JOIN g b USING (gram) WHERE a.class < b.class
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT class AS a, class AS b FROM c UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
), m AS (
  SELECT r.a AS class, min(c.first) AS component_id FROM reach r JOIN c ON r.b = c.class GROUP BY r.a
)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM k LEFT JOIN m USING (class)
"""

#: Every window of 400 bytes by its hash; what repeats is merged to runs.
OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (
  SELECT u, p, md5_number(substring(x, 2 * p + 1, 800)) AS h FROM (SELECT u, x, unnest(range(0, greatest(n - 399, 0))) AS p FROM d)
), r AS (
  SELECT u, p FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1
), i AS (
  SELECT u, p, sum(fresh) OVER (PARTITION BY u ORDER BY p) AS k
  FROM (SELECT u, p, CASE WHEN p <= lag(p) OVER (PARTITION BY u ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM r)
), s AS (
  SELECT u, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY u, k
), g AS (
  SELECT u, a, b, coalesce(lag(b) OVER (PARTITION BY u ORDER BY a), 0) AS before FROM s
), o AS (
  SELECT u, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM g JOIN d USING (u) GROUP BY u
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(x, 2 * coalesce(last, 0) + 1, 2 * n))) AS kept_sha256
FROM d LEFT JOIN o USING (u)
"""


def _quoted(pattern: str) -> str:
    """A pattern within an SQL literal."""
    return pattern.replace("'", "''")


#: Spans from the lengths of matches and of what lies between them; every window's entropy by counting.
OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents
), z AS (
  SELECT u, 0 AS k, string_split_regex(t, '{_quoted(secret_scan.ASSIGN)}') AS gaps, regexp_extract_all(t, '{_quoted(secret_scan.ASSIGN)}') AS found FROM d
  UNION ALL SELECT u, 1, string_split_regex(t, '{secret_scan.ACCESS}'), regexp_extract_all(t, '{secret_scan.ACCESS}') FROM d
  UNION ALL SELECT u, 2, string_split_regex(t, '{secret_scan.HEX}'), regexp_extract_all(t, '{secret_scan.HEX}') FROM d
  UNION ALL SELECT u, 3, string_split_regex(t, '{secret_scan.CANDIDATE}'), regexp_extract_all(t, '{secret_scan.CANDIDATE}') FROM d
), m AS (
  SELECT u, k, unnest(found) AS s, unnest(gaps[:len(found)]) AS gap, unnest(range(len(found))) AS i FROM z WHERE len(found) > 0
), a AS (
  SELECT u, k, s, (sum(length(gap) + length(s)) OVER (PARTITION BY u, k ORDER BY i))::BIGINT AS stop FROM m
), base AS (
  SELECT u, k, stop - length(s) AS start, stop FROM a WHERE k IN (1, 2) OR k = 0 AND length(regexp_extract(s, '{_quoted(secret_scan.ASSIGN)}', 2)) >= 6
), c AS (
  SELECT u, s, stop - length(s) AS start, stop FROM a WHERE k = 3
), pieces AS (
  SELECT DISTINCT s, unnest(list_distinct(list_append(list_filter(string_split_regex(s, '{_quoted(secret_scan.PIECES)}'), lambda x: length(x) >= {secret_scan.WINDOW}), s))) AS x FROM c
), chars AS (
  SELECT x, i, c, count(*) AS n FROM (SELECT x, i, unnest(string_split(substring(x, i, {secret_scan.WINDOW}), '')) AS c FROM (SELECT x, unnest(range(1, length(x) - {secret_scan.WINDOW} + 2)) AS i FROM (SELECT DISTINCT x FROM pieces))) GROUP BY x, i, c
), bits AS (
  SELECT x, max(b) AS bits FROM (SELECT x, i, log2({secret_scan.WINDOW}) - sum(n * log2(n)) / {secret_scan.WINDOW} AS b FROM chars GROUP BY x, i) GROUP BY x
), kinds AS (
  SELECT x, bits, CASE WHEN regexp_matches(x, '^[0-9a-fA-F]+$') THEN 3 WHEN regexp_matches(x, '^[0-9A-Za-z]+$') THEN 4 ELSE 5 END AS k FROM bits
), dense AS (
  SELECT x, k, regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') AND bits >= CASE k WHEN 3 THEN {secret_scan.THRESHOLD['entropy_hex']} WHEN 4 THEN {secret_scan.THRESHOLD['entropy_alnum']} ELSE {secret_scan.THRESHOLD['entropy_base64']} END AS yes FROM kinds
), secret AS (
  SELECT s, any_value(k) FILTER (x = s) AS k FROM pieces JOIN dense USING (x) GROUP BY s
  HAVING bool_or(yes) FILTER (x = s) AND NOT (contains(s, '/') AND len(list_filter(string_split_regex(s, '{secret_scan.SEPARATORS}'), lambda x: NOT regexp_matches(x, '{secret_scan.WORD.replace('*+', '*')}'))) = 0)
    AND (NOT regexp_matches(s, '{_quoted(secret_scan.KNOWN)}') OR coalesce(bool_or(yes) FILTER (x <> s), false))
), more AS (
  SELECT c.u, k, start, stop FROM c JOIN secret USING (s) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.u = c.u AND b.start < c.stop AND c.start < b.stop)
), e AS (
  SELECT u, k, start, ['assign', 'access', 'hex', 'entropy_hex', 'entropy_alnum', 'entropy_base64'][k + 1] || ':' || start || ':' || stop AS span FROM (FROM base UNION ALL FROM more)
), o AS (
  SELECT u, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM e GROUP BY u
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (u)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB twins of the queries that SQL can express on whole tables."""
    return {"op2_near_dedup": OP2_SQL, "op4_source_mix": OP4_SQL, "op6_suffix_dedup": OP6_SQL, "op7_secret_scan": OP7_SQL, "op8_quality_rules": OP8_SQL, "op9_warc_round_trip": OP9_SQL}
