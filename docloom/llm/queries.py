"""Registered queries of the training-text operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import clusters, decontamination, divergence, html_blocks, line_rules, near_duplicates
from docloom.llm import packing, quality, sharding, substrings, token_files, toxicity, warc
from docloom.llm.common import table
from docloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARDS = 40


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer())
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset"
    )


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer(), path)
    return token_files.token_index(spark, path)


@query
def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return sharding.number_slots(sharding.assign_shards(rows, SHARDS))


@query
def op1_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


ORACLES["op1_winnowing_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op5_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lowest FROM win) WHERE doc_id > lowest),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) w
  LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op6_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query
def op10_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


ORACLES["op10_line_cleaning"] = r"""
WITH d AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c
        FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM d WHERE len(w) >= 3))),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(array_to_string(lines, '')) AS chars,
         length(array_to_string(list_filter(lines, lambda x:
           regexp_matches(x, '[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}]["''\x{201D}\x{2019}\x{BB})\]]*[\x20\x09-\x0D]*$')
           AND len(regexp_extract_all(x, '[#*$%&|<>]|!!')) * 100 <= length(x) * 5
           AND NOT (length(x) > 20 AND x = upper(x) AND x <> lower(x))
           AND NOT regexp_matches(x, '([|\x{BB}\x{203A}\x{2022}\x{2192}][^|\x{BB}\x{203A}\x{2022}\x{2192}]{0,40}){3,}')
           AND NOT regexp_matches(lower(x), 'all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy|we use cookies|accept (all )?cookies|enable javascript|copyright \(c\)|\x{A9}|click here to|subscribe to our|sign up for our|follow us on|share this (page|article|post)')), '')) AS left_chars
  FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * left_chars >= 50 * chars AS kept
FROM counted
"""


@query
def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path, payloads=False))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.kind").alias("record_type"),
        F.col("refers_to.page_id").alias("refers_to"),
    )


ORACLES["op3_warc_transactions"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS lead,
         array_to_string(list_transform(range(0, 32), lambda k:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
             1 + ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)]), '') AS payload_digest
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM d
"""


@query
def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).select(
        "doc_id",
        F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


@query
def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
per AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df
  FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS all_n FROM per GROUP BY ALL HAVING sum(df) >= 30),
v AS (SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, all_n
  FROM g JOIN kept k USING (lang) LEFT JOIN per USING (lang, source, term)),
total AS (SELECT lang, source, sum(n) AS total FROM cell GROUP BY ALL),
share AS (
  SELECT c.lang, c.source, term, n,
         1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (all_n + 5)) // (all_total + 5 * v)::HUGEINT AS q
  FROM cell c JOIN total USING (lang, source) JOIN v ON v.lang = c.lang),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM share WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query
def op12_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroid_clusters(table(spark, sf_dir, "embeddings"))


def _rounds(rounds: int) -> str:
    """One step of the rounds as SQL: distances to all centroids, then floors of means."""
    parts = []
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS (
  SELECT r, vec_id, cluster, distance FROM (
    SELECT r, vec_id, cluster, distance, row_number() OVER (PARTITION BY r ORDER BY distance, cluster) AS place
    FROM (SELECT r, vec_id, cluster,
                 list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS distance
          FROM vec, c{k}))
  WHERE place = 1)""")
        if k < rounds:
            parts.append(f"""m{k} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n
        FROM a{k} JOIN vec USING (r), range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (cluster))""")
    return ",\n".join(parts)


ORACLES["op12_orchard_clusters"] = rf"""
WITH vec AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS cluster, v AS c FROM vec
  ORDER BY sha256('1:' || vec_id::VARCHAR), v LIMIT 16),
{_rounds(3)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""


@query
def op13_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, classifier).select(
        "doc_id",
        F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"),
    )
