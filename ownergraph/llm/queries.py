"""Registered queries of the training-data operators, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.llm import embedding_pq
from ownergraph.llm.bpe_count import token_counts
from ownergraph.llm.common import prepare, table
from ownergraph.llm.decision_list import quality
from ownergraph.llm.edit_match import contamination
from ownergraph.llm.hard_negatives import hard_negatives
from ownergraph.llm.language_gru import language_id
from ownergraph.llm.line_dedup import line_report
from ownergraph.llm.packing import pack
from ownergraph.llm.prefix_trie import prefix_trie, turn_sequences, with_shared_openings
from ownergraph.llm.simhash_anchor import near_duplicates
from ownergraph.llm.token_files import token_files
from ownergraph.llm.toxicity import toxicity
from ownergraph.llm.warc import warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    """Register a query; its oracle, where SQL can express it, is in ORACLES."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@register
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pq.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@register
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)


@register
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


@register
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


# Every pair of lines with a common word is counted in full.
ORACLES["op6_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
worded AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(
         string_split_regex(line, '[ \\t\\r\\x0B\\f]+'), lambda w: w <> ''))) AS ws
  FROM lines),
sets AS (
  SELECT ws, len(ws) AS n, min({'d': doc_id, 'l': line_no}) AS head, row_number() OVER () AS s
  FROM worded WHERE len(ws) > 0 GROUP BY ws),
words AS (SELECT s, n, unnest(ws) AS w FROM sets),
alike AS (
  SELECT a.s AS s, b.s AS t
  FROM words a JOIN words b ON a.w = b.w AND a.s < b.s AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
  GROUP BY a.s, b.s, a.n, b.n
  HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
both_ways AS (SELECT s, t FROM alike UNION ALL SELECT t, s FROM alike),
cuts AS (
  SELECT x.s, x.ws, least(x.head, coalesce(min(y.head), x.head)) AS cut
  FROM sets x LEFT JOIN both_ways p ON p.s = x.s LEFT JOIN sets y ON y.s = p.t
  GROUP BY x.s, x.ws, x.head),
gone AS (
  SELECT DISTINCT doc_id, line_no FROM worded JOIN cuts USING (ws)
  WHERE {'d': doc_id, 'l': line_no} > cut)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, coalesce(g.nos, '') AS removed_lines
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS nos
  FROM gone GROUP BY doc_id) g USING (doc_id)
"""


@register
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@register
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


@register
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = with_shared_openings(turn_sequences(table(spark, sf_dir, "conversations")), every=100, most=6)
    return prefix_trie(rebuilt).drop("turn_digest")


# Every prefix as a list of turns; the check sum bit by bit.
ORACLES["op12_conversation_trie"] = """
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
numbered AS (
  SELECT c, s, c - c % 100 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda sum, byte: list_reduce(list_prepend(xor(sum, byte), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
             lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
  FROM own),
rebuilt AS (
  SELECT n.c, list_concat(coalesce(b.s[1:n.h], []), n.s[n.h + 1:]) AS s
  FROM numbered n LEFT JOIN own b ON b.c = n.base),
beginnings AS (SELECT c, len(s) AS size, s, unnest(range(len(s) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT s[1:d] AS p, d, min(c) AS first, count(*) AS n,
         sha256(coalesce(string_agg(CASE WHEN size = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends
  FROM beginnings GROUP BY s[1:d], d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.p[1:k] AS p, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM (SELECT x.p, x.d, y.p IS NULL AS leaf, CASE WHEN x.d > 0 THEN (x.n - 1) * length(x.p[x.d].t) ELSE 0 END AS saved,
               unnest(range(x.d + 1)) AS k
        FROM nodes x LEFT JOIN kids y ON y.p = x.p) a GROUP BY a.p[1:k])
SELECT v.first AS conv_id, v.d AS depth, u.first AS parent_conv_id, v.n AS n_convs, coalesce(k.n, 0) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN below b ON b.p = v.p LEFT JOIN kids k ON k.p = v.p
LEFT JOIN nodes u ON v.d > 0 AND u.d = v.d - 1 AND u.p = v.p[1:v.d - 1]
"""


@register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


# Every anchor is scored with every row.
ORACLES["op11_hard_negatives"] = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND len(a.q) = len(b.q) AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
