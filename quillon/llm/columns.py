"""Columns of the operators' queries that SQL can express, as queries of their own, where the rest of the query is a model's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chat, language_model, quality, urls


def chat_digests(spark, sf_dir: str) -> DataFrame:
    """What is read back from the formatted conversations."""
    return chat.op2_chat(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256 FROM g
"""


def quality_metrics(spark, sf_dir: str) -> DataFrame:
    """The counts that the rules look at, and the base rules."""
    return quality.op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p : p + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM windows JOIN twice USING (doc_id, s), range(8) AS r(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
"""


def base_scores(spark, sf_dir: str) -> DataFrame:
    """Unigram scores beside the model's."""
    return language_model.op5_language_model(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


BASE_SQL = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], list_transform(range(8), lambda z: 0::BIGINT)),
    lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) AS crc
), d AS (
  SELECT row_number() OVER () AS r, doc_id, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [chr(10)]) AS w,
    xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1]))) % 5 = 1 AS held_out FROM documents, t
), tokens AS (
  SELECT r, held_out, unnest(w) AS x FROM d
), counts AS (
  SELECT x, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY x
), totals AS (
  SELECT sum(c) AS n, count(*) AS v FROM counts
), scored AS (
  SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base FROM tokens LEFT JOIN counts USING (x), totals GROUP BY r
)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(base, 5) AS base_score FROM scored JOIN d USING (r), totals
"""


def url_rules(spark, sf_dir: str) -> DataFrame:
    """Hosts, paths, rules and, where a rule decides, verdicts."""
    found = urls.op7_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def _rules_sql() -> str:
    rules = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN '{h + p}' THEN '{v}'" for h, p, v in rules)
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (SELECT *, CASE {rule} END AS rule FROM p)
SELECT *, CASE rule {verdict} END AS verdict FROM r
"""


QUERIES = {"chat_digests": chat_digests, "quality_metrics": quality_metrics, "language_base_scores": base_scores, "url_rules": url_rules}
ORACLE_SQL = {"chat_digests": CHAT_SQL, "quality_metrics": QUALITY_SQL, "language_base_scores": BASE_SQL, "url_rules": _rules_sql()}
