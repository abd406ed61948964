"""Queries of the training-data operators over the served tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminated
from .html_density import extract_pages
from .jaccard_join import similar_components
from .language_crf import fit_languages, predict_languages
from .packing import pack_documents
from .phrase_dedup import WIDTH, kept_digest, repeat_spans
from .quality_repetition import MAX_COVERED, MAX_LONGEST, MIN_WORDS, repetition_rules
from .token_counts import token_counts
from .toxicity_kn import fit_toxicity, score_toxicity
from .warc import captures


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repetition_rules(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(_table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeat_spans(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", kept_digest(rows["kept"]).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(_table(spark, sf_dir, "documents"), k=3, percent=90, lower=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repetition": op1_repetition,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_best_fit": op6_best_fit,
    "op7_phrase_dedup": op7_phrase_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_language": op9_language,
    "op10_jaccard_join": op10_jaccard_join,
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _windows_covered(k: int, name: str) -> str:
    """Words per text in k-word windows found twice or more in it."""
    return f"""
{name}_w AS (SELECT rid, unnest(range(1, greatest(len(w) - {k} + 2, 1))) AS p, w FROM d),
{name}_h AS (SELECT rid, p, md5(array_to_string(w[p : p + {k} - 1], ' ')) AS h FROM {name}_w),
{name}_t AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, h) AS c FROM {name}_h) WHERE c > 1),
{name} AS (SELECT rid, sum(least(coalesce(nxt - p, {k}), {k}))::BIGINT AS n FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM {name}_t) GROUP BY rid)"""


ORACLE_SQL: dict[str, str] = {
    "op1_repetition": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
{_windows_covered(3, "three")},
{_windows_covered(MIN_WORDS, "ten")},
{_windows_covered(MAX_LONGEST + 1, "long")},
lines AS (SELECT rid, (count(*) - count(DISTINCT l))::BIGINT AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
         coalesce(three.n, 0) AS n_repeat_words, coalesce(ten.n, 0) AS n_covered, long.n IS NULL AS short_repeats
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN three USING (rid) LEFT JOIN ten USING (rid) LEFT JOIN long USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_covered <= {MAX_COVERED} * n_words AND short_repeats AS kept, n_covered
FROM judged""",
    "op4_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (
  SELECT *, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS top,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, url
FROM q""",
    "op10_jaccard_join": f"""
WITH RECURSIVE d AS (
  SELECT rid, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)),
s AS (SELECT DISTINCT rid, md5(array_to_string(w[p : p + 2], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS p FROM d)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.rid < b.rid GROUP BY ALL),
linked AS (SELECT x, y FROM pairs JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(rid, r) AS (SELECT rid, rid FROM d UNION SELECT reach.rid, y FROM reach JOIN both_ways ON x = r)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM d JOIN reach USING (rid) JOIN d e ON e.rid = reach.r LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id""",
    "op7_phrase_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT rid, unnest(range(1, greatest(len(w) - {WIDTH} + 2, 1))) AS p, w FROM d),
hashed AS (SELECT rid, p, md5(array_to_string(w[p : p + {WIDTH} - 1], ' ')) AS h FROM starts),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY h) AS c FROM hashed) WHERE c > 1),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + {WIDTH})) AS p FROM twice),
left_over AS (
  SELECT rid, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (rid)""",
}
