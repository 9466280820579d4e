"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import (
    bpe, decontaminate, embeddings, language, line_dedup, lm, quality, simhash, substrings, toxicity, urls, vector_codes, whitening
)
from footfall.llm.frames import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read(spark, sf_dir, "documents"), bpe.public_codec())


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_learned(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_learned(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("doc.text"), F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_learned(read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.deduplicated(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_sentences", "n_removed", "n_run_words", F.sha2("kept", 256).alias("kept_sha256"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_learned(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    return codes.select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(read(spark, sf_dir, "embeddings"))
    # Beyond the range of a long, NULL.
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


OP2_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split
), rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fit AS (
  SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.host, p.path
)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN len(list_intersect(string_split_regex(p.host, '[.-]'),
         ['casino', 'bets', 'poker', 'ads', 'spam', 'adult', 'porn', 'pills', 'viagra'])) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fit f ON p.host = f.host AND p.path = f.path
"""

OP8_SQL = r"""
WITH lines AS (
  SELECT d.rowid AS r, d.doc_id, u.pos, d.parts[u.pos] AS line,
         translate(trim(d.parts[u.pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS rowid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(d.parts) + 1)) AS pos) u
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.*, coalesce(c.keeper <> l.doc_id, false) AS gone FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""


def _op12_sql(rounds: int = 6) -> str:
    """Every round as two tables: each part's nearest entry, and the codebooks after it."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
pick{i} AS MATERIALIZED (
  SELECT r, p, min(far) % 16 AS e, min(far) // 16 AS d FROM (
    SELECT c.r, c.p, sum((c.x - b.x) * (c.x - b.x)) * 16 + b.e AS far FROM cells c JOIN book{i} b USING (p, q) GROUP BY c.r, c.p, b.e)
  GROUP BY r, p
)""")
        if i < rounds:
            steps.append(f"""
book{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.q, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x FROM book{i} b LEFT JOIN (
    SELECT c.p, k.e, c.q, sum(c.x) AS s, count(*) AS n FROM cells c JOIN pick{i} k USING (r, p) GROUP BY c.p, k.e, c.q) m
  ON b.p = m.p AND b.e = m.e AND b.q = m.q
)""")
    return f"""
WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
cells AS MATERIALIZED (
  SELECT r, (i - 1) // (len(v) // 8) AS p, (i - 1) % (len(v) // 8) AS q, v[i] AS x
  FROM base, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i)
),
book0 AS MATERIALIZED (
  SELECT p, e, q, x FROM cells JOIN (
    SELECT r, e FROM (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM base) WHERE e < 16) USING (r)
),{",".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM pick{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, q)) FROM book{rounds}) AS codebooks_sha256
FROM base JOIN coded USING (r)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_url_filter": op2_url_filter,
        "op3_simhash": op3_simhash,
        "op4_language": op4_language,
        "op5_quality": op5_quality,
        "op6_decontamination": op6_decontamination,
        "op7_embeddings": op7_embeddings,
        "op8_line_dedup": op8_line_dedup,
        "op9_lm_score": op9_lm_score,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_toxicity": op11_toxicity,
        "op12_vector_codes": op12_vector_codes,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op8_line_dedup": OP8_SQL, "op12_vector_codes": _op12_sql()}
