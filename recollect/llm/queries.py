"""The registered queries of this subpackage: each operator with its production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import language, language_model, line_dedup, mixing, near_dedup, neighbours, packing, phrases, substrings, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(_table(spark, sf_dir, "documents")).select("doc_id", "source", "copies")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits are counted in bytes, as levenshtein does in the SQL."""
    return line_dedup.repeated_lines(_table(spark, sf_dir, "documents"), by_bytes=True).drop("th")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.perplexities(_table(spark, sf_dir, "documents"))


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op6_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.similar_documents(_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the vectors whose id is divisible by 100; all vectors are in the index."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), every=100)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are toxic."""
    found = toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.where("toxic = 1").select("doc_id", "odds")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_substring_dedup, op3_line_dedup, op4_lm_scoring, op5_sequence_packing,
        op6_phrase_fingerprints, op7_nearest_neighbours, op8_toxicity, op9_near_dedup, op10_language_id,
    )
}

ORACLES = {
    "op1_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, length(bin(length(text)))::BIGINT AS x,
         (('0x' || substr(md5('1:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (SELECT source, count(*) AS n, sum(x)::BIGINT AS total, floor(sqrt(count(*)) * 100)::BIGINT AS w FROM d GROUP BY source),
q AS (SELECT *, sum(n) OVER ()::BIGINT AS want, sum(w) OVER ()::BIGINT AS every FROM s),
p AS (SELECT *, want * w // every AS share, row_number() OVER (ORDER BY want * w % every DESC, source) AS rank FROM q),
a AS (SELECT source, total, share + CASE WHEN rank <= want - (SELECT sum(share) FROM p) THEN 1 ELSE 0 END AS share FROM p),
e AS (
  SELECT doc_id, d.source, u, total, share, share * x // total AS certain, share * x % total AS rest FROM d JOIN a USING (source)
), r AS (
  SELECT *, share - sum(certain) OVER (PARTITION BY source) AS lacking,
         CASE WHEN rest > 0 THEN row_number() OVER (
           PARTITION BY source ORDER BY CASE WHEN rest > 0 THEN (u * (total - rest)) / ((1 - u) * rest) END NULLS LAST, doc_id) END AS place
  FROM e
), c AS (
  SELECT doc_id, source, (certain + CASE WHEN place <= lacking THEN 1 ELSE 0 END)::INTEGER AS copies FROM r
)
SELECT * FROM c WHERE copies > 0
""",
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
), solid AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ \t\r\f\v]')),
firsts AS (
  SELECT line, min({'d': doc_id, 'l': line_no}) AS first, length(line) AS n FROM solid GROUP BY line
), halves AS (
  SELECT line, first, n, n AS size, 0 AS side, substr(line, 1, n // 2) AS part FROM firsts
  UNION ALL SELECT line, first, n, n, 1, substr(line, n // 2 + 1) FROM firsts
  UNION ALL SELECT line, first, n, n - 1, 0, substr(line, 1, (n - 1) // 2) FROM firsts
  UNION ALL SELECT line, first, n, n - 1, 1, substr(line, n - ((n - 1) - (n - 1) // 2) + 1) FROM firsts
), near AS (
  SELECT a.line, min(b.first) AS target FROM halves a JOIN halves b
    ON a.size = b.size AND a.side = b.side AND a.part = b.part AND b.first < a.first AND abs(a.n - b.n) <= 1
  WHERE levenshtein(a.line, b.line) = 1 GROUP BY a.line
)
SELECT s.doc_id, CAST(s.line_no AS INTEGER) AS line_no, coalesce(t.target, f.first).d AS first_doc_id,
       CAST(coalesce(t.target, f.first).l AS INTEGER) AS first_line_no,
       CASE WHEN t.target IS NULL THEN 0 ELSE 1 END AS edits
FROM solid s JOIN firsts f ON s.line = f.line LEFT JOIN near t ON s.line = t.line
WHERE t.target IS NOT NULL OR s.doc_id <> f.first.d OR s.line_no <> f.first.l
""",
}
