"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import exact_dedup, language_id, line_dedup, minhash, mixing, ngram, packing, quality, sharding, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(_table(spark, sf_dir, "documents")).drop("th")


def op3_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over raw pages, with all its kinds of evidence; the text models are those of the documents."""
    langs, table = language_id.fit(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang", 1000)
    return language_id.identify(language_id.pages_rows(_table(spark, sf_dir, "pages")), langs, table).drop("th").withColumnRenamed("id", "page_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), b AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < b.last, false) AS gone FROM k LEFT JOIN b USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def _op5_sql() -> str:
    """Every rule is tried on every url."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    fits = " UNION ALL ".join(f"SELECT {q(r.host)} AS h, {q(r.path)} AS p, {q(r.text)} AS rule, {q(r.verdict)} AS v" for r in url_filter.LIST_RULES)
    whens = lambda what: "CASE " + " ".join(f"WHEN regexp_matches(low, {q(r.regex)}) THEN {q(what(r))}" for r in url_filter.PATTERN_RULES) + " END"
    return f"""
WITH rules AS ({fits}), u AS (
  SELECT page_id, row_number() OVER () AS rn, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), s AS (
  SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), f AS (
  SELECT rn, max({{'n': length(rule), 'rule': rule, 'v': v}}) AS fit
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rn
)
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(fit.v, {whens(lambda r: r.verdict)}, 'allow') AS verdict,
       CASE WHEN fit IS NULL THEN {whens(lambda r: r.name)} END AS pattern
FROM s LEFT JOIN f USING (rn)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("th")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op10_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_packing": op2_packing,
        "op3_language_id": op3_language_id,
        "op3_language_id_pages": op3_language_id_pages,
        "op4_line_dedup": op4_line_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_quality": op6_quality,
        "op7_minhash": op7_minhash,
        "op8_sharding": op8_sharding,
        "op9_mixing": op9_mixing,
        "op10_ngram": op10_ngram,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op4_line_dedup": OP4_SQL, "op5_url_filter": _op5_sql()}
