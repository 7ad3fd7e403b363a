"""Registered queries of the core engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.levels import label_of, normalised_label, state_label
from .operators import content, evaluate, keywords
from .operators.chunk import bounds
from .operators.detect import findings, public, spread
from .operators.html import html_text
from .operators.rollup import chunk_levels, document_levels, level_distribution, tag_levels, top_findings
from .plans.oracle import ctes, level_ctes, seeded_sql
from .rules.catalog import DEFAULT
from .rules.loader import catalog_table
from .rules.model import Catalog, ScanOptions
from .sources import sinks
from .streaming.scan import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CARDS = DEFAULT.only("credit_card_001")
MAILS = DEFAULT.only("email_001")
SECRETS = DEFAULT.only("credentials_001")
IDS = DEFAULT.only("vn_id_001")
BANKS = DEFAULT.only("bank_account_001")
ADDRESSES = DEFAULT.only("internal_ip_001")

DOCS, SEEDED = "SELECT doc_id, text FROM documents", seeded_sql()
BOTH = f"{DOCS} UNION ALL {SEEDED}"
HIT = 'rule_id, pattern_idx, "offset", length, round(boost, 4) AS boost, round(confidence, 4) AS confidence, level'


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", "text")


def _seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Texts made of few bytes of keys: the keys are spread, and texts made where they are scanned."""
    return spark.sql(seeded_sql().replace("FROM customer", "FROM {customer}"), customer=spread(_table(spark, sf, "customer")))


def _both(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).unionByName(_seeded(spark, sf))


def _hits(found: DataFrame, *more) -> DataFrame:
    return found.select("doc_id", "rule_id", "pattern_idx", "offset", "length", F.round("boost", 4).alias("boost"), F.round("confidence", 4).alias("confidence"), "level", *more)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _hit_query(name: str, source: str, frame, catalog: Catalog, options: ScanOptions = ScanOptions()) -> None:
    query(name, f"{ctes(source, catalog, options)} SELECT doc_id, {HIT} FROM findings")(lambda spark, sf: _hits(findings(frame(spark, sf), catalog=catalog, options=options)))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Card numbers that pass the checksum, with confidence and level."""
    return _hits(findings(_docs(spark, sf), catalog=CARDS)).select("doc_id", "offset", "length", "confidence", "level")


_hit_query("card_luhn_levels", DOCS, _docs, CARDS)
_hit_query("email_hits", BOTH, _both, MAILS)
_hit_query("secret_token_hits", BOTH, _both, SECRETS)
_hit_query("private_ip_hits", BOTH, _both, ADDRESSES)
_hit_query("citizen_id_boosts", SEEDED, _seeded, IDS)
_hit_query("bank_account_escalation", SEEDED, _seeded, BANKS)
_hit_query("cvv_expiry_boost", SEEDED, _seeded, CARDS)
_hit_query("all_findings_seeded", SEEDED, _seeded, DEFAULT)
_hit_query("all_findings_documents", DOCS, _docs, DEFAULT)
_hit_query("low_threshold_findings", SEEDED, _seeded, DEFAULT, ScanOptions(min_confidence=0.3))
_hit_query("narrow_window_boosts", SEEDED, _seeded, DEFAULT, ScanOptions(window=50))


@query("mask_preview", f"{ctes(BOTH, CARDS)} SELECT doc_id, \"offset\", substr(value, 1, 4) || '****' || substr(value, -4) AS preview FROM findings")
def mask_preview(spark: SparkSession, sf: str) -> DataFrame:
    return findings(_both(spark, sf), catalog=CARDS).select("doc_id", "offset", "preview")


@query("context_snippet", f"{ctes(DOCS, MAILS)} SELECT f.doc_id, f.\"offset\", octet_length(encode(s.text)[greatest(f.\"offset\" - 60, 0) + 1 : f.\"offset\" + f.length + 60]) AS snippet_bytes FROM findings f JOIN src s USING (doc_id)")
def context_snippet(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of the context; the text of it is compared where no character is cut (see the tests)."""
    d = _docs(spark, sf)
    f = findings(d, catalog=MAILS).select("doc_id", "offset", "length").join(d, "doc_id")
    b = F.encode("text", "UTF-8")
    return f.select("doc_id", "offset", F.octet_length(S.byte_slice(b, F.greatest(F.col("offset") - 60, F.lit(0)), F.least(F.octet_length("text"), F.col("offset") + F.col("length") + 60))).cast("long").alias("snippet_bytes"))


@query("document_levels", f"{ctes(BOTH, DEFAULT)}{level_ctes(DEFAULT)} SELECT doc_id, coalesce(level, 0)::INT AS level_code, CASE coalesce(level, 0) WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' ELSE 'RESTRICTED' END AS level, coalesce(match_count, 0) AS match_count FROM src LEFT JOIN levels USING (doc_id)")
def q_document_levels(spark: SparkSession, sf: str) -> DataFrame:
    d = _both(spark, sf)
    return document_levels(d, findings(d)).select("doc_id", "level_code", "level", "match_count")


@query("level_distribution", f"{ctes(BOTH, DEFAULT)}{level_ctes(DEFAULT)} SELECT CASE level WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' ELSE 'RESTRICTED' END AS level, count(*) AS n, (SELECT count(*) FROM src) AS scanned FROM levels WHERE level >= 1 GROUP BY 1")
def q_level_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = _both(spark, sf)
    return level_distribution(document_levels(d, findings(d)))


@query("entropy_bump", f"{ctes(BOTH, MAILS)}{level_ctes(MAILS) if MAILS.compounds else ''} SELECT doc_id, hit_level, round(entropy, 6) AS entropy, bumped FROM bumped")
def entropy_bump(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_levels(findings(_both(spark, sf), catalog=MAILS), catalog=MAILS).select("doc_id", "hit_level", F.round("entropy", 6).alias("entropy"), "bumped")


@query("tag_levels", f"{ctes(SEEDED, DEFAULT)}{level_ctes(DEFAULT)} SELECT doc_id, tag, level FROM tags")
def q_tag_levels(spark: SparkSession, sf: str) -> DataFrame:
    return tag_levels(findings(_seeded(spark, sf)), ["doc_id"])


@query("compound_levels", f"{ctes(SEEDED, DEFAULT)}{level_ctes(DEFAULT)} SELECT doc_id, hit_level, bumped, level FROM levels")
def compound_levels(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_levels(findings(_seeded(spark, sf))).select("doc_id", "hit_level", "bumped", "level")


@query("compound_violations", f"{ctes(SEEDED, DEFAULT)}{level_ctes(DEFAULT)} SELECT doc_id, name, result AS result_level, violation AS violation_type, alert AS alert_priority FROM held JOIN comp USING (k) WHERE violation <> ''")
def compound_violations(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_levels(findings(_seeded(spark, sf))).select("doc_id", F.explode("violations").alias("v")).select("doc_id", "v.*")


@query("top3_findings", f"{ctes(BOTH, DEFAULT)} SELECT doc_id, rank::INT AS rank, greatest(total - 3, 0) AS more, rule_id, \"offset\", length, level FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pid, nth) AS rank, count(*) OVER (PARTITION BY doc_id) AS total FROM findings) WHERE rank <= 3")
def top3_findings(spark: SparkSession, sf: str) -> DataFrame:
    return top_findings(findings(_both(spark, sf))).drop("preview")


_CSV_SQL = f"{ctes(DOCS, DEFAULT)}{level_ctes(DEFAULT)} SELECT doc_id::VARCHAR AS path, 'OK' AS status, CASE coalesce(l.level, 0) WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' ELSE 'RESTRICTED' END AS level, coalesce(rule_id, '') AS rule_id, coalesce(\"offset\"::VARCHAR, '') AS \"offset\", coalesce(f.length::VARCHAR, '') AS length, coalesce(printf('%.4f', round(confidence, 4)), '') AS confidence, '' AS error FROM src LEFT JOIN levels l USING (doc_id) LEFT JOIN findings f USING (doc_id)"


@query("csv_rows", _CSV_SQL)
def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    out = sinks.csv_rows(document_levels(d, findings(d)), "doc_id")
    return out.withColumn("path", F.col("path").cast("string"))


@query("audit_rows", f"{ctes(DOCS, DEFAULT)}{level_ctes(DEFAULT)} SELECT doc_id AS path, CASE l.level WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' ELSE 'RESTRICTED' END AS level, rule_id AS rule, \"offset\", round(confidence, 4) AS confidence FROM levels l JOIN findings f USING (doc_id) WHERE l.level >= 1")
def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return sinks.audit_rows(document_levels(d, findings(d)), "doc_id")


_PAGES = "SELECT page_id AS doc_id, html AS text FROM pages"


@query("page_source_hits", f"{ctes(_PAGES, DEFAULT)} SELECT doc_id, {HIT} FROM findings")
def page_source_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(findings(_table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))))


@query("page_text_hits")
def page_text_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in the visible text of pages (checked against a brute-force reading in the tests)."""
    return _hits(findings(_table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), html_text("html").alias("text"))))


_TURNS = "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations"


@query("conversation_levels", f"{ctes(_TURNS, DEFAULT)} SELECT doc_id // 1000 AS conv_id, max(level) AS level, count(*) AS n FROM findings GROUP BY 1")
def conversation_levels(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return findings(t).groupBy(F.floor(F.col("doc_id") / 1000).alias("conv_id")).agg(F.max("level").alias("level"), F.count(F.lit(1)).alias("n"))


_KW = ctes(BOTH, DEFAULT)
_KW_SEEDED = ctes(SEEDED, DEFAULT)


@query("keyword_hits", f"{_KW_SEEDED} SELECT s.doc_id, rule_id, keyword, pri, p.pos AS \"offset\" FROM (SELECT doc_id, lower(text) AS low, hex(encode(lower(text))) AS lowhex FROM src) s JOIN kw ON contains(low, keyword), LATERAL (SELECT unnest(range(length(lowhex) // 2)) AS pos) p WHERE substr(lowhex, (2 * p.pos + 1)::INT, length(kwhex)) = kwhex")
def keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.keyword_hits(_seeded(spark, sf))


@query("keyword_rules", f"{_KW} SELECT DISTINCT doc_id, rule_id FROM src JOIN kw ON contains(lower(text), keyword)")
def keyword_rules(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.has_rule(_both(spark, sf))


_KW_HITS = "kwhits AS (SELECT s.doc_id, rule_id, keyword, pri, p.pos FROM (SELECT doc_id, lower(text) AS low, hex(encode(lower(text))) AS lowhex FROM src) s JOIN kw ON contains(low, keyword), LATERAL (SELECT unnest(range(length(lowhex) // 2)) AS pos) p WHERE substr(lowhex, (2 * p.pos + 1)::INT, length(kwhex)) = kwhex)"


@query("primary_counts", f"{ctes(SEEDED, DEFAULT)}, {_KW_HITS} SELECT doc_id, rule_id, count(*) FILTER (pri) AS \"primary\", count(*) AS hits FROM kwhits GROUP BY ALL")
def primary_counts(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.primary_counts(keywords.keyword_hits(_seeded(spark, sf)))


_NEAR = "CASE WHEN pos >= \"offset\" AND pos < \"offset\" + length THEN 0 WHEN pos < \"offset\" THEN \"offset\" - pos ELSE pos - \"offset\" - length + 1 END"


@query("near_match", f"{ctes(SEEDED, DEFAULT)}, {_KW_HITS} SELECT doc_id, rule_id, \"offset\", length, coalesce(bool_or(pri AND {_NEAR} <= 50), false) AS \"primary\", coalesce(bool_or(NOT pri AND {_NEAR} <= 50), false) AS secondary FROM findings LEFT JOIN kwhits USING (doc_id, rule_id) GROUP BY ALL")
def near_match(spark: SparkSession, sf: str) -> DataFrame:
    d = _seeded(spark, sf)
    return keywords.near_match(findings(d), keywords.keyword_hits(d), 50)


@query("boost_explained", f"{ctes(SEEDED, IDS)}, {_KW_HITS} SELECT doc_id, rule_id, \"offset\", length, string_agg(keyword || '@' || dist || ' zone ' || CASE WHEN dist <= 20 THEN 1 WHEN dist <= 50 THEN 2 ELSE 3 END || CASE WHEN pri THEN ' primary +' ELSE ' secondary +' END || b, ', ' ORDER BY dist, keyword, pri) AS explanation, least(30, sum(b))::INT AS boost_hundredths FROM (SELECT f.doc_id, f.rule_id, \"offset\", length, keyword, pri, {_NEAR} AS dist, CASE WHEN {_NEAR} <= 20 THEN CASE WHEN pri THEN 15 ELSE 7 END WHEN {_NEAR} <= 50 THEN CASE WHEN pri THEN 10 ELSE 5 END ELSE CASE WHEN pri THEN 5 ELSE 2 END END AS b FROM findings f JOIN kwhits USING (doc_id, rule_id)) WHERE dist <= 200 GROUP BY doc_id, rule_id, \"offset\", length")
def boost_explained(spark: SparkSession, sf: str) -> DataFrame:
    d = _seeded(spark, sf)
    found = findings(d, catalog=IDS).dropDuplicates(["doc_id", "rule_id", "offset", "length"])
    return keywords.explain_boost(found, keywords.keyword_hits(d, catalog=IDS))


@query("chunk_bounds", "SELECT doc_id, i::INT AS chunk_idx, greatest(i * 1000 - 100, 0)::BIGINT AS start, least(n, (i + 1) * 1000)::BIGINT AS \"end\" FROM (SELECT doc_id, octet_length(encode(text)) AS n, unnest(range(ceil(octet_length(encode(text)) / 1000.0)::BIGINT)) AS i FROM documents)")
def chunk_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.explode(bounds(F.octet_length("text"), 1000, 100)).alias("w")).select("doc_id", "w.*")


@query("byte_entropy", "SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT doc_id, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, substr(h, (2 * i + 1)::INT, 2) AS b FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(octet_length(encode(text)))) AS i FROM documents)) GROUP BY doc_id, b) GROUP BY doc_id")
def byte_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_docs(spark, sf)).where(F.octet_length("text") > 0).select("doc_id", F.round(S.entropy(F.encode("text", "UTF-8")), 6).alias("entropy"))


_D = "'4111111111111' || lpad(cast(c_custkey AS STRING), 6, '0')"
_V = f"SELECT c_custkey, '079' || lpad(cast(c_custkey AS STRING), 9, '0') AS id, lpad(cast(c_custkey % 1000 AS STRING), 3, '0') || '123456789' AS any_id, substr({_D}, 1, 12 + cast(c_custkey % 9 AS INT)) AS card, lpad(cast(c_custkey * 7 AS STRING), 4, '0') || '55555' AS bank FROM customer"
_LUHN = "(length(card) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(card)), lambda k: CASE WHEN k % 2 = 0 THEN substr(card, (length(card) - k)::INT, 1)::INT ELSE (substr(card, (length(card) - k)::INT, 1)::INT * 2) // 10 + (substr(card, (length(card) - k)::INT, 1)::INT * 2) % 10 END)) % 10 = 0)"


@query("validators", f"SELECT c_custkey, {_LUHN} AS luhn, substr(any_id, 1, 3) IN ({', '.join(repr(x) for x in S.PROVINCES)}) AS cccd, (length(bank) BETWEEN 9 AND 16 AND (substr(bank, 1, 4) IN ({', '.join(repr(x) for x in S.BANK4)}) OR substr(bank, 1, 3) IN ({', '.join(repr(x) for x in S.BANK3)}) OR bank LIKE '1%')) AS bank FROM ({_V})")
def validators(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.sql(_V.replace("FROM customer", "FROM {customer}"), customer=_table(spark, sf, "customer"))
    return d.select("c_custkey", S.luhn(F.col("card")).alias("luhn"), S.vn_cccd_prefix(F.col("any_id")).alias("cccd"), S.vn_bank_prefix(F.col("bank")).alias("bank"))


@query("byte_sizes", "SELECT o_orderkey, (CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 100) * 1073741824 WHEN 1 THEN (o_orderkey % 100) * 1048576 + 524288 WHEN 2 THEN (o_orderkey % 100) * 1024 ELSE o_orderkey % 100 END)::BIGINT AS bytes FROM orders")
def byte_sizes(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 100).cast("string")
    text = F.when(k % 4 == 0, F.concat(n, F.lit("GB"))).when(k % 4 == 1, F.concat(n, F.lit(".5 mb"))).when(k % 4 == 2, F.concat(n, F.lit("KB"))).otherwise(n)
    return _table(spark, sf, "orders").select("o_orderkey", S.parse_bytes(text).alias("bytes"))


@query("level_labels", "SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' WHEN 3 THEN 'RESTRICTED' ELSE 'PUBLIC' END AS label, list_extract(['UNKNOWN', 'OK', 'ERROR', 'TIMEOUT', 'ENCRYPTED', 'SKIPPED_BINARY', 'SKIPPED_TOO_LARGE', 'SKIPPED_DIRECTORY'], (c_custkey % 8 + 1)::INT) AS state, CASE c_custkey % 6 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' WHEN 5 THEN '' ELSE 'SECRET' END AS norm FROM customer")
def level_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf, "customer").select("c_custkey", label_of((k % 5).cast("int")).alias("label"), state_label((k % 8).cast("int")).alias("state"), normalised_label(F.concat(F.lit(" l"), (k % 6).cast("string"))).alias("norm"))





@query("path_and_prefix", "SELECT c_custkey, 'testdata/f_' || c_custkey || '_001.txt' AS path, 'rule_' || c_custkey AS prefix FROM customer")
def path_and_prefix(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    head = F.when(F.col("c_custkey") % 3 == 0, "./").when(F.col("c_custkey") % 3 == 1, "/data/x/").otherwise("C:\\y\\")
    return _table(spark, sf, "customer").select("c_custkey", S.normal_path(F.concat(head, F.lit("testdata/f_"), k, F.lit("_001.txt"))).alias("path"), S.rule_prefix(F.concat(F.lit("rule_"), k, F.lit("_001"))).alias("prefix"))


_BYTES = "SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'EFBBBF616263' WHEN 1 THEN 'FFFE61006200' WHEN 2 THEN 'FEFF00610062' WHEN 3 THEN '68C3A96C6C6F' WHEN 4 THEN '68E96C6C6F' WHEN 5 THEN '255044462D312E34' WHEN 6 THEN '4D5A9000' WHEN 7 THEN repeat('E900', 20) ELSE repeat('00E9', 20) END AS h FROM customer"


@query("binary_and_encoding", f"SELECT c_custkey, (h LIKE '25504446%' OR h LIKE '4D5A%' OR length(regexp_replace(regexp_replace(h, '(..)', '\\1 ', 'g'), '00 ', '~', 'g')) - length(replace(regexp_replace(regexp_replace(h, '(..)', '\\1 ', 'g'), '00 ', '~', 'g'), '~', '')) > (length(h) // 2) // 20) AS skipped, CASE c_custkey % 9 WHEN 0 THEN 'utf8' WHEN 1 THEN 'utf16le' WHEN 2 THEN 'utf16be' WHEN 4 THEN 'windows1252' WHEN 6 THEN 'windows1252' WHEN 7 THEN 'utf16le' WHEN 8 THEN 'utf16be' ELSE 'utf8' END AS enc FROM ({_BYTES})")
def binary_and_encoding(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.sql(_BYTES.replace("FROM customer", "FROM {customer}"), customer=_table(spark, sf, "customer")).withColumn("b", F.unhex("h"))
    return d.select("c_custkey", content.is_binary(F.lit("dat"), F.col("b")).alias("skipped"), content.encoding(F.col("b")).alias("enc"))


_STATS = " UNION ALL ".join(f"SELECT {i} AS place, '{r.id}' AS rule_id, '{r.category}' AS category, {r.level_code} AS level, {r.priority} AS priority, {len(r.patterns)} AS patterns, {len(r.primary)} AS primary_keywords, {len(r.secondary)} AS secondary_keywords, {len(r.escalation)} AS escalation_keywords" for i, r in enumerate(DEFAULT.ordered()))


@query("rule_catalog_stats", _STATS)
def rule_catalog_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog_table(spark, DEFAULT)


# Evaluation: labels against levels by two rules.
_EVAL = DEFAULT.only("credit_card_001", "email_001", "credentials_001")
_TRUTH = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'SECRET' WHEN quality = 1 THEN 'PUBLIC' ELSE 'INTERNAL' END AS expected FROM labels"
_PAIRS = f"{ctes(DOCS, _EVAL)}, pairs AS (SELECT doc_id, expected, coalesce(predicted, 'PUBLIC') AS predicted FROM ({_TRUTH}) LEFT JOIN (SELECT doc_id, CASE max(level) WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' ELSE 'SECRET' END AS predicted FROM findings GROUP BY doc_id) USING (doc_id))"
_CLASSES = f"{_PAIRS}, classes AS (SELECT class, count(*) FILTER (expected = class AND predicted = class) AS tp, count(*) FILTER (expected <> class AND predicted = class) AS fp, count(*) FILTER (expected = class AND predicted <> class) AS fn, count(*) FILTER (expected = class) AS support FROM (VALUES ('PUBLIC'), ('INTERNAL'), ('CONFIDENTIAL'), ('SECRET')) c(class), pairs GROUP BY class), rated AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM classes), final AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rated)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    labels = _table(spark, sf, "labels")
    truth = labels.select("doc_id", F.when(F.col("toxic") == 1, "SECRET").when(F.col("quality") == 1, "PUBLIC").otherwise("INTERNAL").alias("expected"))
    code = findings(_docs(spark, sf), catalog=_EVAL).groupBy("doc_id").agg(F.max("level").alias("code"))
    return evaluate.matched(truth, code.select("doc_id", normalised_label(label_of(F.col("code"))).alias("p"), F.when(F.col("code") == 3, "SECRET").otherwise(label_of(F.col("code"))).alias("predicted")).drop("p"), "doc_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


query("confusion_matrix", f"{_PAIRS} SELECT expected, " + ", ".join(f"count(*) FILTER (predicted = '{c}') AS \"{c}\"" for c in evaluate.CLASSES) + " FROM pairs GROUP BY expected")(lambda s, d: evaluate.confusion(_pairs(s, d)))
query("class_metrics", f"{_CLASSES} SELECT class, tp, fp, fn, support, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM final")(lambda s, d: _rounded(evaluate.class_metrics(_pairs(s, d))))
query("macro_metrics", f"{_CLASSES} SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1, round(coalesce(avg(f1) FILTER (support > 0), 0), 4) AS f1_supported FROM final")(lambda s, d: _rounded(evaluate.macro_metrics(_pairs(s, d))))
query("binary_metrics", f"{_PAIRS}, b AS (SELECT count(*) FILTER (expected <> 'PUBLIC' AND predicted <> 'PUBLIC') AS tp, count(*) FILTER (expected = 'PUBLIC' AND predicted <> 'PUBLIC') AS fp, count(*) FILTER (expected <> 'PUBLIC' AND predicted = 'PUBLIC') AS fn, round(avg((expected = predicted)::INT), 4) AS accuracy FROM pairs), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM b) SELECT tp, fp, fn, accuracy, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM r")(lambda s, d: _rounded(evaluate.binary_metrics(_pairs(s, d))))
query("error_directions", f"{_PAIRS} SELECT expected, predicted, count(*) AS n, CASE WHEN list_position(['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'SECRET'], predicted) < list_position(['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'SECRET'], expected) THEN 'under' ELSE 'over' END AS direction FROM pairs WHERE expected <> predicted GROUP BY ALL")(lambda s, d: evaluate.error_directions(_pairs(s, d)))
query("mismatch_kinds", f"{_PAIRS} SELECT doc_id, expected, predicted, CASE WHEN predicted = 'PUBLIC' THEN 'false-negative' WHEN expected = 'PUBLIC' THEN 'false-positive' ELSE 'label-mismatch' END AS kind FROM pairs WHERE expected <> predicted")(lambda s, d: evaluate.mismatches(_pairs(s, d), "doc_id"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    return windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("public_findings", f"{ctes(SEEDED, DEFAULT)} SELECT doc_id, rule_id, \"offset\", length, round(confidence, 4) AS confidence FROM findings")
def public_findings(spark: SparkSession, sf: str) -> DataFrame:
    return public(findings(_seeded(spark, sf))).select("doc_id", "rule_id", "offset", "length", F.round("confidence", 4).alias("confidence"))
