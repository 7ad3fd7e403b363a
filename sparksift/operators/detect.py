"""Findings: patterns over chunks, scored by keywords near them and by checksums.

All of it is one narrow stage: matches with their byte offsets and the keywords
near them come from Arrow batches, scores are expressions. Only matches are
exploded, and the rule attributes of a match come from a broadcast table with one
row per pattern of the catalogue.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import to_java
from ..functions.levels import INTERNAL, level_code
from ..functions.scalars import VALIDATORS, byte_slice, clamp01, latin1, mask
from ..rules.catalog import CARD_CODE, CARD_EXPIRY, DEFAULT
from ..rules.model import Catalog, Pattern, Rule, ScanOptions
from .chunk import chunk as to_chunks
from .occurrences import pattern_hits

PLACEHOLDERS = r"your_api_key_here|your[-_]?password|changeme|placeholder|dummy|example|xxxxx|\*\*\*|\$\{"
NO_REPLY = r"^(?:no-?reply|donotreply|mailer-daemon|bounce)@"
COMMENT = r"^[\s\u0085  -     　]*(?:#|//|;)"
CVV, EXPIRY = to_java(CARD_CODE), to_java(CARD_EXPIRY)
AROUND, SNIPPET = 300, 60
SPACES = "[\\t\\n\\f\\r \\u000b]"


def view(word: str) -> str:
    """The word's lower-cased bytes as characters."""
    return word.lower().encode().decode("latin-1")


def pattern_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """One row per pattern: what scoring needs."""
    rows = [
        (n, r.id, i, r.name, r.category, p.note, float(p.confidence * r.weight), list(p.validators), level_code(p.override) if p.override else r.level_code, float(r.card_boost), [view(w) for w in r.escalation], level_code(r.escalate_to) if r.escalate_to else 0)
        for n, r, i, p in catalog.patterns()
    ]
    schema = "pid int, rule_id string, pattern_idx int, rule_name string, category string, note string, base double, validators array<string>, rule_level int, card_boost double, escalation array<string>, escalate_to int"
    return spark.createDataFrame(rows, schema).coalesce(1)


def spread(docs: DataFrame) -> DataFrame:
    """Few input partitions, as of one small file, are spread over the cores; larger inputs stay as they are read."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(2 * cores) if not docs.isStreaming and docs.rdd.getNumPartitions() < 2 * cores else docs


def reachable(rule: Rule, p: Pattern, options: ScanOptions) -> bool:
    """Can a match of the pattern get the least confidence at all?"""
    best = min(1.0, p.confidence * rule.weight + options.most_boost / 100)
    if any(v in VALIDATORS for v in p.validators):
        best = min(best + options.validator_bonus, options.validator_most)
    return round(min(1.0, best + rule.card_boost), 9) >= options.min_confidence


def candidates(chunks: DataFrame, catalog: Catalog, options: ScanOptions = ScanOptions(), raw: bool = False) -> DataFrame:
    """A row per match: pid, start, end, value, nth, hundredths (what keywords near it give), and the chunk's columns with its lower-cased text.

    RE2 says which chunks of a batch match (see occurrences). Patterns that can't
    reach the least confidence are left out, unless raw.
    """
    keep = [*chunks.columns, "__low"]
    patterns = [x for x in catalog.patterns() if raw or reachable(x[1], x[3], options)]
    d = chunks.withColumn("__low", F.lower("chunk"))
    d = d.select(*keep, pattern_hits(F.col("chunk"), F.col("__low"), patterns, options).alias("__hits"))
    d = d.select(*keep, F.explode("__hits").alias("h")).withColumn("__b", F.encode("chunk", "UTF-8"))
    return d.select(*keep, "__b", "h.pid", "h.start", "h.end", byte_slice(F.col("__b"), F.col("h.start"), F.col("h.end")).cast("string").alias("value"), "h.nth", F.col("h.boost").alias("hundredths"))


def distance(at: Column, start: Column, end: Column) -> Column:
    """From a keyword's first byte to the match [start, end)."""
    return F.when((at >= start) & (at < end), 0).when(at < start, start - at).otherwise(at - end + 1)


def zone(dist: Column, primary: Column, options: ScanOptions) -> Column:
    """Boost in hundredths."""
    out = F.when(dist > options.window, 0)
    for far, pri, sec in options.zones:
        out = out.when(dist <= far, F.when(primary, pri).otherwise(sec))
    return out.otherwise(0)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog: Catalog = DEFAULT, options: ScanOptions = ScanOptions(), raw: bool = False) -> DataFrame:
    """One row per finding of the documents' texts.

    Columns: id, chunk_idx, n_chunks, chunk_bytes (of the chunk), seq (emission
    order in the chunk), rule_id, rule_name, pattern_idx, note, category, offset, length,
    boost, confidence, level, preview, context, value. With raw, findings below
    the least confidence are kept. Null texts give nothing.
    """
    spark = docs.sparkSession
    base = to_chunks(spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "text", options)
    m = candidates(base, catalog, options, raw).join(F.broadcast(pattern_table(spark, catalog)), "pid")
    start, end, value = F.col("start"), F.col("end"), F.col("value")
    low_value = F.lower(value)
    before = F.substring_index(byte_slice(F.col("__b"), F.lit(0), start).cast("string"), "\n", -1)
    m = m.where(~before.rlike(COMMENT))
    m = m.where(~((F.col("rule_id") == "credentials_001") & low_value.rlike(PLACEHOLDERS)) & ~((F.col("rule_id") == "email_001") & low_value.rlike(NO_REPLY)))
    for name, check in VALIDATORS.items():
        m = m.where(~F.array_contains("validators", name) | check(value))

    low_bytes = F.encode(F.col("__low"), "UTF-8")
    n = F.octet_length("__b")
    m = m.withColumn("boost", F.col("hundredths") / 100.0)
    score = clamp01(F.col("base") + F.col("boost"))
    score = F.when(F.exists("validators", lambda v: v.isin(*VALIDATORS)), F.least(score + options.validator_bonus, F.lit(options.validator_most))).otherwise(score)
    far_left, far_right = F.greatest(start - AROUND, F.lit(0)), F.least(n, end + AROUND)
    wide = F.make_valid_utf8(byte_slice(F.col("__b"), far_left, far_right).cast("string"))
    both = (F.col("card_boost") > 0) & wide.rlike(CVV) & wide.rlike(EXPIRY)
    m = m.withColumn("confidence", F.when(both, clamp01(score + F.col("card_boost"))).otherwise(score))
    if not raw:
        m = m.where(F.round("confidence", 9) >= options.min_confidence)

    level = F.col("rule_level")
    if catalog.capped_domains:
        capped = "@(?:" + "|".join(d.replace(".", r"\.") for d in catalog.capped_domains) + r")\z"
        level = F.when((F.col("rule_id") == "email_001") & low_value.rlike(capped), F.least(level, F.lit(INTERNAL))).otherwise(level)
    low_wide = latin1(byte_slice(low_bytes, far_left, far_right))
    raised = (F.size("escalation") > 0) & F.exists("escalation", lambda k: F.contains(low_wide, k))
    level = F.when(raised, F.greatest(level, F.col("escalate_to"))).otherwise(level)
    context = F.make_valid_utf8(byte_slice(F.col("__b"), F.greatest(start - SNIPPET, F.lit(0)), F.least(n, end + SNIPPET)).cast("string"))
    return m.select(
        F.col("id").alias(id_col), "chunk_idx", "n_chunks", n.alias("chunk_bytes"), (F.col("pid") * (1 << 20) + F.col("nth")).cast("long").alias("seq"), "rule_id", "rule_name", "pattern_idx", "note", "category",
        (F.col("base_offset") + start).cast("long").alias("offset"), (end - start).cast("int").alias("length"), "boost", "confidence", level.cast("int").alias("level"), mask(value).alias("preview"), context.alias("context"), "value",
        F.when((level < 3) & (n >= 1024), F.col("__b")).alias("__chunk"),
    )


def public(found: DataFrame) -> DataFrame:
    """Without the sensitive columns."""
    return found.drop("__chunk", "value", "context", "rule_name", "note")
