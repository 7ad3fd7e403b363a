"""Results as JSON lines, CSV rows, audit rows and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import STATES, label_of, state_label


def json_rows(results: DataFrame, path_col: str) -> DataFrame:
    """One JSON value per document."""
    status = F.coalesce("status_code", F.lit(STATES.index("OK"))) if "status_code" in results.columns else F.lit(STATES.index("OK"))
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    took = F.col("scan_duration_ms") if "scan_duration_ms" in results.columns else F.lit(0)
    return results.select(F.to_json(F.struct(F.col(path_col).alias("path"), status.alias("status_code"), "level_code", "level", took.cast("long").alias("scan_duration_ms"), "matches", error.alias("error"))).alias("value"))


def text_rows(results: DataFrame, path_col: str, most: int = 3) -> DataFrame:
    """A block of text per document: status, level, the first `most` findings (0: all) and how many more there are."""
    status = state_label(F.col("status_code")) if "status_code" in results.columns else F.lit("OK")
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    took = F.col("scan_duration_ms") if "scan_duration_ms" in results.columns else F.lit(0)
    n = F.coalesce(F.size("matches"), F.lit(0))
    shown = F.slice("matches", 1, most) if most else F.col("matches")
    lines = F.transform(shown, lambda m: F.format_string("  - %s conf=%.2f offset=%d len=%d", m["rule_id"], m["confidence"], m["offset"], m["length"]))
    more = F.when((n > most) & F.lit(most > 0), F.array(F.format_string("  ... and %d more matches", n - most))).otherwise(F.array().cast("array<string>"))
    body = F.when(error.isNotNull(), F.array(F.concat(F.lit("  error: "), error))).when(n == 0, F.array(F.lit("  no findings"))).otherwise(F.concat(lines, more))
    head = F.array(F.concat(F.lit("["), status, F.lit("/"), "level", F.lit("] "), F.col(path_col).cast("string")), F.format_string("  matches: %d  duration: %dms", n, took.cast("long")))
    return results.select(F.array_join(F.concat(head, body), "\n").alias("value"))


def csv_rows(results: DataFrame, path_col: str) -> DataFrame:
    """A row per finding, or one with empty finding fields."""
    status = state_label(F.col("status_code")) if "status_code" in results.columns else F.lit("OK")
    error = F.coalesce("error", F.lit("")) if "error" in results.columns else F.lit("")
    r = results.select(F.col(path_col).alias("path"), status.alias("status"), "level", F.explode_outer("matches").alias("m"), error.alias("error"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return r.select("path", "status", "level", text("m.rule_id").alias("rule_id"), text("m.offset").alias("offset"), text("m.length").alias("length"), F.when(F.col("m.confidence").isNull(), "").otherwise(F.format_string("%.4f", "m.confidence")).alias("confidence"), "error")


def audit_rows(results: DataFrame, path_col: str, least: int = 1) -> DataFrame:
    """A row per finding of the documents at `least` or above."""
    r = results.where(F.col("level_code") >= least).select(F.col(path_col).alias("path"), "level", F.explode("matches").alias("m"))
    return r.select("path", "level", F.col("m.rule_id").alias("rule"), F.col("m.offset").alias("offset"), F.round("m.confidence", 4).alias("confidence"))


def evaluation_rows(pairs: DataFrame, path_col: str) -> DataFrame:
    """A row per evaluated document, as of the evaluation's CSV; is_edge, duration_ms and error where pairs has them."""
    own = lambda c, none: F.col(c) if c in pairs.columns else none
    return pairs.select(F.col(path_col).alias("file"), "expected", "predicted", (F.col("expected") == F.col("predicted")).alias("correct"), own("is_edge", F.lit(False)).alias("is_edge"), F.format_string("%.2f", own("duration_ms", F.lit(0)).cast("double")).alias("duration_ms"), F.coalesce(own("error", F.lit(None).cast("string")), F.lit("")).alias("error"))


def write_audit(results: DataFrame, path_col: str, path: str, least: int = 1) -> None:
    """Appends JSON lines with the time of writing."""
    audit_rows(results, path_col, least).withColumn("ts", F.current_timestamp()).write.mode("append").json(path)


def summary(results: DataFrame, least: int = 1) -> str:
    """Text block: documents scanned, and shown documents per level."""
    rows = {r["level_code"]: r["n"] for r in results.groupBy("level_code").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")
    return "\n".join([f"scanned: {sum(rows.values())}", *[f"{names[k]}: {rows.get(k, 0)}" for k in range(least, 4)]])


def wire(results: DataFrame) -> DataFrame:
    """Codes of a service response: level, status, and 0 as the error code of OK and skipped documents."""
    ok = F.col("status_code").isin(STATES.index("OK"), *[i for i, s in enumerate(STATES) if s.startswith("SKIPPED")])
    return results.withColumn("level_name", label_of(F.col("level_code"))).withColumn("error_code", F.when(ok, 0).otherwise(F.col("status_code")))
