"""The same row-level transformations over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import findings, public
from ..rules.catalog import DEFAULT
from ..rules.model import Catalog, ScanOptions


def findings_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog: Catalog = DEFAULT, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of a stream of documents. Stateless: each micro-batch is scanned as a table would be."""
    return public(findings(docs, id_col, text_col, catalog, options))


def once(found: DataFrame, time_col: str, delay: str, keys: list[str]) -> DataFrame:
    """The first of repeated findings that arrive within the delay; state is dropped behind the watermark."""
    return found.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events per window and key, for batch and stream alike."""
    d = events.withWatermark(time_col, delay) if events.isStreaming else events
    return d.groupBy(F.window(time_col, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
