"""Texts cut into overlapping windows of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import byte_slice, latin1
from ..rules.model import ScanOptions


def bounds(n: Column, size: int, overlap: int) -> Column:
    """(chunk_idx, start, end) of the windows over n bytes; one window for up to `size` bytes, none for none."""
    count = F.ceil(n / size).cast("int")
    one = lambda i: F.struct(i.cast("int").alias("chunk_idx"), F.greatest(i.cast("long") * size - overlap, F.lit(0)).cast("long").alias("start"), F.least(n.cast("long"), (i.cast("long") + 1) * size).alias("end"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<struct<chunk_idx:int,start:bigint,end:bigint>>"))


def chunk(docs: DataFrame, text_col: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """docs with chunk_idx, base_offset, n_chunks and chunk instead of the text.

    A window that begins or ends inside a character drops that character's bytes,
    and its base offset counts them, so offsets stay those of the text.
    """
    n = F.octet_length(text_col)
    keep = [c for c in docs.columns if c != text_col]
    d = docs.where(n > 0).withColumn("__w", F.explode(bounds(n, options.chunk_bytes, options.overlap_bytes))).withColumn("n_chunks", F.ceil(n / options.chunk_bytes).cast("int"))
    raw = byte_slice(F.encode(F.col(text_col), "UTF-8"), F.col("__w.start"), F.col("__w.end"))
    head = F.length(F.regexp_extract(latin1(F.substring(raw, 1, 3)), "^[\u0080-¿]{0,3}", 0))
    tail = F.length(F.regexp_extract(latin1(F.substring(raw, -3, 3)), "(?:[Â-ß]|[à-ï][\u0080-¿]?|[ð-ô][\u0080-¿]{0,2})$", 0))
    cut = F.substring(raw, head + 1, F.octet_length(raw) - head - tail).cast("string")
    whole = F.col("n_chunks") == 1
    return d.select(*keep, F.col("__w.chunk_idx").alias("chunk_idx"), "n_chunks", F.when(whole, F.lit(0)).otherwise(F.col("__w.start") + head).cast("long").alias("base_offset"), F.when(whole, F.col(text_col)).otherwise(cut).alias("chunk"))
