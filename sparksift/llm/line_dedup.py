"""Line dedup with DataFrame functions only.

A line's key is the line without white space at its ends and with A-Z lower-cased.
Keys of at least `min_chars` code points that occur in at least `min_docs`
documents lose all their lines, except in the document of the largest id that
has the key. Keys are compared by two 64-bit hashes, 128 bits together.

Pass 1 explodes each document's distinct keys and counts them (partial counts
before the shuffle, so a line in a third of all documents is no hot group).
Pass 2 looks its lines up in the surviving keys, which are broadcast only up to
BROADCAST_ROWS, and collects the dropped positions of each document.

Cases: null or empty text is one empty line; each row counts as a document; a
null id is below all others, and a key whose rows all have a null id drops
nothing; rows that repeat id and text get the same result; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, ascii_lower, cut, hot_join, text_of

BROADCAST_ROWS = 100_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS_CHARS)))


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("2"), F.col(key)).alias("h2")]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept_text."""
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("txt")).withColumn("th", F.xxhash64("txt"))
    lines = F.split("txt", "\n", -1)
    long_lines = F.filter(lines, lambda x: F.length(x) >= min_chars)
    keys = F.array_distinct(F.filter(F.transform(long_lines, line_key), lambda k: F.length(k) >= min_chars))
    counts = base.select("id", F.explode(keys).alias("key")).select("id", *_hashes("key")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    common = cut(counts.where(F.col("n") >= min_docs))
    n_common, total = common.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    at = base.select("id", "th", F.posexplode(lines).alias("pos", "line")).where(F.length("line") >= min_chars).select("id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars).select("id", "th", "pos", *_hashes("key"))
    if n_common <= BROADCAST_ROWS:
        found = at.join(F.broadcast(common), ["h1", "h2"])
    else:
        found = hot_join(cut(at.join(common.select("h1", "h2"), ["h1", "h2"], "left_semi")), common, ["h1", "h2"], "n", total)
    gone = found.where(F.col("last").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("last"))))
    drops = gone.groupBy(F.col("id").alias("d_id"), F.col("th").alias("d_th")).agg(F.collect_set("pos").alias("gone"))

    out = base.join(drops.hint("shuffle_hash"), base["id"].eqNullSafe(F.col("d_id")) & (base["th"] == F.col("d_th")), "left")
    out = out.withColumn("lines", F.split("txt", "\n", -1))
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("txt")).otherwise(F.array_join(F.transform(rest, lambda i: F.col("lines")[i]), "\n"))
    return out.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
