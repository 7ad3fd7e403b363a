"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a 126-bit key: a hash of the text, so that equal texts are
neighbours, then a hash of the id and the row's number. The splitters of that
order are found by counting: each round counts, over all rows, the exact bytes
below 4096 probes inside the interval that still holds a splitter, and descends
into the probe interval around its target. A splitter is settled once its bytes
are within `tolerance` of a shard's size; groups of equal texts are cut only
where no boundary between groups is that near. Then one exchange moves the rows.

The driver sees at most (shards - 1) * 4096 sums a round. Each shard is numbered
in buckets of about BUCKET_ROWS rows, so that no task sorts a whole shard.

Cases: null text counts as empty (size 1); null ids and repeated rows are placed
like others; fewer rows than shards leave some empty; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_of

#: Right shifts of the 63-bit halves of the key, from coarse to exact.
SHIFTS = (51, 39, 27, 15, 3, 0)
BUCKET_ROWS = 100_000


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The shards - 1 boundaries (h, h2) of keys(h, h2, size); a row goes right of a boundary if its key is not below it."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slack = total / shards * tolerance
    found: dict[int, tuple[int, int]] = {}
    #: By splitter: the interval's prefix in each half (None: not fixed yet) and the bytes below it.
    active = {i: (None, None, 0) for i in range(1, shards)}
    for level in range(2 * len(SHIFTS)):
        if not active:
            break
        half, k = divmod(level, len(SHIFTS))
        col, shift = F.col("h2" if half else "h"), SHIFTS[k]
        wanted = {(a, b) for a, b, _ in active.values()}
        conds = []
        for a, b in wanted:
            c = F.lit(True)
            if half:
                c = c & (F.col("h") == a)
                if k:
                    c = c & (F.shiftright("h2", SHIFTS[k - 1]) == b)
            elif k:
                c = c & (F.shiftright("h", SHIFTS[k - 1]) == a)
            conds.append(c)
        rows = keys.where(reduce(or_, conds)).groupBy((F.col("h") if half else F.shiftright(col, SHIFTS[k - 1]) if k else F.lit(0)).alias("a"), (F.shiftright("h2", SHIFTS[k - 1]) if half and k else F.lit(0)).alias("b"), F.shiftright(col, shift).alias("p")).agg(F.sum("size").alias("bytes")).collect()
        by: dict[tuple, list[tuple[int, int]]] = {}
        for r in rows:
            by.setdefault((r["a"], r["b"]), []).append((r["p"], r["bytes"]))
        for v in by.values():
            v.sort()
        for i, (a, b, below) in list(active.items()):
            target = total * i / shards
            children = by.get((a if (half or k) else 0, b if half and k else 0), [])
            acc, best, inside = below, None, None
            for p, n in children:
                if best is None or abs(acc - target) < abs(best[0] - target):
                    best = (acc, p)
                if acc <= target < acc + n:
                    inside = (p, acc)
                acc += n
            end = (acc, children[-1][0] + 1) if children else (below, 0)
            if best is None or abs(end[0] - target) < abs(best[0] - target):
                best = end
            settled = abs(best[0] - target) <= slack or inside is None or level == 2 * len(SHIFTS) - 1
            if settled:
                found[i] = (a, best[1] << shift) if half else (best[1] << shift, 0)
                del active[i]
            elif half:
                active[i] = (a, inside[0], inside[1])
            else:
                active[i] = (inside[0], None, inside[1])
    return [found[i] for i in range(1, shards)]


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot. Bytes per shard are near equal."""
    half = lambda c: F.shiftrightunsigned(c, 1)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("txt"))
    keys = base.select("id", (F.octet_length("txt") + 1).cast("long").alias("size"), F.crc32("txt").alias("crc"), half(F.xxhash64("txt")).alias("h"), F.monotonically_increasing_id().alias("rid"))
    keys = cut(keys.withColumn("h2", half(F.xxhash64("id", "rid"))).drop("rid"))
    n = keys.count()
    edges = find_splitters(keys, shards, tolerance)
    over = [((F.col("h") > a) | ((F.col("h") == a) & (F.col("h2") >= b))).cast("int") for a, b in edges]
    parts = max(1, n // shards // BUCKET_ROWS)
    placed = keys.withColumn("shard", reduce(lambda x, y: x + y, over, F.lit(0))).withColumn("bucket", F.pmod("h2", F.lit(parts)))
    sizes = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("shard", "bucket", (F.sum("m").over(W.partitionBy("shard").orderBy("bucket")) - F.col("m")).alias("first"))
    numbered = placed.withColumn("at", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("h", "h2")))
    out = numbered.join(before, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("at") - 1).cast("long").alias("slot"))
