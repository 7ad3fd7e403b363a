"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target is its share of the whole mix, at most `most` times its size;
the rate target / size is the expected number of copies of each of its
documents. Its whole part is certain, the fraction is rounded: documents of a
source lie ordered by size, longest first so that what is left over is short, in
leaves of about LEAF_ITEMS. In a leaf, fractions
meet in turn and mass moves at random from one to the other until one is
integral, which is decided; the mass is counted in words, so that no meeting
changes the expected words of the source. What is left of the leaf is one
fraction at most.
Leaves' residuals meet in the same way, LEAF_ITEMS at a time, up a tree to one
residual per source, of a short document. Every document keeps its expectation,
and a source misses its target by less than that document.

All draws are hashes of `seed`, the id and the text, so that reruns agree.

Cases: null text counts as empty (size 0, nothing to take); a null source is a
source of its own, the last; null ids are ids like others; rows that repeat id,
source and text share one decision; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, hot_join, text_of

LEAF_ITEMS = 256
EPS = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes(source, source_size, n), one row per source -> with target. The one window without partitions sees a row per source."""
    ordered = W.orderBy(F.isnull("source"), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # Sources reach their cap in the order of cap / weight. One is capped if the rest, shared by weight from it on, would exceed its cap.
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.isnull("source"), "source")
    everything = W.partitionBy(F.lit(0))
    t = t.withColumn("all_w", F.sum("w").over(everything)).withColumn("mix", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("rest_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))).withColumn("rest", F.col("mix") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("capped", F.col("cap") * F.col("rest_w") <= F.col("w") * F.col("rest"))
    level = F.max(F.when(~F.col("capped"), F.struct(-F.col("cap") / F.col("w"), F.col("rest") / F.col("rest_w")).alias("x"))).over(everything)
    t = t.withColumn("level", level).withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("level.col2")))
    return t.select("source", "source_size", "n", "target")


def _draw(level: int, seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *keys), 11) / F.lit(float(1 << 53))


def _meet(items: Column, kind: str, level: int, seed: int) -> Column:
    """One leaf: array of (size, k, p) -> (has, k, size, p, done): the residual, and what was decided.

    A meeting moves t words of expected mass one way or the other, with chances
    that keep both expectations: p_a * size_a + p_b * size_b stays as it is.
    """
    done_type = f"array<struct<k:{kind},z:int>>"
    none = F.array().cast(done_type)

    def state(has: Column, k: Column, size: Column, p: Column, done: Column) -> Column:
        return F.struct(has.alias("has"), k.cast(kind).alias("k"), size.cast("bigint").alias("size"), p.cast("double").alias("p"), done.cast(done_type).alias("done"))

    def decided(k: Column, z: Column) -> Column:
        return F.array(F.struct(k.alias("k"), z.cast("int").alias("z"))).cast(done_type)

    def left(k: Column, size: Column, p: Column, done: Column) -> Column:
        """The residual, decided as well if it is integral by now."""
        whole = (p < EPS) | (p > 1 - EPS)
        return state(~whole, k, size, p, F.concat(done, F.when(whole, decided(k, F.round(p))).otherwise(none)))

    def merge(acc: Column, x: Column) -> Column:
        a, b, sa, sb = acc["p"], x["p"], acc["size"], x["size"]
        up, down = F.least((1 - a) * sa, b * sb), F.least(a * sa, (1 - b) * sb)
        u = _draw(level, seed, x["k"])
        keep_x = lambda z, p: left(x["k"], sb, p, F.concat(acc["done"], decided(acc["k"], F.lit(z))))
        keep_a = lambda z, p: left(acc["k"], sa, p, F.concat(acc["done"], decided(x["k"], F.lit(z))))
        rise = F.when((1 - a) * sa <= b * sb, keep_x(1, b - up / sb)).otherwise(keep_a(0, a + up / sa))
        fall = F.when(a * sa <= (1 - b) * sb, keep_x(0, b + down / sb)).otherwise(keep_a(1, a - down / sa))
        return F.when(~acc["has"], state(F.lit(True), x["k"], sb, b, acc["done"])).when(u < down / (up + down), rise).otherwise(fall)

    start = state(F.lit(False), F.lit(None), F.lit(0), F.lit(0.0), none)
    return F.aggregate(items, start, merge)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """One row per document: id, source, th (hash of the text), size in words, source_size, target, copies."""
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_of(text_col).alias("txt"))
    rows = cut(base.select("id", "source", F.regexp_count("txt", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("txt").alias("th")))
    total = rows.count()
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = cut(source_targets(sizes, weights, share, most))

    keys = rows.groupBy("id", "source", "th").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keys = cut(hot_join(cut(keys), targets, ["source"], "n", total).withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole")).drop("n"))
    open_ = keys.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS) & (F.col("size") > 0)).withColumn("class", F.floor(F.log2("size") * 8))

    classes = open_.groupBy("source", "class").agg(F.count(F.lit(1)).alias("m"))
    classes = classes.withColumn("first", F.sum("m").over(W.partitionBy("source").orderBy("class")) - F.col("m"))
    leaf = F.floor(F.col("first") / LEAF_ITEMS) + F.pmod(F.xxhash64(F.lit(seed), "id", "th"), F.ceil(F.col("m") / LEAF_ITEMS))
    k = F.struct("id", "th")
    kind = open_.select(k.alias("k")).schema["k"].dataType.simpleString()
    items = hot_join(open_, cut(classes), ["source", "class"], "m", total).select("source", leaf.cast("long").alias("node"), F.struct("size", k.alias("k"), "p").alias("item"))
    met = cut(items.groupBy("source", "node").agg(F.sort_array(F.collect_list("item"), False).alias("items")).select("source", "node", _meet(F.col("items"), kind, 0, seed).alias("r")))
    decided = met.select("source", F.explode("r.done").alias("d")).select("source", "d.k", "d.z")

    # The tree above the leaves: k is now the leaf whose residual a fraction is.
    last = met.agg(F.max("node")).first()[0]
    left = met.where("r.has").select("source", "node", F.col("r.size").alias("size"), F.col("node").alias("k"), F.col("r.p").alias("p"))
    leaves = None
    level = 1
    while last is not None:
        last //= LEAF_ITEMS
        group = F.floor(F.col("node") / LEAF_ITEMS).cast("long")
        up = cut(left.groupBy("source", group.alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "size", "k", "p")), False).alias("items")).select("source", "node", _meet(F.col("items"), "bigint", level, seed).alias("r")))
        some = up.select("source", F.explode("r.done").alias("d")).select("source", F.col("d.k").alias("node"), "d.z")
        leaves = some if leaves is None else leaves.unionByName(some)
        left = up.where("r.has").select("source", "node", F.col("r.size").alias("size"), F.col("r.k").alias("k"), F.col("r.p").alias("p"))
        level += 1
        if last == 0:
            top = left.select("source", F.col("k").alias("node"), (_draw(level, seed, F.col("source"), F.col("k")) < F.col("p")).cast("int").alias("z"))
            leaves = leaves.unionByName(top)
            break
    if leaves is not None:
        r = met.where("r.has").select(F.col("source").alias("s"), F.col("node").alias("at"), F.col("r.k").alias("k"))
        decided = decided.unionByName(r.join(leaves, r["s"].eqNullSafe(leaves["source"]) & (r["at"] == leaves["node"])).select(F.col("s").alias("source"), "k", "z"))
    decided = decided.select(F.col("source").alias("z_source"), F.col("k.id").alias("z_id"), F.col("k.th").alias("z_th"), "z")
    on = F.col("id").eqNullSafe(F.col("z_id")) & F.col("source").eqNullSafe(F.col("z_source")) & (F.col("th") == F.col("z_th"))
    near_one = F.when(F.col("p") >= 1 - EPS, 1).otherwise(0)
    final = keys.join(decided, on, "left").select("id", "source", "th", "c", "source_size", "target", (F.col("whole") + F.coalesce("z", near_one)).cast("long").alias("copies"))
    return hot_join(rows, cut(final), ["id", "source", "th"], "c", total).drop("c").withColumnsRenamed({"id": id_col, "source": source_col})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken, with all columns of docs."""
    got = copies(docs, id_col, text_col, source_col, **options).where("copies > 0").select(F.col(id_col).alias("__sparksift_id"), F.col(source_col).alias("__sparksift_source"), F.col("th").alias("__sparksift_th"), F.col("copies").alias("__sparksift_copies")).distinct()
    on = docs[id_col].eqNullSafe(F.col("__sparksift_id")) & docs[source_col].eqNullSafe(F.col("__sparksift_source")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("__sparksift_th"))
    both = docs.join(got.hint("shuffle_hash"), on)
    return both.withColumn("__sparksift_copy", F.explode(F.sequence(F.lit(1), F.col("__sparksift_copies")))).select(*docs.columns)
