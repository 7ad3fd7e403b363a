"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

A text is the multiset of its shingles. Each pair of a shingle and a dyadic
interval of weights, (0,1], (1,2], (2,4], (4,8] .., has a Poisson process whose
rate is the interval's length; a point has a time, a register and, for an
interval that the weight only partly covers, a weight, which must not exceed the
shingle's. A register's value is its earliest point. Two texts agree in a
register with the probability of their weighted Jaccard similarity. Points are
made in the order of time up to a limit at which all registers are full, so that
most shingles of a long text cost one comparison.

Texts of equal words are one node from the start. Registers are banded, and links
are pairs of nodes whose exact multiset overlap reaches the threshold:
1. Every node that shares a bucket is compared with one node, the least of the
   first nodes of its buckets. These links join most of a group of copies.
2. Where a bucket still holds several components, links between those can be
   missing. Its nodes' shingles are put in one order, rarest first. Two texts of
   the least overlap share a shingle among the first of each, as many as their
   sizes allow, at places that leave room for that overlap; only such pairs of
   different components are compared. Copies of one template whose own parts
   differ by more than the threshold thus give no pairs at all, and a shingle of
   a large component pairs its nodes with others alone.
Every link between components that share a bucket is found by 2, and nothing is
capped. To compare, the text of a first node meets those of its partners, which
are spread over groups of GROUP_ROWS.

Cases: null text counts as empty; texts without words are equal; fewer than five
words make one shingle; null ids sort last; rows that repeat an id are rows of
their own, one row of a class is kept; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, arrow_bytes, cut, drop_rows, hot_join, mix64, text_of, tidy
from .components import components
from .words import sequence_hashes, shingle_hashes, word_hashes

BANDS, ROWS = 24, 4
#: Partners of one node that are compared in one task, about.
GROUP_ROWS = 5_000
_G = np.uint64(0x9E3779B97F4A7C15)


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def bag(g: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their counts, and the text of each; sorts the shingles of each text in place."""
    for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
        g[a:b].sort()
    if not len(g):
        return g, np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    new[start[:-1][np.diff(start) > 0]] = True
    at = np.flatnonzero(new)
    return g[at], np.diff(np.append(at, len(g))), np.searchsorted(start, at, side="right") - 1


def bag_minhash(items: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Registers (n, k) of n multisets: the bits of the earliest times. Empty multisets have infinite times."""
    seeds, rates, least, most, owners = [], [], [], [], []
    j = 0
    while True:
        low = 0 if j == 0 else 1 << (j - 1)
        has = counts > low
        if not has.any():
            break
        c, size = counts[has], max(low, 1)
        seeds.append(mix64(items[has] + np.uint64((j + 1) * int(_G) & (2**64 - 1))))
        rates.append(np.full(len(c), 1.0 / size))
        least.append(np.full(len(c), low, np.int64))
        most.append(np.minimum(c, low + size))
        owners.append(owner[has])
        j += 1
    times = np.full(n * k, np.inf)
    if not seeds:
        return times.view(np.uint64).reshape(n, k)
    seed, gap, low, top, own = (np.concatenate(x) for x in (seeds, rates, least, most, owners))
    size = np.maximum(low, 1)
    weight = np.bincount(owner, weights=counts, minlength=n)
    limit = np.where(weight > 0, k * (math.log(k) + 5.0) / np.maximum(weight, 1), 0.0)
    state = mix64(seed + _G)
    t = -np.log(_uniform(state)) * gap
    live = np.flatnonzero(t <= limit[own])
    while True:
        while len(live):
            bits = mix64(state[live] ^ np.uint64(0x5851F42D4C957F2D))
            register = (bits >> np.uint64(33)).astype(np.int64) % k
            place = low[live] + 1 + (bits & np.uint64(0xFFFFFFFF)).astype(np.int64) % size[live]
            ok = place <= top[live]
            np.minimum.at(times, own[live[ok]] * k + register[ok], t[live[ok]])
            state[live] = mix64(state[live] + _G)
            t[live] -= np.log(_uniform(state[live])) * gap[live]
            live = live[t[live] <= limit[own[live]]]
        open_ = np.isinf(times.reshape(n, k)).any(axis=1) & (weight > 0)
        if not open_.any():
            return times.view(np.uint64).reshape(n, k)
        limit[open_] *= 2
        live = np.flatnonzero(open_[own] & (t <= limit[own]))


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    r = registers.reshape(len(registers), bands, rows)
    h = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), r.shape[:2]).copy()
    for i in range(rows):
        h = mix64(h * np.uint64(31) + r[:, :, i])
    return h.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, th (hash of the text), fp1, fp2 (hashes of its words), n (shingles), bands."""
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("txt")).withColumn("th", F.xxhash64("txt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrow_bytes(b.column("txt"))
            for i, j, h, at in word_hashes(data, offsets):
                f1, f2 = sequence_hashes(h, at)
                g, start = shingle_hashes(h, at)
                n = np.diff(start)
                items, counts, owner = bag(g, start)
                keys = band_hashes(bag_minhash(items, counts, owner, j - i, bands * rows), bands, rows)
                some = n > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(n.astype(np.int64)), lists], names=["id", "th", "fp1", "fp2", "n", "bands"])

    schema = T.StructType([base.schema["id"], *[T.StructField(c, T.LongType()) for c in ("th", "fp1", "fp2", "n")], T.StructField("bands", T.ArrayType(T.LongType()))])
    return base.select("id", "th", "txt").mapInArrow(tidy(run), schema)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    values, at = np.unique(both, return_index=True)
    total = np.diff(np.append(at, len(both)))
    in_a = np.searchsorted(a, values, side="right") - np.searchsorted(a, values, side="left")
    common = int(np.minimum(in_a, total - in_a).sum())
    return common / (len(both) - common)


def _texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, repeats: bool) -> DataFrame:
    """wanted(nid, ..) with the nodes' texts."""
    slim = cut(wanted.join(nodes.select("nid", "id", "th"), "nid"))
    base = docs.select(F.col(id_col).alias("d_id"), text_of(text_col).alias("txt")).withColumn("d_th", F.xxhash64("txt"))
    if repeats:
        base = base.dropDuplicates(["d_id", "d_th"])
    side = F.broadcast(slim) if slim.count() <= BROADCAST_ROWS else slim
    return base.join(side, F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_th") == F.col("th"))).select(*wanted.columns, "txt")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, threshold: float, repeats: bool) -> DataFrame:
    """The pairs (a, b) whose texts' exact overlap reaches the threshold. The text of a is sent once to each group of its partners."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("long").alias("parts"))
    heads = groups.select("a", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.col("a").alias("nid"), F.lit(0).alias("role"))
    parts = F.broadcast(groups.where("parts > 1"))  # fewer than pairs / GROUP_ROWS
    members = pairs.join(parts, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.col("b").alias("nid"), F.lit(1).alias("role"))
    texts = _texts_of(heads.unionByName(members), nodes, docs, id_col, text_col, repeats)
    ordered = texts.repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for batch in batches:
            data, offsets = arrow_bytes(batch.column("txt"))
            a, part, role, nid = (batch.column(c).to_pylist() for c in ("a", "part", "role", "nid"))
            found = []
            for i, j, h, at in word_hashes(data, offsets):
                g, start = shingle_hashes(h, at)
                for k in range(i, j):
                    bag_ = np.sort(g[start[k - i] : start[k - i + 1]])
                    if role[k] == 0:
                        key, first = (a[k], part[k]), bag_
                    elif key == (a[k], part[k]) and overlap(first, bag_) >= threshold:
                        found.append((a[k], nid[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return ordered.select("a", "part", "role", "nid", "txt").mapInArrow(tidy(run), "a long, b long")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """texts(nid, comp, txt) -> (nid, comp, n, items): the multiset as a set, of hashes of each shingle and the number of its occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrow_bytes(b.column("txt"))
            for i, j, h, at in word_hashes(data, offsets):
                g, start = shingle_hashes(h, at)
                items, counts, _ = bag(g, start)
                first = np.repeat(np.cumsum(counts) - counts, counts)
                each = mix64(np.repeat(items, counts) + (np.arange(len(g)) - first).astype(np.uint64) * _G)
                lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(each.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("nid").slice(i, j - i), b.column("comp").slice(i, j - i), pa.array(np.diff(start)), lists], names=["nid", "comp", "n", "items"])

    return texts.select("nid", "comp", "txt").mapInArrow(tidy(run), "nid long, comp long, n long, items array<long>")


def across(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of sets(nid, comp, n, items) of different components that can reach the threshold.

    Items are ordered by the number of sets that hold them, then by hash; one that
    no other set has needs no place but counts as earlier. Of a pair, the smaller
    set's item is among its first n - 2t/(1+t)n and the other's among its first
    n - tn; at their first common item, both have enough items left.
    """
    t = threshold
    each = sets.select("nid", F.explode("items").alias("item"))
    common = cut(each.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    total = common.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    held = hot_join(each, common, ["item"], "df", total).groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("o"))
    room = F.floor(F.col("n") * (1 - t) + 1e-6) + 1 - (F.col("n") - F.size("o"))  # places below n - tn that the common items fill
    first = F.slice("o", 1, F.greatest(room, F.lit(0)).cast("int"))
    spots = sets.select("nid", "comp", "n").join(held, "nid").select("nid", "comp", "n", (F.col("n") - F.size("o")).alias("alone"), F.posexplode(first).alias("k", "x"))
    spots = cut(spots.select("nid", "comp", "n", F.col("x.item").alias("item"), (F.col("n") - F.col("alone") - F.col("k")).alias("left")))
    n_spots = spots.count()
    by = spots.groupBy("item", "comp").agg(F.count(F.lit(1)).alias("m"))
    by = cut(by.groupBy("item").agg(F.max(F.struct("m", "comp")).alias("x"), F.count(F.lit(1)).alias("comps"), F.sum("m").alias("m")).where("comps > 1").select("item", "m", F.col("x.comp").alias("main")))
    rows = cut(hot_join(spots, by, ["item"], "m", n_spots).select("item", "nid", "comp", "n", "left", (F.col("comp") != F.col("main")).alias("out")))
    small = rows.where((1 + t) * F.col("left") >= 2 * t * F.col("n") - 1e-6).select("item", *[F.col(c).alias(f"{c}_a") for c in ("nid", "comp", "n", "left", "out")])
    need = t * (F.col("n_a") + F.col("n")) - 1e-6
    fits = (F.col("comp_a") != F.col("comp")) & (F.col("n_a") <= F.col("n")) & (F.col("n_a") >= t * F.col("n") - 1e-6) & ((1 + t) * F.col("left_a") >= need) & ((1 + t) * F.col("left") >= need)
    pairs = small.where("out_a").join(rows, "item").where(fits).unionByName(small.where("not out_a").join(rows.where("out"), "item").where(fits))
    return pairs.select(F.least("nid_a", "nid").alias("a"), F.greatest("nid_a", "nid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, class_id (least id of its class), class_size, kept, th."""
    each = cut(signatures(docs, id_col, text_col, bands, rows).withColumn("rid", F.monotonically_increasing_id()))
    total = each.count()
    repeats = not each.groupBy("id", "th").count().where("count > 1").isEmpty()
    first = F.min(F.struct(F.isnull("id").alias("no_id"), "id", "th", "rid")).alias("first")
    nodes = each.groupBy("fp1", "fp2").agg(F.count(F.lit(1)).alias("copies"), first, F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(nodes.select("fp1", "fp2", "copies", "n", "bands", F.col("first.id").alias("id"), F.col("first.th").alias("th")).withColumn("nid", F.monotonically_increasing_id()))
    buckets = nodes.select("nid", "n", F.explode("bands").alias("h"))
    fits = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)

    heads = cut(buckets.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("nid", "n")).alias("head")).where("m > 1"))
    n_heads, entries = heads.agg(F.count(F.lit(1)), F.coalesce(F.sum("m"), F.lit(0))).first()
    shared = cut(buckets.join(F.broadcast(heads), "h") if n_heads <= BROADCAST_ROWS else hot_join(buckets, heads, ["h"], "m", entries))
    star = shared.where((F.col("nid") != F.col("head.nid")) & fits(F.col("n"), F.col("head.n")))
    star = cut(star.groupBy(F.col("nid").alias("b")).agg(F.min("head.nid").alias("a")))
    links = cut(verified(star, docs, nodes, id_col, text_col, threshold, repeats))
    comps = components(links)

    # Buckets of several components, and links between those.
    labelled = cut(shared.join(comps, shared["nid"] == comps["node"], "left").select("h", "nid", F.coalesce("comp", "nid").alias("comp")))
    mixed = labelled.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h", "m")
    mixed = cut(hot_join(labelled, mixed, ["h"], "m", entries).select("nid", "comp").distinct())
    if not mixed.isEmpty():
        sets = cut(shingle_sets(_texts_of(mixed, nodes, docs, id_col, text_col, repeats)))
        extra = cut(verified(cut(across(sets, threshold)), docs, nodes, id_col, text_col, threshold, repeats))
        if not extra.isEmpty():
            links = links.unionByName(extra)
            comps = components(links)

    placed = nodes.join(comps, nodes["nid"] == comps["node"], "left").select("fp1", "fp2", "copies", F.coalesce("comp", "nid").alias("comp"))
    out = cut(hot_join(each.select("id", "th", "fp1", "fp2", "rid"), cut(placed), ["fp1", "fp2"], "copies", total))
    classes = cut(out.groupBy("comp").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.isnull("id").alias("no_id"), "id", "rid")).alias("head")))
    out = hot_join(out, classes, ["comp"], "class_size", total)
    return out.select(F.col("id").alias(id_col), F.col("head.id").alias("class_id"), "class_size", (F.col("rid") == F.col("head.rid")).alias("kept"), "th")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with all columns of docs."""
    judged = near_duplicates(docs, id_col, text_col, **options).select(F.col(id_col).alias("id"), F.col("th").alias("key"), "kept")
    return drop_rows(docs, judged, id_col, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
