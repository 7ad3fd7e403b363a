"""Exact dedup by composable polynomial fingerprints.

A text, with every run of white space replaced by one space, is cut into chunks
of bytes. Each chunk is hashed on its own as a polynomial modulo two primes, and
the hashes combine by length-shifted arithmetic:
    H(a + b) = H(a) * BASE ** len(b) + H(b)   (mod P).
So chunks of a huge document can be hashed in any order or place (see
`combine_chunks`), and the fingerprint doesn't depend on the cut. Documents of
equal fingerprint are then compared chunk by chunk with the group's first
document; whoever differs from it goes through another round among its like.

Cases: null text counts as empty; a null id sorts last; of rows that repeat the
smallest id exactly one is kept; an empty table gives an empty result; columns
other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, WS, arrow_bytes, cut, drop_rows, hot_join, text_of, tidy

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1469598103)
CHUNK_BYTES = 1 << 16
#: Members of a group that are compared in one task, about.
GROUP_ROWS = 10_000
KEYS = ["n_bytes", "fp1", "fp2"]


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** (n-1), ..., base, 1 modulo prime."""
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        m = min(size, n - size)
        out[size : size + m] = out[:m] * np.uint64(pow(base, size, prime)) % np.uint64(prime)
        size += m
    return out[::-1].copy()


def chunk_hash(data: np.ndarray, table: np.ndarray, prime: int) -> int:
    """Polynomial hash of one chunk of bytes; table: powers() for the longest chunk."""
    n = len(data)
    return int(np.dot(data.astype(np.uint64) + np.uint64(1), table[len(table) - n :])) % prime if n else 0


def combine(left: tuple[int, int], right: tuple[int, int], base: int, prime: int) -> tuple[int, int]:
    """(hash, length) of the concatenation, from those of its two parts."""
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def fingerprint(data: np.ndarray, tables: list[np.ndarray], primes=PRIMES, bases=BASES) -> tuple[int, ...]:
    step = len(tables[0])
    out = []
    for table, prime, base in zip(tables, primes, bases):
        h = (0, 0)
        for a in range(0, len(data), step):
            part = data[a : a + step]
            h = combine(h, (chunk_hash(part, table, prime), len(part)), base, prime)
        out.append(h[0])
    return tuple(out)


def combine_chunks(chunks: DataFrame, key: str, primes=PRIMES, bases=BASES) -> DataFrame:
    """Fingerprints of documents that are stored as chunk rows (key, chunk_no, chunk binary).

    Each chunk is hashed where it lies; only hashes and lengths are shuffled. The
    group collected per document is its list of (number, length, hashes).
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = arrow_bytes(b.column("chunk"))
            n = int((o[1:] - o[:-1]).max()) if len(b) else 0
            tables = [powers(x, p, max(n, 1)) for x, p in zip(bases, primes)]
            got = [[chunk_hash(d[s:e], t, p) for s, e in zip(o[:-1], o[1:])] for t, p in zip(tables, primes)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("chunk_no"), pa.array(o[1:] - o[:-1], pa.int64()), *[pa.array(g, pa.int64()) for g in got]], names=[key, "no", "len", "h1", "h2"])

    slim = chunks.select(key, F.col("chunk_no").cast("long").alias("chunk_no"), F.coalesce("chunk", F.lit(b"")).alias("chunk"))
    kind = chunks.schema[key].dataType.simpleString()
    each = slim.mapInArrow(tidy(hashes), f"{key} {kind}, no long, len long, h1 long, h2 long")
    parts = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("no", "len", "h1", "h2"))).alias("p"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column("p").to_pylist():
                hs = [(0, 0), (0, 0)]
                for c in p:
                    hs = [combine(h, (c[f"h{i + 1}"], c["len"]), bases[i], primes[i]) for i, h in enumerate(hs)]
                rows.append((hs[0][1], hs[0][0], hs[1][0]))
            yield pa.RecordBatch.from_arrays([b.column(key), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]], names=[key, *KEYS])

    return parts.mapInArrow(tidy(fold), f"{key} {kind}, n_bytes long, fp1 long, fp2 long")


def _fingerprints(base: DataFrame, primes, bases, chunk_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [powers(b, p, chunk_bytes) for b, p in zip(bases, primes)]
        for batch in batches:
            d, o = arrow_bytes(batch.column("norm"))
            fps = [fingerprint(d[s:e], tables, primes, bases) for s, e in zip(o[:-1], o[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sha"), pa.array(o[1:] - o[:-1], pa.int64()), pa.array([f[0] for f in fps], pa.int64()), pa.array([f[1] for f in fps], pa.int64())], names=["id", "sha", *KEYS])

    return base.mapInArrow(tidy(run), T.StructType([base.schema["id"], base.schema["sha"], *[T.StructField(k, T.LongType()) for k in KEYS]]))


def _chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """One row per chunk of the normalised text, with the other columns."""
    rest = [c for c in rows.columns if c != "norm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, o = arrow_bytes(batch.column("norm"))
            for i, (s, e) in enumerate(zip(o[:-1], o[1:])):
                cuts = list(range(int(s), int(e), chunk_bytes)) or [int(s)]
                for a in range(0, len(cuts), 64):
                    some = cuts[a : a + 64]
                    take = pa.array([i] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in rest], pa.array(range(a, a + len(some)), pa.int64()), pa.array([d[x : min(x + chunk_bytes, int(e))].tobytes() for x in some], pa.binary())], names=[*rest, "chunk_no", "chunk"])

    return rows.select(*rest, "norm").mapInArrow(tidy(run), T.StructType([*[rows.schema[c] for c in rest], T.StructField("chunk_no", T.LongType()), T.StructField("chunk", T.BinaryType())]))


def _different(base: DataFrame, cand: DataFrame, n_cand: int, chunk_bytes: int) -> DataFrame:
    """(id, sha) of the candidates whose text isn't that of their group's first document."""
    keys = cand.select(F.col("id").alias("c_id"), F.col("sha").alias("c_sha"), *KEYS, "n", F.col("rep.id").alias("rep_id"), F.col("rep.sha").alias("rep_sha")).distinct()
    keys = F.broadcast(keys) if n_cand <= BROADCAST_ROWS else keys.hint("shuffle_hash")
    texts = base.join(keys, base["id"].eqNullSafe(F.col("c_id")) & (base["sha"] == F.col("c_sha")))
    is_rep = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("sha") == F.col("rep_sha"))
    texts = texts.select("id", "sha", *KEYS, is_rep.alias("is_rep"), F.ceil(F.col("n") / GROUP_ROWS).cast("long").alias("parts"), "norm")
    pieces = _chunks(texts, chunk_bytes)
    member = pieces.where(~F.col("is_rep")).withColumn("part", F.pmod(F.xxhash64("id", "sha"), "parts"))
    first = pieces.where("is_rep").select(*KEYS, "chunk_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("chunk").alias("rep_chunk")).dropDuplicates([*KEYS, "part", "chunk_no"])
    return member.join(first, [*KEYS, "part", "chunk_no"]).where(F.col("chunk") != F.col("rep_chunk")).select("id", "sha").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES, bases=BASES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    base = docs.select(F.col(id_col).alias("id"), F.regexp_replace(text_of(text_col), WS, " ").alias("norm")).withColumn("sha", F.sha2("norm", 256))
    todo = cut(_fingerprints(base, primes, bases, chunk_bytes).withColumn("rid", F.monotonically_increasing_id()))
    total = todo.count()
    done = None
    turn = 0
    while True:
        groups = cut(todo.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.isnull("id").alias("no_id"), "id", "rid", "sha")).alias("rep")))
        several = groups.where("n > 1")
        n_cand = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        wrong = None
        if n_cand:
            wrong = cut(_different(base, hot_join(todo, several, KEYS, "n", total), n_cand, chunk_bytes))
            wrong = None if wrong.isEmpty() else wrong
        if wrong is None:
            out = hot_join(todo, groups, KEYS, "n", total)
            out = out.select("id", "rid", "sha", F.col("rep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("rep.rid")).alias("kept"))
            done = out if done is None else done.unionByName(out)
            return done.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
        w = wrong.select(F.col("id").alias("w_id"), F.col("sha").alias("w_sha"))
        on = F.col("id").eqNullSafe(F.col("w_id")) & (F.col("sha") == F.col("w_sha"))
        right = cut(todo.join(w, on, "left_anti"))
        sizes = right.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.isnull("id").alias("no_id"), "id", "rid", "sha")).alias("rep"))
        out = hot_join(right, sizes, KEYS, "n", total).select("id", "rid", "sha", F.col("rep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("rep.rid")).alias("kept"))
        done = out if done is None else done.unionByName(out)
        todo = cut(todo.join(w, on, "left_semi"))
        turn += 1


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    judged = exact_dedup(docs, id_col, text_col, **options).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("key"), "kept")
    return drop_rows(docs, judged, id_col, F.sha2(F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), WS, " "), 256))
