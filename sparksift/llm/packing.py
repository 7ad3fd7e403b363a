"""Best-fit packing by a grouping genetic algorithm.

Documents become token ids and are cut into pieces of at most `capacity`; only
the first piece of a longer document may be shorter. Full pieces are sequences
of their own. The others are spread at random over blocks of about BLOCK_ITEMS,
each a bin-packing problem of bounded size, and every block is worked on by
several islands, which are spread over all cores. An island starts from best-fit-decreasing and
perturbed best-fit packings. A crossover injects whole well-filled bins of one
parent into the other, removes the bins that hold duplicates of them and best-
fits the displaced pieces, longest first. Between epochs the best packing of
each island migrates to the next island of its block; the best of all is kept.

Cases: null text counts as empty and is one piece, the end mark alone; null ids
and repeated rows are packed like others; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import random
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_of, tidy, trimmed

BLOCK_ITEMS = 16_384
#: Merging one piece of text of n characters takes n ** 2 steps in the fast tokenizer; longer runs than this go to the other one.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def default_vocabulary() -> tuple[str, str, str]:
    """Paths of the vocabulary (tokenizers), of the same vocabulary as ranks (tiktoken), and the pattern of its words."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def make_encoder(vocabulary: tuple[str, str, str]):
    """text -> bytes of its ids (little-endian, 32 bits each): those of tokenizers, without tokens added at the ends.

    tiktoken gives the same ids at a quarter of the CPU time. Texts that hold the
    string of an added token, and those with long runs, go to tokenizers.
    """
    import tiktoken
    from tokenizers import Tokenizer

    json_path, ranks_path, pattern = vocabulary
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    added = tuple(t.content for t in Tokenizer.from_file(json_path).get_added_tokens_decoder().values())
    slow = None  # it takes much memory, and few texts need it

    def encode(text: str) -> bytes:
        nonlocal slow
        if any(t in text for t in added) or len(text) >= 1000 and LONG_RUN.search(text):
            slow = slow or Tokenizer.from_file(json_path)
            return array("I", slow.encode(text, add_special_tokens=False).ids).tobytes()
        return fast.encode_to_numpy(text, disallowed_special=()).tobytes()

    return encode


def pieces_of(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("txt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder(vocabulary)
        end = array("I", [end_id]).tobytes()
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("txt")):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                a, k = 0, 0
                while a < n:
                    e = first if k == 0 else a + capacity
                    at.append(i), piece.append(k), start.append(a), length.append(e - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * e]))
                    a, k = e, k + 1
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    return base.mapInArrow(tidy(run), T.StructType([base.schema["id"], *[T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))]]))


class Bins:
    """A packing in the making: bins of item numbers, and the open bins by their free room."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def open(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.free.append(free)
        if free:
            self.by_free[free].append(len(self.items) - 1)
            self.mask |= 1 << free

    def best_fit(self, item: int) -> None:
        """Into the fullest bin that has room, else into a new one."""
        n = self.sizes[item]
        m = self.mask >> n
        if not m:
            self.open([item], self.capacity - n)
            return
        room = n + (m & -m).bit_length() - 1
        k = self.by_free[room].pop()
        if not self.by_free[room]:
            self.mask ^= 1 << room
        self.items[k].append(item)
        self.free[k] = left = room - n
        if left:
            self.by_free[left].append(k)
            self.mask |= 1 << left

    def fitness(self) -> tuple[int, float]:
        """Fewer bins are better, then fuller ones."""
        return len(self.items), -sum((self.capacity - f) ** 2 for f in self.free)


def packed(order, sizes: list[int], capacity: int) -> Bins:
    b = Bins(sizes, capacity)
    for i in order:
        b.best_fit(i)
    return b


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Well-filled bins of b, the bins of a without their items, and the displaced items best-fitted."""
    limit = sorted(b.free)[len(b.free) // 2]
    share = rng.uniform(0.1, 0.6)
    child = Bins(a.sizes, a.capacity)
    taken: set[int] = set()
    for items, free in zip(b.items, b.free):
        if free <= limit and rng.random() < share:
            child.open(list(items), free)
            taken.update(items)
    displaced: list[int] = []
    for items, free in zip(a.items, a.free):
        if taken.isdisjoint(items):
            # badly filled bins are broken up as well: their items may fit better
            if free > limit and rng.random() < 0.5:
                displaced.extend(items)
            else:
                child.open(list(items), free)
        else:
            displaced.extend(i for i in items if i not in taken)
    for i in sorted(displaced, key=lambda i: -a.sizes[i]):
        child.best_fit(i)
    return child


def from_assignment(assigned: np.ndarray, sizes: list[int], capacity: int) -> Bins:
    groups: list[list[int]] = [[] for _ in range(int(assigned.max()) + 1 if len(assigned) else 0)]
    for i, k in enumerate(assigned.tolist()):
        groups[k].append(i)
    b = Bins(sizes, capacity)
    for g in groups:
        b.open(g, capacity - sum(sizes[i] for i in g))
    return b


def assignment(b: Bins) -> np.ndarray:
    out = np.zeros(len(b.sizes), dtype="<i4")
    for k, items in enumerate(b.items):
        out[items] = k
    return out


def evolve(sizes: list[int], capacity: int, population: list[Bins], seed: int, generations: int, members: int = 3) -> list[Bins]:
    rng = random.Random(seed)
    if not population:
        population = [packed(range(len(sizes)), sizes, capacity)]
    while len(population) < members:  # sizes are sorted, longest first
        noise = rng.uniform(0.01, 0.08) * capacity
        keys = [n + rng.uniform(-noise, noise) for n in sizes]
        population.append(packed(sorted(range(len(sizes)), key=lambda i: -keys[i]), sizes, capacity))
    least = -(-sum(sizes) // capacity)
    for _ in range(generations):
        population.sort(key=Bins.fitness)
        population = population[:members]
        if len(population[0].items) <= least:
            break
        a, b = rng.sample(range(len(population)), 2) if len(population) > 1 else (0, 0)
        population += [crossover(population[a], population[b], rng), crossover(population[b], population[a], rng)]
    population.sort(key=Bins.fitness)
    return population[:members]


STATE = "block long, island int, sizes binary, packing binary, bins long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary=None, islands: int = 3, epochs: int = 2, generations: int = 6, seed: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(pieces_of(docs, id_col, text_col, capacity, end_id, vocabulary or default_vocabulary()).withColumn("rid", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity).select("*", (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    n = rest.count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)))

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = np.sort(pdf["length"].to_numpy())[::-1].astype("<i4").tobytes()
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])] * islands, "island": range(islands), "sizes": [sizes] * islands, "packing": [b""] * islands, "bins": [0] * islands})

    def epoch(number: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            block, island = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
            sizes = np.frombuffer(pdf["sizes"].iloc[0], "<i4").tolist()
            pop = [from_assignment(np.frombuffer(p, "<i4"), sizes, capacity) for p in sorted(pdf["packing"]) if p]
            pop = evolve(sizes, capacity, pop, hash((seed, number, block, island)), generations)
            raw = pdf["sizes"].iloc[0]
            rows = [(block, island, raw, assignment(p).tobytes(), len(p.items)) for p in pop]
            if islands > 1:
                rows.append((block, (island + 1) % islands, raw, rows[0][3], rows[0][4]))
            return pd.DataFrame(rows, columns=["block", "island", "sizes", "packing", "bins"])

        return lambda t: trimmed(run(t))

    # Islands are little data and much work: adaptive execution would merge them into one task.
    spark = docs.sparkSession
    tasks = min(blocks * islands, max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    state = rest.select("block", "length").groupBy("block").applyInPandas(lambda t: trimmed(start(t)), STATE)
    for k in range(epochs):
        state = state.repartition(tasks, "block", "island").groupBy("block", "island").applyInPandas(epoch(k), STATE)
    best = state.groupBy("block").agg(F.min(F.struct("bins", "packing")).alias("b")).select("block", F.col("b.packing").alias("packing"))

    def place(items: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = items.sort_values(["length", "rid"], ascending=[False, True], kind="stable").drop(columns=["block"])
        bins = np.frombuffer(found["packing"].iloc[0], "<i4").astype(np.int64)
        out["sequence_id"] = (int(items["block"].iloc[0]) << 32) + bins
        out["offset"] = out.groupby("sequence_id")["length"].cumsum() - out["length"]
        return out

    placed = rest.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(lambda t, b: trimmed(place(t, b)), full.schema)
    return full.unionByName(placed).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
