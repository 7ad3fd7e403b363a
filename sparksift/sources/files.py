"""File listings as DataFrames, and the text of the files they name.

Spark's own file index hides names that begin with a dot or underscore, so the
listing walks the tree itself. The driver looks for no more folders than are
needed to share the work (FOLDERS); the executors list them and what is below,
so that no file's name passes through the driver. Contents are read there as
well; the root must be on storage that all of them see.
"""

from __future__ import annotations

import os
import stat
import time
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import EXTRACTABLE, extract
from ..operators.content import decoded, encoding, is_binary

SKIPPED_DIRS = (".git", ".hg", ".idea", ".svn", ".venv", ".vscode", "__pycache__", "node_modules")
SCHEMA = "path string, ext string, length long"
#: Folders that the listing is shared out by.
FOLDERS = 512
#: Contents that are handed on at a time, and names that are.
BATCH_BYTES, BATCH_NAMES = 16 << 20, 10_000


def _ext(name: str) -> str:
    return os.path.splitext(name)[1].lower().lstrip(".") if not (name.startswith(".") and name.count(".") == 1) else name[1:].lower()


def walk(root: str, recursive: bool = True, skip_dirs: tuple[str, ...] = SKIPPED_DIRS, follow_symlinks: bool = False) -> Iterator[tuple[str, str, int]]:
    """(path, extension, size) of the regular files; a missing root yields nothing, unreadable folders are left out.

    A root that is a file yields itself. Links are never followed into files.
    """
    skipped = {d.lower() for d in skip_dirs}
    try:
        info = os.lstat(root)
    except OSError:
        return
    if stat.S_ISREG(info.st_mode):
        yield root, _ext(os.path.basename(root)), info.st_size
        return
    todo = [root]
    while todo:
        try:
            entries = sorted(os.scandir(todo.pop()), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if recursive and e.name.lower() not in skipped:
                    todo.append(e.path)
            elif e.is_file(follow_symlinks=False):
                yield e.path, _ext(e.name), e.stat(follow_symlinks=False).st_size


def _shares(root: str, recursive: bool, skip_dirs: tuple[str, ...]) -> list[tuple[str, bool]]:
    """(folder, with all below it) that make up the tree, breadth first until there are FOLDERS of them."""
    skipped = {d.lower() for d in skip_dirs}
    flat, deep = [], deque([root])
    while recursive and deep and len(flat) + len(deep) < FOLDERS:
        folder = deep.popleft()
        flat.append((folder, False))
        try:
            with os.scandir(folder) as entries:
                deep.extend(sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and e.name.lower() not in skipped))
        except OSError:
            continue
    return [*flat, *((d, recursive) for d in deep)]


def list_files(spark: SparkSession, root: str, recursive: bool = True, extensions: tuple[str, ...] = (), max_size: int = 0, skip_dirs: tuple[str, ...] = SKIPPED_DIRS) -> DataFrame:
    """path, ext, length of the files below root."""
    wanted = {e.lower().lstrip(".") for e in extensions}
    shares = _shares(root, recursive, skip_dirs)

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, deep in zip(pdf["folder"], pdf["deep"]):
                found = (r for r in walk(folder, bool(deep), skip_dirs) if (not wanted or r[1] in wanted) and (max_size <= 0 or r[2] <= max_size))
                while rows := list(islice(found, BATCH_NAMES)):
                    yield pd.DataFrame(rows, columns=["path", "ext", "length"])

    tasks = spark.createDataFrame(shares, "folder string, deep boolean")
    return tasks.repartition(min(len(shares), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(names, SCHEMA)


def read_files(listing: DataFrame, max_size: int = 0) -> DataFrame:
    """path, ext, length, status, error, text (extracted by extension, or decoded if the file isn't binary), duration_ms of reading and extracting."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                began = time.monotonic()
                content = text = error = None
                status = "OK"
                try:
                    if os.path.isdir(row.path):
                        status = "SKIPPED_DIRECTORY"
                    elif 0 < max_size < os.stat(row.path).st_size:
                        status = "SKIPPED_TOO_LARGE"
                    else:
                        with open(row.path, "rb") as f:
                            content = f.read()
                        if row.ext in EXTRACTABLE:
                            text, content = extract(row.ext, content), None
                except Exception as e:  # noqa: BLE001 - a bad file is a row with a status, not a failed scan
                    content, error = None, f"{type(e).__name__}: {e}"
                    low = error.lower()
                    status = "TIMEOUT" if isinstance(e, TimeoutError) else "ENCRYPTED" if "encrypt" in low or "password" in low else "ERROR"
                rows.append((row.path, row.ext, row.length, status, error, text, content, int(1000 * (time.monotonic() - began))))
                size += len(content or text or "")
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    columns = ["path", "ext", "length", "status", "error", "text", "content", "duration_ms"]
    raw = listing.mapInPandas(load, SCHEMA + ", status string, error string, text string, content binary, duration_ms long")
    binary = F.col("content").isNotNull() & is_binary(F.col("ext"), F.col("content"))
    status = F.when(binary, "SKIPPED_BINARY").otherwise(F.col("status"))
    text = F.when(F.col("content").isNotNull() & ~binary, decoded(F.coalesce("content", F.lit(b"")), encoding(F.coalesce("content", F.lit(b""))))).otherwise(F.col("text"))
    return raw.select("path", "ext", "length", status.alias("status"), "error", text.alias("text"), "duration_ms")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """CSV with path, expected_level, include_eval, notes; rows without the first three are left out."""
    schema = "path string, expected_level string, include_eval string, notes string"
    raw = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    return raw.where(F.col("include_eval").isNotNull()).withColumn("include_eval", F.lower(F.trim("include_eval")) == "true")


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines results; of several lines for a path the last one counts."""
    schema = "path string, status_code int, level_code int, level string, scan_duration_ms long, matches array<struct<rule_id:string,offset:long,length:int,confidence:double>>, error string"
    raw = spark.read.schema(schema).json(path).withColumn("__at", F.monotonically_increasing_id())
    cols = [c for c in raw.columns if c not in ("path", "__at")]
    return raw.where(F.col("path").isNotNull()).groupBy("path").agg(F.max_by(F.struct(*cols), "__at").alias("x")).select("path", "x.*")


def folder_labels(files: DataFrame) -> DataFrame:
    """Expected levels from folders L1_PUBLIC .. L4_RESTRICTED; files below EDGE_CASES are marked."""
    folder = F.regexp_extract(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), r"(?:^|/)(L[1-4]_[A-Z]+|EDGE_CASES)(?:/|$)", 1)
    level = F.when(folder == "L1_PUBLIC", "PUBLIC").when(folder == "L2_INTERNAL", "INTERNAL").when(folder == "L3_CONFIDENTIAL", "CONFIDENTIAL").when(folder == "L4_RESTRICTED", "SECRET")
    return files.withColumn("expected", level).withColumn("is_edge", folder == "EDGE_CASES")
