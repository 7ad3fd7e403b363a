"""Whole scans: listing to results, and tables of texts to results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import STATES
from ..operators.detect import findings
from ..operators.rollup import document_levels
from ..rules.catalog import DEFAULT
from ..rules.model import Catalog, ScanOptions
from ..sources.files import SKIPPED_DIRS, list_files, read_files

#: Larger files are skipped, unless a scan says otherwise; 0 stands for no limit.
MAX_SIZE = 50 << 20


@dataclass(frozen=True)
class Scan:
    """findings: one row per finding; results: one row per document, with all levels."""

    findings: DataFrame
    results: DataFrame

    def shown(self, least: int = 1, errors: bool = False) -> DataFrame:
        """Results at a level or above, with errors=True also those that weren't scanned."""
        c = F.col("level_code") >= least
        if errors and "status_code" in self.results.columns:
            c = c | (F.col("status_code") != STATES.index("OK"))
        return self.results.where(c)


def scan_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog: Catalog = DEFAULT, options: ScanOptions = ScanOptions()) -> Scan:
    found = findings(docs, id_col, text_col, catalog, options)
    return Scan(found, document_levels(docs, found, id_col, catalog, options))


def scan_files(spark: SparkSession, root: str, catalog: Catalog = DEFAULT, options: ScanOptions = ScanOptions(), recursive: bool = True, extensions: tuple[str, ...] = (), max_size: int = MAX_SIZE, skip_dirs: tuple[str, ...] = SKIPPED_DIRS) -> Scan:
    """Files below a root. Too large ones keep a row with their status. Texts are kept on the executors' disks, so that each file is read once; a lost one's are read again."""
    files = read_files(list_files(spark, root, recursive, extensions, skip_dirs=skip_dirs), max_size).persist(StorageLevel.DISK_ONLY)
    scan = scan_texts(files, "path", "text", catalog, options)
    code = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status")).cast("int") - 1
    return Scan(scan.findings, scan.results.join(files.select("path", code.alias("status_code"), "error", F.col("duration_ms").alias("scan_duration_ms")), "path"))
