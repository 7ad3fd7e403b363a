"""Command line: scan, rules, benchmark, copy-rules."""

from __future__ import annotations

import argparse
import shutil
import sys
import time

from pyspark.sql import SparkSession

from .functions.levels import parse_level
from .plans.scan import scan_files
from .rules.catalog import DEFAULT
from .rules.loader import load
from .rules.model import ScanOptions
from .sources import sinks
from .sources.files import SKIPPED_DIRS, list_files


def _size(text: str) -> int:
    units = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "B": 1}
    t = text.strip().upper()
    for u, n in units.items():
        if t.endswith(u):
            return int(float(t[: -len(u)]) * n)
    return int(t)


def _settings(path: str | None) -> dict[str, object]:
    """section.key -> value of a YAML file; empty values are left out."""
    if not path:
        return {}
    import yaml

    with open(path) as f:
        tree = yaml.safe_load(f) or {}
    return {f"{section}.{k}": v for section, values in tree.items() if isinstance(values, dict) for k, v in values.items() if v not in (None, "")}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparksift")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("--path", required=True)
    s.add_argument("--rules")
    s.add_argument("--level", default="INTERNAL")
    s.add_argument("--format", choices=("jsonl", "csv", "text"), default="text")
    s.add_argument("--output")
    s.add_argument("--audit")
    s.add_argument("--ext", default="")
    s.add_argument("--max-size")
    s.add_argument("--min-confidence", type=float)
    s.add_argument("--config", help="YAML with scanner, rules, scoring and output sections; options given here come first")
    s.add_argument("--flat", action="store_true")
    s.add_argument("--dry-run", action="store_true")
    r = sub.add_parser("rules")
    r.add_argument("--rules")
    b = sub.add_parser("benchmark")
    b.add_argument("--path", required=True)
    b.add_argument("--iterations", type=int, default=3)
    c = sub.add_parser("copy-rules")
    c.add_argument("source")
    c.add_argument("target")
    a = p.parse_args(argv)
    if a.command == "copy-rules":
        shutil.copytree(a.source, a.target, dirs_exist_ok=True)
        return 0
    settings = _settings(getattr(a, "config", None))
    rules = getattr(a, "rules", None) or settings.get("rules.index")
    catalog = load(rules) if rules else DEFAULT
    if a.command == "rules":
        print(f"{len(catalog.ordered())} rules, {len(catalog.compounds)} compound rules")
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "benchmark":
        for _ in range(a.iterations):
            began = time.time()
            n = scan_files(spark, a.path).results.count()
            print(f"{n / (time.time() - began):.1f} files a second")
        return 0
    extensions = tuple(x for x in a.ext.split(",") if x)
    if a.dry_run:
        listing = list_files(spark, a.path, not a.flat, extensions)
        for row in listing.toLocalIterator():
            print(row["path"])
        return 0
    least = parse_level(a.level)
    pick = lambda given, key, default: given if given is not None else settings.get(key, default)
    options = ScanOptions(min_confidence=float(pick(a.min_confidence, "rules.min_confidence", 0.60)), window=int(settings.get("rules.context_window", 200)), entropy_threshold=float(settings.get("scoring.entropy_threshold", 4.5)))
    skip = tuple(settings.get("scanner.skip_dirs", SKIPPED_DIRS))
    scan = scan_files(spark, a.path, catalog, options, not a.flat, extensions, _size(str(pick(a.max_size, "scanner.max_file_size", "50MB"))), skip)
    shown = scan.shown(least)
    rows = {"jsonl": sinks.json_rows, "csv": sinks.csv_rows}.get(a.format, sinks.text_rows)(shown, "path")
    if a.output:
        (rows.write.csv(a.output, header=True) if a.format == "csv" else rows.write.text(a.output))
    else:
        for row in rows.toLocalIterator():
            print(*row, sep=",")
    if audit := a.audit or settings.get("output.audit_log"):
        sinks.write_audit(scan.results, "path", audit, least)
    if a.format == "text":
        print(sinks.summary(scan.results, least))
    return 0


if __name__ == "__main__":
    sys.exit(main())
