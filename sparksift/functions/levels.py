"""Sensitivity levels and scan states: codes, labels and how they are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUBLIC, INTERNAL, CONFIDENTIAL, RESTRICTED = range(4)
LABELS = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")
STATES = ("UNKNOWN", "OK", "ERROR", "TIMEOUT", "ENCRYPTED", "SKIPPED_BINARY", "SKIPPED_TOO_LARGE", "SKIPPED_DIRECTORY")
_CODES = {**{n: i for i, n in enumerate(LABELS)}, "SECRET": RESTRICTED}


def level_code(label: str | None) -> int:
    """Lenient reading, as in rules: an unknown label is PUBLIC."""
    return _CODES.get((label or "").strip().upper(), PUBLIC)


def parse_level(label: str) -> int:
    """Strict reading, as for options."""
    code = _CODES.get(label.strip().upper())
    if code is None:
        raise ValueError(f"unknown level: {label!r}")
    return code


def label_of(code: Column) -> Column:
    """Label of a level code; other codes are PUBLIC."""
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in LABELS]), F.when(code.between(0, 3), code)), F.lit("PUBLIC"))


def code_of(label: Column) -> Column:
    known = F.upper(F.trim(label))
    out = F.when(known == "SECRET", RESTRICTED)
    for i, n in enumerate(LABELS):
        out = out.when(known == n, i)
    return out.otherwise(PUBLIC)


def normalised_label(label: Column) -> Column:
    """Labels of evaluation files: CLEAN and L0..L4 are aliases, anything unknown is empty."""
    u = F.upper(F.trim(label))
    for alias, name in (("CLEAN", "PUBLIC"), ("L0", "PUBLIC"), ("L1", "INTERNAL"), ("L2", "CONFIDENTIAL"), ("L3", "SECRET"), ("L4", "SECRET")):
        u = F.replace(u, F.lit(alias), F.lit(name))
    return F.when(u.isin("PUBLIC", "INTERNAL", "CONFIDENTIAL", "SECRET"), u).otherwise("")


def state_label(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in STATES]), F.when(code.between(0, 7), code)), F.lit("UNKNOWN"))
