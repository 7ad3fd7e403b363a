"""Rule catalogues from YAML: an index with includes in order, a file per rule, compound rules."""

from __future__ import annotations

import re
from pathlib import Path

from .model import Catalog, Compound, Pattern, Rule


def load(index: str | Path, strict: bool = True) -> Catalog:
    """The catalogue of an index file. A missing include or a bad expression is an error; strict=False skips missing files. Disabled rules are dropped."""
    import yaml

    index = Path(index)
    head = yaml.safe_load(index.read_text()) or {}
    rules = []
    for name in head.get("includes") or head.get("include") or []:
        path = index.parent / name
        if not path.exists() and not strict:
            continue
        rule = _rule(yaml.safe_load(path.read_text()))
        if rule.enabled:
            rules.append(rule)
    compounds = tuple(Compound(c["name"], tuple(c["conditions"]), c["result_level"], c.get("min_component_level"), c.get("violation_type"), c.get("alert_priority")) for c in head.get("compound_rules") or [])
    return Catalog(tuple(rules), compounds)


def _pattern(p: dict) -> Pattern:
    from ..functions.dialect import to_java

    to_java(p["regex"])
    re.compile(re.sub(r"\\p\{\w+\}", r"\\w", p["regex"].replace("(?i)", "")))  # a broken expression fails here and not in a task
    return Pattern(p["regex"], float(p.get("confidence", 0)), bool(p.get("context_required")), tuple(p.get("validators") or ()), p.get("override_level"), p.get("description", ""))


def _rule(d: dict) -> Rule:
    words = d.get("keywords") or []
    primary, secondary = (words, []) if isinstance(words, list) else (words.get("primary") or [], words.get("secondary") or [])
    less, up = d.get("false_positive_reduction") or {}, d.get("escalation") or {}
    return Rule(
        d["id"], d.get("name", d["id"]), d.get("category", ""), d.get("level", "PUBLIC"), float(d.get("weight", 1)), int(d.get("priority", 0)), tuple(_pattern(p) for p in d.get("patterns") or []),
        tuple(map(str, primary)), tuple(map(str, secondary)), bool(less.get("exclude_if_no_keywords")), float(less.get("cvv_expiry_boost") or 0), tuple(map(str, up.get("keywords") or [])), up.get("escalate_to"), tuple(d.get("tags") or []), bool(d.get("enabled", True)),
    )


def catalog_table(spark, catalog: Catalog):
    """A row per enabled rule: id, category, level, priority, counts of patterns and keyword entries."""
    rows = [(i, r.id, r.category, r.level_code, r.priority, len(r.patterns), len(r.primary), len(r.secondary), len(r.escalation)) for i, r in enumerate(catalog.ordered())]
    return spark.createDataFrame(rows, "place int, rule_id string, category string, level int, priority int, patterns int, primary_keywords int, secondary_keywords int, escalation_keywords int").coalesce(1)
