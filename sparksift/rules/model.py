"""Rules as data: what the catalogue and the YAML loader produce."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.levels import level_code


@dataclass(frozen=True)
class Pattern:
    """A regular expression in RE2 syntax. `anchors`: lower-case literals of which every matching text contains one (after lower-casing); empty: no such gate."""

    regex: str
    confidence: float
    needs_context: bool = False
    validators: tuple[str, ...] = ()
    override: str | None = None
    note: str = ""
    anchors: tuple[str, ...] = ()
    gate: str | None = None  # a cheap Java expression that every matching text satisfies


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    category: str
    level: str
    weight: float
    priority: int
    patterns: tuple[Pattern, ...]
    primary: tuple[str, ...] = ()
    secondary: tuple[str, ...] = ()
    exclude_if_no_keywords: bool = False
    card_boost: float = 0.0
    escalation: tuple[str, ...] = ()
    escalate_to: str | None = None
    tags: tuple[str, ...] = ()
    enabled: bool = True

    @property
    def level_code(self) -> int:
        return level_code(self.level)

    @property
    def keywords(self) -> list[tuple[str, bool]]:
        """Every keyword entry (lower-cased text, primary), repeated entries included."""
        words = [(w, True) for w in self.primary] + [(w, False) for w in (*self.secondary, *self.escalation)]
        return [(w.lower(), p) for w, p in words if w]


@dataclass(frozen=True)
class Compound:
    name: str
    conditions: tuple[str, ...]
    result: str
    least: str | None = None
    violation: str | None = None
    alert: str | None = None


@dataclass(frozen=True)
class Catalog:
    rules: tuple[Rule, ...]
    compounds: tuple[Compound, ...] = ()
    capped_domains: tuple[str, ...] = ()

    def ordered(self) -> list[Rule]:
        """Enabled rules by priority, highest first; equal ones keep their place."""
        return sorted((r for r in self.rules if r.enabled), key=lambda r: -r.priority)

    def patterns(self) -> list[tuple[int, Rule, int, Pattern]]:
        """(number, rule, pattern number in the rule from 1, pattern) in emission order."""
        flat = [(r, i, p) for r in self.ordered() for i, p in enumerate(r.patterns, 1)]
        return [(n, r, i, p) for n, (r, i, p) in enumerate(flat)]

    def only(self, *ids: str) -> Catalog:
        return replace(self, rules=tuple(r for r in self.rules if r.id in ids))


@dataclass(frozen=True)
class ScanOptions:
    min_confidence: float = 0.60
    window: int = 200
    entropy_threshold: float = 4.5
    chunk_bytes: int = 65536
    overlap_bytes: int = 512
    zones: tuple[tuple[int, int, int], ...] = field(default=((20, 15, 7), (50, 10, 5), (200, 5, 2)))  # distance up to, primary and secondary boost in hundredths
    most_boost: int = 30
    validator_bonus: float = 0.12
    validator_most: float = 0.99
