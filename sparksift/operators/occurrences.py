"""Where expressions and words occur, a batch of texts at a time in Arrow.

RE2 tells which texts of a batch match at all, several expressions in one pass;
only those are looked at one by one. Words are searched for in the bytes of the
whole batch. Offsets are bytes of the text, from 0.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import arrow_bytes
from ..rules.model import Catalog, ScanOptions

#: Expressions that one pass asks for.
TOGETHER = 8
HITS = "array<struct<pid:int,start:int,end:int,nth:int,boost:int>>"
WORDS = "array<struct<rule_id:string,keyword:string,pri:boolean,offset:bigint>>"


def any_of(words: list[str]) -> str:
    """An expression that finds one of the words; those that contain another one are left out."""
    words = sorted(set(words), key=lambda w: (len(w), w))
    return "|".join(re.escape(w) for i, w in enumerate(words) if not any(o in w for o in words[:i]))


def rows_with(texts: pa.Array, regex: str) -> np.ndarray:
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, regex), False).to_numpy(zero_copy_only=False))


def matching(texts: pa.Array, regexes: list[str], together: int = TOGETHER) -> Iterator[tuple[int, np.ndarray]]:
    """(number of an expression, rows that it matches)."""
    for first in range(0, len(regexes), together):
        group = regexes[first : first + together]
        try:
            rows = rows_with(texts, "|".join(f"(?:{r})" for r in group)) if len(group) > 1 else np.arange(len(texts))
        except pa.ArrowInvalid:  # too large for RE2 as one
            rows = np.arange(len(texts))
        some = texts.take(pa.array(rows)) if len(rows) < len(texts) else texts
        if len(rows):
            yield from ((first + k, rows[rows_with(some, r)]) for k, r in enumerate(group))


def spans(texts: pa.Array, regex: str) -> Iterator[list[tuple[int, int]]]:
    """Start and end of every match in each of the texts, which hold no nulls."""
    data = arrow_bytes(texts)[0].tobytes()
    free = (chr(c) for c in itertools.chain(range(1, 9), range(14, 32), range(0xE000, 0xF900)) if chr(c).encode() not in data)
    left, right = next(free), next(free)
    for s in pc.replace_substring_regex(texts, regex, rf"{left}\0{right}").to_pylist():
        head, *rest = s.encode().split(left.encode())
        at, found = len(head), []
        for part in rest:
            value, _, gap = part.partition(right.encode())
            found.append((at, at + len(value)))
            at += len(value) + len(gap)
        yield found


def word_hits(texts: pa.Array, words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of a word, rows, offsets) of every occurrence, overlapping ones too."""
    data, o = arrow_bytes(texts)
    data, o = data[o[0] : o[-1]].tobytes(), o - o[0]
    for k, w in enumerate(words):
        found, at = [], data.find(w)
        while at >= 0:
            found.append(at)
            at = data.find(w, at + 1)
        if found:
            at = np.array(found, np.int64)
            row = np.searchsorted(o, at, side="right") - 1
            inside = at + len(w) <= o[row + 1]
            yield k, row[inside], at[inside] - o[row[inside]]


def listed(n: int, rows: np.ndarray, **columns: pa.Array) -> pa.Array:
    """n lists of structs: the columns' values, in their order, in the lists that rows names."""
    order = pa.array(np.argsort(rows, kind="stable"))
    each = pa.StructArray.from_arrays([c.take(order) for c in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(_ends(n, rows), each)


def _ends(n: int, rows: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32())


def pattern_hits(chunk: Column, low: Column, patterns: list, options: ScanOptions) -> Column:
    """HITS of each chunk by the patterns (number, rule, _, pattern): the matches, and in hundredths what keywords near them give. low: the lower-cased chunk."""
    regexes = [p.regex for _, _, _, p in patterns]
    contexts = [any_of([w for w, _ in r.keywords]) if p.needs_context or r.exclude_if_no_keywords else None for _, r, _, p in patterns]
    points = [_points(r.keywords, options) for _, r, _, _ in patterns]
    numbers = [n for n, _, _, _ in patterns]
    needed = [p.needs_context or r.exclude_if_no_keywords for _, r, _, p in patterns]
    longest = max((len(w) for words in points for w, _ in words), default=0)
    window, most = options.window, options.most_boost

    def near(words, text: bytes, start: int, end: int, n: int) -> int:
        left = max(start - window, 0)
        w = text[left : min(n, end + window - 1 + longest)]
        total = 0
        for word, zones in words:
            at = w.find(word)
            while at >= 0:
                place = at + left
                dist = 0 if start <= place < end else start - place if place < start else place - end + 1
                if dist <= window:
                    total += next((b for far, b in zones if dist <= far), 0)
                at = w.find(word, at + 1)
        return min(most, total)

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array, lows: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        sizes = np.diff(arrow_bytes(texts)[1])
        data, o = arrow_bytes(pc.fill_null(lows, ""))
        found: list[tuple[int, int, int, int, int, int]] = []
        for k, rows in matching(texts, regexes):
            if needed[k] and len(rows):
                rows = rows[rows_with(lows.take(pa.array(rows)), contexts[k])] if contexts[k] else rows[:0]
            if not len(rows):
                continue
            for row, places in zip(rows.tolist(), spans(texts.take(pa.array(rows)), regexes[k])):
                text, n = data[o[row] : o[row + 1]].tobytes(), int(sizes[row])
                found += [(row, numbers[k], start, end, nth, near(points[k], text, start, end, n)) for nth, (start, end) in enumerate(places)]
        row, *rest = np.array(found, np.int64).reshape(-1, 6).T
        return listed(len(texts), row, **{c: pa.array(v, pa.int32()) for c, v in zip(("pid", "start", "end", "nth", "boost"), rest)})

    return hits(chunk, low)


def _points(keywords: list[tuple[str, bool]], options: ScanOptions) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Each word's bytes with (distance up to, hundredths) of all its entries together."""
    each: dict[bytes, list[bool]] = {}
    for w, primary in keywords:
        each.setdefault(w.encode(), []).append(primary)
    return [(w, [(far, sum(a if primary else b for primary in entries)) for far, a, b in options.zones]) for w, entries in each.items()]


def entry_hits(low: Column, catalog: Catalog) -> Column:
    """WORDS of each lower-cased text: the occurrences of every keyword entry."""
    entries = [(r.id, w, p) for r in catalog.ordered() for w, p in r.keywords]
    words = sorted({w for _, w, _ in entries})
    owners = [[e for e, (_, x, _) in enumerate(entries) if x == w] for w in words]
    ids, names, primary = (pa.array([e[i] for e in entries], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_())))

    @F.arrow_udf(WORDS)
    def hits(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        parts = [(np.zeros(0, np.int64),) * 3]
        for k, row, at in word_hits(texts, [w.encode() for w in words]):
            parts += [(row, np.full(len(row), e), at) for e in owners[k]]
        row, entry, at = (np.concatenate(x) for x in zip(*parts))
        entry = pa.array(entry)
        return listed(len(texts), row, rule_id=ids.take(entry), keyword=names.take(entry), pri=primary.take(entry), offset=pa.array(at))

    return hits(low)


def rules_with_keyword(low: Column, catalog: Catalog) -> Column:
    """Of each lower-cased text the ids of the rules of which it holds some keyword."""
    ids, regexes = zip(*[(r.id, any_of([w for w, _ in r.keywords])) for r in catalog.ordered() if r.keywords])

    @F.arrow_udf("array<string>")
    def rules(texts: pa.Array) -> pa.Array:
        parts = [(rows, np.full(len(rows), k)) for k, rows in matching(texts, list(regexes), 1)]
        row, k = (np.concatenate(x) for x in zip(*parts))
        return pa.ListArray.from_arrays(_ends(len(texts), row), pa.array(ids).take(pa.array(k[np.argsort(row, kind="stable")])))

    return rules(low)
