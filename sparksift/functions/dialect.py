"""RE2 expressions rewritten for java.util.regex, with the same matches.

RE2's \\b, \\d, \\s and \\w are ASCII, (?i) folds all of Unicode, `.` excludes only
the newline and `$` is the very end. Java differs in each.
"""

from __future__ import annotations

WORD = "0-9A-Za-z_"
_CLASS = {"d": "0-9", "s": r"\t\n\f\r ", "w": WORD}
AHEAD, NOT_AHEAD = f"(?=[{WORD}])", f"(?![{WORD}])"
BEHIND, NOT_BEHIND = f"(?<=[{WORD}])", f"(?<![{WORD}])"
BOUNDARY = f"(?:{BEHIND}{NOT_AHEAD}|{NOT_BEHIND}{AHEAD})"
NO_BOUNDARY = f"(?:{BEHIND}{AHEAD}|{NOT_BEHIND}{NOT_AHEAD})"


def _word_next(p: str, i: int) -> bool:
    """What starts at i is surely a word character: a literal one, \\d or \\w, or a group all of whose alternatives start so."""
    if p.startswith(r"\d", i) or p.startswith(r"\w", i):
        return True
    if i < len(p) and p[i] == "(":
        j = i + 3 if p.startswith("(?:", i) else i + 1
        if j >= len(p) or p[j] == "?":
            return False
        depth, starts = 0, [j]
        while j < len(p):
            c = p[j]
            if c == "\\":
                j += 1
            elif c == "[":
                j = _class_end(p, j)
            elif c == "(":
                depth += 1
            elif c == ")":
                if not depth:
                    break
                depth -= 1
            elif c == "|" and not depth:
                starts.append(j + 1)
            j += 1
        quantified = j + 1 < len(p) and p[j + 1] in "?*"
        return not quantified and all(_word_next(p, s) for s in starts)
    if i < len(p) and p[i].isascii() and (p[i].isalnum() or p[i] == "_"):
        return not (i + 1 < len(p) and (p[i + 1] in "?*" or p[i + 1] == "{"))
    return False


def _class_end(p: str, i: int) -> int:
    """Index of the bracket that closes the class opened at i."""
    j = i + 1
    if p[j] == "^":
        j += 1
    if p[j] == "]":
        j += 1
    while p[j] != "]":
        j += 2 if p[j] == "\\" else 1
    return j


def to_java(pattern: str) -> str:
    out: list[str] = []
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        if pattern.startswith("(?i)", i):
            out.append("(?iu)")
            i += 4
        elif c == "\\":
            e = pattern[i + 1]
            if e == "b":
                out.append(NOT_BEHIND if _word_next(pattern, i + 2) else BOUNDARY)
            elif e == "B":
                out.append(NO_BOUNDARY)
            elif e in "dsw":
                out.append(f"[{_CLASS[e]}]")
            elif e in "DSW":
                out.append(f"[^{_CLASS[e.lower()]}]")
            elif e in "pP" and pattern[i + 2 : i + 3] == "{":
                end = pattern.index("}", i)
                out.append(pattern[i : end + 1])
                i = end - 1
            else:
                out.append("\\" + e)
            i += 2
        elif c == "[":
            end = _class_end(pattern, i)
            out.append(_java_class(pattern[i + 1 : end]))
            i = end + 1
        elif c == ".":
            out.append(r"[^\n]")
            i += 1
        elif c == "$":
            out.append(r"\z")
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _java_class(body: str) -> str:
    out, i = [], 0
    if body.startswith("^"):
        out.append("^")
        i = 1
    while i < len(body):
        c = body[i]
        if c == "\\":
            e = body[i + 1]
            out.append(_CLASS[e] if e in _CLASS else "\\" + e)
            i += 2
        else:
            out.append("\\" + c if c in "[&" else c)
            i += 1
    return f"[{''.join(out)}]"
