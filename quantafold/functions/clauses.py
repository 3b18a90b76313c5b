"""Numbered clauses of a text, and back."""

from __future__ import annotations

import re

# The forms of numbering, by which a level is told.
FORMS = (
    ("decimal", re.compile(r"(?<![\w.,])(\d{1,2}(?:\.\d{1,2}){0,3})[.)]?\s+(?=[A-Z\"“一-鿿])")),
    ("letter", re.compile(r"(?<!\w)\(([a-z])\)\s*")),
    ("roman", re.compile(r"(?<!\w)\(([ivx]{1,5})\)\s*")),
    ("capital", re.compile(r"(?<!\w)\(([A-Z])\)\s*")),
    ("number", re.compile(r"(?<!\w)\((\d{1,2})\)\s*")),
)
_ROMAN = {"i": 1, "v": 5, "x": 10}


def _value(kind: str, label: str) -> int:
    if kind == "roman":
        digits = [_ROMAN[c] for c in label]
        return sum(-d if any(e > d for e in digits[k + 1 : k + 2]) else d for k, d in enumerate(digits))
    return ord(label.lower()) - 96 if kind in ("letter", "capital") else int(label.split(".")[-1])


def parse_clauses(text: str | None) -> list[tuple[str, str, int]]:
    """(label, text, level) of each numbered clause in order; what stands before the first has the label ''.

    A label opens a clause only if it's the first of its form or follows the one before it at that
    level, so that references in running text aren't taken for clauses. A form met first within another
    is a level below it. Null and blank texts have no clauses.
    """
    if not text or not text.strip():
        return []
    marks = sorted((m.start(), m.end(), kind, m[1]) for kind, form in FORMS for m in form.finditer(text))
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int, str, int]] = []
    end = -1
    for start, stop, kind, label in marks:
        if start < end:
            continue
        value = _value(kind, label)
        at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == kind and stack[k][1] + 1 == value), None)
        if at is not None:
            del stack[at + 1 :]
            stack[at] = (kind, value)
        elif value == 1 and all(k != kind for k, _ in stack):
            stack.append((kind, 1))
        else:
            continue
        written = text[start:stop].strip()
        found.append((start, stop, written, len(stack)))
        end = stop
    if not found:
        return [("", text.strip(), 0)]
    head = text[: found[0][0]].strip()
    out = [("", head, 0)] if head else []
    for k, (_, stop, written, level) in enumerate(found):
        until = found[k + 1][0] if k + 1 < len(found) else len(text)
        out.append((written, text[stop:until].strip(), level))
    return out


def join_clauses(clauses: list[tuple[str, str, int]]) -> str:
    """The text of clauses, parted by blanks."""
    return " ".join(f"{label} {text}".strip() for label, text, _ in clauses)


def longest_matches(matches: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Matches (text, start, end inclusive) without those strictly within another, in order."""
    kept, reach = [], -1
    for m in sorted(set(matches), key=lambda m: (m[1], -m[2])):
        if m[2] > reach or (kept and (m[1], m[2]) == (kept[-1][1], kept[-1][2])):
            kept.append(m)
            reach = max(reach, m[2])
    return kept
