"""Quantities in text: the number, its multiplier and what is left as the unit."""

from __future__ import annotations

import re
import unicodedata

# Words that multiply a number.
MULTIPLIERS = {
    "hundred": 1e2,
    "thousand": 1e3,
    "million": 1e6,
    "billion": 1e9,
    "mn": 1e6,
    "bn": 1e9,
    "百": 1e2,
    "千": 1e3,
    "萬": 1e4,
    "万": 1e4,
    "百萬": 1e6,
    "百万": 1e6,
    "億": 1e8,
    "亿": 1e8,
}

_TAG = re.compile(r"<[^<>]*>")
_POWER = re.compile(r"\s*[x×*]\s*10\s*(?:<s>\s*|\^\s*)?([-+−]?\d+)(?:\s*</s>)?")
# a number that doesn't belong to a unit: not '000, not the 2 of CO2 or m3
_NUMBER = re.compile(
    r"(?<![\w'’.,$])[-+−]?(?:\d{1,3}(?:,\d{3})+|\d{1,3}(?:[   ]\d{3})+(?!\d)|\d+)(?:\.\d+)?(?:[eE][-+−]?\d+)?"
)
_NOISE = re.compile(r"(?i)\(?\b(?:restated|approx\.?|about|circa|unaudited)\b\.?\)?|[~≈*#†]")
_RANGE = re.compile(r"\(0\s*-\s*1\)")  # of "ratio (0-1)"
_WORD = re.compile(r"(?i)^\s*(百萬|百万|萬|万|億|亿|hundred|thousand|million|billion)(?![a-z])\s*")


def parse_quantity(text: str | None) -> tuple[float, str] | None:
    """(number with its multiplier, unit text); None where no number stands.

    Thousands may be parted by commas or blanks; powers may be written 1e3, x 10<s>3</s> or ^3.
    Marks of rounding and restatement are dropped.
    """
    if not text:
        return None
    try:
        return float(text), ""
    except ValueError:
        pass
    s = unicodedata.normalize("NFKC", text).replace("−", "-")
    s = _NOISE.sub(" ", _POWER.sub(lambda m: "e" + m[1].replace("−", "-"), s))
    s = _RANGE.sub(" ", _TAG.sub("", s))
    m = _NUMBER.search(s)
    if not m:  # a number right behind a unit or its own sign
        m = re.search(r"(?<![A-Za-z\d'’])[-+]?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?(?!\d)", s)
        if not m:
            return None
    try:
        number = float(re.sub(r"[,\s]", "", m[0]))
    except ValueError:
        return None
    before, after = s[: m.start()], s[m.end() :]
    if w := _WORD.match(after):
        number *= MULTIPLIERS[w[1].lower()]
        after = after[w.end() :]
    unit = f"{before} {after}".strip(" \t\r\n,;:")
    while unit[:1] == "(" and unit[-1:] == ")":
        unit = unit[1:-1].strip()
    return number, unit
