"""Freely entered values mapped to a canonical list (problem 3)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.unit_grammar import UnitGrammar
from ..operators.units import bounded
from ..sources.tables import present

UNMATCHED = "unmatched"

# Marks of lists before a name, marks at its edges.
LEADING = re.compile(r"^(?:[-–—•·*]|\([a-z0-9]{1,2}\)|\d{1,2}\.\d{1,2}\b)\s*")
EDGES = " \t:;,.*#†-–—•"
_BRACKETED = re.compile(r"[(\[]([^()\[\]]*)[)\]]")
_BEHIND = re.compile(r"(?:\s[-–—]|\s*/|,)\s+([^,()\[\]–—/]+)$")
_BEFORE = re.compile(r"^([^\W\d_]+)\s+(?=\S)")
_NUMBERS = re.compile(r"[0-9一二三四五六七八九十]+")


def _general(part: str) -> str:
    """A part of a value with its numbers made alike: note 8 and note 12 are one."""
    return _NUMBERS.sub("#", " ".join(part.split()))


def _parts(s: str) -> Iterator[tuple[str, str]]:
    """What stands beside a name and may be a note: ('beside', text in brackets or behind a comma, dash or stroke), ('before', first word)."""
    for m in _BRACKETED.finditer(s):
        yield "beside", _general(m[1])
    bare = _BRACKETED.sub(" ", s).strip()
    while m := _BEHIND.search(bare):
        yield "beside", _general(m[1])
        bare = bare[: m.start()].strip()
    if "," not in s and (m := _BEFORE.match(bare)):  # a turned name begins with what stands behind others
        yield "before", m[1]


class Automaton:
    """A Levenshtein automaton that is made as it's used and serves words of any length.

    A state is a set of (offset, edits) relative to a base position in the word; a step depends only
    on the state and on which of the next characters equal the one read, so steps are worked out once
    and kept for all words.
    """

    def __init__(self, most: int):
        self.most = most
        self.window = 2 * most + 1
        self.steps: dict[tuple, tuple] = {}
        self.start = ((0, 0),)

    def step(self, state: tuple, bits: int, room: int) -> tuple:
        """(by how much the base moves on, the new state); the state is () where nothing can match."""
        key = (state, bits, room)
        if key not in self.steps:
            self.steps[key] = self._work_out(state, bits, room)
        return self.steps[key]

    def _work_out(self, state: tuple, bits: int, room: int) -> tuple:
        reached: dict[int, int] = {}

        def reach(at: int, edits: int) -> None:
            if at <= room and edits <= self.most and edits < reached.get(at, self.most + 1):
                reached[at] = edits

        for at, edits in state:
            if bits >> at & 1:
                reach(at + 1, edits)
                continue
            reach(at, edits + 1)  # a character too many was read
            reach(at + 1, edits + 1)  # another character was read
            for skipped in range(1, self.most - edits + 1):  # characters of the word are missing
                if bits >> (at + skipped) & 1:
                    reach(at + skipped + 1, edits + skipped)
                    break
        kept = sorted((at, e) for at, e in reached.items() if not any(o < e and abs(a - at) <= e - o for a, o in reached.items()))
        if not kept:
            return 0, ()
        base = kept[0][0]
        return base, tuple((at - base, e) for at, e in kept)


class AliasTrie:
    """Reference entries and their aliases, each path ending at the entry it stands for."""

    _automata: dict[int, Automaton] = {}

    def __init__(self):
        self.top: dict = {}
        self.size = 0
        self.depth = 0  # of the longest path

    def add(self, path: str, entry: str) -> None:
        self.depth = max(self.depth, len(path))
        node = self.top
        for ch in path:
            node = node.setdefault(ch, {})
        ends = node.setdefault("", [])
        if entry not in ends:
            ends.append(entry)
            self.size += 1

    def exact(self, word: str) -> list[str]:
        node = self.top
        for ch in word:
            node = node.get(ch)
            if node is None:
                return []
        return node.get("", [])

    def within(self, word: str, most: int) -> list[tuple[int, str]]:
        """(distance, entry) of all entries with a path at most *most* edits from *word*, nearest first."""
        n = len(word)
        if n > self.depth + most:  # longer than any path can be with its edits
            return []
        automaton, masks = self._automata.setdefault(most, Automaton(most)), _places(word)
        full, window = (1 << automaton.window) - 1, automaton.window
        found: dict[str, int] = {}
        stack = [(self.top, 0, automaton.start)]
        step = automaton.step
        while stack:
            node, base, state = stack.pop()
            for ch, below in node.items():
                if ch == "":
                    d = min(e + n - base - at for at, e in state)
                    if d <= most:
                        for entry in below:
                            found[entry] = min(d, found.get(entry, d))
                    continue
                move, new = step(state, masks.get(ch, 0) >> base & full, min(n - base, window))
                if new:
                    stack.append((below, base + move, new))
        return sorted((d, e) for e, d in found.items())

    def begins(self, word: str, most: int) -> bool:
        """Whether some path begins with what is at most *most* edits from *word*."""
        n = len(word)
        if n > self.depth + most:
            return False
        automaton, masks = self._automata.setdefault(most, Automaton(most)), _places(word)
        full, window = (1 << automaton.window) - 1, automaton.window
        stack = [(self.top, 0, automaton.start)]
        while stack:
            node, base, state = stack.pop()
            if any(n - base - at <= most - e for at, e in state):  # what is left of the word counts as missing
                return True
            for ch, below in node.items():
                if ch:
                    move, new = automaton.step(state, masks.get(ch, 0) >> base & full, min(n - base, window))
                    if new:
                        stack.append((below, base + move, new))
        return False


def _places(word: str) -> dict[str, int]:
    """Each character's places in the word, as bits."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(word):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def allowed(length: int) -> int:
    """The edits that a value of so many characters may be away: none up to 3, then 1, 2 from 9, 3 from 18, 4 from 24."""
    return 0 if length < 4 else 1 if length < 9 else 2 if length < 18 else 3 if length < 24 else 4


class Canonicalizer:
    """Finds the entry that a freely entered value means."""

    def __init__(self, entries: dict[str, list[str]], aliases: list[tuple[str, str]] = (), asides: list[tuple[str, str]] = ()):
        self.units = UnitGrammar()
        self.beside = {"", "#"} | {t for kind, t in asides if kind == "beside"}
        self.before = {t for kind, t in asides if kind == "before"}
        self.trie = AliasTrie()
        self.kept: dict[str, str] = {}
        for entry, names in entries.items():
            for name in (entry, *names):
                if name:
                    self.trie.add(self.plain(name), entry)
        for alias, entry in aliases:
            self.trie.add(alias, entry)
        self.vocabulary: dict[str, list[str]] = {}
        for word in sorted({w for names in entries.values() for n in names if n for w in self.plain(n).split() if w.isalpha()}):
            self.vocabulary.setdefault(word[0], []).append(word)

    def plain(self, value: str) -> str:
        """Lower case, no markup, no numbering or notes, single blanks."""
        s = re.sub(r"(?i)\b(co|m)<s>([23])</s>", r"\1\2", value)  # part of a unit, not a note's mark
        s = unicodedata.normalize("NFKC", re.sub(r"<s>[^<>]*</s>", "", s)).lower().replace("_", " ")
        s = " ".join(s.split())
        before = None
        while before != s:
            before = s
            s = _BRACKETED.sub(lambda m: " " if _general(m[1]) in self.beside else m[0], LEADING.sub("", s.strip(EDGES.replace(".", "")))).strip()
            if (m := _BEHIND.search(s)) and _general(m[1]) in self.beside:
                s = s[: m.start()].strip()
            if (m := _BEFORE.match(s)) and m[1] in self.before:
                s = s[m.end() :]
            s = " ".join(s.split())
        return s

    def _shapes(self, value: str) -> Iterator[str]:
        """The ways to read a value: as it is, without the unit behind it, turned at a comma."""
        s = self.plain(value)
        seen = set()
        for base in (s, *self._without_unit(s)):
            base = self.plain(base)
            parts = [x for p in base.split(",") if (x := self.plain(p.strip(EDGES)).strip(EDGES)) and _general(x) not in self.beside and x not in self.before]
            turned = [f"{' '.join(parts[k:])} {' '.join(parts[:k])}" for k in range(1, len(parts))] + ([" ".join(parts)] if "," in base else [])
            for shape in (base, *turned):
                shape = " ".join(shape.split())
                if shape and shape not in seen:
                    seen.add(shape)
                    yield shape

    def wording(self, value: str) -> str:
        """The value plain, without a unit in brackets or behind `in`."""
        s = self.plain(value)
        return self.plain(next(self._marked_unit(s), s))

    def _without_unit(self, s: str) -> Iterator[str]:
        yield from self._marked_unit(s)
        words = s.split(" ")
        for k in range(1, min(6, len(words))):
            if self.units.read(" ".join(words[-k:])):
                yield " ".join(words[:-k])

    def _marked_unit(self, s: str) -> Iterator[str]:
        if (m := re.search(r"^(.*\S)\s*\(((?:[^()]|\([^()]*\))+)\)$", s)) and self.units.read(m[2]):
            yield m[1]
        if (m := re.search(r"^(.*\S),? in (\S.*)$", s)) and self.units.read(m[2]):
            yield m[1]

    def _written_out(self, shape: str) -> Iterator[str]:
        """Shortened words (gen., w'force, mgmt) replaced by words of the reference."""
        options = []
        for token in re.split(r"\s+", shape):
            word = token.rstrip(".")
            full = []
            if token.endswith(".") and len(word) >= 2:
                full = [w for w in self.vocabulary.get(word[0], ()) if w.startswith(word) and w != word]
            elif "'" in token or (len(word) >= 3 and not set(word) & set("aeiou") and word.isalpha()):
                letters = word.replace("'", "")
                full = [w for w in self.vocabulary.get(word[0], ()) if len(w) > len(letters) and w[-1] == letters[-1] and _in_order(letters, w)]
            options.append(full or [token])
        if not any(len(o) > 1 or o[0] != t for o, t in zip(options, shape.split(), strict=False)):
            return
        readings = [""]
        for full in options:
            readings = [f"{r} {w}" if r else w for r in readings for w in full]
            if len(readings) > 64:  # those that no path begins with can't be found whatever follows
                readings = [r for r in readings if self.trie.begins(r, allowed(len(shape) * 9))]
        yield from readings

    def find(self, value: str | None) -> str:
        """The entry's name or 'unmatched'; null, blank, and values that name no entry are unmatched."""
        if not value or not value.strip():
            return UNMATCHED
        if value not in self.kept:
            if len(self.kept) > 200_000:  # bounded memory of a long-lived worker
                self.kept.clear()
            self.kept[value] = self._find(value)
        return self.kept[value]

    def _find(self, value: str) -> str:
        shapes = list(self._shapes(value))
        for shape in shapes:
            if len(got := self.trie.exact(shape)) == 1:
                return got[0]
        best: dict[str, float] = {}
        for shape in shapes:
            for written in (shape, *self._written_out(shape)):
                for d, entry in self.trie.within(written, allowed(len(written))):
                    best[entry] = min(best.get(entry, 99.0), d / len(written))
        if not best:
            return UNMATCHED
        low = min(best.values())
        nearest = sorted(e for e, d in best.items() if d <= low)
        return nearest[0] if len(nearest) == 1 else UNMATCHED


def _in_order(letters: str, word: str) -> bool:
    rest = iter(word)
    return all(c in rest for c in letters)


def mine_asides(known: DataFrame, entries: dict[str, list[str]], spread: float = 0.15, least: int = 5, share: float = 0.001) -> list[tuple[str, str]]:
    """What stands beside names without telling which: parts of values (in brackets, behind commas, dashes and strokes, first words)
    that occur with at least *spread* of all entries (and *least*), in at least *share* of the distinct wordings.

    *known*: `value`, `entry`. A wording has a handful of parts, so at most some parts / *share* come to the driver. First words that begin a name
    of an entry are none.
    """
    begins = {w for names in entries.values() for n in names if n for w in n.lower().split()[:1]}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Canonicalizer({})
        for part in parts:
            found = [(kind, text, entry) for value, entry in zip(part["value"], part["entry"], strict=True) for kind, text in set(_parts(finder.plain(value))) if text and not (kind == "before" and text in begins)]
            yield pd.DataFrame(found, columns=["kind", "part", "entry"])

    wordings = known.filter(present("value") & present("entry")).select("value", "entry").distinct()
    total = wordings.count()
    counted = wordings.mapInPandas(run, "kind string, part string, entry string").groupBy("kind", "part", "entry").agg(F.count("*").alias("n")).groupBy("kind", "part").agg(F.count("*").alias("spread"), F.sum("n").alias("n"))
    kept = counted.filter((F.col("spread") >= max(least, spread * len(entries))) & (F.col("n") >= share * total)).select("kind", "part")
    return sorted((r.kind, r.part) for r in bounded(kept, 20_000, "asides"))


def mine_aliases(known: DataFrame, entries: dict[str, list[str]], share: float = 0.0005, least: int = 3, asides: list[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """Alias paths from rows whose entry is known: `value`, `entry`, `who`.

    A wording that the trie doesn't reach becomes an alias of its entry if at least *least* different
    `who` use it, it makes up at least *share* of the entry's rows, and nine tenths of its rows mean
    that entry. *share* bounds the result: at most 1 / share aliases per entry go to the driver. Counts
    are over all rows.
    """
    notes = list(asides)
    counted = known.filter(present("value") & present("entry")).groupBy("value", "entry").agg(F.count("*").alias("n"), F.count_distinct("who").alias("w"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Canonicalizer(entries, (), notes)
        for part in parts:
            rows = []
            for value, entry, n, w in zip(part["value"], part["entry"], part["n"], part["w"], strict=True):
                shapes = list(finder._shapes(value))
                reached = any(finder.trie.exact(s) for s in shapes) or any(finder.trie.within(s, allowed(len(s))) for s in shapes)
                shape = "" if reached else finder.wording(value)
                rows.append((shape, entry, int(n), int(w)))
            yield pd.DataFrame(rows, columns=["alias", "entry", "n", "w"])

    shaped = counted.mapInPandas(run, "alias string, entry string, n bigint, w bigint").groupBy("alias", "entry").agg(F.sum("n").alias("n"), F.max("w").alias("w"))
    totals = counted.groupBy("entry").agg(F.sum("n").alias("of_entry"))
    uses = shaped.filter("alias <> ''").groupBy("alias").agg(F.sum("n").alias("of_alias"), F.max_by("entry", "n").alias("entry"), F.max("n").alias("n"), F.max("w").alias("w"))
    kept = uses.join(totals, "entry").filter((F.col("w") >= least) & (F.col("n") >= share * F.col("of_entry")) & (F.col("n") >= 0.9 * F.col("of_alias")))
    finder = Canonicalizer({})
    chosen = []
    for alias, entry, _ in sorted(((r.alias, r.entry, r.n) for r in kept.collect()), key=lambda r: (-r[2], r[0])):
        if not finder.trie.within(alias, allowed(len(alias))):  # misspellings of a chosen alias need no path
            finder.trie.add(alias, entry)
            chosen.append((alias, entry))
    return chosen


def canonicalize(rows: DataFrame, columns: list[str], entries: dict[str, list[str]], aliases: list[tuple[str, str]] = (), output: str = "canonical", asides: list[tuple[str, str]] = ()) -> DataFrame:
    """All rows with *output*: the entry that the first of *columns* that names one means, else 'unmatched'.

    *asides* (mine_asides) are set aside first. A trie of the entries, their synonyms and *aliases* is searched with a Levenshtein automaton; all
    entries within a distance that depends on the value's length are candidates, the nearest wins, and
    values as near to two entries are unmatched. Values are read once per distinct combination, which
    is joined back by its text, so a value that fills a third of all rows is searched once.

    Cases: null and empty values name nothing; repeated rows each get their entry; no entries at all
    leave everything unmatched; further columns are kept; a column named *output* is replaced, unless
    it's one of *columns*, which raises ValueError.
    """
    if output in columns:
        raise ValueError(f"{output} is read; give the result another name")
    rows = rows.drop(output)
    keys = [f"_quantafold_k{i}" for i in range(len(columns))]
    texts = [F.coalesce(F.col(c), F.lit("")).alias(k) for c, k in zip(columns, keys, strict=True)]
    pairs, notes = list(aliases), list(asides)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Canonicalizer(entries, pairs, notes)
        for part in parts:
            found = []
            for values in zip(*[part[k] for k in keys], strict=True):
                found.append(next((f for f in map(finder.find, values) if f != UNMATCHED), UNMATCHED))
            yield part.assign(**{output: found})

    distinct = rows.select(*texts).distinct()
    mapped = distinct.mapInPandas(run, ", ".join(f"{k} string" for k in keys) + f", {output} string")
    keyed = rows.select("*", *texts)
    return keyed.join(mapped, keys, "left").select(*[F.col(f"`{c}`") for c in rows.columns], output)
