"""Names typed by people: their form, and how alike two forms are."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable
from typing import NamedTuple

# Legal forms and what goes with them, in full and shortened; endings of names in
# Chinese; characters that scans confuse. Other general words are learnt (operators.company_keys.general_words).
LEGAL = frozenset(
    "the company co limited ltd group grp gp holdings holding hldgs hldg international intl int "
    "industries inds ind corporation corp corpn inc incorporated plc llc llp gmbh pte pty and its subsidiaries".split()
)
LEGAL_LONG = ("company", "limited", "group", "holdings", "international", "industries", "corporation", "subsidiaries")
ENDINGS_ZH = ("股份有限公司", "控股有限公司", "有限公司", "集團", "集团", "控股", "公司")
MISREAD = str.maketrans({"0": "o", "1": "l", "5": "s", "8": "b", "3": "e", "6": "b", "9": "g", "4": "a"})

_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff々〆]")
_ACCENTS = re.compile(r"[\u0300-\u036f]")


def without_accents(text: str) -> str:
    """Letters of any script without the accents that are written above or below them."""
    return unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFD", text)))


def words_of(name: str | None) -> list[str]:
    """The words of a name of any script, in lower case, without accents, markup, apostrophes or misread characters."""
    text = without_accents(unicodedata.normalize("NFKC", re.sub(r"<[^<>]*>", " ", name or "")))
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    words = re.findall(r"[^\W_]+", re.sub(r"['’`]", "", text.lower()))
    return [w.translate(MISREAD) if re.search(r"[a-z]", w) else w for w in words]


class Form(NamedTuple):
    """What is left of a name: kind 'en', 'zh' or '' (nothing); the sector it names or ''; its other words, sorted."""

    kind: str
    sector: str
    tokens: tuple[str, ...]

    @property
    def key(self) -> str:
        return f"{self.kind}|{self.sector}|{' '.join(self.tokens)}"


def edit_distance(a: str, b: str, most: int = 99) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _shortens(short: str, word: str) -> bool:
    """pwr, shpg, chem: the word's own letters in order, the first one kept."""
    if not 2 <= len(short) <= min(5, len(word) - 1) or short[0] != word[0]:
        return False
    if word.startswith(short) and len(short) >= 3:
        return True
    rest = iter(word)
    return all(c in rest for c in short) and not any(c in "aeiou" for c in short[1:])


class NameReader:
    """Reads names to forms; *sectors* are the lines of business that names may hold, *known* the
    words of registered names, which are never taken for a general word or a misspelt one, *general* further
    words that tell nothing about which company is meant."""

    def __init__(self, sectors: list[str], known: Iterable[str] = (), general: Iterable[str] = ()):
        self.sectors = sorted({s.lower() for s in sectors if s and " " not in s})
        self.known = frozenset(known)
        self.general = LEGAL | frozenset(general)
        self.words: dict[str, str | None] = {}

    def form(self, name: str | None) -> Form:
        """The form of a name of any script; null, blank, and names of general words or marks only give Form('', '', ())."""
        if not name or not name.strip():
            return Form("", "", ())
        words = words_of(name)
        if any(_CJK.search(w) for w in words):
            base = "".join(w for w in words if w not in self.general)
            for end in ENDINGS_ZH:
                if base.endswith(end) and len(base) > len(end):
                    base = base[: -len(end)]
                    break
            if _CJK.search(base):
                return Form("zh", "", (base,))
            words = [base]
        left, sector = [], ""
        for word in words:
            if word in self.general:
                continue
            meaning = self._meaning(word)
            if meaning == "":
                continue
            if meaning and not sector:
                sector = meaning
            else:
                left.append(word)
        if not left and not sector:
            return Form("", "", ())
        return Form("en", sector, tuple(sorted(left)))

    def _meaning(self, word: str) -> str | None:
        """The sector that a word stands for, '' for a general word misspelt, None for other words."""
        if word not in self.words:
            if len(self.words) > 200_000:  # bounded memory of a long-lived worker
                self.words.clear()
            self.words[word] = self._find(word)
        return self.words[word]

    def _find(self, word: str) -> str | None:
        if word in self.sectors:
            return word
        if word in self.known:
            return None
        near = [s for s in self.sectors if len(word) >= 4 and edit_distance(word, s, 1) <= 1]
        if len(near) == 1:
            return near[0]
        if any(len(word) >= 4 and edit_distance(word, g, 2 if len(g) > 8 else 1) <= (2 if len(g) > 8 else 1) for g in LEGAL_LONG):
            return ""
        short = [s for s in self.sectors if _shortens(word, s)]
        if len(short) > 1:  # ppr: paper rather than property
            short = [s for s in short if s[-1] == word[-1]]
        return short[0] if len(short) == 1 else None


def grams(form: Form, q: int = 4) -> list[str]:
    """The distinct q-grams of a form's words, each word marked at its start; pairs of characters for Chinese."""
    if form.kind == "zh":
        word = "^" + form.tokens[0]
        return sorted({word[i : i + 2] for i in range(len(word) - 1)})
    made = set()
    for token in form.tokens:
        word = "^" + token
        made.update(word[i : i + q] for i in range(max(1, len(word) - q + 1)))
    return sorted(made)


def _token_likeness(typed: str, of: str) -> float:
    if typed == of:
        return 1.0
    if len(typed) >= 2 and of.startswith(typed) and len(of) - len(typed) <= 5:
        return 0.9  # cut short
    longest = max(len(typed), len(of))
    most = 1 if longest < 6 else 2
    d = edit_distance(typed, of, most)
    return 1 - d / longest if d <= most else 0.0


def likeness(typed: Form, of: Form, weight: dict[str, float] | None = None) -> float:
    """Soft weighted token likeness from 0 to 1: each word of the registered form is matched with its
    likest typed word, each used once; rare words weigh more. Forms of different sectors aren't alike.
    A typed word may be two run together.
    """
    if typed.kind != of.kind or not typed.tokens or not of.tokens:
        return 0.0
    if typed.kind == "zh":
        a, b = typed.tokens[0], of.tokens[0]
        d = edit_distance(a, b, 1)
        return 1 - d / max(len(a), len(b)) if d <= 1 and min(len(a), len(b)) > 2 else 0.0
    if typed.sector and of.sector and typed.sector != of.sector:
        return 0.0
    if len(typed.tokens) < len(of.tokens):
        joined = "".join(typed.tokens)
        options = ["".join(of.tokens), "".join(reversed(of.tokens))]
        d = min(edit_distance(joined, o, 2) for o in options)
        return 1 - d / len(joined) if d <= 2 else 0.0
    weights = [weight.get(t, 1.0) if weight else 1.0 for t in of.tokens]
    pairs = sorted(((_token_likeness(t, o), i, j) for i, t in enumerate(typed.tokens) for j, o in enumerate(of.tokens)), reverse=True)
    used_t, used_o, total = set(), set(), 0.0
    for s, i, j in pairs:
        if s > 0 and i not in used_t and j not in used_o:
            used_t.add(i)
            used_o.add(j)
            total += s * weights[j]
    extra = len(typed.tokens) - len(used_t)  # typed words that match nothing
    if len(used_o) < len(of.tokens):
        return 0.0
    return total / (sum(weights) + extra * (sum(weights) / len(weights)))


def rarity(count: int, all_: int) -> float:
    """The weight of a word that *count* of *all_* names hold."""
    return math.log(1 + all_ / max(count, 1))
