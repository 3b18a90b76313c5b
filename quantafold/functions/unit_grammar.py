"""Unit strings segmented by dynamic programming over tries of prefixes, roots and exponents.

A unit is read as factors, each of a scale (million, '000), a prefix (k, mega), a root (Wh, tonne, 人) and an
exponent (m3, cu. m, 平方米), joined by blanks or a sign of division. Symbols keep their case (mg and
Mg, mL and ML differ), words don't. A string that breaks the case of symbols throughout (mwh, KWH) is
read without case, at a price. At each position the cheapest reading is kept per state and size; the readings of
the whole string are scored by their pieces, by whether their dimension is the one that the field expects, and
by how far their size is from the field's common unit: `mwh` of an energy field is megawatt hours, `ML` of a
water field a million litres, `HK$ M` of a money field a million dollars.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable

# The lexicon. Roots: symbols (their case counts), whether they take prefixes, words, value in
# the base unit, base dimension.
ROOTS = (
    (("t",), True, ("ton", "tons", "tonne", "tonnes", "metric ton", "metric tons", "metric tonne", "metric tonnes", "噸", "公噸", "吨", "公吨"), 1.0, "mass"),
    (("MT", "mt"), False, (), 1.0, "mass"),
    (("g", "gm"), True, ("gram", "grams", "gramme", "grammes", "克"), 1e-6, "mass"),
    (("kgs", "Kgs", "KGs", "KGS"), False, ("公斤",), 1e-3, "mass"),
    (("lb", "lbs"), False, ("pound", "pounds", "磅"), 0.00045359237, "mass"),
    (("oz",), False, ("ounce", "ounces"), 0.028349523125e-3, "mass"),
    ((), False, ("short ton", "short tons"), 0.90718474, "mass"),
    ((), False, ("long ton", "long tons"), 1.0160469088, "mass"),
    (("Wh", "W h", "W.h", "W·h"), True, ("watt hour", "watt hours", "watt-hour", "watt-hours", "瓦時", "瓦时"), 1e-6, "energy"),
    (("J",), True, ("joule", "joules", "焦", "焦耳"), 1e-6 / 3600, "energy"),
    (("cal",), True, ("calorie", "calories", "卡"), 4.184e-6 / 3600, "energy"),
    (("Btu", "BTU"), True, (), 1055.05585262e-6 / 3600, "energy"),
    (("MMBtu", "mmBtu", "MMBTU"), False, (), 1055.05585262 / 3600, "energy"),
    (("toe",), True, ("tonne of oil equivalent", "tonnes of oil equivalent"), 11.63, "energy"),
    (("tce",), True, ("tonne of coal equivalent", "tonnes of coal equivalent"), 8.141, "energy"),
    ((), False, ("therm", "therms"), 105.505585262 / 3600, "energy"),
    ((), False, ("度",), 1e-3, "energy"),
    (("m",), True, ("metre", "metres", "meter", "meters", "米"), 1.0, "length"),
    (("ft",), False, ("foot", "feet", "呎"), 0.3048, "length"),
    (("yd",), False, ("yard", "yards"), 0.9144, "length"),
    ((), False, ("inch", "inches"), 0.0254, "length"),
    ((), False, ("mile", "miles", "英里"), 1609.344, "length"),
    ((), False, ("公里",), 1e3, "length"),
    (("ha",), False, ("hectare", "hectares", "公頃", "公顷"), 1e4, "length2"),
    ((), False, ("acre", "acres", "英畝", "英亩"), 4046.8564224, "length2"),
    (("sqm",), False, (), 1.0, "length2"),
    (("sqft",), False, ("平方呎",), 0.09290304, "length2"),
    (("L", "l"), True, ("litre", "litres", "liter", "liters", "ltr", "升", "公升"), 1e-3, "length3"),
    (("cbm", "CBM"), False, (), 1.0, "length3"),
    (("gal",), False, ("gallon", "gallons", "us gallon", "us gallons", "加侖", "加仑"), 3.785411784e-3, "length3"),
    ((), False, ("imperial gallon", "imperial gallons"), 4.54609e-3, "length3"),
    (("bbl",), False, ("barrel", "barrels"), 0.158987294928, "length3"),
    (("FTE", "FTEs"), False, ("person", "persons", "people", "employee", "employees", "headcount", "head", "staff", "capita", "人", "名", "僱員", "雇員", "雇员", "員工", "员工"), 1.0, "people"),
    ((), False, ("case", "cases", "no. of cases", "number of cases", "incident", "incidents", "宗", "個案", "起"), 1.0, "case"),
    ((), False, ("%", "percent", "per cent", "pct", "percentage", "百分比"), 1.0, "share"),
    ((), False, ("‰", "per mille", "per mil", "permille"), 0.1, "share"),
    ((), False, ("fraction", "ratio", "ratio (0-1)"), 100.0, "share"),
    ((), False, ("basis point", "basis points", "bps"), 0.01, "share"),
    (("h",), False, ("hour", "hours", "hr", "hrs", "小時", "小时"), 1.0, "hour"),
    ((), False, ("minute", "minutes", "mins", "分鐘", "分钟"), 1 / 60, "hour"),
    (("HKD", "HK$"), False, ("hk dollar", "hk dollars", "hong kong dollar", "hong kong dollars", "港元", "港幣", "港币"), 1.0, "money:HKD"),
    (("USD", "US$"), False, ("us dollar", "us dollars", "美元"), 1.0, "money:USD"),
    (("CNY", "RMB", "¥"), False, ("rmb yuan", "yuan", "人民幣", "人民币", "人民幣元", "人民币元"), 1.0, "money:CNY"),
    (("EUR", "€"), False, ("euro", "euros", "歐元", "欧元"), 1.0, "money:EUR"),
    (("GBP", "£"), False, ("pound sterling", "pounds sterling", "英鎊", "英镑"), 1.0, "money:GBP"),
    (("JPY",), False, ("yen", "日圓", "日元"), 1.0, "money:JPY"),
)
# The SI prefixes as symbols and words.
PREFIXES = {
    ("q",): 1e-30, ("r",): 1e-27, ("y", "yocto"): 1e-24, ("z", "zepto"): 1e-21, ("a", "atto"): 1e-18, ("f", "femto"): 1e-15, ("p", "pico"): 1e-12, ("n", "nano"): 1e-9,
    ("µ", "μ", "u", "micro", "微"): 1e-6, ("m", "milli", "毫"): 1e-3, ("c", "centi", "厘"): 1e-2, ("d", "deci"): 1e-1, ("da", "deca"): 1e1, ("h", "hecto"): 1e2, ("k", "K", "kilo", "千"): 1e3,
    ("M", "mega", "兆"): 1e6, ("G", "giga", "吉"): 1e9, ("T", "tera", "太"): 1e12, ("P", "peta"): 1e15, ("E", "exa"): 1e18, ("Z", "zetta"): 1e21, ("Y", "yotta"): 1e24, ("R",): 1e27, ("Q",): 1e30,
}
# Words and symbols that count units. Those of the second table go with money only.
SCALES = {
    ("thousand", "thousands", "'000", "’000", "000", "10^3", "103", "1,000", "1000", "千"): 1e3,
    ("million", "millions", "mn", "MM", "M", "10^6", "106", "1,000,000", "百萬", "百万"): 1e6,
    ("billion", "billions", "bn", "10^9", "109", "十億", "十亿"): 1e9,
    ("trillion",): 1e12, ("萬", "万"): 1e4, ("億", "亿"): 1e8, ("hundred", "百"): 1e2, ("k", "K"): 1e3,
}
MONEY_SCALES = {("m", "mm", "mil"): 1e6, ("b", "B"): 1e9}
EXPONENTS_BEFORE = {("cubic", "cu.", "cu", "立方"): 3, ("square", "sq.", "sq", "平方"): 2}
EXPONENTS_AFTER = {("3", "³", "^3", "**3"): 3, ("2", "²", "^2", "**2"): 2}
CARBON = ("co2", "co2e", "co2-e", "co2 e", "co2eq", "co2-eq", "co2 equivalent", "co2-equivalent", "carbon dioxide equivalent", "of co2", "of co2e", "of co2 equivalent", "of carbon dioxide equivalent", "二氧化碳", "二氧化碳當量", "二氧化碳当量")
PER = ("/", "per ", "每")
YEARLY = ("/year", "/ year", "/yr", "/ yr", "per year", "per annum", "p.a.", "/年", "每年")
FILLER = (" ", "-", ".", "·", "*", "of ", "in ", "(", ")")

_SCALE, _PREFIX, _ROOT, _BEFORE, _AFTER, _CARBON, _PER, _YEARLY, _FILL = range(9)
WITHOUT_CASE = 2.5  # price of reading symbols without their case
OTHER_DIMENSION = 4.0  # price of a dimension that the field doesn't expect
MOST_FACTORS = 6  # a string of more factors is no unit
PER_DECADE = 0.1  # price of each power of ten between a reading and the field's common unit


def _folded(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    return "".join(x if len(x := ch.lower()) == 1 else ch for ch in text)


def _symbol(word: str) -> bool:
    return word.isascii() and len(word) <= 2 or word in "µμ"


def _trie(entries: Iterable[tuple[str, bool, tuple]]) -> dict:
    """entries: word, whether its case counts, what it is. Nodes end at '' with (exact forms or None, what)."""
    top: dict = {}
    for word, cased, what in entries:
        node = top
        for ch in _folded(word):
            node = node.setdefault(ch, {})
        node.setdefault("", []).append((word if cased else None, what))
    return top


class UnitGrammar:
    """Reads units. `read(text, prior, size)` gives (factor, dimension vector) or None.

    prior: the dimension vector that the field expects, size: the factor of its common unit, both or None. Texts
    of any length are read; whether a reading is kept for the next time depends on the length, its result doesn't.
    """

    def __init__(self, roots: dict[str, tuple[float, str]] | None = None):
        words: list[tuple[str, bool, tuple]] = []
        for symbols, prefixable, names, value, dimension in ROOTS:
            words += [(w, True, (_ROOT, value, dimension, prefixable, True)) for w in symbols]
            words += [(w, False, (_ROOT, value, dimension, True, False)) for w in names]
        words += [(w, False, (_ROOT, *v, False, False)) for w, v in (roots or {}).items()]
        words += [(w, _symbol(w), (_PREFIX, v, _symbol(w))) for k, v in PREFIXES.items() for w in k]
        words += [(w, w.isascii() and len(w) <= 2 and w.isalpha(), (_SCALE, v, False)) for k, v in SCALES.items() for w in k]
        words += [(w, False, (_SCALE, v, True)) for k, v in MONEY_SCALES.items() for w in k]
        words += [(w, False, (_BEFORE, v)) for k, v in EXPONENTS_BEFORE.items() for w in k]
        words += [(w, False, (_AFTER, v)) for k, v in EXPONENTS_AFTER.items() for w in k]
        words += [(w, False, (_CARBON,)) for w in CARBON] + [(w, False, (_PER,)) for w in PER] + [(w, False, (_YEARLY,)) for w in YEARLY] + [(w, False, (_FILL,)) for w in FILLER]
        self.trie = _trie(words)
        self.cache: dict = {}

    @staticmethod
    def clean(text: str) -> str:
        s = unicodedata.normalize("NFKC", text.replace("<s>", "").replace("</s>", ""))
        return " ".join(s.split()).strip(" .,;:").strip()

    def read(self, text: str | None, prior: tuple | None = None, size: float | None = None) -> tuple[float, tuple] | None:
        if not text:
            return None
        if len(text) > 200:  # not worth the memory of a worker
            return self._read(self.clean(text), prior, size)
        key = (text, prior, size)
        if key not in self.cache:
            if len(self.cache) > 100_000:  # bounded memory of a long-lived worker
                self.cache.clear()
            self.cache[key] = self._read(self.clean(text), prior, size)
        return self.cache[key]

    def _read(self, s: str, prior: tuple | None, size: float | None) -> tuple[float, tuple] | None:
        def score(reading: tuple[float, float, tuple]) -> tuple[float, float]:
            cost, factor, vector = reading
            if prior is not None:
                if self.kind(vector) != self.kind(prior):
                    cost += OTHER_DIMENSION
                elif size:
                    cost += PER_DECADE * abs(math.log10(factor / size))
            return cost, -factor

        readings = self._readings(s, True) + [(cost + WITHOUT_CASE, f, v) for cost, f, v in self._readings(s, False)]
        if not readings:
            return None
        _, factor, vector = min(readings, key=score)
        return factor, vector

    def _readings(self, s: str, cased: bool) -> list[tuple[float, float, tuple]]:
        """(cost, factor, vector) of the ways to read the whole string."""
        n, low = len(s), _folded(s)
        # state: (vector, (pending scale, of money only), (pending prefix, must be glued), pending exponent, sign, (last dimension, its power, its unit))
        states: list[dict] = [{} for _ in range(n + 1)]
        states[0][((), (1.0, False), (1.0, False), 1, 1, ("", 0, 1.0)), 1.0] = 0.0
        for i in range(n):
            if not states[i]:
                continue
            for end, exact, what in self._words(low, i):
                if cased and exact is not None and exact != s[i:end]:
                    continue
                for (state, factor), cost in list(states[i].items()):
                    new = self._step(state, what, low, i, end, cased)
                    if new is None or len(new[0][0]) > MOST_FACTORS:
                        continue
                    target = new[0], factor * new[1]
                    states[end][target] = min(cost + new[2], states[end].get(target, math.inf))
        readings = []
        for (state, factor), cost in states[n].items():
            vector, _, prefix, exponent, sign, _ = state
            trailing = self._trailing(state)
            if trailing is not None and prefix[0] == 1.0 and exponent == 1 and sign > 0 and vector:
                readings.append((cost, factor * trailing, self._tidy(vector)))
        return readings

    def _words(self, low: str, i: int):
        node, k = self.trie, i
        while k < len(low) and low[k] in node:
            node = node[low[k]]
            k += 1
            for exact, what in node.get("", ()):
                yield k, exact, what

    @staticmethod
    def _trailing(state) -> float | None:
        """What a scale behind the last root (HK$ M, tonnes '000) brings; None where it can't stand."""
        vector, (scale, of_money), _, _, _, (dimension, power, _) = state
        if scale == 1.0:
            return 1.0
        if not vector or not power or of_money and not vector[-1][0].startswith("money"):
            return None
        return scale if vector[-1][1] > 0 else 1 / scale

    @staticmethod
    def _step(state, what, low, i, end, cased):
        vector, scale, prefix, exponent, sign, last = state
        kind = what[0]
        latin = "abcdefghijklmnopqrstuvwxyz"
        glued = low[i] in latin and i > 0 and low[i - 1] in latin
        word_goes_on = end < len(low) and low[end - 1] in latin and low[end] in latin
        if kind == _FILL:
            return None if prefix[1] and cased else (state, 1.0, 0.1)
        if kind == _SCALE:
            short = end - i == 1
            if exponent != 1 or prefix[0] != 1.0 or scale[0] != 1.0 and (glued or short) or (glued and not short) or (vector and sign > 0 and glued):
                return None
            behind = 0.2 if vector and sign > 0 and not vector[-1][0].startswith("money") else 0.0
            return (vector, (scale[0] * what[1], scale[1] or what[2]), prefix, exponent, sign, (last[0], last[1] or (1 if vector and sign > 0 else 0), last[2])), 1.0, 1.0 + behind + (0.3 if short else 0.0)
        if kind == _PREFIX:
            if prefix[0] != 1.0 or vector and sign > 0 or glued and not what[2] and scale[0] == 1.0:
                return None
            rare = 0.0 if 1e-6 <= what[1] <= 1e12 and abs(math.log10(what[1])) not in (1.0, 2.0) else 0.3
            return (vector, scale, (what[1], what[2]), exponent, sign, last), 1.0, 0.8 + (0.2 if what[2] else 0.0) + rare
        if kind == _BEFORE:
            return None if exponent != 1 or prefix[0] != 1.0 or vector and sign > 0 else ((vector, scale, prefix, what[1], sign, last), 1.0, 1.0)
        if kind == _ROOT:
            _, value, dimension, prefixable, symbol = what
            if word_goes_on and not (dimension == "mass" and low[end : end + 3] == "co2"):
                return None
            if vector and sign > 0 or prefix[0] != 1.0 and (not prefixable or prefix[1] and cased and not symbol):
                return None
            if exponent != 1 and dimension != "length" or scale[1] and not dimension.startswith("money"):
                return None
            unit = prefix[0] * value
            base, power = (dimension[:-1], int(dimension[-1])) if dimension[-1] in "23" else (dimension, exponent)
            gain = scale[0] * (unit**exponent if base == dimension else unit)
            vector = (*vector, (base, power * sign))
            return (vector, (1.0, False), (1.0, False), 1, 1, (base if power == 1 else "", 1, unit if base == "length" else 1.0)), gain if sign > 0 else 1 / gain, 2.0 - 0.1 * (end - i)
        if kind == _AFTER:
            if last[0] != "length" or not vector or vector[-1][0] != "length" or abs(vector[-1][1]) != 1 or scale[0] != 1.0:
                return None
            way, power = vector[-1][1], what[1]
            return ((*vector[:-1], ("length", way * power)), scale, prefix, exponent, sign, ("", 1, 1.0)), last[2] ** (way * (power - 1)), 0.2
        if kind == _CARBON:
            if last[0] != "mass" or not vector or vector[-1][0] != "mass" or scale[0] != 1.0 or word_goes_on:
                return None
            return ((*vector[:-1], ("carbon", vector[-1][1])), scale, prefix, exponent, sign, ("", 1, 1.0)), 1.0, 0.2
        trailing = UnitGrammar._trailing(state)
        if not vector or sign < 0 or exponent != 1 or prefix[0] != 1.0 or trailing is None:
            return None
        if kind == _PER:
            return (vector, (1.0, False), prefix, 1, -1, ("", 0, 1.0)), trailing, 0.5
        return (vector, (1.0, False), prefix, 1, 1, ("", 1, 1.0)), trailing, 0.5  # yearly: the facts are of one year

    @staticmethod
    def _tidy(vector: tuple) -> tuple:
        powers: dict[str, int] = {}
        for d, p in vector:
            powers[d] = powers.get(d, 0) + p
        return tuple(sorted((d, p) for d, p in powers.items() if p))

    @staticmethod
    def kind(vector: tuple) -> tuple:
        """The vector with all currencies alike."""
        return tuple((d.split(":")[0], p) for d, p in vector)

    @staticmethod
    def currency(vector: tuple) -> str | None:
        """The currency of an amount, also of an amount per something; None where there's none."""
        return next((d.split(":")[1] for d, _ in vector if d.startswith("money:")), None)
