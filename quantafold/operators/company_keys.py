"""Company names joined to a registry by their words.

A lean resolver for operators that need one series per company: spellings meet the registry on
words that are alike, found by equality of keys, and the pairs that meet are compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import LEGAL, Form, NameReader, likeness, words_of
from ..session import cut
from ..sources.tables import present
from .units import bounded

ALIKE = 0.8  # likeness from which two forms are of one company
MARGIN = 0.02


HELD_BY_MANY = 1_000  # forms that hold a word, from which it is met together with what another word may be
_WHOLE = 18  # letters up to which a word is met by what is left without two of them
_WHOLE_JOINED = 12  # the same for words run together, of which each registered name has two


def _without(word: str, most: int) -> set[str]:
    """The word with up to *most* of its characters left out. Two words within *most* insertions, deletions,
    substitutions and swaps of neighbours have one of these in common."""
    found = edge = {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        found = found | edge
    return found


def _near(word: str, typed: bool, whole: int = _WHOLE) -> set[str]:
    """What words within two edits of each other have in common: of short ones what is left without two characters; of
    longer ones, as one of their halves is within one edit, what is left of a half without one. Where the
    other word is halved isn't known, so typed words have all beginnings and ends that may be a half."""
    keys: set[str] = set()
    n = len(word)
    if n <= whole:
        keys |= {f"2{w}" for w in _without(word, 2)}
    if n >= whole - 1:
        fronts = range(max(0, (n - 2) // 2 - 1), min(n, (n + 2) // 2 + 1) + 1) if typed else [n // 2]
        backs = range(max(0, (n - 1) // 2 - 1), min(n, (n + 3) // 2 + 1) + 1) if typed else [n - n // 2]
        keys |= {f"a{w}" for k in fronts for w in _without(word[:k], 1)} | {f"z{w}" for k in backs for w in _without(word[n - k :], 1)}
    return keys


def _cuts(word: str, typed: bool) -> set[str]:
    """What a word that is cut short has in common with the whole one."""
    if typed:
        return {f"c{word}"} if len(word) >= 2 else set()
    return {f"c{word[:k]}" for k in range(max(2, len(word) - 5), len(word))}


def strong_keys(word: str, typed: bool) -> list[str]:
    """What words with a likeness of ALIKE or more have in common: equal, cut short, one edit in five to nine
    letters or two in ten or more."""
    keys = {f"={word}"} | _cuts(word, typed)
    if 4 <= len(word) <= 9:
        keys |= {f"1{w}" for w in _without(word, 1)}
    if len(word) >= 8:
        keys |= _near(word, typed)
    return sorted(keys)


def weak_keys(word: str, typed: bool) -> list[str]:
    """What words with any likeness have in common: one edit in up to five letters, two in six or more."""
    keys = {f"={word}"} | _cuts(word, typed)
    if len(word) <= 5:
        keys |= {f"1{w}" for w in _without(word, 1)}
    if len(word) >= 4:
        keys |= _near(word, typed)
    return sorted(keys)


def _keyed(rows: DataFrame, columns: list[str], of: str, find: Callable[[object], list[str]]) -> DataFrame:
    """*columns* and a row for each `key` that *find* gives for the column *of*, of string or array type."""
    types = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), 1_000):
                some = part.iloc[start : start + 1_000]
                keys = [find(x) for x in some[of]]
                made = some[columns].loc[some.index.repeat([len(k) for k in keys])].reset_index(drop=True)
                made["key"] = pd.Series([k for ks in keys for k in ks], index=made.index, dtype=object)
                yield made

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), "key string"])
    return rows.select(*dict.fromkeys([*columns, of])).mapInPandas(run, schema)


def _edits(a: str | Column, b: str | Column, most: int) -> Column:
    return F.levenshtein(a, b, most) >= 0


def _alike_words(typed: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (`word`, `of_word`) of distinct words that may have a likeness of ALIKE or more: all that have, and few others.
    Each edit is at most two of Levenshtein's, which knows no swaps."""
    left = _keyed(typed, ["word"], "word", lambda w: strong_keys(w, True))
    right = _keyed(of, ["word"], "word", lambda w: strong_keys(w, False)).withColumnRenamed("word", "of_word")
    longest = F.greatest(F.length("word"), F.length("of_word"))
    cut_short = F.expr("startswith(of_word, word)") & (F.length("of_word") - F.length("word") <= 5)
    near = cut_short | F.when(longest < 10, _edits("word", "of_word", 2)).otherwise(_edits("word", "of_word", 4))
    return left.join(right, "key").filter(near).select("word", "of_word").distinct()


def meets(typed: DataFrame, of: DataFrame, many: int = HELD_BY_MANY) -> DataFrame:
    """All pairs of forms whose likeness can be ALIKE or more, with whatever weights of words: `form`, `kind`, `sector`,
    `tokens` and `partner`, `partner_sector`, `partner_tokens`.

    *typed* and *of*: distinct forms (Form.key) with kind, sector, tokens. What likeness requires is used, so that no pair that is alike is lost:
    - as a mean it needs one pair of words that is as much alike, so words are paired first, distinct ones only, and
      forms meet on them, within the same sector or where one names none (a key of its own, so that the join is on
      equality). Each further word of the partner must resemble one that is typed; that is tested where they meet, before rows move.
    - a word that more than *many* partners hold would bring all of them together: there forms meet on it and on what
      another word has in common with one that resembles it. It changes what is compared and not what is found.
    - with fewer words typed than registered both are compared run together, within two edits.
    - Chinese names are within one edit.
    """
    right = of.select(F.col("form").alias("partner"), F.col("kind").alias("partner_kind"), F.col("sector").alias("partner_sector"), F.col("tokens").alias("partner_tokens"))
    out = ["form", "kind", "sector", "tokens", "partner", "partner_sector", "partner_tokens"]
    mine, whose = ["form", "kind", "sector", "tokens"], ["partner", "partner_sector", "partner_tokens"]
    latin, latin_of = typed.filter("kind = 'en' and size(tokens) > 0").select(*mine), right.filter("partner_kind = 'en' and size(partner_tokens) > 0").select(*whose)

    # rows that meet carry sector and words only, of which the form is made again
    form, partner = (F.concat(F.lit("en|"), F.col(of), F.lit("|"), F.array_join(words, " ")) for of, words in (("sector", "tokens"), ("partner_sector", "partner_tokens")))
    whole = [form.alias("form"), F.lit("en").alias("kind"), "sector", "tokens", partner.alias("partner"), "partner_sector", "partner_tokens"]
    slim, slim_of = mine[2:], whose[1:]
    of_fields = F.explode(F.when(F.col("partner_sector") == "", F.array(F.lit("*"), F.lit(""))).otherwise(F.array("partner_sector", F.lit("*"))))
    posted = latin_of.select(*slim_of, F.posexplode("partner_tokens").alias("_at", "of_word")).withColumn("field", of_fields)
    asked = latin.select(*slim, F.posexplode("tokens").alias("_at", "word"))
    alike = cut(_alike_words(asked.select("word").distinct(), posted.select(F.col("of_word").alias("word")).distinct()))
    bare = posted.filter("field = ''").select("of_word").distinct()  # held by partners that name no sector, mostly few
    anywhere = asked.filter("sector <> ''").join(alike.join(bare, "of_word", "left_semi"), "word").withColumn("field", F.lit(""))
    asked = asked.join(alike, "word").withColumn("field", F.when(F.col("sector") == "", "*").otherwise(F.col("sector"))).unionByName(anywhere)
    heavy = cut(posted.groupBy("field", "of_word").agg(F.count("*").alias("_n")).filter(F.col("_n") > many).select("field", "of_word"))
    resembles = F.forall("partner_tokens", lambda y: F.exists("tokens", lambda x: F.startswith(y, x) | ((F.abs(F.length(x) - F.length(y)) <= 2) & _edits(x, y, 4))))
    enough = (F.size("tokens") >= F.size("partner_tokens")) & (4 * F.size("tokens") <= 5 * F.size("partner_tokens")) & resembles
    if heavy.isEmpty():
        met = [asked.drop("_at").join(posted.drop("_at"), ["field", "of_word"]).filter(enough).select(*whole)]
    else:
        met = [asked.drop("_at").join(heavy, ["field", "of_word"], "left_anti").join(posted.drop("_at"), ["field", "of_word"]).filter(enough).select(*whole)]

        def others(words: str) -> Column:  # the form's other words; "" where it has none, which only a form of one word can be alike to
            rest = F.filter(words, lambda _, at: at != F.col("_at"))
            return F.when(F.size(rest) == 0, F.array(F.lit(""))).otherwise(rest)

        left = asked.join(heavy, ["field", "of_word"]).withColumn("_rest", others("tokens"))
        held = posted.join(heavy, ["field", "of_word"]).withColumn("_rest", others("partner_tokens"))
        left = _keyed(left, [*slim, "field", "of_word"], "_rest", lambda ws: sorted({k for w in ws for k in weak_keys(w, True)}))
        held = _keyed(held, [*slim_of, "field", "of_word"], "_rest", lambda ws: sorted({k for w in ws for k in weak_keys(w, False)}))
        met.append(left.join(held, ["field", "of_word", "key"]).filter(enough).select(*whole))

    longest = latin_of.agg(F.max(F.size("partner_tokens"))).first()[0] or 0
    if longest > 1:
        joined = latin.filter(F.size("tokens") < longest).withColumn("_joined", F.array_join("tokens", ""))
        ways = F.explode(F.array_distinct(F.array(F.array_join("partner_tokens", ""), F.array_join(F.reverse("partner_tokens"), ""))))
        joined_of = latin_of.filter(F.size("partner_tokens") > 1).withColumn("_of", ways)
        left = _keyed(joined, [*mine, "_joined"], "_joined", lambda w: sorted(_near(w, True, _WHOLE_JOINED)))
        held = _keyed(joined_of, [*whose, "_of"], "_of", lambda w: sorted(_near(w, False, _WHOLE_JOINED)))
        close = (F.size("tokens") < F.size("partner_tokens")) & (F.abs(F.length("_joined") - F.length("_of")) <= 2) & _edits("_joined", "_of", 4)
        met.append(left.join(held, "key").filter(close).select(*out))

    left = _keyed(typed.filter("kind = 'zh'").select(*mine, F.get("tokens", F.lit(0)).alias("_word")), [*mine, "_word"], "_word", lambda w: sorted(_without(w, 1)))
    held = _keyed(right.filter("partner_kind = 'zh'").select(*whose, F.get("partner_tokens", F.lit(0)).alias("_of")), [*whose, "_of"], "_of", lambda w: sorted(_without(w, 1)))
    met.append(left.join(held, "key").filter(_edits("_word", "_of", 2)).select(*out))
    return reduce(DataFrame.unionByName, met).distinct()


_SCHEMA = "name string, kind string, sector string, tokens array<string>, form string"


def _read(names: DataFrame, sectors: list[str], general: list[str]) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = NameReader(sectors, general=general)
        for part in parts:
            rows = [(n, f.kind, f.sector, list(f.tokens), f.key) for n in part["name"] for f in (reader.form(n),)]
            yield pd.DataFrame(rows, columns=["name", "kind", "sector", "tokens", "form"])

    return names.select("name").mapInPandas(run, _SCHEMA)


def general_words(names: DataFrame, registry: DataFrame, sectors: list[str], share: float = 0.005, least: int = 3) -> list[str]:
    """Words that say nothing about which company is meant: held by no registered name, by at least *share*
    of the distinct *names* (and *least* of them), and standing beside as many different registered words as
    names, at least five.

    Counted over all distinct names; a name has a handful of words, so at most some words / *share* come
    to the driver. Names of other scripts count like others; an empty registry or table gives none.
    """
    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = NameReader(sectors)
        for part in parts:
            yield pd.DataFrame({"name": part["name"], "words": [sorted({w for w in words_of(n) if w not in LEGAL and reader._meaning(w) is None}) for n in part["name"]]})

    schema = "name string, words array<string>"
    each = names.select("name").mapInPandas(split, schema).filter("size(words) > 0")
    held = registry.filter(present("name")).select("name").distinct().mapInPandas(split, schema).select(F.explode("words").alias("word")).distinct()
    total = names.count()
    mine = each.select("words", F.explode("words").alias("word")).join(held, "word", "left_anti")
    frequent = mine.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= max(least, share * total))
    beside = mine.join(frequent, "word").select(F.col("word").alias("of"), "n", F.explode("words").alias("word")).join(held, "word", "left_semi").groupBy("of", "n").agg(F.count_distinct("word").alias("spread"))
    return sorted(r[0] for r in bounded(beside.filter((F.col("spread") >= F.col("n")) & (F.col("spread") >= 5)).select("of"), 20_000, "general words"))


def company_of(names: DataFrame, registry: DataFrame, sectors: list[str]) -> DataFrame:
    """`name`, `entity` of each distinct non-empty name: the registered company it's most like, else its own form.

    *registry*: `entity` (string), `name`. A name as near to two companies stands for itself, as does one of
    general words or marks only. Null, empty and blank names are left out; an empty registry leaves each
    form an entity of its own. Forms meet their partners by what likeness requires (meets), so none that is alike enough is missed.
    """
    distinct = cut(names.filter(present("name") & (F.trim("name") != "")).select("name").distinct())
    general = general_words(distinct, registry, sectors)
    every = cut(_read(distinct, sectors, general))
    owners = cut(_read(registry.filter(present("name")).select("name").distinct(), sectors, general).join(registry, "name").filter("kind <> ''"))
    forms = every.filter("kind <> ''").select("form", "kind", "sector", "tokens").dropDuplicates(["form"])
    met = cut(meets(forms, owners.select("form", "kind", "sector", "tokens").dropDuplicates(["form"])))

    @F.pandas_udf("double")
    def alike(kind: pd.Series, sector: pd.Series, tokens: pd.Series, of_sector: pd.Series, of_tokens: pd.Series) -> pd.Series:
        return pd.Series([likeness(Form(k, s, tuple(t)), Form(k, os, tuple(ot))) for k, s, t, os, ot in zip(kind, sector, tokens, of_sector, of_tokens, strict=True)], dtype="float64")

    scored = met.withColumn("alike", alike("kind", "sector", "tokens", "partner_sector", "partner_tokens")).filter(F.col("alike") >= ALIKE).select("form", "partner", "alike")
    scored = scored.join(owners.select(F.col("form").alias("partner"), "entity").distinct(), "partner").groupBy("form", "entity").agg(F.max("alike").alias("alike"))
    order = Window.partitionBy("form").orderBy(F.desc("alike"), "entity")
    best = scored.withColumn("_rank", F.row_number().over(order)).withColumn("_next", F.lead("alike", 1, 0.0).over(order)).filter((F.col("_rank") == 1) & (F.col("alike") >= F.col("_next") + MARGIN))
    own = F.when(F.col("kind") == "", F.concat(F.lit("name:"), "name")).otherwise(F.concat(F.lit("form:"), "form"))
    return every.select("name", "kind", "form").join(best.select("form", "entity"), "form", "left").select("name", F.coalesce("entity", own).alias("entity"))
