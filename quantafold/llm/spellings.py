"""Variant spellings of names typed by people (problem 2).

A set-similarity join on token q-grams proposes, soft weighted token similarity decides; of the pairs proposed
only those meet whose words can be alike enough. Spellings are first read to forms (case, order, general words and punctuation set aside), so
that the join runs over distinct forms and a spelling that fills a third of all rows counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import Form, NameReader, grams, likeness
from ..operators.company_keys import ALIKE, HELD_BY_MANY, general_words, meets
from ..session import cut
from ..sources.tables import present

THRESHOLD = 0.5  # share of the typed form's q-grams that a partner must hold to be proposed
MARGIN = 0.02  # by which the best partner must surpass the next one

_FORMS = "name string, kind string, sector string, tokens array<string>, form string, grams array<string>"


def read_forms(names: DataFrame, sectors: list[str], general: list[str] = ()) -> DataFrame:
    """`name` with its form: kind, sector, tokens, form (a key) and q-grams. One narrow pass."""
    sector_list, general_list = list(sectors), list(general)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = NameReader(sector_list, general=general_list)
        for part in parts:
            rows = []
            for name in part["name"]:
                f = reader.form(name)
                rows.append((name, f.kind, f.sector, list(f.tokens), f.key, grams(f) if f.tokens else []))
            yield pd.DataFrame(rows, columns=["name", "kind", "sector", "tokens", "form", "grams"])

    return names.select("name").mapInPandas(run, _FORMS)


def _by_rarity(forms: DataFrame, threshold: float) -> DataFrame:
    """Adds `size` and `prefix`: the rarest q-grams, of which any partner that holds *threshold* of all has one.

    Rarity is counted over all forms; ties go by the q-gram itself.
    """
    each = forms.select("form", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "gram").groupBy("form").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]).alias("by_rarity"))
    size = F.size("by_rarity")
    keep = size - F.ceil(size * F.lit(threshold)).cast("int") + 1
    return ranked.select("form", F.slice("by_rarity", F.lit(1), keep).alias("prefix"))


def propose(typed: DataFrame, of: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (form, partner) in which the partner holds at least *threshold* of the typed form's q-grams.

    *typed* and *of*: distinct forms with kind, sector, tokens, grams. The prefix of the typed form
    meets the q-grams of the partners, within the same sector or where one names none, which is
    joined as a key of its own so that the join is on equality. The overlap of pairs is then counted whole.
    """
    prefixes = _by_rarity(typed.select("form", "grams").unionByName(of.select("form", "grams")).dropDuplicates(["form"]), threshold)
    left = typed.join(prefixes, "form").select("form", "kind", "sector", "tokens", "grams", F.explode("prefix").alias("gram"))
    left = left.withColumn("field", F.explode(F.when(F.col("sector") == "", F.array(F.lit("*"))).otherwise(F.array("sector", F.lit("")))))
    right = of.select(F.col("form").alias("partner"), F.col("sector").alias("partner_sector"), F.col("tokens").alias("partner_tokens"), F.col("grams").alias("partner_grams"))
    fields = F.explode(F.when(F.col("partner_sector") == "", F.array(F.lit("*"), F.lit(""))).otherwise(F.array("partner_sector", F.lit("*"))))
    posted = right.select("partner", fields.alias("field"), F.explode("partner_grams").alias("gram"))
    met = left.select("form", "field", "gram").join(posted, ["field", "gram"]).select("form", "partner").distinct()
    pairs = met.join(typed.select("form", "kind", "sector", "tokens", "grams"), "form").join(right, "partner")
    overlap = F.size(F.array_intersect("grams", "partner_grams"))
    return pairs.filter(overlap >= F.ceil(F.size("grams") * F.lit(threshold))).select("form", "kind", "sector", "tokens", "partner", "partner_sector", "partner_tokens")


def propose_alike(typed: DataFrame, of: DataFrame, threshold: float = THRESHOLD, many: int = HELD_BY_MANY) -> DataFrame:
    """Those pairs of propose that can be alike, without meeting all the others.

    A q-gram is held by a share of all forms, so the pairs that meet on one grow with the square of the forms, and nearly
    all of them are dropped by their likeness. Here forms meet on what a likeness of ALIKE requires, and the overlap
    of q-grams is counted whole for these.
    """
    pairs = meets(typed, of, many).join(typed.select("form", "grams"), "form").join(of.select(F.col("form").alias("partner"), F.col("grams").alias("partner_grams")), "partner")
    overlap = F.size(F.array_intersect("grams", "partner_grams"))
    return pairs.filter(overlap >= F.ceil(F.size("grams") * F.lit(threshold))).select("form", "kind", "sector", "tokens", "partner", "partner_sector", "partner_tokens")


def verify(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """The pairs with `alike`, their soft weighted token likeness; *weights*: `token`, `weight`."""
    held = pairs.join(
        pairs.select("partner", F.explode("partner_tokens").alias("token")).distinct().join(weights, "token").groupBy("partner").agg(F.map_from_entries(F.collect_set(F.struct("token", "weight"))).alias("weights")), "partner"
    )

    @F.pandas_udf("double")
    def alike(kind: pd.Series, sector: pd.Series, tokens: pd.Series, partner_sector: pd.Series, partner_tokens: pd.Series, weight: pd.Series) -> pd.Series:
        return pd.Series(
            [likeness(Form(k, s, tuple(t)), Form(k, ps, tuple(pt)), dict(w)) for k, s, t, ps, pt, w in zip(kind, sector, tokens, partner_sector, partner_tokens, weight, strict=True)], dtype="float64"
        )

    return held.withColumn("alike", alike("kind", "sector", "tokens", "partner_sector", "partner_tokens", "weights")).drop("weights")


def _weights(of: DataFrame) -> DataFrame:
    """How much each word of the registered forms counts: rare words more."""
    total = of.count()
    return of.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.log(1 + F.lit(float(total)) / F.count("*")).alias("weight"))


def components(edges: DataFrame, most: int = 30) -> DataFrame:
    """`node`, `label`: the smallest node that can be reached over *edges* (`a`, `b`).

    Labels are passed on and jump to their label's label, so rounds grow with the logarithm of the
    longest chain; each round is one aggregation with partial minima, checkpointed.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))).distinct())
    labels = both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("label"))
    for _ in range(most):
        passed = both.join(labels.withColumnRenamed("node", "near"), "near").select("node", "label")
        jumped = labels.alias("x").join(labels.alias("y"), F.col("x.label") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.label").alias("label"))
        new = cut(labels.unionByName(passed).unionByName(jumped).groupBy("node").agg(F.min("label").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def link_spellings(spellings: DataFrame, registry: DataFrame | None, sectors: list[str]) -> DataFrame:
    """`name`, `entity`, `alike`: the entity that each distinct spelling stands for.

    *spellings*: a column `name`; *registry*: `entity` (string) and `name`, its registered names, of
    which those of different script link through the entity. Words that say nothing about the company are learnt from the
    spellings (general_words). A spelling goes to the registered form that is most like it, if it's alike enough
    and no other entity is as near; forms alike to none are joined with each other and linked by components,
    with the smallest form as their entity.

    Cases: null and blank names are left out; every other spelling is in the result, names of general words or marks
    only stand for themselves; repeated rows and registered names count once; a form that two entities
    share, or that is as near to two, goes to neither and stands for itself; without a registry all forms are joined
    with each other; an empty table gives no rows.
    """
    spark = spellings.sparkSession
    names = cut(spellings.filter(present("name") & (F.trim("name") != "")).select("name").distinct())
    if registry is None:
        registry = spark.createDataFrame([], "entity string, name string")
    general = general_words(names, registry, sectors)
    read = cut(read_forms(names, sectors, general))
    forms = cut(read.filter("kind <> ''").dropDuplicates(["form"]).drop("name"))
    registered = read_forms(registry.filter(present("name")).select("name").distinct(), sectors, general).join(registry, "name").filter("kind <> '' and size(tokens) > 0")
    owners = cut(registered.groupBy("form", "kind", "sector", "tokens", "grams").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("n")).filter("n = 1").drop("n"))
    checked = verify(cut(propose_alike(forms, owners.drop("entity"))), _weights(owners)).join(owners.select(F.col("form").alias("partner"), "entity"), "partner")
    per_entity = cut(checked.filter(F.col("alike") >= ALIKE).groupBy("form", "entity").agg(F.max("alike").alias("alike")))
    order = Window.partitionBy("form").orderBy(F.desc("alike"), "entity")
    ranked = per_entity.withColumn("_next", F.lead("alike", 1, 0.0).over(order)).withColumn("_rank", F.row_number().over(order))
    owned = ranked.filter((F.col("_rank") == 1) & (F.col("alike") >= F.col("_next") + MARGIN)).select("form", "entity", "alike")
    loose = cut(forms.join(per_entity.select("form").distinct(), "form", "left_anti"))
    labels = spark.createDataFrame([], "node string, label string")
    if not loose.isEmpty():
        own = verify(cut(propose_alike(loose, loose)), _weights(loose)).filter((F.col("alike") >= ALIKE) & (F.col("form") != F.col("partner")))
        labels = components(own.select(F.col("form").alias("a"), F.col("partner").alias("b")))
    itself = F.when(F.col("form") == "||", F.concat(F.lit("name:"), "name")).otherwise(F.concat(F.lit("form:"), F.coalesce("label", "form")))
    joined = read.select("name", "form").join(owned, "form", "left").join(labels.withColumnRenamed("node", "form"), "form", "left")
    return cut(joined.select("name", F.coalesce("entity", itself).alias("entity"), F.coalesce("alike", F.lit(1.0)).alias("alike")))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """`name_a`, `name_b`: each pair of different spellings of one entity, name_a < name_b by code point.

    A join on the entity's distinct spellings; their number per entity is that of ways to write a
    name, whatever the number of rows.
    """
    a, b = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
