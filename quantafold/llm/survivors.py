"""The best representative of each group of duplicate records (problem 5).

Fields that depend on each other form bundles, and a bundle is taken whole from one record. Which
record gives which bundle is found by branch and bound: the most trusted choice under which the
functional dependencies between bundles hold. With the record's id as a dependency of all bundles the choice
is a surviving record (choose_survivors); with those of the fields it may take bundles of several (choose_bundles).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import present


@dataclass(frozen=True)
class Bundles:
    """bundles: name -> its fields. same: (bundle, bundle, field): the records that give both must agree on the field."""

    bundles: dict[str, tuple[str, ...]]
    same: tuple[tuple[str, str, str], ...] = ()

    def shared(self, bundle: str) -> tuple[str, ...]:
        """The fields on which the bundle's record must agree with others'."""
        return tuple(sorted({f for a, b, f in self.same if bundle in (a, b)}))


FACT_BUNDLES = Bundles(
    {
        "reading": ("metric", "value", "unit", "raw_value", "raw_unit", "converted_value", "converted_unit", "multiplier"),
        "place": ("document_id", "page_no", "table_id", "table_area", "position", "table_score"),
        "match": ("target_metric", "similar_score", "new_metric", "label"),
    },
    (("reading", "place", "document_id"), ("reading", "match", "metric")),
)
FACT_CRITERIA = {"reading": ("_filled", "uploaded"), "place": ("table_score",), "match": ("similar_score",)}
PART = 4_096  # candidates of a group that one task searches; more are searched in parts and compared


def best_choice(candidates: dict[str, list[tuple[int, int, dict]]], same: tuple[tuple[str, str, str], ...]) -> tuple[int, dict[str, int]] | None:
    """The most trusted legal choice: (its trust, bundle -> id of the record that gives it); None if there's none.

    candidates: bundle -> (trust, id, shared fields) of records that may give it. Branches over bundles, the most
    trusted candidate first; the bound of a branch is its trust so far plus the most that the bundles left can
    bring, so whole branches fall away once a full choice is better. Choices that break a dependency are cut off;
    candidates that can't agree with what's chosen aren't looked at, as they are found by their shared fields. Of choices as
    good the one with the smallest ids in order of the bundles wins; two nulls agree.
    """
    names = list(candidates)
    binding = {b: [(o, f) for x, y, f in same for o, mine in ((y, x), (x, y)) if mine == b and names.index(o) < names.index(b)] for b in names}
    by_shared: dict[str, dict[tuple, list]] = {}
    for b in names:
        for c in sorted(candidates[b], key=lambda c: (-c[0], c[1])):
            by_shared.setdefault(b, {}).setdefault(tuple(c[2].get(f) for _, f in binding[b]), []).append(c)
    most = [max((c[0] for c in candidates[b]), default=0) for b in names]
    left = [sum(most[k:]) for k in range(len(names) + 1)]
    best: tuple[int, tuple] | None = None

    def branch(at: int, chosen: list[tuple[int, int, dict]], trust: int) -> None:
        nonlocal best
        if at == len(names):
            score = trust, tuple(-c[1] for c in chosen)
            if best is None or score > best:
                best = score
            return
        need = tuple(chosen[names.index(o)][2].get(f) for o, f in binding[names[at]])
        for c in by_shared.get(names[at], {}).get(need, ()):
            if best is not None and trust + c[0] + left[at + 1] < best[0]:
                break  # the candidates that follow bring no more
            branch(at + 1, [*chosen, c], trust + c[0])

    branch(0, [], 0)
    return None if best is None else (best[0], {b: -i for b, i in zip(names, best[1], strict=True)})


def filled(columns: list[str]) -> Column:
    """How many of the columns are neither null nor empty."""
    return reduce(lambda a, b: a + b, [F.when(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != ""), 1).otherwise(0) for c in columns])


def choose_survivors(records: DataFrame, keys: list[str], criteria: dict[str, tuple[str, ...]], id_: str = "id") -> DataFrame:
    """Per group of two or more records: *keys*, `group_id` (its smallest id) and `id` of the survivor.

    *criteria*: bundle -> numbers or times, larger is better, null is least. A record's trust for a bundle is the number
    of the bundle's criteria in which no other record of the group surpasses it; branch and bound chooses the
    bundles under the dependency that all come of one record. Only a record that leads in some
    criterion can add trust, so each group comes down to its leaders in one aggregation with partial
    maxima, however large the group: for each set of criteria the record that leads in all of the set, if
    there is one, ties by the other criteria in order, then by the smallest id. So the most trusted record
    is always among them, whatever other rows tie for a criterion; 2^(n-1) maxima serve all sets of n
    criteria. Where one record leads in all, the bound is met at the root. The other groups are branched over, a few
    records each; of records as trusted the one with the larger criteria in order survives.

    Cases: records with a null key are in no group; nulls in criteria count as least; records alike in
    all criteria are told apart by the smallest id; groups of one record and empty tables give no rows;
    further columns don't matter.
    """
    names = [c for of in criteria.values() for c in of]
    times = [F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for c in names]
    slim = records.dropna(subset=keys).select(*keys, id_, *[t.alias(f"_c{i}") for i, t in enumerate(times)])
    n = len(names)
    # an order serves the set of criteria that it begins with, with or without 0 behind it; those of one criterion come first
    turns = [[*some, *[j for j in range(n) if j not in some]] for size in range(n) for some in combinations(range(1, n), size)]
    leaders = [F.max(F.struct(*[F.col(f"_c{i}") for i in turn], (-F.col(id_)).alias("_id"))).alias(f"_l{k}") for k, turn in enumerate(turns)]
    groups = slim.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(id_).alias("group_id"), *leaders).filter("_n > 1")
    one = reduce(lambda a, b: a & b, [F.col("_l0._id") == F.col(f"_l{i}._id") for i in range(1, n)], F.lit(True))
    several = F.array_distinct(F.array(*[F.struct(*[F.col(f"_l{k}._c{j}").alias(f"_c{j}") for j in range(n)], (-F.col(f"_l{k}._id")).alias("_rid")) for k in range(len(turns))]))
    groups = groups.select(*keys, "group_id", F.when(~one, several).alias("_several"), (-F.col("_l0._id")).alias("_first"))
    at = {c: j for j, c in enumerate(names)}
    bundles = list(criteria)
    same = tuple((bundles[0], b, "id") for b in bundles[1:])

    @F.pandas_udf("bigint")
    def survivor(several: pd.Series, first: pd.Series) -> pd.Series:
        made = []
        for rows, whole in zip(several, first, strict=True):
            if rows is None:  # one record leads in all
                made.append(whole)
                continue
            records_ = [dict(r) for r in rows]
            most = [max(r[f"_c{j}"] for r in records_) for j in range(n)]
            ordered = sorted(records_, key=lambda r: (*(-r[f"_c{j}"] for j in range(n)), r["_rid"]))  # the place in this order breaks ties
            candidates = {b: [(sum(r[f"_c{at[c]}"] == most[at[c]] for c in of), k, {"id": r["_rid"]}) for k, r in enumerate(ordered)] for b, of in criteria.items()}
            made.append(ordered[best_choice(candidates, same)[1][bundles[0]]]["_rid"])
        return pd.Series(made, dtype="int64")

    return groups.select(*keys, "group_id", survivor("_several", "_first").alias("id"))


def choose_bundles(records: DataFrame, keys: list[str], trust: dict[str, str], id_: str = "id", rules: Bundles = FACT_BUNDLES, part: int = PART) -> DataFrame:
    """Per group of two or more records: *keys*, `group_id`, `id` and `sources`, bundle -> id of the record that gives it.

    *trust*: bundle -> column of whole numbers, how much the record is trusted for it; null counts as 0. *records* also holds the
    shared fields. `id` is that of the record that gives most bundles, the first bundle's where they tie.

    Records alike in all shared fields can stand for each other in any choice, so a group comes down to one candidate per
    bundle and combination of shared fields, with partial maxima. A group in which one record is the most trusted for all bundles
    is decided at the root. In the others a candidate stays only if it can still beat the most trusted single record, with the most that
    the other bundles bring; what stays is searched by branch and bound, by more than one task where a group has over
    *part* candidates: legal choices agree on the first dependency's field, by which the parts are made, and the best
    parts' choices are compared. So no task sees an unbounded group but for the wordings of the other
    dependencies' fields.

    Cases: records with a null key are in no group; nulls in shared fields agree with each other; ties go to a single record, then
    to smaller ids; groups of one record and empty tables give no rows; further columns don't matter.
    """
    bundles, shared = list(rules.bundles), sorted({f for _, _, f in rules.same})
    slim = records.dropna(subset=keys).select(*keys, F.col(id_).alias("_id"), *shared, *[F.coalesce(F.col(trust[b]).cast("bigint"), F.lit(0)).alias(f"_t{k}") for k, b in enumerate(bundles)])
    total = reduce(lambda a, b: a + b, [F.col(f"_t{k}") for k in range(len(bundles))])
    best = [F.max(F.struct(F.col(f"_t{k}").alias("t"), (-F.col("_id")).alias("i"))).alias(f"_b{k}") for k in range(len(bundles))]
    cells = cut(slim.groupBy(*keys, *shared).agg(F.count("*").alias("_n"), F.min("_id").alias("_low"), F.max(F.struct(total.alias("t"), (-F.col("_id")).alias("i"))).alias("_whole"), *best))
    groups = cells.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.min("_low").alias("group_id"), F.max("_whole").alias("_whole"), *[F.max(f"_b{k}.t").alias(f"_most{k}") for k in range(len(bundles))]).filter("_n > 1")
    ceiling = reduce(lambda a, b: a + b, [F.col(f"_most{k}") for k in range(len(bundles))])
    groups = cut(groups.select(*keys, "group_id", F.col("_whole.t").alias("_least"), (-F.col("_whole.i")).alias("_rid"), ceiling.alias("_ceiling"), *[f"_most{k}" for k in range(len(bundles))]))
    contested = groups.filter("_least < _ceiling")
    each = [F.struct(F.lit(k).alias("bundle"), F.col(f"_b{k}.t").alias("t"), (-F.col(f"_b{k}.i")).alias("i"), *[F.when(F.lit(f in rules.shared(b)), F.col(f)).alias(f) for f in shared]) for k, b in enumerate(bundles)]
    keep = F.array(*[F.when(F.col(f"_b{k}.t") + F.col("_ceiling") - F.col(f"_most{k}") > F.col("_least"), each[k]) for k in range(len(bundles))])
    held = cells.join(contested.select(*keys, "group_id", "_least", "_ceiling", *[f"_most{k}" for k in range(len(bundles))]), keys)
    stay = held.select("group_id", F.explode(F.array_compact(keep)).alias("c")).groupBy("group_id", "c.bundle", *[F.col(f"c.{f}").alias(f) for f in shared]).agg(F.max(F.struct("c.t", (-F.col("c.i")).alias("i"))).alias("c"))
    by = rules.same[0][2] if rules.same else None
    cutting = [k for k, b in enumerate(bundles) if by in rules.shared(b)]
    parts = stay.groupBy("group_id").agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("_parts"))
    own = F.array(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")) if by else F.array(F.lit(0))
    everywhere = F.sequence(F.lit(0), F.col("_parts") - 1) if by else F.array(F.lit(0))
    placed = stay.join(parts, "group_id").withColumn("_part", F.explode(F.when(F.col("bundle").isin(cutting), own).otherwise(everywhere)))
    lists = placed.groupBy("group_id", "_part").agg(F.collect_list(F.struct("bundle", "c.t", (-F.col("c.i")).alias("i"), *shared)).alias("_rows"))
    schema = f"group_id bigint, _trust bigint, {', '.join(f'_s{k} bigint' for k in range(len(bundles)))}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group, rows in zip(batch["group_id"], batch["_rows"], strict=True):
                candidates: dict[str, list] = {b: [] for b in bundles}
                for r in map(dict, rows):
                    candidates[bundles[r["bundle"]]].append((r["t"], r["i"], {f: r[f] for f in shared}))
                got = best_choice(candidates, rules.same)
                if got:
                    out.append((group, got[0], *(got[1][b] for b in bundles)))
            yield pd.DataFrame(out, columns=["group_id", "_trust", *(f"_s{k}" for k in range(len(bundles)))])

    found = lists.select("group_id", "_rows").mapInPandas(run, schema)
    sources = [F.col(f"_s{k}") for k in range(len(bundles))]
    found = found.groupBy("group_id").agg(F.max(F.struct("_trust", *[(-s).alias(f"_s{k}") for k, s in enumerate(sources)])).alias("_best"))
    both = groups.select(*keys, "group_id", "_least", "_rid").join(found, "group_id", "left")
    mixed = F.coalesce(F.col("_best._trust") > F.col("_least"), F.lit(False))
    given = [F.when(mixed, -F.col(f"_best._s{k}")).otherwise(F.col("_rid")) for k in range(len(bundles))]
    both = both.select(*keys, "group_id", *[g.alias(f"_s{k}") for k, g in enumerate(given)])
    votes = [F.struct(reduce(lambda a, b: a + b, [F.when(x == y, 1).otherwise(0) for y in sources]).alias("n"), F.lit(-k).alias("k"), x.alias("i")) for k, x in enumerate(sources)]
    return both.select(*keys, "group_id", F.array_max(F.array(*votes))["i"].alias("id"), F.create_map(*[x for b, s in zip(bundles, sources, strict=True) for x in (F.lit(b), s)]).alias("sources"))


def fuse(records: DataFrame, survivors: DataFrame, rules: Bundles = FACT_BUNDLES, id_: str = "id") -> DataFrame:
    """One surviving record per group: `group_id`, `id`, and the fields of each bundle from the record that gives it."""
    wanted = survivors.select("group_id", F.col("id").alias("_survivor"), F.map_entries("sources").alias("_s"))
    wanted = wanted.select("group_id", "_survivor", F.explode(F.array_distinct(F.transform("_s", lambda x: x["value"]))).alias("_rid"), "_s")
    wanted = wanted.withColumn("_gives", F.transform(F.filter("_s", lambda x: x["value"] == F.col("_rid")), lambda x: x["key"])).drop("_s")
    joined = wanted.join(records.withColumnRenamed(id_, "_rid"), "_rid")
    taken = [F.max(F.when(F.array_contains("_gives", b), F.struct(F.col(f)))).getField(f).alias(f) for b, fields in rules.bundles.items() for f in fields]
    return joined.groupBy("group_id").agg(F.max("_survivor").alias("id"), *taken)


def fact_trust(records: DataFrame, uploads: DataFrame, half_life_days: float = 730.0, rules: Bundles = FACT_BUNDLES) -> DataFrame:
    """*records* with a trust per bundle, `trust_<bundle>`, in millionths: the share of its own fields that are filled, and
    its quality: for the reading how late its document was uploaded (halved with each *half_life_days* before the
    latest upload of all), for the place table_score, for the match similar_score; null is 0."""
    last = uploads.agg(F.max("uploaded")).first()[0]
    age = (F.lit(float(last or 0)) - F.col("uploaded")) / (86_400e6 * half_life_days)
    quality = {"reading": F.pow(F.lit(2.0), -age), "place": F.col("table_score"), "match": F.col("similar_score")}
    dated = records.join(uploads, "document_id", "left")
    return dated.select(*[F.col(f"`{c}`") for c in records.columns], *[F.round(1e6 * (filled(list(fields)) / len(fields) + F.coalesce(F.nanvl(quality[b], F.lit(0.0)), F.lit(0.0)))).cast("bigint").alias(f"trust_{b}") for b, fields in rules.bundles.items()])


def upload_times(files: DataFrame) -> DataFrame:
    """`document_id`, `uploaded`: microseconds of the latest upload of each document."""
    return files.filter(present("document_id")).groupBy("document_id").agg(F.max(F.unix_micros(F.col("uploaded_date").cast("timestamp"))).alias("uploaded"))
