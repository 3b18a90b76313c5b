"""Relational operators: predicates, joins, de-duplication, aggregates and ordered windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

LOOKUPS = {
    "exact": lambda c, v: c == v,
    "in": lambda c, v: c.isin(list(v)),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "contains": lambda c, v: c.contains(v),
    "icontains": lambda c, v: F.lower(c).contains(v.lower()),
    "startswith": lambda c, v: c.startswith(v),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def _column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValueError(f"no field {name}; there are {', '.join(df.columns)}")
    return F.col(f"`{name}`")


def where(df: DataFrame, **lookups) -> Column:
    """A conjunction of `field=value` and `field__lookup=value`; unknown fields and lookups raise ValueError."""
    terms = []
    for key, value in lookups.items():
        name, _, lookup = key.partition("__")
        if (lookup or "exact") not in LOOKUPS:
            raise ValueError(f"no lookup {lookup}; there are {', '.join(LOOKUPS)}")
        terms.append(LOOKUPS[lookup or "exact"](_column(df, name), value))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def negated(predicate: Column) -> Column:
    """Not *predicate*, where an unknown outcome (null) counts as not met, so its rows stay."""
    return ~F.coalesce(predicate, F.lit(False))


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named fields, all if none is named; unknown ones raise ValueError."""
    return df.select(*[_column(df, f) for f in fields]) if fields else df


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in *order*, which must be total for a stable result. Null keys are keys."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def best_by_max(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """As best_per_key with all of *order* descending, by partial maxima instead of a sort: nothing but one
    row per key and partition is shuffled, so hot keys don't matter. Nulls of *order* come last.
    """
    kept = F.max(F.struct(*order, *payload)).alias("_best")
    return df.groupBy(*keys).agg(kept).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [*order, *payload]])


def share_of_group(df: DataFrame, group: list[str], part: list[str], value: str, digits: int = 4) -> DataFrame:
    """The share of each part in the sum of its group; null where the group's sum is 0."""
    sums = df.groupBy(*group, *part).agg(F.sum(value).alias("_sum"))
    whole = F.sum("_sum").over(Window.partitionBy(*group))
    return sums.select(*group, *part, F.round(F.try_divide(F.col("_sum"), whole), digits).alias("share"))


def coverage(df: DataFrame, group: list[str], who: str, reported: Column, digits: int = 4) -> DataFrame:
    """Of the different *who* of each group, the share that has a row for which *reported* holds."""
    return df.groupBy(*group).agg(F.round(F.try_divide(F.count_distinct(F.when(reported, F.col(who))), F.count_distinct(who)), digits).alias("coverage"))


def column_maxima(df: DataFrame, keys: list[str]) -> DataFrame:
    """The maximum of each column by itself per key (not the latest row)."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in df.columns if c not in keys])


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """*target* and those of *rows* whose key it lacks; fields must be the same, of rows of one key the first by all columns stays."""
    if set(rows.columns) != set(target.columns):
        raise ValueError(f"fields differ: {sorted(set(rows.columns) ^ set(target.columns))}")
    fresh = best_per_key(rows, keys, [F.col(c) for c in rows.columns]).join(target, keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def update_where(target: DataFrame, predicate: Column | None, values: dict[str, Column] | None) -> DataFrame:
    """Sets *values* where *predicate* holds; nothing changes if either is missing."""
    if predicate is None or not values:
        return target
    met = F.coalesce(predicate, F.lit(False))
    return target.select(*[F.when(met, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def delete_where(target: DataFrame, predicate: Column | None) -> DataFrame:
    """Drops the rows for which *predicate* holds; without one nothing is dropped."""
    return target if predicate is None else target.filter(negated(predicate))


def replace_by_key(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Deletes from *target* the keys of *rows*, then adds *rows*."""
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of known keys update the other fields (null keeps the old value); those of new keys are added."""
    rest = [c for c in target.columns if c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest])
    return target.join(new, keys, "full").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in rest]).select(*target.columns)


def islands(df: DataFrame, partition: list[str], order: list[str], same: list[str], name: str = "island") -> DataFrame:
    """Numbers the runs of rows in *order* that agree in *same* (null agrees with null), from 1."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in same]) | (F.row_number().over(w) == 1)
    return df.withColumn("_new", changed.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def carry_forward(df: DataFrame, partition: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The last value of *column* that isn't null, up to each row."""
    return df.withColumn(name, F.last(column, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def first_seen(df: DataFrame, value: str, key: str, name: str = "first_seen") -> DataFrame:
    """Whether a row's *key* is the least among those of its value; null is a value like others, equal keys are all first.

    By a digest of the value, whose least key is found by partial minima, so neither long values nor one that a third of
    the rows hold are brought together.
    """
    marked = df.withColumn("_digest", F.coalesce(F.md5(F.col(value).cast("string")), F.lit("")))
    least = marked.groupBy("_digest").agg(F.min(key).alias("_least"))
    return marked.join(least, "_digest").withColumn(name, F.col(key) == F.col("_least")).drop("_digest", "_least")


def positions(df: DataFrame, partition: list[str], order: list[str | Column], name: str, ties: bool = False) -> DataFrame:
    """Numbers the rows of each partition in order from 1; with *ties* rows alike in *order* get the first number of them.

    Rows are laid out by range of partition and order, numbered within each range, and a range's numbers begin where those of
    the ranges before it end, so one partition that holds most rows is numbered by many tasks. Rows alike in partition and
    order lie in one range. Null keys make a partition of their own. *order* must be total for a stable result without *ties*.
    """
    sorts = [F.col(c) if isinstance(c, str) else c for c in order]
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = cut(df.withColumn("_key", F.struct(*partition)).repartitionByRange(buckets, "_key", *sorts).withColumn("_part", F.spark_partition_id()))
    counts = laid.groupBy("_part", "_key").agg(F.count("*").alias("_n"))
    firsts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")).drop("_n")
    within = Window.partitionBy("_part", "_key").orderBy(*sorts)
    local = laid.withColumn("_local", F.rank().over(within) if ties else F.row_number().over(within))
    placed = local.alias("l").join(firsts.alias("f"), (F.col("l._part") == F.col("f._part")) & F.col("l._key").eqNullSafe(F.col("f._key")))
    return placed.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("_before") + F.col("_local")).alias(name))


def batches(df: DataFrame, partition: list[str], order: list[str], size: int, name: str = "batch", full_only: bool = False) -> DataFrame:
    """Numbers blocks of *size* rows in order within each partition, from 0; *full_only* drops the rest."""
    made = positions(df, partition, order, "_at").withColumn(name, F.floor((F.col("_at") - 1) / F.lit(size)))
    if full_only:
        whole = df.groupBy(*partition).agg(F.count("*").alias("_all"))
        made = made.join(whole, partition).filter((F.col(name) + 1) * size <= F.col("_all")).select(*df.columns, name)
    return made.drop("_at")


def shard_ranges(total: int, shards: int) -> list[tuple[int, int]]:
    """The half-open ranges of contiguous shards: the first total % shards hold one more."""
    base, more = divmod(total, shards)
    starts = [k * base + min(k, more) for k in range(shards + 1)]
    return list(zip(starts[:-1], starts[1:], strict=True))


def unpivot_identifiers(dim: DataFrame, keep: list[str], identifiers: list[str]) -> DataFrame:
    """One row per identifier of each dimension row, as strings; nulls are left out."""
    return dim.unpivot(keep, [F.col(c).cast("string").alias(c) for c in identifiers], "identifier_kind", "identifier").filter("identifier IS NOT NULL")


def any_of_equal(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], key: str) -> DataFrame:
    """Rows of *left* and *right* that agree in at least one of *pairs*: a union of equi-joins instead of an OR join; *key* tells the rows of the result apart."""
    parts = [left.join(right, left[a].cast("string") == right[b].cast("string")) for a, b in pairs]
    return reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates([key])


def least_k(df: DataFrame, keys: list[str], order: str, k: int, payload: list[str]) -> DataFrame:
    """The *k* rows of least *order* per key, with *payload*, ties by payload; nulls of *order* come first.

    A rank under a limit: Spark keeps at most *k* rows per key and partition before it shuffles, so a hot key weighs little.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *payload))
    return df.select(*keys, order, *payload).withColumn("_rn", rank).filter(F.col("_rn") <= k).drop("_rn")


def any_contains(column: str, words: list[str]) -> Column:
    """Whether the column holds one of the words, case aside; null where the column is null."""
    low = F.lower(F.col(column))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words], F.lit(False))


def valid_relation(head: str, relation: str, tail: str, allowed: dict[tuple[str, str], list[str]]) -> Column:
    """Whether a relation may lead from its head's type to its tail's: (head, relation) -> tails; false for null."""
    terms = [(F.col(head) == h) & (F.col(relation) == r) & F.col(tail).isin(tails) for (h, r), tails in allowed.items()]
    return F.coalesce(reduce(lambda a, b: a | b, terms, F.lit(False)), F.lit(False))


def in_a_row(df: DataFrame, partition: list[str], order: list[str], time: str, kinds: list[Column], gaps: list[float]) -> DataFrame:
    """The rows that begin a pattern: each row from there on is of the next of *kinds*, at most the next of *gaps* seconds behind the one before."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked, terms = df.withColumn("_t", F.col(time).cast("timestamp").cast("double")), []
    for k, kind in enumerate(kinds):
        marked = marked.withColumn(f"_k{k}", kind)
    for k in range(len(kinds)):
        terms.append(F.lead(f"_k{k}", k).over(w) if k else F.col("_k0"))
        if k:
            terms.append(F.lead("_t", k).over(w) - (F.lead("_t", k - 1).over(w) if k > 1 else F.col("_t")) <= gaps[k - 1])
    met = reduce(lambda a, b: a & b, terms)
    return marked.withColumn("_met", F.coalesce(met, F.lit(False))).filter("_met").select(*df.columns)


def paired_triples(df: DataFrame, partition: list[str], order: list[str], id_: str, first: Column, second: Column) -> DataFrame:
    """`number_id`, `measure_id`, `keyword_id` of nine rows in order of which the first six go *first*, *second* by turns: three rows each."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = df.withColumn("_f", first).withColumn("_s", second)
    at = lambda c, k: F.lead(c, k).over(w) if k else F.col(c)
    made = marked.select(*partition, *[at(id_, k).alias(f"_e{k}") for k in range(9)], reduce(lambda a, b: a & b, [at("_s" if k % 2 else "_f", k) for k in range(6)]).alias("_met"))
    triples = F.explode(F.array(*[F.struct(F.col(f"_e{2 * k}").alias("number_id"), F.col(f"_e{2 * k + 1}").alias("measure_id"), F.col(f"_e{6 + k}").alias("keyword_id")) for k in range(3)])).alias("_t")
    return made.filter("_met AND _e8 IS NOT NULL").select(*partition, triples).select(*partition, "_t.*")


def interleave(df: DataFrame, source: str, order: list[str], ratios: dict[str, float], name: str = "slot") -> DataFrame:
    """Numbers for mixing sources by *ratios*: the k-th row of a source stands at k / ratio; rows of sources without one are left out."""
    placed = positions(df.filter(F.col(source).isin(list(ratios))), [source], order, "_k")
    ratio = F.element_at(F.create_map(*[F.lit(x) for kv in ratios.items() for x in kv]), F.col(source))
    return placed.withColumn(name, F.col("_k") / ratio).drop("_k")


def enrich(rows: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """*rows* with the record of their keys; a row without one makes the query fail when it's run."""
    made = rows.join(records.withColumn("_there", F.lit(True)), keys, "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no record for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))).otherwise(F.col("_there"))
    return made.withColumn("_there", checked).filter("_there").drop("_there")
