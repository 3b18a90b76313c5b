"""Entity, attribute, value rows into a wide table by positional stitching (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..session import cut

_SPARK = {"double": DoubleType(), "bigint": LongType(), "string": StringType()}
_NUMPY = {"double": np.float64, "bigint": np.int64, "string": object}
_ARROW = {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string()}


MOST_IN_RANGE = 2_000_000  # places of all columns of one ordinal range, so that a task's memory doesn't follow the number of attributes


def _ordinals(cells: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Adds `_ordinal`: 0, 1, 2, ... over the entities, gapless over the whole table.

    Entities are hashed to buckets; within a bucket they're numbered in order of their keys, and a
    bucket's numbers begin where those before it end. Only one count per bucket goes to the driver,
    and numbers depend on the data alone, so a task that is run again gives the same ones.
    """
    local = cells.withColumn("_bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
    ranked = local.withColumn("_local", F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*keys)))
    counts = dict(local.groupBy("_bucket").agg(F.countDistinct(F.struct(*keys)).alias("n")).collect())
    start, starts = 0, []
    for b in range(buckets):
        starts.append(start)
        start += counts.get(b, 0)
    # element_at on a literal array keeps the lookup inside generated code
    return ranked.withColumn("_ordinal", F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("_bucket") + 1) + F.col("_local") - 1)


def stitch(rows: DataFrame, keys: list[str], attribute: str, value: str, columns: dict[str, str], buckets: int | None = None, span: int = 4096, every: bool = False) -> DataFrame:
    """One row per entity: `ordinal`, the *keys*, one typed column per attribute, `conflicts`.

    columns: attribute -> 'double', 'bigint' or 'string'. A cell of two or more different values gets
    the smallest, and its attribute stands in `conflicts` (an array in order of the columns, empty if
    none). Rows of other attributes are left out; entities without any value in *columns* too, unless
    *every* is set: then each distinct combination of the keys has a row, of nulls where it has no value.

    Positional stitching: entities get global ordinals; within each range of *span* ordinals every
    attribute is written as one typed column at the positions of its entities, and the columns are put
    side by side by position, without joins. Rows are first reduced to one per entity and attribute
    with partial aggregates, so a hot key costs what its distinct cells do.

    Cases: null keys make an entity of their own (null is a key like others); null, NaN and, for
    typed columns, values that can't be cast are no values; repeated rows count once; an empty table
    gives no rows; attributes never met give null columns; further columns are left out. An attribute
    named, case aside, as a key, `ordinal`, `conflicts` or an attribute before it gets `_value` behind its
    column's name.
    """
    if len(columns) > 10_000:
        raise ValueError("more than 10,000 attributes; keep such a table long")
    buckets = buckets or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    names, kinds = list(columns), [columns[c] for c in columns]
    headings: list[str] = []
    for name in names:
        taken = {h.lower() for h in (*keys, "ordinal", "conflicts", *headings)}
        while name.lower() in taken:
            name += "_value"
        headings.append(name)
    picked = rows.select(*keys, F.col(attribute).alias("_attribute"), F.col(value).alias("_value"))
    if not every:
        picked = picked.filter(F.col("_attribute").isin(names))
    if len(names) >= 200:  # a literal map of so many would make the generated code long
        places = rows.sparkSession.createDataFrame(list(enumerate(names)), "_place int, _attribute string")
        picked = picked.join(F.broadcast(places), "_attribute", "left")
    else:
        picked = picked.withColumn("_place", F.element_at(F.create_map(*[x for k, c in enumerate(names) for x in (F.lit(c), F.lit(k))]), F.col("_attribute")))
    one_type = len(set(kinds)) == 1
    if one_type:
        picked = picked.withColumn("_value", F.col("_value").try_cast(kinds[0]))
    else:  # kept as text until it's written into its column
        picked = picked.withColumn("_value", F.col("_value").cast("string"))
        for kind in ("double", "bigint"):
            at = [k for k, x in enumerate(kinds) if x == kind]
            if at:
                picked = picked.withColumn("_value", F.when(F.col("_place").isin(at), F.col("_value").try_cast(kind).cast("string")).otherwise(F.col("_value")))
    if one_type and kinds[0] == "double":
        picked = picked.withColumn("_value", F.nanvl("_value", F.lit(None).cast("double")))
    full = F.col("_value").isNotNull() & F.col("_place").isNotNull()
    if every:  # what fills no cell stands at place -1, which is no column's, and keeps its entity
        picked = picked.select(*keys, F.when(full, F.col("_place")).otherwise(-1).alias("_place"), F.when(full, F.col("_value")).alias("_value"))
    else:
        picked = picked.filter(full)
    cells = picked.groupBy(*keys, "_place").agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    cells = cells.select(*keys, "_place", "_low", F.coalesce(F.col("_low") != F.col("_high"), F.lit(False)).alias("_several"))
    placed = _ordinals(cells, keys, buckets).select("_bucket", "_ordinal", *keys, "_place", "_low", "_several")
    span = max(1, min(span, MOST_IN_RANGE // max(len(names), 1)))
    ordered = placed.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_ordinal")
    key_fields = [f for k in keys for f in cells.schema.fields if f.name == k]
    out = StructType([StructField("ordinal", LongType()), *[StructField(f.name, f.dataType) for f in key_fields], *[StructField(n, _SPARK[k]) for n, k in zip(headings, kinds, strict=True)], StructField("conflicts", ArrayType(StringType()))])
    key_count = len(keys)

    def write(first: int, ordinals: np.ndarray, keyed: list[pa.Array], places: np.ndarray, values: np.ndarray, several: np.ndarray) -> pa.RecordBatch:
        at = ordinals - first
        size = int(at[-1]) + 1
        heads = np.flatnonzero(np.r_[True, ordinals[1:] != ordinals[:-1]])  # ordinals have no gaps
        made = [pa.array(np.arange(first, first + size))] + [k.take(pa.array(heads)) for k in keyed]
        for place, kind in enumerate(kinds):
            mine = places == place
            column, missing = np.zeros(size, _NUMPY[kind]), np.ones(size, bool)
            got = values[mine]
            if kind == "bigint":
                got = np.array([int(x) for x in got], np.int64)
            elif kind == "double":
                got = got.astype(np.float64)
            column[at[mine]], missing[at[mine]] = got, False
            made.append(pa.array(column, _ARROW[kind], mask=missing))
        marks: list[list[str]] = [[] for _ in range(size)]
        for k in np.flatnonzero(several):
            marks[at[k]].append(names[places[k]])
        made.append(pa.array([sorted(m, key=order.get) for m in marks], pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays(made, names=out.names)

    order = {n: k for k, n in enumerate(names)}

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts the ordered cells into ordinal ranges; the last range of a batch waits for the next."""
        rest: pa.Table | None = None
        for batch in batches:
            got = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, got]).combine_chunks() if rest is not None else got
            ordinals = rest.column("_ordinal").to_numpy()
            if len(ordinals) < 8 * span:
                continue
            whole = int(np.searchsorted(ordinals, ordinals[-1]))  # the last entity may go on
            yield from ranges(rest.slice(0, whole))
            rest = rest.slice(whole).combine_chunks()
        if rest is not None and len(rest):
            yield from ranges(rest)

    def ranges(cells: pa.Table) -> Iterator[pa.RecordBatch]:
        cells = cells.combine_chunks()
        ordinals = cells.column("_ordinal").to_numpy()
        breaks = np.flatnonzero(np.r_[True, np.diff(ordinals) > 1, True]) if len(ordinals) else []
        places, several = cells.column("_place").to_numpy(), cells.column("_several").to_numpy(zero_copy_only=False)
        values = cells.column("_low").to_numpy(zero_copy_only=False)
        keyed = [cells.column(2 + k).combine_chunks() for k in range(key_count)]
        for a, b in zip(breaks[:-1], breaks[1:], strict=True):  # buckets lie apart
            while a < b:
                end = min(b, a + int(np.searchsorted(ordinals[a:b], ordinals[a] + span)))
                yield write(int(ordinals[a]), ordinals[a:end], [k.slice(a, end - a) for k in keyed], places[a:end], values[a:end], several[a:end])
                a = end

    return ordered.mapInArrow(assemble, out)


def conflicting_cells(wide: DataFrame, keys: list[str], attribute: str) -> DataFrame:
    """The cells of a stitched table that are not single-valued: *keys* and *attribute*."""
    return wide.select(*keys, F.explode("conflicts").alias(attribute))


def dense_ids(rows: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """The distinct values of *key*, not null, in order, numbered from 0 without gaps.

    Range partitions hold the values in order; a count per partition gives each its first number, so
    that no single task sees all values.
    """
    buckets = buckets or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    values = cut(rows.filter(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(buckets, key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()))
    counts = values.groupBy("_part").agg(F.count("*").alias("_n"))
    firsts = counts.withColumn("_first", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # one row per partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return values.withColumn("_local", local).join(F.broadcast(firsts), "_part").select(key, (F.col("_first") + F.col("_local")).alias(name))
