"""Groups of rows handed to Python one after the other within a partition.

applyInPandas makes a data frame per group, which for many small groups costs more than the work.
Here a partition's rows come in Arrow batches in order of their group, and each group is a list of tuples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def per_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[list[tuple]], Iterable[tuple]], schema: StructType | str) -> DataFrame:
    """*run* gets the rows of each group, as tuples of all columns in order of *order*, and gives rows of *schema*.

    One shuffle by *keys*; a task holds one group and one batch of results at a time.
    """
    places = [df.columns.index(k) for k in keys]
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = out.names

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(out)
        held: list[tuple] = []
        key, made = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                mine = tuple(row[p] for p in places)
                if mine != key:
                    if held:
                        made.extend(run(held))
                    held, key = [], mine
                    if len(made) >= 8192:
                        yield _batch(made, names, arrow)
                        made = []
                held.append(row)
        if held:
            made.extend(run(held))
        if made:
            yield _batch(made, names, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, out)


def _arrow(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
