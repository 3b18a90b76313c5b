"""Items of varying length combined into containers of fixed capacity (problem 8)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .encode import FOLDER, count_tokens

ASSIGNED = StructType([StructField("container_id", IntegerType()), StructField("bin", LongType()), StructField("piece", IntegerType()), StructField("first_token", LongType()), StructField("tokens", LongType())])


class _Stock:
    """Unpacked items by size: how many are left, and the largest size left at or under any bound."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.left = np.bincount(sizes, minlength=capacity + 1)
        self._refresh()

    def _refresh(self) -> None:
        self.at_most = np.maximum.accumulate(np.where(self.left > 0, np.arange(len(self.left)), -1))
        self.stale = False

    def largest(self, bound: int) -> int:
        """The largest size left that is at most *bound*; -1 if there's none."""
        if bound < 0:
            return -1
        got = int(self.at_most[bound])
        while got >= 0 and self.left[got] == 0:  # sizes used up since the last refresh
            got = int(self.at_most[got - 1]) if got else -1
        return got

    def take(self, size: int) -> None:
        self.left[size] -= 1
        self.stale |= self.left[size] == 0

    def give(self, size: int) -> None:
        self.left[size] += 1
        if self.left[size] == 1:
            self._refresh()

    def best_two(self, least: int, most: int) -> tuple[int, int] | None:
        """Two sizes left with the largest sum above *least* and at most *most*."""
        if self.stale:
            self._refresh()
        first = np.flatnonzero(self.left[1 : most // 2 + 1]) + 1
        if not len(first):
            return None
        second = self.at_most[most - first]
        alone = (second == first) & (self.left[first] < 2)
        if alone.any():  # an item can't be paired with itself
            below = self.at_most[np.maximum(first - 1, 0)]
            second = np.where(alone, np.where(below > 0, below, -1), second)
        sums = np.where(second > 0, first + second, -1)
        best = int(sums.argmax())
        return (int(first[best]), int(second[best])) if sums[best] > least else None


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of sizes: filled greedily, largest fitting item first; then, while a gap is left, a bin's
    smallest item is replaced by the two unpacked ones that fill the widened gap most tightly.
    """
    stock, bins = _Stock(sizes, capacity), []
    left = len(sizes)
    while left:
        if stock.stale:
            stock._refresh()
        size = stock.largest(capacity)
        bin_, gap = [], capacity
        while size > 0 and gap > 0:
            stock.take(size)
            bin_.append(size)
            gap -= size
            size = stock.largest(gap)
        if not bin_:  # only empty items are left; they go into the last bin
            rest = int(stock.left[0])
            (bins[-1] if bins else bins.append([]) or bins[-1]).extend([0] * rest)
            break
        while gap > 0:
            smallest = bin_[-1]  # sizes fall
            pair = stock.best_two(smallest, gap + smallest)
            if pair is None:
                break
            stock.give(bin_.pop())
            for x in pair:
                stock.take(x)
            bin_ = sorted([*bin_, *pair], reverse=True)
            gap -= sum(pair) - smallest
        bins.append(bin_)
        left = int(stock.left.sum())
    return bins


def _assign(sizes: np.ndarray, capacity: int, whole_first: int) -> np.ndarray:
    """The bin of each item: items of one size are alike and taken in their order."""
    order = np.argsort(sizes, kind="stable")
    starts = np.searchsorted(sizes[order], np.arange(capacity + 2))
    at = starts.copy()
    made = np.zeros(len(sizes), np.int64)
    for k, bin_ in enumerate(best_two_fit(sizes, capacity)):
        for size in bin_:
            made[order[at[size]]] = whole_first + k
            at[size] += 1
    return made


def pack(texts: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, shard_rows: int = 40_000) -> DataFrame:
    """For each container kind where each text goes: *key*, container_id, bin, piece, first_token, tokens.

    Sizes are tokens of the container's tokenizer. A text within the capacity is one piece; a longer
    one is split into full pieces, each a bin of its own, and a remainder that is packed as an item.
    Best-two-fit runs within shards of about *shard_rows* rows, drawn by a hash of key, size and, of rows alike in both, their
    number, so that neither a hot key nor the order or layout of the rows matters: the same rows give the same bins; a shard leaves at most its last bins unfilled, some hundredths
    of a percent of its space. All rows are placed, nothing is sampled. The shuffle carries key and size only.

    Cases: null and empty texts have size 0 and share a bin; equal sizes and repeated rows are each
    placed, in order of the key; an empty table gives no rows; a container without capacity (null or
    less than 1) raises ValueError. `bin` is unique within a container kind.
    """
    kinds = [(r.container_id, r.tokenizer, r.capacity_tokens) for r in containers.select("container_id", "tokenizer", "capacity_tokens").limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    if any(not c or c < 1 for _, _, c in kinds):
        raise ValueError("a container needs a capacity of at least 1")
    names = sorted({t for _, t, _ in kinds})
    if not names:
        return texts.sparkSession.createDataFrame([], StructType([texts.schema[key], *ASSIGNED.fields]))
    shards = max(1, -(-texts.count() // shard_rows))
    made = [_pack_by(texts, [(i, c) for i, t, c in kinds if t == name], name, key, text, folder, shards) for name in names]
    return reduce(DataFrame.unionByName, made)


def _pack_by(texts: DataFrame, kinds: list[tuple[int, int]], name: str, key: str, text: str, folder: str, shards: int) -> DataFrame:
    # the token count runs on the scan's partitions, before the shuffle; rows alike in key and size can stand for each other
    alike = count_tokens(texts, key, text, name, folder).groupBy(key, "tokens").agg(F.count("*").alias("_n"))
    each = alike.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).drop("_n")
    sized = each.select(key, F.pmod(F.xxhash64(key, "tokens", "_copy"), F.lit(shards)).cast("int").alias("_shard"), "tokens")
    out = StructType([sized.schema[key], *ASSIGNED.fields])

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([(key, "ascending"), ("tokens", "ascending")])
        tokens = group.column("tokens").to_numpy()
        shard = int(group.column("_shard")[0].as_py())
        parts = []
        for container, capacity in kinds:
            full = np.where(tokens > capacity, tokens // capacity, 0)
            rest = tokens - full * capacity
            items = np.flatnonzero((rest > 0) | (full == 0))
            rows = np.repeat(np.arange(len(tokens)), full)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
            bins = np.r_[np.arange(len(rows)), _assign(rest[items], capacity, len(rows))]
            take = np.r_[rows, items]
            pieces = np.r_[piece, full[items]]
            parts.append(
                pa.Table.from_arrays(
                    [group.column(key).take(pa.array(take)), pa.array(np.full(len(take), container, np.int32)), pa.array((np.int64(shard) << 36) + bins), pa.array(pieces.astype(np.int32)), pa.array((pieces * capacity).astype(np.int64)), pa.array(np.r_[np.full(len(rows), capacity), rest[items]].astype(np.int64))],
                    names=out.names,
                )
            )
        return pa.concat_tables([p.cast(parts[0].schema) for p in parts])

    return sized.groupBy("_shard").applyInArrow(place, out)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container kind: bins, tokens packed, and the share of all space that is filled."""
    per_bin = packed.groupBy("container_id", "bin").agg(F.sum("tokens").alias("t"))
    per = per_bin.groupBy("container_id").agg(F.count("*").alias("bins"), F.sum("t").alias("tokens"))
    return per.join(containers.select("container_id", "capacity_tokens"), "container_id").withColumn("filled", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6))


def overfull(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Bins that hold more than their capacity; none if the packing is right."""
    per_bin = packed.groupBy("container_id", "bin").agg(F.sum("tokens").alias("tokens"))
    return per_bin.join(containers.select("container_id", "capacity_tokens"), "container_id").filter("tokens > capacity_tokens")
