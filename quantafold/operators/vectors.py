"""Vector similarity over array<float> columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine likeness; null for null or zero vectors."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


BLOCK = 4_096  # vectors of either side that one task multiplies at a time


def block_matches(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 1, threshold: float | None = None, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """*key*, `other`, `likeness`: the *k* vectors most like each query but itself, of at least *threshold*; with *group* of each
    value of that column of *vectors*, which is added. Ties by the smallest key; likeness has five digits.

    A stated set of queries against all vectors, by matrix products: both sides are cut to blocks of about *block* rows, each
    task multiplies one block with another and keeps the best *k* per query, and the best of those are found by partial
    maxima. Exact; null and zero vectors are like none.
    """
    many = lambda df: max(1, -(-df.count() // block))
    rows, columns = many(queries), many(vectors)
    groups = [group] if group else []
    unit = lambda df, *more: df.select(F.col(key), F.col(vector).cast("array<double>").alias("_v"), *more)
    number = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = unit(queries, number(rows).alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("_j"))
    right = unit(vectors, *groups, number(columns).alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("_i"))
    kinds = dict(vectors.dtypes)
    names = [key, *groups, "other", "likeness"]
    schema = ", ".join([f"`{key}` {kinds[key]}", *(f"`{g}` {kinds[g]}" for g in groups), f"other {kinds[key]}", "likeness double"])

    def matrix(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        size = max((len(v) for v in column if v is not None), default=0)
        made = np.array([v if v is not None and len(v) == size else np.zeros(size) for v in column], float).reshape(len(column), size)
        made = np.nan_to_num(made)
        norms = np.sqrt((made * made).sum(1))
        return made / np.where(norms > 0, norms, 1.0)[:, None], norms > 0

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names}).astype({"likeness": float})
        b = b.sort_values(key, kind="stable").reset_index(drop=True)  # so that the smallest key comes first among ties
        (x, fine), (y, good) = matrix(a["_v"]), matrix(b["_v"])
        likes = np.round(x @ y.T, 5) if x.shape[1] == y.shape[1] else np.full((len(a), len(b)), -2.0)
        mine, theirs = a[key].to_numpy(), b[key].to_numpy()
        likes[(mine[:, None] == theirs[None]) | ~fine[:, None] | ~good[None]] = -2.0
        out = []
        for label, places in (b.groupby(group).indices.items() if group else [(None, np.arange(len(b)))]):
            part = likes[:, places]
            for _ in range(min(k, len(places))):
                top = part.argmax(1)
                value = part[np.arange(len(a)), top]
                kept = value >= (-1.5 if threshold is None else threshold)
                out.append(pd.DataFrame({key: mine[kept], **({group: label} if group else {}), "other": theirs[places[top[kept]]], "likeness": value[kept]}))
                part[np.arange(len(a)), top] = -2.0
        return pd.concat(out)[names]

    near = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(best, schema)
    if k == 1:
        top = near.groupBy(key, *groups).agg(F.max(F.struct("likeness", (-F.col("other")).alias("o"))).alias("m"))
        return top.select(key, *groups, (-F.col("m.o")).alias("other"), F.col("m.likeness").alias("likeness"))
    return near.withColumn("_rn", F.row_number().over(Window.partitionBy(key, *groups).orderBy(F.desc("likeness"), "other"))).filter(F.col("_rn") <= k).drop("_rn")


def best_matches(vectors: DataFrame, references: DataFrame, key: str, vector: str, threshold: float | None = None) -> DataFrame:
    """*key*, `best`, `likeness`: the nearest reference but itself; ties by the smallest id."""
    return block_matches(vectors, references, key, vector, 1, threshold).withColumnRenamed("other", "best")


def top_matches(vectors: DataFrame, references: DataFrame, key: str, vector: str, threshold: float, k: int) -> DataFrame:
    """*key*, `matches`: up to *k* references of at least *threshold*, the likest first."""
    top = block_matches(vectors, references, key, vector, k, threshold)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("likeness")).alias("l"), "other"))), lambda x: x["other"]).alias("matches"))


def hashed_grams(column: str | Column, dimensions: int = 64, n: int = 3) -> Column:
    """A text as an array<double>: counts of character n-grams hashed to *dimensions* places.

    Needs no trained weights: the default of the encoder slot. Null and empty texts give zeros.
    """
    text = F.concat(F.lit(" "), F.lower(F.coalesce(_c(column), F.lit(""))), F.lit(" "))
    starts = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    places = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(dimensions)).cast("int"))

    @F.pandas_udf("array<double>")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([np.bincount(p, minlength=dimensions).astype(float) for p in part])

    return counted(places)


def word_vectors(texts: DataFrame, column: str, output: str = "vector", dimensions: int = 64, least: int = 2, seed: int = 7) -> DataFrame:
    """*texts* with *output*, the mean of the vectors of a text's words, trained on these texts; words met fewer than *least* times have none,
    so that the vocabulary, which the driver holds while it trains, is bounded by the texts over *least*. Null, empty and unknown texts give zeros.
    Likeness of two texts is the cosine of their vectors. Trained vectors aren't comparable from one set of texts to another.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = texts.withColumn("_words", F.filter(F.split(F.lower(F.coalesce(_c(column), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    model = Word2Vec(vectorSize=dimensions, minCount=least, seed=seed, inputCol="_words", outputCol="_mean", numPartitions=max(1, words.rdd.getNumPartitions())).fit(words)
    return model.transform(words).withColumn(output, vector_to_array("_mean")).drop("_words", "_mean")
