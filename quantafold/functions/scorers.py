"""Slots for trained models: a scorer is a function from a batch of texts to a value each.

Models that the environment lacks are stood in for by rules, so that plans run and a scorer can be put in their place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pd.Series], pd.Series | pd.DataFrame]
_CELL = re.compile(r"^\s*[~≈]?\s*([-+]?[\d.,]*\d)\s*\(?([^()\d]*?)\)?[*#]?\s*$")


def pass_through(texts: pd.Series) -> pd.Series:
    """All texts are well formed."""
    return texts.notna()


def split_by_rule(cells: pd.Series) -> pd.DataFrame:
    """Number and unit of a cell; both null where no number begins it."""
    found = [_CELL.match(c) if c else None for c in cells]
    return pd.DataFrame({"number": [m[1] if m else None for m in found], "unit": [(m[2].strip() or None) if m else None for m in found]})


def apply(df: DataFrame, column: str, scorer: Scorer, schema: str) -> DataFrame:
    """*df* with `made`, what the scorer makes of *column*, over Arrow batches; *schema*: a type, or the fields of a struct."""

    @F.pandas_udf(schema)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield scorer(part)

    return df.withColumn("made", run(column))


def keep(df: DataFrame, column: str, scorer: Scorer) -> DataFrame:
    """The rows for which the scorer gives true; null counts as false."""

    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield scorer(part)

    return df.filter(F.coalesce(run(column), F.lit(False)))
