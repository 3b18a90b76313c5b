"""Calendar years in whatever written form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_year(column: str | Column) -> Column:
    """The year as int: '2006', ' 2006 ', '2006.0', 'FY2006', 'Year 2006', '2006年'.

    Digits of other scripts (full-width) are read too. Null where no run of four digits stands.
    """
    c = F.col(column) if isinstance(column, str) else column
    ascii_digits = F.translate(c, "０１２３４５６７８９", "0123456789")
    return F.regexp_extract(ascii_digits, r"(?<!\d)(\d{4})(?!\d)", 1).try_cast("int")
