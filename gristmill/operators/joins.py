"""Joins whose keys may be frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than one HOT_SHARE-th of the rows is hot.
HOT_SHARE = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row for each key, of which n says how many rows have it.

    A key that holds at least a HOT_SHARE-th of all `total` rows would be one task's work. There are HOT_SHARE such keys at
    most, so their part of the table is broadcast and their rows stay where they are; the others are shuffled.
    """
    hot = F.col(n) * HOT_SHARE >= F.lit(total)
    few, many = table.filter(hot).drop(n), table.filter(~hot).drop(n)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti")  # HOT_SHARE rows at most, here and below
    return rows.join(F.broadcast(few), key).unionByName(others.join(many, key))
