"""Positions and prefix sums over all rows of a sorted table, without a window over a key that may be hot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from gristmill.llm.common import HOT_SHARE, materialise, spread_join

#: monotonically_increasing_id() has the partition above this bit and the row's place in it below.
_PART_BIT = 33


def ordered(df: DataFrame, order: list[str], tag: str, value: str | None = None) -> DataFrame:
    """df, written in the order of these columns (nulls first), with `at`, the number of rows before, and with value, a column
    of integers without nulls, `before`, its sum over those rows.

    Rows are dealt into ranges and sorted there; a row's place in its range and the range's sums give its place among all.
    A range's bounds are rows, so a frequent key spans many ranges if the last columns of the order tell its rows apart.
    The ranges' sums are one row for each partition, and only they are broadcast.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    t = df.repartitionByRange(*by).sortWithinPartitions(*by)
    if value is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for b in batches:
                v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
                sums = np.cumsum(v) + total
                if len(v):
                    total = int(sums[-1])
                yield b.append_column("__sum", pa.array(sums - v))

        t = t.mapInArrow(run, StructType([*t.schema.fields, StructField("__sum", LongType())]))
    t = materialise(t.withColumn("__id", F.monotonically_increasing_id()), tag)
    part, place = F.shiftright("__id", _PART_BIT), F.col("__id").bitwiseAND((1 << _PART_BIT) - 1)
    sums = [F.max(place + 1).alias("n")] + ([F.max(F.col("__sum") + F.col(value)).alias("s")] if value is not None else [])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    ranges = t.groupBy(part.alias("__part")).agg(*sums)
    ranges = ranges.select("__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in ranges.columns[1:]])
    t = t.withColumn("__part", part).join(F.broadcast(ranges), "__part").withColumn("at", place + F.col("__n"))
    if value is not None:
        t = t.withColumn("before", F.col("__sum") + F.col("__s")).drop("__sum", "__s")
    return t.drop("__part", "__id", "__n")


def with_key(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with the one row that table has for each key, of which n says how many rows have it; see spread_join."""
    return spread_join(rows, table.withColumn("__rows", F.col(n)), key, "__rows", max(total, HOT_SHARE))


def null_first(column: str):
    """A text that is never null and sorts as the column's text does, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))
