"""Results of an experiment, kept step by step.

A step's result is a version of the whole table: what the steps before have given, and this step's rows. A version is written
in a folder of its own; when that is whole, a pointer of the next number, which names it, is renamed into place. Readers follow the
pointer of the highest number. So they see whole versions only, a step that fails leaves the last one as it was, and a step that is
run again takes its former place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.staging import delete, listed, rename

_POINTER, _VERSION = "pointer-", "version-"


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """The names of the pointers there are, the last one holding; two for as long as a step ends, or if it broke off then."""
    return sorted(x for x in listed(spark, path) if x.startswith(_POINTER))


def _folder(spark: SparkSession, path: str, pointer: str) -> str:
    return f"{path}/{spark.read.text(f'{path}/{pointer}').head().value}"


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all steps, with `step`; None before the first."""
    pointers = _pointers(spark, path)
    return spark.read.parquet(_folder(spark, path, pointers[-1])) if pointers else None


def put(spark: SparkSession, path: str, step: str, rows: DataFrame) -> None:
    """Add a step's rows, in place of those that it gave before. One writer at a time."""
    earlier = _pointers(spark, path)
    held = results(spark, path)
    new = rows.withColumn("step", F.lit(step))
    if held is not None:
        new = held.filter(F.col("step") != step).unionByName(new)
    folder = f"{_VERSION}{uuid.uuid4().hex}"
    new.write.parquet(f"{path}/{folder}")
    spark.createDataFrame([(folder,)], "value string").coalesce(1).write.text(f"{path}/.{folder}")
    number = int(earlier[-1].removeprefix(_POINTER)) + 1 if earlier else 1
    rename(spark, f"{path}/.{folder}", f"{path}/{_POINTER}{number:012d}")
    for pointer in earlier:
        delete(spark, f"{path}/{pointer}")
    for old in listed(spark, path):  # versions that nothing points at, of steps that broke off too
        if old.startswith(_VERSION) and old != folder:
            delete(spark, f"{path}/{old}")


def run_steps(spark: SparkSession, path: str, steps: Iterable[tuple[str, Callable[[], DataFrame]]], again: bool = False) -> DataFrame | None:
    """Run the steps that have no result yet, or with `again` all of them, and keep each one's as soon as it is there."""
    for step, run in steps:
        held = results(spark, path)
        if again or held is None or held.filter(F.col("step") == step).isEmpty():
            put(spark, path, step, run())
    return results(spark, path)
