"""Sources and sinks (S1-S8, S14): CSV and JSON lines with explicit schemas, since inference would drop leading zeros."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.text import strip
from gristmill.operators.staging import staged
from gristmill.operators.profile import require_columns

PUZZLES = ("id", "prompt", "answer")
RECORDS = "id string, prompt string, trace string, extracted_answer string, gold_answer string"


def read_puzzles(spark: SparkSession, path: str, stripped: bool = False, columns: tuple[str, ...] = PUZZLES) -> DataFrame:
    """Puzzle rows of a CSV file with a header, all as text; cells may hold quotes and line ends.

    Columns are found by their names in the header, in any order and beside others; ValueError if one is missing (S2).
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    require_columns(df, *columns)
    df = df.select(*columns)
    return df.withColumns({c: strip(F.col(c)) for c in ("prompt", "answer") if c in columns}) if stripped else df


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Training records of JSON lines, with `skipped` true for lines that can't be read."""
    df = spark.read.schema(RECORDS + ", _corrupt_record string").json(path)
    return df.withColumn("skipped", F.col("_corrupt_record").isNotNull() | F.col("prompt").isNull() | F.col("trace").isNull()).drop("_corrupt_record")


def usable_records(records: DataFrame) -> tuple[DataFrame, int]:
    """The records of read_records() that can be used, and how many others are skipped; ValueError if all are."""
    r = records.agg(F.count("*").alias("n"), F.count_if("skipped").alias("skipped")).first()
    if r.skipped == r.n:
        raise ValueError(f"none of {r.n} records can be used")
    return records.filter("not skipped").drop("skipped"), r.skipped


def built_or(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """Records at path and 'reused', if any can be read there; else what build() makes, written there, and 'built' (S14).

    Files that hold no usable record are built anew; other errors of reading or building are not hidden.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        held = read_records(spark, path).filter("not skipped").drop("skipped")
        if not held.isEmpty():
            return held, "reused"
    build().write.mode("overwrite").json(path)
    return read_records(spark, path).filter("not skipped").drop("skipped"), "built"


def concatenated(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """(source_ix, file, line, text): the lines of text files, one path after the other, stripped and without blank ones.

    Order is that of the paths, then of a path's files by name, then of lines in a file: a large file is read in splits, and
    a line's place is that of its split and its place in the split, numbered over the whole file by the sorted rows. With
    a limit the first so many lines are kept.
    """
    out = None
    for k, path in enumerate(paths):
        # Every split is one task's: its file and where it begins order the splits, the row number orders a split's lines.
        one = spark.read.text(path).select(F.lit(k).alias("source_ix"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), strip(F.col("value")).alias("text"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("there are no files to read")
    rows = staged(out.filter("text <> ''"), "lines")  # places are fixed once they are written
    order = ["source_ix", "file", "block", "row"]
    counts = rows.groupBy("source_ix", "file", "block").agg(F.count("*").alias("n"))
    # A row for each split: its first line's number, counting the lines of the file's earlier splits.
    before = Window.partitionBy("source_ix", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_ix", "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source_ix", "file", "block").orderBy("row")
    numbered = rows.join(counts, ["source_ix", "file", "block"]).withColumn("line", F.col("before") + F.row_number().over(within))
    if limit is None:
        return numbered.orderBy(*order).select("source_ix", "file", "line", "text")
    return numbered.orderBy(*order).limit(limit).select("source_ix", "file", "line", "text")


def append_records(records: DataFrame, path: str, run_id: str) -> None:
    """Append under a run's own folder, so that a repeated run replaces its rows instead of doubling them."""
    records.write.mode("overwrite").json(f"{path}/run={run_id}")
