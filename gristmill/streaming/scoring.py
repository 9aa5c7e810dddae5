"""Scoring as a stream: the batch expressions work unchanged on streaming rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scoring import extract_answer, is_correct


def scored_stream(rows: DataFrame) -> DataFrame:
    """rows (answer, completion) with extracted_answer and correct; stateless, for append mode."""
    df = rows.withColumn("extracted_answer", extract_answer(F.col("completion")))
    return df.withColumn("correct", is_correct(F.col("answer"), F.col("extracted_answer")))


def accuracy_by_window(scored: DataFrame, ts: str = "ts", length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, total, n_correct) in event time; rows later than `late` are dropped by the watermark."""
    return scored.withWatermark(ts, late).groupBy(F.window(ts, length).alias("window")).agg(F.count("*").alias("total"), F.count_if("correct").alias("n_correct"))
