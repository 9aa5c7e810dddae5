"""Corpus profiles: domains, answer formats, templates and coverage gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.classify import BINARY_WIDTHS, EXPECTED_FORMATS, answer_format, domain, template_signature
from gristmill.functions.text import strip


def require_columns(df: DataFrame, *names: str) -> None:
    """ValueError unless df has all of these columns."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_rows(df: DataFrame, what: str) -> None:
    """ValueError if df has no rows (P1); one row is looked for."""
    if df.isEmpty():
        raise ValueError(f"there are no {what}")


def profiled(puzzles: DataFrame) -> DataFrame:
    """puzzles with domain, format, signature and width of binary answers; no shuffle."""
    require_columns(puzzles, "id", "prompt", "answer")
    df = puzzles.withColumns({"domain": domain(F.col("prompt")), "format": answer_format(F.col("answer")), "signature": template_signature(F.col("prompt"))})
    return df.withColumn("width", F.when(F.col("format") == "binary", F.length(strip(F.col("answer")))))


def histograms(rows: DataFrame) -> DataFrame:
    """(domain, dimension, key, n): rows, answer formats, binary widths and templates of each domain in one pass."""
    long = rows.select("domain", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), k.cast("string").alias("key")) for d, k in (("rows", F.lit("")), ("format", F.col("format")), ("width", F.col("width")), ("template", F.col("signature")))))).alias("x"))
    return long.filter("x.key is not null").groupBy("domain", F.col("x.dimension").alias("dimension"), F.col("x.key").alias("key")).agg(F.count("*").alias("n"))


def domain_shares(rows: DataFrame) -> DataFrame:
    """(domain, n, share), over all rows."""
    counts = rows.groupBy("domain").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def most_common(rows: DataFrame, key: str, k: int, position: str = "pos") -> DataFrame:
    """The k most frequent keys of each domain; of equals, the one seen first comes first."""
    counts = rows.groupBy("domain", key).agg(F.count("*").alias("n"), F.min(position).alias("first_pos"))
    order = Window.partitionBy("domain").orderBy(F.col("n").desc(), "first_pos")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def first_ids(rows: DataFrame, by: str, k: int = 3, position: str = "pos") -> DataFrame:
    """The first k ids of each group in the order of position."""
    order = Window.partitionBy(by).orderBy(position)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(by, "rank", "id")


def coverage_gaps(rows: DataFrame) -> DataFrame:
    """(kind, domain, detail, n): the summary, uncovered rows, domains not seen, formats and widths not generated."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(d,) for d, _ in EXPECTED_FORMATS], "domain string")  # the seven domains
    formats = spark.createDataFrame([(d, f) for d, fs in EXPECTED_FORMATS for f in fs], "domain string, format string")
    seen = rows.groupBy("domain", "format", "width").agg(F.count("*").alias("n"))
    by_domain = seen.groupBy("domain").agg(F.sum("n").alias("n"))
    covered = by_domain.agg(F.coalesce(F.sum(F.when(F.col("domain") != "uncovered", F.col("n"))), F.lit(0)).alias("n")).select(F.lit("covered").alias("kind"), F.lit("").alias("domain"), F.lit("").alias("detail"), "n")
    uncovered = by_domain.filter("domain = 'uncovered'").select(F.lit("uncovered").alias("kind"), "domain", F.lit("").alias("detail"), "n")
    unseen = known.join(by_domain, "domain", "left_anti").select(F.lit("not_seen").alias("kind"), "domain", F.lit("").alias("detail"), F.lit(0).cast("long").alias("n"))
    odd = seen.filter("format <> 'empty' and domain <> 'uncovered'").join(formats, ["domain", "format"], "left_anti").groupBy("domain", "format").agg(F.sum("n").alias("n")).select(F.lit("format").alias("kind"), "domain", F.col("format").alias("detail"), "n")
    wide = seen.filter((F.col("domain") == "binary_ops") & F.col("width").isNotNull() & ~F.col("width").isin(*BINARY_WIDTHS)).groupBy("domain", "width").agg(F.sum("n").alias("n")).select(F.lit("width").alias("kind"), "domain", F.col("width").cast("string").alias("detail"), "n")
    return covered.unionByName(uncovered).unionByName(unseen).unionByName(odd).unionByName(wide)
