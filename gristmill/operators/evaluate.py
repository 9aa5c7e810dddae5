"""Evaluation of predictions (J1, J2, A10-A12, Y3) and frozen stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.scoring import is_correct
from gristmill.operators.joins import spread_join
from gristmill.operators.profile import require_columns


def last_predictions(predictions: DataFrame, position: str = "pos") -> DataFrame:
    """One prediction for each id: the last one given."""
    require_columns(predictions, "id", "prediction", position)
    return predictions.groupBy(F.col("id").cast("string").alias("id")).agg(F.max_by("prediction", position).alias("prediction"))


def scored(solutions: DataFrame, predictions: DataFrame, position: str = "pos") -> DataFrame:
    """solutions with prediction, missing and correct; an answer without a prediction is wrong."""
    require_columns(solutions, "id", "answer")
    held = last_predictions(predictions, position).withColumn("__found", F.lit(True))
    df = solutions.withColumn("id", F.col("id").cast("string")).join(held, "id", "left")
    df = df.withColumn("missing", F.col("__found").isNull()).drop("__found")
    return df.withColumn("correct", ~F.col("missing") & is_correct(F.col("answer"), F.coalesce("prediction", F.lit("None"))))


def with_prompts(solutions: DataFrame, predictions: DataFrame, prompt: str = "prompt", position: str = "pos") -> DataFrame:
    """solutions with their prompt: their own column if they have one, else that of the predictions, else null.

    Which one is decided by the columns there are, not row by row.
    """
    if prompt in solutions.columns:
        return solutions
    if prompt not in predictions.columns:
        return solutions.withColumn(prompt, F.lit(None).cast("string"))
    held = predictions.groupBy(F.col("id").cast("string").alias("__id")).agg(F.max_by(prompt, position).alias(prompt))
    return solutions.join(held, solutions["id"].cast("string") == held["__id"], "left").drop("__id")


def accuracy_rollup(rows: DataFrame, by: str) -> DataFrame:
    """(group, total, n_correct, accuracy): each group and, as '__all__', all rows, in one pass."""
    df = rows.rollup(by).agg(F.count("*").alias("total"), F.count_if("correct").alias("n_correct"), F.grouping(by).alias("g"))
    return df.select(F.when(F.col("g") == 1, "__all__").otherwise(F.col(by)).alias("group"), "total", "n_correct", F.round(F.col("n_correct") / F.col("total"), 6).alias("accuracy"))


#: Draws of a bootstrap task at most.
DRAWS = 4_000_000


def bootstrap_interval(rows: DataFrame, reps: int = 1000, level: float = 0.95) -> DataFrame:
    """(lo, hi) of the mean of `correct` by hashed resampling.

    Every replicate is n draws with replacement: draw j of replicate r takes place md5(r, j) mod n; the correct rows stand
    at the first places, as their order tells nothing. So replicates are equal in any engine, need two counts of the rows,
    and are counted where they are drawn: reps * n draws, in tasks of DRAWS each at most. binomial_interval() needs none.
    """
    r = rows.agg(F.count("*").alias("n"), F.count_if("correct").alias("k")).first()
    if not r.n:
        raise ValueError("no rows to resample")
    spark, total = rows.sparkSession, reps * r.n
    draws = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // DRAWS))).select(F.floor(F.col("id") / r.n).cast("long").alias("r"), (F.col("id") % r.n).alias("j"))
    at = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("r").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long") % r.n
    means = draws.groupBy("r").agg((F.count_if(at < r.k) / r.n).alias("m"))
    a = (1 - level) / 2
    return means.agg(F.round(F.percentile("m", F.lit(a)), 6).alias("lo"), F.round(F.percentile("m", F.lit(1 - a)), 6).alias("hi"))


def binomial_interval(rows: DataFrame, reps: int = 1000, level: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """The same interval from two counts: the sum of a resample of n flags is Binomial(n, share)."""
    import numpy as np

    r = rows.agg(F.count("*").alias("n"), F.count_if("correct").alias("k")).first()
    if not r.n:
        raise ValueError("no rows to resample")
    means = np.random.default_rng(seed).binomial(r.n, r.k / r.n, reps) / r.n
    a = (1 - level) / 2
    return tuple(float(x) for x in np.percentile(means, [100 * a, 100 * (1 - a)]))


def hashed_rank(seed: int, key: Column) -> Column:
    """What rows are shuffled by: md5 of seed and key, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


#: Hexadecimal digits of a hash by which the split counts the rows of a stratum.
PREFIX = 4


def stratified_split(rows: DataFrame, stratum: str, key: str = "id", fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with split 'val' or 'train': of each stratum, max(1, round-half-even(n * fraction)) rows are held out, those of least hash.

    Rows are counted by the first digits of their hash; sums of these counts tell in which of the 16 ** PREFIX ranges a
    stratum's cut lies. Below and above it a row's hash decides; only the rows of that one range are ranked.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    require_columns(rows, stratum, key)
    name = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))
    df = rows.withColumn("__s", name).withColumn("__h", F.coalesce(hashed_rank(seed, F.col(key)), F.lit(""))).withColumn("__p", F.substring("__h", 1, PREFIX))
    counts = df.groupBy("__s", "__p").agg(F.count("*").alias("n"))
    within = Window.partitionBy("__s")  # 16 ** PREFIX rows at most
    counts = counts.withColumn("upto", F.sum("n").over(within.orderBy("__p"))).withColumn("all", F.sum("n").over(within))
    held = F.greatest(F.lit(1).cast("double"), F.bround(F.col("all") * fraction))
    cuts = counts.filter((F.col("upto") >= held) & (F.col("upto") - F.col("n") < held)).select("__s", F.col("__p").alias("__cut"), (held - F.col("upto") + F.col("n")).alias("__need"), F.col("all").alias("__n"))
    met = spread_join(df, cuts, "__s", "__n", rows.count())
    border = met.filter(F.col("__p") == F.col("__cut")).withColumn("__rank", F.row_number().over(Window.partitionBy("__s").orderBy("__h", key)))
    border = border.withColumn("split", F.when(F.col("__rank") <= F.col("__need"), "val").otherwise("train"))
    others = met.filter(F.col("__p") != F.col("__cut")).withColumn("split", F.when(F.col("__p") < F.col("__cut"), "val").otherwise("train"))
    return others.select(*rows.columns, "split").unionByName(border.select(*rows.columns, "split"))


def frozen_split(rows: DataFrame, path: str, stratum: str, key: str = "id", fraction: float = 0.2, seed: int = 42, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, val). The held-out ids are written once and read ever after, until force."""
    require_columns(rows, stratum, key)
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if force or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        stratified_split(rows, stratum, key, fraction, seed).filter("split = 'val'").select(key).orderBy(key).write.mode("overwrite").json(path)
    ids = spark.read.schema(rows.select(key).schema).json(path)
    return rows.join(ids, key, "left_anti"), rows.join(ids, key, "left_semi")
