"""Assembly, splits and evaluation against plain Python."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import dataset, evaluate, report


def test_corruption_reaches_its_rate(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("a"), (F.col("id") % 40).cast("string"))).alias("answer")).unionByName(spark.createDataFrame([(9999, None)], "id long, answer string"))
    before = {r.id: r.answer for r in rows.collect()}
    got = dataset.corrupted(rows, 0.3).collect()
    assert len(got) == 3001 and 0.27 < sum(r.corrupted for r in got) / 3000 < 0.33
    assert all((r.answer != before[r.id]) == r.corrupted and r.answer in set(before.values()) for r in got)
    one = spark.createDataFrame([(k, "same") for k in range(20)], "id long, answer string")
    assert not any(r.corrupted for r in dataset.corrupted(one, 0.9).collect()) and dataset.corrupted(rows.limit(0), 0.5).count() == 0
    two = spark.createDataFrame([(k, "xy"[k % 2]) for k in range(200)], "id long, answer string")
    assert all(r.answer == ("yx" if r.corrupted else "xy")[r.id % 2] for r in dataset.corrupted(two, 0.5).collect())


def test_checked_writing_and_counts(spark, tmp_path):
    schema = "id string, family string, status string, gold_answer string, extracted_answer string"
    good = spark.createDataFrame([("1", "roman", "derived_match", "X", "x"), ("2", "symbol", "derived_match", "7", "7.0")], schema)
    bad = good.unionByName(spark.createDataFrame([("3", "__other__", "unmatched", "5", None)], schema))
    assert dataset.write_checked(good, str(tmp_path / "a")) == 2 and spark.read.json(str(tmp_path / "a")).count() == 2
    with pytest.raises(ValueError, match="1 of 3 .* 3"):
        dataset.write_checked(bad, str(tmp_path / "b"))
    assert not (tmp_path / "b").exists() and dataset.write_checked(bad, str(tmp_path / "b"), 0.5) == 3
    counts = {(r.family, r.status): r.n for r in dataset.status_counts(bad).collect()}
    assert counts["symbol", "derived_match"] == 1 and counts["encrypt", "none"] == 0 and ("symbol", "none") not in counts
    r = dataset.match_rates(bad).first()
    assert (r.n, r.matched, r.derived, r.right) == (3, 0.666667, 0.666667, 0.666667) and dataset.match_rates(bad.limit(0)).first().matched == 0


def test_skips(spark):
    def pairs(*reasons):
        return spark.createDataFrame([((x,),) for x in reasons], "pair struct<reject:string>")

    assert dataset.check_skips(pairs(None, None, None, None, "missing")) == 0.2 and dataset.check_skips(pairs()) == 0.0
    with pytest.raises(ValueError, match="2 of 5"):
        dataset.check_skips(pairs(None, None, None, "x", "x"))
    with pytest.raises(ValueError, match="all of 1"):
        dataset.check_skips(pairs("x"), max_share=1.0)


def test_prompts_come_from_solutions_else_predictions(spark):
    solutions = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, answer string")
    predictions = spark.createDataFrame([(1, "x", "old", 0), (1, "x", "new", 1)], "id long, prediction string, prompt string, pos long")
    assert {r.id: r.prompt for r in evaluate.with_prompts(solutions, predictions).collect()} == {"1": "new", "2": None}
    own = solutions.withColumn("prompt", F.lit("mine"))
    assert {r.prompt for r in evaluate.with_prompts(own, predictions).collect()} == {"mine"}
    assert {r.prompt for r in evaluate.with_prompts(solutions, predictions.drop("prompt")).collect()} == {None}


def test_frozen_split_intervals_and_json(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("s"))
    train, val = evaluate.frozen_split(rows, str(tmp_path / "split"), "s")
    first = {r.id for r in val.collect()}
    assert len(first) == 12 and not first & {r.id for r in train.collect()} and train.count() == 48
    again = evaluate.frozen_split(rows, str(tmp_path / "split"), "s", seed=1)[1]
    assert {r.id for r in again.collect()} == first
    forced = evaluate.frozen_split(rows, str(tmp_path / "split"), "s", seed=1, force=True)[1]
    assert {r.id for r in forced.collect()} != first
    flags = spark.range(400).select((F.col("id") % 4 != 0).alias("correct"))
    lo, hi = evaluate.binomial_interval(flags)
    r = evaluate.bootstrap_interval(flags).first()
    assert 0.68 < lo < 0.75 < hi < 0.82 and abs(r.lo - lo) < 0.02 and abs(r.hi - hi) < 0.02
    with pytest.raises(ValueError, match="no rows"):
        evaluate.bootstrap_interval(flags.limit(0))
    one = spark.createDataFrame([("d", 1, [("int", 1)], [(8, 1)], 1, [("t", 1)])], "domain string, n long, answer_formats array<struct<key:string,n:long>>, binary_widths array<struct<key:int,n:long>>, distinct_templates long, top_templates array<struct<key:string,n:long>>")
    report.write_json(one, str(tmp_path / "json"))
    written = "".join(p.read_text() for p in (tmp_path / "json").glob("part-*.json"))
    assert json.loads(written)["count"] == 1


def test_bootstrap_draws_every_row_of_every_replicate(spark):
    n, k, reps = 300, 225, 50
    means = sorted(sum(int(hashlib.md5(f"{r}-{j}".encode()).hexdigest()[:8], 16) % n < k for j in range(n)) / n for r in range(reps))
    got = evaluate.bootstrap_interval(spark.range(n).select((F.col("id") % 4 != 0).alias("correct")), reps=reps).first()
    assert (got.lo, got.hi) == tuple(round(float(x), 6) for x in np.percentile(means, [2.5, 97.5]))
