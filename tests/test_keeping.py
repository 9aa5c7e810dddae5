"""What is written and kept: checked writes, steps of an experiment, files one after the other, model batches, windows of a stream."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from gristmill.operators import dataset, evaluate, experiments, families, profile, report, rules, staging
from gristmill.sources.files import concatenated
from gristmill.streaming.scoring import accuracy_by_window

RECORDS = "id string, family string, status string, gold_answer string, extracted_answer string"


def test_a_refused_write_leaves_what_was_there(spark, tmp_path):
    path, seen = str(tmp_path / "records"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    good = spark.createDataFrame([(str(k), "roman", "derived_match", "X", "x") for k in range(40)], RECORDS)
    assert dataset.write_checked(good.withColumn("extracted_answer", counted("extracted_answer")), path) == 40
    assert seen.value == 40  # counted while written, not before
    bad = good.withColumn("extracted_answer", F.when(F.col("id") == "7", "V").otherwise(F.col("extracted_answer")))
    with pytest.raises(ValueError, match="1 of 40 .* 7"):
        dataset.write_checked(bad, path)
    held = spark.read.json(path)
    assert held.count() == 40 and held.filter("extracted_answer = 'V'").isEmpty() and [p.name for p in tmp_path.iterdir()] == ["records"]
    assert dataset.write_checked(bad, path, 0.1) == 40 and spark.read.json(path).filter("extracted_answer = 'V'").count() == 1
    assert dataset.write_checked(good.limit(0), path) == 0


def test_steps_survive_a_failure_and_a_repeat(spark, tmp_path):
    path, runs = str(tmp_path / "results"), []

    def step(name, value, fails=False):
        def run():
            runs.append(name)
            return spark.range(3).select((F.col("id") + value).alias("x")) if not fails else spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("x"))

        return name, run

    assert experiments.results(spark, path) is None
    with pytest.raises(Exception, match="broken"):
        experiments.run_steps(spark, path, [step("a", 10), step("b", 0, fails=True), step("c", 30)])

    def rows():
        return sorted((r.step, r.x) for r in experiments.results(spark, path).collect())

    a, b = [("a", 10), ("a", 11), ("a", 12)], [("b", 20), ("b", 21), ("b", 22)]
    assert rows() == a  # what was done before the failure
    got = experiments.run_steps(spark, path, [step("a", 99), step("b", 20)])
    assert runs == ["a", "b", "b"] and sorted((r.step, r.x) for r in got.collect()) == a + b
    experiments.put(spark, path, "a", spark.range(1).select((F.col("id") + 7).alias("x")))
    assert rows() == [("a", 7), *b]
    assert len([p for p in (tmp_path / "results").iterdir() if not p.name.startswith(".")]) == 2  # one version and its pointer
    # A step that broke off between its pointer and the removal of the one before: the later one holds.
    last = sorted(p.name for p in (tmp_path / "results").iterdir() if p.name.startswith("pointer-"))[0]
    spark.createDataFrame([("version-lost",)], "value string").coalesce(1).write.text(f"{path}/pointer-000000000000")
    assert rows() == [("a", 7), *b] and last > "pointer-000000000000"


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    first, second = tmp_path / "one.txt", tmp_path / "two"
    lines = [f"line {k} " + "x" * (k % 37) for k in range(4000)]
    first.write_text("\n\n".join(f"  {x}\t" for x in lines) + "\n \n", encoding="utf-8")
    second.mkdir()
    (second / "b.txt").write_text("b1\n\nb2", encoding="utf-8")
    (second / "a.txt").write_text("\n a1\n", encoding="utf-8")
    (second / "c.txt").write_text("\n \n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert spark.read.text(str(first)).rdd.getNumPartitions() > 5
        got = [(r.source_ix, r.line, r.text) for r in concatenated(spark, [str(first), str(second)]).collect()]
        top = [r.text for r in concatenated(spark, [str(second), str(first)], 10).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [*((0, k, x.strip()) for k, x in enumerate(lines, 1)), (1, 1, "a1"), (1, 1, "b1"), (1, 2, "b2")]
    assert top == ["a1", "b1", "b2", *(x.strip() for x in lines[:7])]
    with pytest.raises(ValueError, match="no files"):
        concatenated(spark, [])


def test_model_batches_are_filled_over_arrow_batches(spark, tmp_path):
    log = str(tmp_path / "calls")

    def set_up():
        with open(log, "a") as f:
            f.write("set up\n")

        def answer(prompts):
            with open(log, "a") as f:
                f.write(f"{len(prompts)}\n")
            return [f"{p[:4]}!" for p in prompts]

        return answer

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = spark.range(0, 43, 1, 1).select("id", F.format_string("%04d", "id").alias("prompt"))
        got = {r.id: r.completion for r in dataset.generated(rows, batch=8, set_up=set_up).collect()}
        assert got == {k: f"{k:04d}!" for k in range(43)}
        assert open(log).read().split("\n")[:-1] == ["set up", *["8"] * 5, "3"]
        assert dataset.generated(rows.limit(0), lambda ps: ps).count() == 0
        with pytest.raises(Exception, match="completions of"):
            dataset.generated(rows, lambda ps: ps[1:]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    with pytest.raises(ValueError, match="either"):
        dataset.generated(rows)


def test_accuracy_in_event_time(spark, tmp_path):
    def at(minute):
        return datetime.datetime(2024, 1, 1, 12, minute)

    rows = [(at(1), True), (at(4), False), (at(9), True), (at(10), True), (at(25), False)]
    source = spark.createDataFrame(rows, "ts timestamp, correct boolean")
    batch = {r.window.start.minute: (r.total, r.n_correct) for r in accuracy_by_window(source).collect()}
    assert batch == {0: (3, 2), 10: (1, 1), 20: (1, 0)}
    source.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in" / "*"))
    query = accuracy_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.window.start.minute: (r.total, r.n_correct) for r in spark.table("windows").collect()} == batch


def test_nothing_to_report_or_evaluate(spark):
    none = profile.profiled(spark.createDataFrame([], "id string, prompt string, answer string, pos long"))
    with pytest.raises(ValueError, match="no puzzles"):
        report.render(none)
    with pytest.raises(ValueError, match="no answers"):
        report.evaluation_text(evaluate.accuracy_rollup(spark.createDataFrame([], "lang string, correct boolean"), "lang"), 0, (0.0, 0.0))


def test_router_reads_its_input_once(spark, tmp_path):
    rows = [("1", "What is 2 + 2?", "4"), ("2", "In Alice's Wonderland, numbers are secretly converted.\n1 -> I\nNow, write the number 9 in it.", "IX")]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    puzzles = spark.createDataFrame(rows, "id string, prompt string, answer string").withColumn("answer", counted("answer"))
    got = {r.id: (r.family, r.predicted) for r in rules.solve_all(puzzles).collect()}
    assert got == {"1": ("__other__", None), "2": ("numeral", "IX")} and seen.value == 2
    assert staging.staged(spark.range(3), "none").count() == 3


@pytest.mark.parametrize("family", families.FAMILIES)
def test_worded_puzzles_have_one_answer(spark, family):
    rows = families.generated(spark.range(300).withColumnRenamed("id", "pos"), family).collect()
    assert len(rows) == 300 and len({r.prompt for r in rows}) > 290 and {r.prompt.count("\n") - 1 for r in rows} == {3, 4, 5}
    for r in rows:
        assert r.verified and r.trace.endswith(f"\\boxed{{{r.answer}}}")
        if family in families.RATIOS:
            lines = [[round(100 * float(x)) for x in re.findall(r"\d+\.\d\d", line)] for line in r.prompt.split("\n")[1:]]
            power = 2 if family == "gravitational" else 1
            asked = lines[-1][0]
            low = max((2 * y - 1) * asked**power / (2 * x**power) for x, y in lines[:-1])
            high = min((2 * y + 1) * asked**power / (2 * x**power) for x, y in lines[:-1])
            assert low <= high and int(low + 0.5) == int(high + 0.5) == round(100 * float(r.answer)) or asked in [x for x, _ in lines[:-1]]
