import pytest

from gristmill.sources.files import append_records, built_or, read_puzzles, read_records, usable_records
from gristmill.streaming.scoring import scored_stream


def test_stream_scores_like_batch(spark, tmp_path):
    rows = spark.createDataFrame([("7", "\\boxed{7}"), ("8", "no"), (None, None)], "answer string, completion string")
    rows.write.parquet(str(tmp_path / "in"))
    q = scored_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("scored").collect())) == sorted(map(str, scored_stream(rows).collect()))


def test_csv_keeps_zeros_and_line_ends(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,prompt,answer\n007,"a\nb, ""c""",0011\n')
    assert [tuple(r) for r in read_puzzles(spark, str(tmp_path / "p.csv")).collect()] == [("007", 'a\nb, "c"', "0011")]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text("answer,more,id,prompt\n01,x,007, p \n")
    assert [tuple(r) for r in read_puzzles(spark, str(tmp_path / "p.csv"), stripped=True).collect()] == [("007", "p", "01")]
    (tmp_path / "q.csv").write_text("id,prompt\n1,p\n")
    with pytest.raises(ValueError, match="missing columns: answer"):
        read_puzzles(spark, str(tmp_path / "q.csv"))
    assert [tuple(r) for r in read_puzzles(spark, str(tmp_path / "q.csv"), True, ("id", "prompt")).collect()] == [("1", "p")]


def test_lines_that_cannot_be_read_are_counted(spark, tmp_path):
    good = '{"id": "1", "prompt": "p", "trace": "t"}'
    (tmp_path / "a.json").write_text(good + '\n\n{"id": \n{"id": "2", "prompt": "p"}\n')
    rows, skipped = usable_records(read_records(spark, str(tmp_path / "a.json")))
    assert [(r.id, r.prompt, r.trace) for r in rows.collect()] == [("1", "p", "t")] and skipped == 2
    for name, text in (("b.json", "{\n[\n"), ("c.json", "")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match="can be used"):
            usable_records(read_records(spark, str(tmp_path / name)))


def test_built_once_then_reused(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.createDataFrame([("1", "p", "t", "a", "a")], "id string, prompt string, trace string, extracted_answer string, gold_answer string")

    path = str(tmp_path / "r")
    seen = [(how, [r.id for r in rows.collect()]) for rows, how in (built_or(spark, path, build) for _ in range(2))]
    assert seen == [("built", ["1"]), ("reused", ["1"])] and len(made) == 1
    build().limit(0).write.mode("overwrite").json(path)
    assert built_or(spark, path, build)[1] == "built"


def test_repeated_append_does_not_double(spark, tmp_path):
    rows = spark.createDataFrame([("1", "p", "t", "a", "a")], "id string, prompt string, trace string, extracted_answer string, gold_answer string")
    for _ in range(2):
        append_records(rows, str(tmp_path / "r"), "one")
    assert read_records(spark, str(tmp_path / "r")).filter("not skipped").count() == 1
