import pytest
from pyspark.sql import functions as F

from gristmill.functions import classify, numerals, scoring
from gristmill.operators.evaluate import stratified_split

VERIFY = [("10011000", "10011000", True), ("11011", "00011011", False), ("1", "1.0", False), ("0", "0.000001", False), ("0.0", "0.000001", True), ("24.64", "24.6401", True), ("24.64", "25.0", False), ("42", "42.0", True), ("-7", "7", False), ("XLVII", "xlvii", True), ("42 apples", "42", False), ("  XLVII  ", "  xlvii  ", True), ("nan", "nan", False), ("inf", "inf", True), ("1_000", "1000", True), ("1d", "1", False)]
EXTRACT = [("\\boxed{3} then \\boxed{7}", "7"), ("\\boxed{42}\\boxed{}", "42"), ("\\boxed{}52}", "}52"), ("\\boxed{\\frac{1}{2}}", "\\frac{1}{2}"), ("\\boxed{  42  }", "42"), ("\\boxed{} The final answer is: 99", "99"), ("Final answer：42", "42"), ("Final answer: 7\nThe final answer is: 3", "7"), ("got 10, got 30", "30"), ("line one\n\nline three\n\n", "line three"), ("\\boxed{}", "\\boxed{}"), ("", "NOT_FOUND"), ("  ", "NOT_FOUND"), (None, "NOT_FOUND")]
FORMATS = [("10010111", "binary"), ("0", "int"), ("-12", "int"), ("24.64", "float"), ("xlvii", "roman"), ("wizard", "word"), ("cat imagines book", "phrase"), ("", "empty"), ("3/4", "other"), ("1e5", "hex")]


def test_verify(spark):
    rows = spark.createDataFrame(VERIFY, "g string, p string, want boolean").withColumn("got", scoring.is_correct(F.col("g"), F.col("p"))).collect()
    assert [r for r in rows if r.got != r.want] == []


def test_extract(spark):
    rows = spark.createDataFrame(EXTRACT, "t string, want string").withColumn("got", scoring.extract_answer(F.col("t"))).collect()
    assert [r for r in rows if r.got != r.want] == []


def test_formats(spark):
    rows = spark.createDataFrame(FORMATS, "t string, want string").withColumn("got", classify.answer_format(F.col("t"))).collect()
    assert [r for r in rows if r.got != r.want] == []


def test_roman_round_trip(spark):
    df = spark.range(0, 4001).select("id", numerals.to_roman(F.col("id")).alias("r")).withColumn("n", numerals.from_roman(F.col("r")))
    assert df.filter("n = id").count() == 3999 and df.filter("r is null").count() == 2


@pytest.mark.parametrize("parts", [1, 8])
def test_split_is_the_same_for_any_partitioning(spark, parts):
    rows = spark.range(57).select("id", (F.col("id") % 3).alias("s")).repartition(parts)
    val = sorted(r.id for r in stratified_split(rows, "s").filter("split = 'val'").collect())
    assert len(val) == 12
    assert val == sorted(r.id for r in stratified_split(spark.range(57).select("id", (F.col("id") % 3).alias("s")), "s").filter("split = 'val'").collect())


def test_split_ranks_only_at_the_cut(spark):
    """Same rows as ranking every stratum whole; nulls, repeats and a stratum that holds most rows."""
    import hashlib

    rows = [(k, "big" if k % 5 else None if k % 3 else "small", "x") for k in range(900)] + [(7, "big", "x"), (None, "big", "x"), (10**9, "one", "x")]
    got = stratified_split(spark.createDataFrame(rows, "id long, s string, n string").repartition(5), "s").collect()
    for s in {r[1] for r in rows}:
        own = sorted((r[0] for r in rows if r[1] == s), key=lambda k: ("" if k is None else hashlib.md5(f"42:{k}".encode()).hexdigest(), k or 0))
        assert sorted((r.id for r in got if r.s == s and r.split == "val"), key=str) == sorted(own[: max(1, round(len(own) * 0.2))], key=str)
    assert sorted(((r.id, r.s, r.n) for r in got), key=str) == sorted(rows, key=str)
