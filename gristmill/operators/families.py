"""Synthetic puzzles in the wording of the ratio and numeral families, proved by their solvers.

Constants and observations are whole numbers of hundredths and ten-thousandths, so every shown decimal is exact. An attempt
draws a constant, observations and a question. What the shown roundings leave of the constant is an interval; the attempt
holds if both its ends give the question one answer, so the examples settle the puzzle. If it doesn't, the next attempt is
drawn, from a hash that counts attempts; after TRIES the last one asks for its first observation again. Rows become puzzles where they
stand, as in generate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import numerals
from gristmill.operators.dataset import trace
from gristmill.operators.generate import Draw
from gristmill.operators.rules import HEADER, SOLVERS

TRIES = 16
#: Numbers of observations of a puzzle.
OBSERVED = (3, 4, 5)
NUMERALS = 100


@dataclass(frozen=True)
class Ratio:
    """y = constant * x (or constant * x * x / 2, if square), rounded to hundredths: ranges of the constant in ten-thousandths and of x in hundredths."""

    square: bool
    constant: tuple[int, int]
    x: tuple[int, int]

    def unit(self) -> int:
        """constant * x (* x) of the whole numbers over this is y in hundredths."""
        return 2_000_000 if self.square else 10_000


RATIOS = {"gravitational": Ratio(True, (50_000, 200_000), (100, 500)), "unit_conversion": Ratio(False, (5_000, 20_000), (500, 5_000))}
FAMILIES = (*RATIOS, "numeral")
# The wording of the families.
OPENINGS = {
    "gravitational": "the gravitational constant has been secretly changed. Here are some example observations:",
    "unit_conversion": "a secret unit conversion is applied to measurements. For example:",
    "numeral": "numbers are secretly converted into a different numeral system. Some examples are given below:",
}
LINES = {"gravitational": ("For t = ", "s, distance = ", " m"), "unit_conversion": ("", " m becomes ", ""), "numeral": ("", " -> ", "")}
QUESTIONS = {"gravitational": ("Now, determine the falling distance for t = ", "s given d = 0.5*g*t^2."), "unit_conversion": ("Now, convert the following measurement: ", " m"), "numeral": ("Now, write the number ", " in the Wonderland numeral system.")}


def _floor(a: Column, b: Column | int) -> Column:
    """a over b, rounded down; both above 0."""
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def _hundredths(v: Column) -> Column:
    return F.concat(_floor(v, 100).cast("string"), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"))


def _attempt(r: Ratio, seed: int, family: str, n: Column, j: Column) -> Column:
    """struct<constant, xs, ys, settled>: n observations and, last, the question."""

    def below(salt, size: int) -> Column:
        text = F.concat(F.lit(f"{seed}:{family}:"), F.col("pos").cast("string"), F.lit(":"), j.cast("string"), F.lit(":"), salt)
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % size

    def power(x: Column) -> Column:
        return x * x if r.square else x

    constant = below(F.lit("constant"), r.constant[1] - r.constant[0] + 1) + r.constant[0]
    xs = F.transform(F.sequence(F.lit(0), n), lambda i: below(F.concat(F.lit("x"), i.cast("string")), r.x[1] - r.x[0] + 1) + r.x[0])
    drawn = F.struct(constant.alias("constant"), xs.alias("xs"))

    def valued(d: Column) -> Column:
        ys = F.transform(d["xs"], lambda x: _floor(d["constant"] * power(x) + r.unit() // 2, r.unit()))
        return F.struct(d["constant"].alias("constant"), d["xs"].alias("xs"), ys.alias("ys"))

    def judged(d: Column) -> Column:
        q = power(F.element_at(d["xs"], -1))

        def end(sign: int) -> Column:
            """The question's answer, in hundredths, at an end of what each observation leaves."""
            return F.slice(F.zip_with(d["xs"], d["ys"], lambda x, y: _floor((2 * y + sign) * q + power(x), 2 * power(x))), F.lit(1), n)

        return F.struct(d["constant"], d["xs"], d["ys"], (F.array_max(end(-1)) == F.array_min(end(1))).alias("settled"))

    one = F.transform(F.transform(F.array(drawn), valued), judged)[0]
    return one


def _drawn(r: Ratio, seed: int, family: str, n: Column) -> Column:
    """The first attempt that holds, or the last one with its first observation as the question."""

    def last(a: Column) -> Column:
        def again(v: Column) -> Column:
            return F.concat(F.slice(v, F.lit(1), n), F.slice(v, 1, 1))

        return F.struct(a["constant"], again(a["xs"]).alias("xs"), again(a["ys"]).alias("ys"), F.lit(True).alias("settled"))

    first = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES - 1)), _attempt(r, seed, family, n, F.lit(0)), lambda a, j: F.when(a["settled"], a).otherwise(_attempt(r, seed, family, n, j)))
    return F.transform(F.array(first), lambda a: F.when(a["settled"], a).otherwise(last(a)))[0]


def _prompt(family: str, shown: Column, outs: Column, n: Column) -> Column:
    before, between, after = LINES[family]
    lines = F.slice(F.zip_with(shown, outs, lambda x, y: F.concat(F.lit(before), x, F.lit(between), y, F.lit(after))), F.lit(1), n)
    question = F.concat(F.lit(QUESTIONS[family][0]), F.element_at(shown, -1), F.lit(QUESTIONS[family][1]))
    return F.array_join(F.concat(F.array(F.lit(HEADER + OPENINGS[family])), lines, F.array(question)), "\n")


def generated(rows: DataFrame, family: str, seed: int = 42) -> DataFrame:
    """pos, rule, prompt, answer, trace and verified for each row's pos.

    The trace is the solver's; verified says that the solver, which is shown only the prompt, finds the answer, and for
    numerals that every numeral reads back as its number.
    """
    draw = Draw(seed, family)
    df = rows.select("pos").withColumn("n", draw.of("n", OBSERVED))
    if family in RATIOS:
        r = RATIOS[family]
        df = df.withColumn("a", _drawn(r, seed, family, F.col("n")))
        df = df.withColumns({"shown": F.transform("a.xs", _hundredths), "outs": F.transform("a.ys", _hundredths), "proved": F.col("a.settled")})
        c = F.col("a.constant")
        rule = F.concat(F.lit("k = "), _floor(c, 10_000).cast("string"), F.lit("."), F.lpad((c % 10_000).cast("string"), 4, "0"))
    else:
        numbers = F.transform(draw.walk("number", NUMERALS, max(OBSERVED) + 1), lambda v: v + 1)
        df = df.withColumn("xs", F.slice(numbers, F.lit(1), F.col("n") + 1))
        df = df.withColumns({"shown": F.transform("xs", lambda v: v.cast("string")), "outs": F.transform("xs", numerals.to_roman)})
        df = df.withColumn("proved", F.forall(F.zip_with("xs", "outs", lambda x, y: numerals.from_roman(y) == x), lambda x: x))
        rule = F.lit("roman")
    df = df.select("pos", rule.alias("rule"), _prompt(family, F.col("shown"), F.col("outs"), F.col("n")).alias("prompt"), F.element_at("outs", -1).alias("answer"), "proved")
    solved = SOLVERS[family].solve(df)
    return solved.select("pos", "rule", "prompt", "answer", trace(F.col("status"), F.col("steps"), F.col("predicted")).alias("trace"), (F.col("proved") & F.col("predicted").eqNullSafe(F.col("answer"))).alias("verified"))
