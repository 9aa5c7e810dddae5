"""Scoring of free text against a gold answer (P11, P12): everything is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import PYWS, bound, last, not_empty, splitlines, strip

NOT_FOUND = "NOT_FOUND"
REL_TOL, ABS_TOL = 1e-2, 1e-5
# Phrases that announce an answer, tried in this order; the colon may be full-width in the last.
_PHRASES = (r"The final answer is:", r"Final answer is:", r"Final answer" + PYWS + "*[:\uff1a]", r"final answer" + PYWS + "*[:\uff1a]")
_FLOAT = r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?(e[+-]?\d+(_\d+)*)?|\.\d+(_\d+)*(e[+-]?\d+(_\d+)*)?|inf(inity)?|nan)\z"


def boxed_answer(text: Column) -> Column:
    """The last non-empty boxed answer: up to the last brace before the next box, or all of it without one; or null."""
    parts = F.split(text, r"\\boxed\{", -1)
    windows = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    inner = F.transform(windows, lambda w: strip(F.when(F.contains(w, F.lit("}")), F.regexp_extract(w, r"(?s)^(.*)\}", 1)).otherwise(w)))
    return last(not_empty(inner))


def phrase_answer(text: Column) -> Column:
    """The last capture of the announcing phrases, taken pattern by pattern; or null."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?iu){p}{PYWS}*([^\\n]+)"), 1) for p in _PHRASES))
    return last(not_empty(F.transform(found, strip)))


def last_number(text: Column) -> Column:
    return last(F.regexp_extract_all(text, F.lit(r"(?U)-?\d+(?:\.\d+)?"), 0))


def last_line(text: Column) -> Column:
    return last(not_empty(F.transform(splitlines(text), strip)))


def extract_answer(text: Column) -> Column:
    """The answer a text gives: boxed, announced, its last number, or its last line; NOT_FOUND if none or null."""
    return F.coalesce(bound(text, lambda t: F.coalesce(boxed_answer(t), phrase_answer(t), last_number(t), last_line(t))), F.lit(NOT_FOUND))


def py_float(c: Column) -> Column:
    """The number that Python's float() reads in ASCII text, or null; digits beyond ASCII are not read."""
    return F.when(c.rlike(_FLOAT), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))


def is_correct(gold: Column, predicted: Column) -> Column:
    """Tolerant equality: binary strings letter by letter, numbers within 1 %, all else without regard to case."""

    def parsed(x: Column) -> Column:
        return F.struct(x["g"].alias("g"), x["p"].alias("p"), py_float(x["g"]).alias("gn"), py_float(x["p"]).alias("pn"))

    def judged(x: Column) -> Column:
        g, p, inf = x["gn"], x["pn"], F.lit(float("inf"))
        finite = (F.abs(g) != inf) & (F.abs(p) != inf)
        near = F.abs(g - p) <= F.greatest(REL_TOL * F.greatest(F.abs(g), F.abs(p)), F.lit(ABS_TOL))
        close = ~F.isnan(g) & ~F.isnan(p) & ((g == p) | (finite & near))
        numbers = g.isNotNull() & p.isNotNull() & ~x["g"].rlike(r"^[01]+\z")
        return F.when(numbers, close).otherwise(F.lower(x["p"]) == F.lower(x["g"]))

    pair = F.struct(strip(gold).alias("g"), strip(predicted).alias("p"))
    return F.coalesce(bound(bound(pair, parsed), judged), F.lit(False))
