"""Roman numerals and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import bound

# The digits of Roman numerals by decimal place, and the values of its letters.
PLACES = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))
LETTERS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
# The steps by which a number is taken apart.
_STEPS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def to_roman(n: Column) -> Column:
    """The numeral of 1 to 3999; null beyond."""
    digits = [F.floor(n / 10**p) % 10 for p in (3, 2, 1, 0)]
    parts = [F.element_at(F.array(*map(F.lit, d)), (k + 1).cast("int")) for d, k in zip(PLACES, digits, strict=True)]
    return F.when((n >= 1) & (n <= 3999), F.concat(*parts))


def from_roman(s: Column) -> Column:
    """The value, letters below their right neighbour subtracting; null for other letters or none."""
    letters = F.split(F.reverse(F.upper(s)), "")
    value = F.create_map(*(x for k, v in LETTERS.items() for x in (F.lit(k), F.lit(v))))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev"))
    total = F.aggregate(F.filter(letters, lambda c: c != ""), start, lambda a, c: F.struct((a["total"] + F.when(value[c] < a["prev"], -value[c]).otherwise(value[c])).alias("total"), value[c].alias("prev")), lambda a: a["total"])
    return F.when(s.rlike(r"(?i)^[IVXLCDM]+\z"), total)


def greedy_steps(n: Column) -> Column:
    """The steps by which n is taken apart, as 'value=letters' in order."""
    steps = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in _STEPS))
    start = F.struct(n.cast("int").alias("left"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        steps,
        start,
        lambda a, x: F.struct((a["left"] % x["v"]).alias("left"), F.concat(a["out"], F.array_repeat(F.concat(x["v"].cast("string"), F.lit("="), x["s"]), F.floor(a["left"] / x["v"]).cast("int"))).alias("out")),
        lambda a: a["out"],
    )


def two_decimals(x: Column) -> Column:
    """Text with two decimals as Python's '.2f' gives it: by the exact binary value, halves to even.

    Whether 200 x lies above or below an odd number is decided exactly: x is split into two parts of 26 bits, whose products
    with 200 are exact. Beyond 2^44, where doubles have no hundredths to be rounded, the digits of x itself are taken.
    """

    def rounded(y: Column) -> Column:
        big = y * 134217729.0
        high = big - (big - y)
        low = y - high
        n = F.floor(y * 100).cast("long")
        above = (high * 200 - (2 * n + 1).cast("double")) + low * 200
        return n + F.when(above > 0, 1).when(above < 0, 0).otherwise(n % 2)

    def shown(n: Column) -> Column:
        return F.concat(F.floor(n / 100).cast("long").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))

    size, minus = F.abs(x), F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(size < float(1 << 44), F.concat(minus, bound(rounded(size), shown))).otherwise(F.round(x, 2).cast("decimal(38,2)").cast("string"))
