"""Checks of generated examples (T2): does the shown output follow from the shown input?

A check reads both back from their texts and never calls the function that made them: it goes the other way round, compares
places or adds up. Columns of the puzzle's parameters are named as the generators name them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import bits, numerals

Check = Callable[[Column, Column], Column]

_ABC = "abcdefghijklmnopqrstuvwxyz"


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("long"))


def _number(text: Column) -> Column:
    return text.try_cast("long")


def _from(text: Column, at: Column) -> Column:
    """text from place `at` on, counted from 1."""
    return F.substring(text, at, F.length(text))


def _each(n: Column, holds: Callable[[Column], Column]) -> Column:
    """Whether holds(i) for all i from 0 to n - 1."""
    return F.forall(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n), holds)


def _binary() -> list[Check]:
    rot, left, right, mask = (F.col(c) for c in ("rot", "left", "right", "mask"))

    def zeros(k: Column) -> Column:
        return F.repeat(F.lit("0"), k)

    def flipped(s: Column, o: Column) -> Column:
        """The places where s and o differ are those of the mask's ones."""
        differs = F.transform(F.sequence(F.lit(1), F.lit(bits.WIDTH)), lambda i: F.when(F.substring(s, i, F.lit(1)) != F.substring(o, i, F.lit(1)), "1").otherwise("0"))
        return (F.length(o) == bits.WIDTH) & (F.array_join(differs, "") == bits.render(mask))

    return [
        lambda s, o: F.translate(o, "01", "10") == s,
        lambda s, o: F.concat(_from(s, rot + 1), F.substring(s, F.lit(1), rot)) == o,
        lambda s, o: F.concat(_from(o, rot + 1), F.substring(o, F.lit(1), rot)) == s,
        flipped,
        lambda s, o: F.concat(_from(s, left + 1), zeros(left)) == o,
        lambda s, o: F.concat(zeros(right), F.substring(s, F.lit(1), bits.WIDTH - right)) == o,
    ]


def _cipher() -> list[Check]:
    def letters(s: Column, o: Column, pair: Callable[[Column, Column], Column]) -> Column:
        """As long as each other, other characters alike, and pair() of the numbers of letters at equal places."""
        a, b = F.split(s, ""), F.split(o, "")
        alike = F.zip_with(a, b, lambda x, y: F.coalesce(F.when(x.rlike("^[a-z]$") & y.rlike("^[a-z]$"), pair(F.ascii(x) - 97, F.ascii(y) - 97)).otherwise(x == y), F.lit(False)))
        return F.forall(alike, lambda x: x)

    def turn(k: Column) -> Check:
        return lambda s, o: letters(s, o, lambda x, y: F.pmod(y - x, F.lit(26)) == k)

    def swapped(s: Column, o: Column) -> Column:
        """Place i holds what stood at its partner's place; an odd last character stays."""
        n = F.length(s)

        def partner(i: Column) -> Column:
            return F.when(i % 2 == 1, i - 1).when(i + 1 < n, i + 1).otherwise(i)

        return (F.length(o) == n) & _each(n, lambda i: F.substring(o, i + 1, F.lit(1)) == F.substring(s, partner(i) + 1, F.lit(1)))

    return [
        turn(F.col("k")),
        turn(F.lit(13)),
        lambda s, o: letters(s, o, lambda x, y: x + y == len(_ABC) - 1),
        lambda s, o: F.array_join(F.reverse(F.split(o, " ")), " ") == F.reverse(s),
        swapped,
    ]


def _linear() -> list[Check]:
    a, b = F.col("a"), F.col("b")
    return [lambda s, o: (_number(o) - b) / a == _number(s)]


def _roman() -> list[Check]:
    def values(s: Column, sign: str) -> tuple[Column, Column]:
        return numerals.from_roman(F.substring_index(s, sign, 1)), numerals.from_roman(F.substring_index(s, sign, -1))

    def summed(s: Column, o: Column) -> Column:
        x, y = values(s, " + ")
        return numerals.from_roman(o) - y == x

    def less(s: Column, o: Column) -> Column:
        x, y = values(s, " - ")
        return numerals.from_roman(o) + y == x

    return [lambda s, o: numerals.from_roman(o) == _number(s), lambda s, o: numerals.from_roman(s) == _number(o), summed, less]


def _sequence() -> list[Check]:
    p, q, r, outs = (F.col(c) for c in ("p", "q", "r", "outs"))

    def place(s: Column) -> Column:
        return F.regexp_extract(s, r"^term (\d+)$", 1).try_cast("int")

    def before(s: Column, k: int) -> Column:
        """The term k places earlier, or null."""
        return F.when(place(s) > k, _number(F.get(outs, F.greatest(place(s) - 1 - k, F.lit(0)))))

    def grows(step: Callable[[Column, Column], Column], *seeds: Column) -> Check:
        """The first terms are the seeds, later ones follow from what stands before them."""

        def check(s: Column, o: Column) -> Column:
            out = step(s, _number(o))
            for k, seed in enumerate(seeds, 1):
                out = F.when(place(s) == k, _number(o) == seed).otherwise(out)
            return out

        return check

    def power(s: Column, o: Column) -> Column:
        return F.aggregate(F.array_repeat(place(s).cast("long"), p.cast("int")), F.lit(1).cast("long"), lambda x, k: x * k) == _number(o) - q

    return [
        grows(lambda s, y: y - before(s, 1) == q, p),
        grows(lambda s, y: y == before(s, 1) * q, p),
        grows(lambda s, y: y - before(s, 1) * 2 + before(s, 2) == p * 2, r, p + q + r),
        grows(lambda s, y: y - before(s, 1) == before(s, 2), p, q),
        power,
    ]


def _list() -> list[Check]:
    k = F.col("k")

    def ordered(sign: int) -> Check:
        def check(s: Column, o: Column) -> Column:
            x, y = _numbers(s), _numbers(o)

            def count(of: Column, v: Column) -> Column:
                return F.size(F.filter(of, lambda w: w == v))

            rising = _each(F.size(y) - 1, lambda i: (F.get(y, i + 1) - F.get(y, i)) * sign >= 0)
            return (F.size(x) == F.size(y)) & rising & F.forall(x, lambda v: count(x, v) == count(y, v))

        return check

    def moved(to: Callable[[Column, Column], Column]) -> Check:
        """As long as the input, and the value at place i stands at place to(i, n)."""

        def check(s: Column, o: Column) -> Column:
            x, y = _numbers(s), _numbers(o)
            n = F.size(x)
            return (F.size(y) == n) & _each(n, lambda i: F.get(y, to(i, n)) == F.get(x, i))

        return check

    def firsts(s: Column, o: Column) -> Column:
        x = _numbers(s)
        return F.filter(x, lambda v, i: F.array_position(x, v) == i + 1) == _numbers(o)

    return [ordered(1), ordered(-1), moved(lambda i, n: n - 1 - i), moved(lambda i, n: F.pmod(i - k, n)), moved(lambda i, n: F.pmod(i + k, n)), firsts]


def _modular() -> list[Check]:
    n, k, c, e = (F.col(x) for x in ("n", "k", "c", "e"))

    def on_clock(difference: Callable[[Column, Column, Column], Column]) -> Check:
        """The output is an hour of the clock, and difference(output, first, second) whole turns."""

        def check(s: Column, o: Column) -> Column:
            a, b = (F.regexp_extract(s, r"^(\d+)(?: . (\d+))?$", g).try_cast("long") for g in (1, 2))
            y = _number(o)
            return y.between(0, n - 1) & (difference(y, a, b) % n == 0)

        return check

    def power(y: Column, a: Column, _: Column) -> Column:
        return y - F.aggregate(F.array_repeat(a, k), F.lit(1).cast("long"), lambda x, v: x * v)

    return [on_clock(lambda y, a, b: y - a - b), on_clock(lambda y, a, b: y + b - a), on_clock(lambda y, a, b: y - a * b), on_clock(power), on_clock(lambda y, a, _: y - e - c * a)]


#: By domain, a check of each rule in the order in which `which` counts them.
PROOFS: dict[str, Callable[[], list[Check]]] = {"binary_ops": _binary, "cipher": _cipher, "linear_eq": _linear, "roman": _roman, "number_seq": _sequence, "list_ops": _list, "modular_arith": _modular}


def proved(domain: str, which: Column, shown: Column, out: Column) -> Column:
    """Whether `out` follows from `shown` by rule `which` of the domain; false where a text can't be read."""
    holds = F.lit(False)
    for k, check in enumerate(PROOFS[domain]()):
        holds = F.when(which == k, check(shown, out)).otherwise(holds)
    return F.coalesce(holds, F.lit(False))
