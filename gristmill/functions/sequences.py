"""Lists, modular arithmetic, sequences and linear rules."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F


def rendered(xs: Column) -> Column:
    return F.array_join(xs.cast("array<string>"), ", ")


def rotated_left(xs: Column, k: Column) -> Column:
    """Empty lists stay; k may be any number."""
    n = F.size(xs)
    at = F.pmod(k, F.greatest(n, F.lit(1))).cast("int")
    return F.when(n == 0, xs).otherwise(F.concat(F.slice(xs, at + 1, n), F.slice(xs, F.lit(1), at)))


def rotated_right(xs: Column, k: Column) -> Column:
    return rotated_left(xs, -k)


def mod_pow(x: Column, k: int, n: Column) -> Column:
    """x to the power k modulo n, by repeated multiplication."""
    out = F.pmod(F.lit(1).cast("long"), n)
    for _ in range(k):
        out = F.pmod(out * F.pmod(x, n), n)
    return out


def units(n: int) -> list[int]:
    """Multipliers from 2 on that have no common divisor with n."""
    return [m for m in range(2, n) if gcd(m, n) == 1]


def arithmetic(a: Column, d: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: a + d * i)


def geometric(a: Column, r: Column, n: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.array(a), lambda s, _: F.array_append(s, F.element_at(s, -1) * r))


def quadratic(a: Column, b: Column, c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")), lambda i: a * i * i + b * i + c)


def fibonacci_like(a: Column, b: Column, n: int) -> Column:
    return F.aggregate(F.sequence(F.lit(3), F.lit(n)), F.array(a, b), lambda s, _: F.array_append(s, F.element_at(s, -1) + F.element_at(s, -2)))


def powers(base: Column, n: int) -> Column:
    return geometric(base, base, n)


def kind_of(xs: Column) -> Column:
    """'constant', 'arithmetic', 'geometric', 'quadratic', 'fibonacci' or 'other', by differences."""
    n = F.size(xs)

    def diffs(s: Column) -> Column:
        return F.zip_with(F.slice(s, F.lit(2), F.size(s) - 1), F.slice(s, F.lit(1), F.size(s) - 1), lambda x, y: x - y)

    first = diffs(xs)
    second = diffs(first)

    def same(s: Column) -> Column:
        return F.size(F.array_distinct(s)) == 1

    geometric_ = F.forall(F.sequence(F.lit(1), n - 2), lambda i: xs[i] * xs[i] == xs[i - 1] * xs[i + 1]) & ~F.array_contains(xs, F.lit(0).cast("long"))
    sums = F.forall(F.sequence(F.lit(2), n - 1), lambda i: xs[i] == xs[i - 1] + xs[i - 2])
    return F.when(same(xs), "constant").when(same(first), "arithmetic").when(geometric_, "geometric").when(same(second), "quadratic").when(sums, "fibonacci").otherwise("other")


def shared_interval(pairs: Column, square: bool) -> Column:
    """struct<k, n, lo, hi, how>: the constant of y = k x, or y = k x^2 / 2, from y rounded to two decimals.

    The intervals that rounding leaves for the constant are intersected, and the middle taken; if they have nothing in
    common, least squares through the origin. pairs is array<struct<x:double,y:double>>; pairs with x = 0 tell nothing.
    """
    used = F.filter(pairs, lambda p: p["x"] != 0)

    def d(p: Column) -> Column:
        return 0.5 * p["x"] * p["x"] if square else p["x"]

    lo = F.array_max(F.transform(used, lambda p: F.least((p["y"] - 0.005) / d(p), (p["y"] + 0.005) / d(p))))
    hi = F.array_min(F.transform(used, lambda p: F.greatest((p["y"] - 0.005) / d(p), (p["y"] + 0.005) / d(p))))
    xy = F.aggregate(used, F.lit(0.0), lambda a, p: a + d(p) * p["y"])
    xx = F.aggregate(used, F.lit(0.0), lambda a, p: a + d(p) * d(p))
    inside = lo <= hi
    return F.when(
        F.size(used) > 0,
        F.struct(F.when(inside, (lo + hi) / 2).otherwise(xy / xx).alias("k"), F.size(used).alias("n"), lo.alias("lo"), hi.alias("hi"), F.when(inside, "interval").otherwise("least_squares").alias("how")),
    )


def line_through(pairs: Column) -> Column:
    """struct<a, b, fits>: slope and intercept of y = a x + b by the first two pairs with different x, and whether all pairs
    lie on it (F17); null without two such pairs. pairs is array<struct<x:double,y:double>>."""
    first = F.get(pairs, F.lit(0))
    other = F.get(F.filter(pairs, lambda p: p["x"] != first["x"]), F.lit(0))
    a = (other["y"] - first["y"]) / (other["x"] - first["x"])
    b = first["y"] - a * first["x"]
    return F.when(other.isNotNull(), F.struct(a.alias("a"), b.alias("b"), F.forall(pairs, lambda p: F.abs(a * p["x"] + b - p["y"]) <= 1e-9 * (1 + F.abs(p["y"]))).alias("fits")))
