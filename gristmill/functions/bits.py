"""8-bit operations and the inference of bit rules (F1-F3, R5-R8, R16). A byte is an int, bit 7 the leftmost character."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import bound

WIDTH = 8
_ALL = (1 << WIDTH) - 1


def parse(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("int")


def render(v: Column) -> Column:
    return F.lpad(F.bin(v), WIDTH, "0")


def rotate_left(v: Column, k: int) -> Column:
    k %= WIDTH
    return F.shiftleft(v, k).bitwiseOR(F.shiftright(v, WIDTH - k)).bitwiseAND(F.lit(_ALL))


def rotate_right(v: Column, k: int) -> Column:
    return rotate_left(v, WIDTH - k % WIDTH)


def invert(v: Column) -> Column:
    return F.lit(_ALL).bitwiseXOR(v)


def xor_mask(v: Column, mask: int) -> Column:
    return v.bitwiseXOR(F.lit(mask))


def shift_left(v: Column, k: int) -> Column:
    return F.shiftleft(v, k).bitwiseAND(F.lit(_ALL))


def shift_right(v: Column, k: int) -> Column:
    return F.shiftright(v, k)


# A rule for an output character is a weight w: bit i of w takes character i of the input, bit 8 is the constant one. `x` of
# an example has the input so numbered, with bit 8 set; an output is numbered likewise. An example is one equation for each of
# the eight rules, and all eight have the same left side, so the equations of an example are one row: bits 0 to 8 the input,
# bits 9 to 16 the output's characters.

_INPUTS = WIDTH + 1
_LEFT = (1 << _INPUTS) - 1


def numbered(bits: Column) -> Column:
    """The input's characters as bits 0 to 7 and the constant as bit 8."""
    return parse(F.reverse(bits)).bitwiseOR(F.lit(1 << WIDTH))


def _characters(out: Column) -> Column:
    """An output's characters as bits 0 to 7."""
    return parse(F.reverse(out))


def _lowest(v: Column) -> Column:
    """The lowest bit of v that is set."""
    return v.bitwiseAND(-v)


def eliminated(examples: Column) -> Column:
    """struct<rows,bad>: the examples' equations by elimination over GF(2), for lists of any length.

    rows[p] is the row whose lowest input bit is p, without the lowest bits of the others, or 0 if there is none; bit k of bad
    says that no weight gives character k. Taking the lowest bit as pivot makes those bits free that depend on lower
    ones; with free bits zero, row p's output bits are bit p of the eight least weights.
    """
    start = F.struct(F.array_repeat(F.lit(0), _INPUTS).alias("rows"), F.lit(0).alias("bad"))

    def reduced(a: Column, e: Column) -> Column:
        row = e["x"].bitwiseOR(F.shiftleft(_characters(e["out"]), _INPUTS))
        return F.aggregate(a["rows"], row, lambda r, b: F.when(r.bitwiseAND(_lowest(b)) != 0, r.bitwiseXOR(b)).otherwise(r))

    def taken(a: Column, r: Column) -> Column:
        known = r.bitwiseAND(F.lit(_LEFT)) == 0
        pivots = F.array(*[F.lit(1 << i) for i in range(_INPUTS)])
        grown = F.zip_with(a["rows"], pivots, lambda b, p: F.when(p == _lowest(r), r).when(b.bitwiseAND(_lowest(r)) != 0, b.bitwiseXOR(r)).otherwise(b))
        return F.struct(F.when(known, a["rows"]).otherwise(grown).alias("rows"), F.when(known, a["bad"].bitwiseOR(F.shiftright(r, _INPUTS))).otherwise(a["bad"]).alias("bad"))

    return F.aggregate(examples, start, lambda a, e: bound(reduced(a, e), lambda r: taken(a, r)))


def _each(body) -> Column:
    """The array of body(k) for the eight characters."""
    return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), body)


def _bit(v: Column, k: Column) -> Column:
    return F.call_function("shiftright", v, k).bitwiseAND(F.lit(1))


def _counts(s: Column) -> Column:
    free = F.size(F.filter(s["rows"], lambda r: r == 0))
    return _each(lambda k: F.when(_bit(s["bad"], k) == 1, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1), free)))


def affine_counts(examples: Column) -> Column:
    """How many weights give each character of every example's output; examples is array<struct<x:int,out:string>>."""
    return bound(eliminated(examples), _counts)


def _weights(s: Column) -> Column:
    def weight(k: Column) -> Column:
        return F.aggregate(F.reverse(s["rows"]), F.lit(0), lambda w, r: w * 2 + _bit(r, k + _INPUTS))

    return _each(lambda k: F.when(_bit(s["bad"], k) == 0, weight(k)))


def affine_fit(examples: Column) -> Column:
    """The least weight for each character: free variables are zero; null where there is none."""
    return bound(eliminated(examples), _weights)


def _affine_value(s: Column, x: Column) -> Column:
    """What the least weights give for an input, as numbered characters; those of `bad` mean nothing."""
    return F.aggregate(s["rows"], F.lit(0), lambda v, r: F.when(x.bitwiseAND(_lowest(r)) != 0, v.bitwiseXOR(F.shiftright(r, _INPUTS))).otherwise(v))


def _written(v: Column) -> Column:
    """Numbered characters as text."""
    return F.reverse(render(v))


def affine_only(examples: Column, query: Column) -> Column:
    """The output by affine rules alone, all eight or none, if they give every example back."""

    def proved(s: Column) -> Column:
        held = F.forall(examples, lambda e: _affine_value(s, e["x"]) == _characters(e["out"]))
        return F.when((F.size(examples) > 0) & (s["bad"] == 0) & held, _written(_affine_value(s, query)))

    return bound(eliminated(examples), proved)


#: Supports of at most three input characters: by size, then in order of positions.
_CHOSEN = [c for size in (1, 2, 3) for c in combinations(range(WIDTH), size)]
SUPPORTS = [sum(1 << i for i in c) for c in _CHOSEN]


def _supports() -> Column:
    """The positions of each support; one of two or one character repeats bit 9 of the input, which is never set."""
    return F.array(*[F.struct(*[F.lit(i).alias(n) for n, i in zip("ijk", (*c, _INPUTS, _INPUTS))]) for c in _CHOSEN])


def _table_values(examples: Column, query: Column, open_: Column) -> Column:
    """struct<done,value> of the characters in open_: by the first support under which equal inputs have equal outputs and
    the query's was seen.

    A support has eight inputs at most. A number of 64 bits holds, for each input, the characters that were 1 with it, and
    another those that were 0; a character is contradicted if both have it for some input. So one pass over the examples
    decides a support for all characters, and once none is open no further support is looked at.
    """

    def key(x: Column, s: Column) -> Column:
        return _bit(x, s["i"]) + _bit(x, s["j"]) * 2 + _bit(x, s["k"]) * 4

    def seen(s: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("zero"))

        def step(a: Column, e: Column) -> Column:
            at = key(e["x"], s) * WIDTH
            one = F.call_function("shiftleft", e["y"].cast("long"), at)
            zero = F.call_function("shiftleft", invert(e["y"]).cast("long"), at)
            return F.struct(a["one"].bitwiseOR(one).alias("one"), a["zero"].bitwiseOR(zero).alias("zero"))

        return F.aggregate(numbered_examples, start, step)

    def folded(v: Column) -> Column:
        """The characters that a number of 64 bits has for any input."""
        out = v
        for k in (32, 16, 8):
            out = out.bitwiseOR(F.shiftright(out, k))
        return out.bitwiseAND(F.lit(_ALL)).cast("int")

    def looked(a: Column, s: Column) -> Column:
        def settled(t: Column) -> Column:
            at = key(query, s) * WIDTH
            one = F.call_function("shiftright", t["one"], at).bitwiseAND(F.lit(_ALL)).cast("int")
            zero = F.call_function("shiftright", t["zero"], at).bitwiseAND(F.lit(_ALL)).cast("int")
            new = one.bitwiseOR(zero).bitwiseAND(invert(folded(t["one"].bitwiseAND(t["zero"])))).bitwiseAND(open_).bitwiseAND(invert(a["done"]))
            return bound(new, lambda n: F.struct(a["done"].bitwiseOR(n).alias("done"), a["value"].bitwiseOR(n.bitwiseAND(one)).alias("value")))

        return F.when(a["done"] == open_, a).otherwise(bound(seen(s), settled))

    numbered_examples = F.transform(examples, lambda e: F.struct(e["x"].alias("x"), _characters(e["out"]).alias("y")))
    return F.aggregate(_supports(), F.struct(F.lit(0).alias("done"), F.lit(0).alias("value")), looked)


def derived(examples: Column, query: Column) -> Column:
    """struct<out, affine>: the output for a query, each character affine, else by truth table; and which characters are affine.

    out is null if any character has neither.
    """

    def solved(s: Column) -> Column:
        def answered(t: Column) -> Column:
            value = _affine_value(s, query).bitwiseAND(invert(s["bad"])).bitwiseOR(t["value"])
            return F.struct(F.when(t["done"] == s["bad"], _written(value)).alias("out"), _each(lambda k: _bit(s["bad"], k) == 0).alias("affine"))

        return bound(_table_values(examples, query, s["bad"]), answered)

    return F.when(F.size(examples) > 0, bound(eliminated(examples), solved))
