"""Synthetic puzzles of seven domains with step traces that check themselves.

Rows of positions become puzzles where they stand: every parameter is drawn from a hash of seed, domain and position, so
there is no shuffle, no state and no order of evaluation, and any partitioning gives the same puzzles. Distinct values
are drawn as a walk through their range whose step has no common divisor with the range's size, from a drawn start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import bits, ciphers, numerals, sequences
from gristmill.operators.proofs import proved

N_DEMOS = 4
N_TERMS = 5

# The wording of prompts, the domains' labels, and what parameters are drawn from.
HEADER = "In Alice's Wonderland, a secret transformation rule governs how things change. Study the examples below to discover the hidden rule, then apply it to the query."
HINTS = {
    "binary_ops": "In this land, numbers wear binary costumes, and a secret bitwise spell transforms each one.",
    "cipher": "In this realm, words and letters are disguised by an ancient secret cipher.",
    "linear_eq": "In this magical land, each number is transformed according to a hidden arithmetic rule of the form  f(x) = a·x + b.",
    "roman": "In this realm, numbers speak in the ancient tongue of the Roman Empire.",
    "number_seq": "In this realm, numbers follow a hidden pattern in a magical sequence. Each term is determined by a secret rule applied to its position.",
    "list_ops": "In this realm, lists of numbers are transformed by a hidden structural rule.",
    "modular_arith": "In this realm, all arithmetic happens on a circular clock that resets back to zero after reaching a certain number.",
}
LABELS = {
    "binary_ops": "binary bit-manipulation",
    "cipher": "cipher",
    "linear_eq": "algebraic",
    "roman": "Roman numeral",
    "number_seq": "number sequence",
    "list_ops": "list transformation",
    "modular_arith": "modular arithmetic",
}
WORDS = "apple brave chess dance eagle flame grace honey ivory jewel knave lunar magic noble orbit pearl queen river stone tower ultra vivid whirl xenon yacht zonal brook cedar drift ember".split()
SLOPES = (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)
MODULI = (5, 6, 7, 8, 10, 11, 12, 13)
GEOMETRIC_STARTS = (-6, -5, -4, -3, -2, 2, 3, 4, 5, 6)
RATIOS = (-3, -2, 2, 3)
#: Offset of each domain's seed, in the order of the domains.
SEED_STEP = 1000


@dataclass(frozen=True)
class Draw:
    """Parameters drawn for the row at `pos`."""

    seed: int
    domain: str

    def below(self, salt: str, n: Column | int) -> Column:
        """0 to n - 1."""
        text = F.concat(F.lit(f"{self.seed}:{self.domain}:"), F.col("pos").cast("string"), F.lit(f":{salt}"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n

    def of(self, salt: str, values) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.below(salt, len(values)) + 1).cast("int"))

    def walk(self, salt: str, size: int, n: int) -> Column:
        """n distinct numbers below size."""
        step = self.of(f"{salt}/step", [u for u in range(1, size) if gcd(u, size) == 1])
        start = self.below(f"{salt}/start", size)
        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: (start + i * step) % size)


@dataclass(frozen=True)
class Rules:
    """What a domain adds to its rows: columns by name, then how an input becomes an output, and both become text."""

    params: list[dict[str, Column]]
    names: list[Column | str]
    about: list[Column | str]
    apply: list[Callable[[Column], Column]]
    shown: Callable[[Column], Column]
    told: Callable[[Column], Column]


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def _choose(which: Column, options: list) -> Column:
    """options[which], only that one being computed."""
    out = F.lit(None)
    for k, o in reversed(list(enumerate(options))):
        out = F.when(which == k, o if isinstance(o, Column) else F.lit(o)).otherwise(out)
    return out


def _shift(name: str, v: Column, k: Column) -> Column:
    return F.call_function(name, v.cast("int"), k.cast("int"))


def _binary(d: Draw) -> Rules:
    rot, mask = F.col("rot"), F.col("mask")

    def visible(side: str) -> Column:
        """A shift after which some example keeps a bit: the first from a drawn one on, or 1."""
        drawn = d.below(side, 7)
        tried = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: ((drawn + i) % 7 + 1).cast("int"))
        good = F.filter(tried, lambda k: F.exists(F.slice("inputs", 1, N_DEMOS), lambda v: _shift(side, v, k).bitwiseAND(F.lit(255)) != 0))
        return F.coalesce(F.get(good, F.lit(0)), F.lit(1))

    return Rules(
        [
            {"which": d.below("rule", 6), "inputs": F.transform(d.walk("v", 256, N_DEMOS + 1), lambda v: v.cast("int"))},
            {"rot": (d.below("rot", 7) + 1).cast("int"), "mask": (d.below("mask", 254) + 1).cast("int"), "left": visible("shiftleft"), "right": visible("shiftright")},
        ],
        ["NOT", _text("ROL-", rot), _text("ROR-", rot), _text("XOR-", bits.render(mask)), _text("SHL-", F.col("left")), _text("SHR-", F.col("right"))],
        [
            "every 0 turns into 1 and every 1 into 0",
            _text("the leftmost ", rot, " of the eight bits go to the right end"),
            _text("the rightmost ", rot, " of the eight bits go to the left end"),
            _text("the bits that are 1 in ", bits.render(mask), " change, the others stay"),
            _text("the leftmost ", F.col("left"), " of the eight bits fall away and as many zeros come in at the right"),
            _text("the rightmost ", F.col("right"), " of the eight bits fall away and as many zeros come in at the left"),
        ],
        [
            bits.invert,
            lambda v: _shift("shiftleft", v, rot).bitwiseOR(_shift("shiftright", v, 8 - rot)).bitwiseAND(F.lit(255)),
            lambda v: _shift("shiftright", v, rot).bitwiseOR(_shift("shiftleft", v, 8 - rot)).bitwiseAND(F.lit(255)),
            lambda v: v.bitwiseXOR(mask),
            lambda v: _shift("shiftleft", v, F.col("left")).bitwiseAND(F.lit(255)),
            lambda v: _shift("shiftright", v, F.col("right")),
        ],
        bits.render,
        bits.render,
    )


def _cipher(d: Draw) -> Rules:
    k = F.col("k")
    words = F.array(*map(F.lit, WORDS))
    low, up = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def turned(letters: Column) -> Column:
        return F.concat(F.substring(letters, k + 1, F.lit(26)), F.substring(letters, F.lit(1), k))

    def text(i: int) -> Column:
        picked = F.slice(d.walk(f"w{i}", len(WORDS), 3), F.lit(1), (d.below("words", 3) + 1).cast("int"))
        return F.array_join(F.transform(picked, lambda w: F.get(words, w.cast("int"))), " ")

    return Rules(
        [{"which": d.below("rule", 5), "k": (d.below("k", 12) + 1).cast("int"), "inputs": F.array(*map(text, range(N_DEMOS + 1)))}],
        [_text("Caesar-", k), "ROT13", "Atbash", "ReverseWords", "SwapPairs"],
        [
            _text("each letter is replaced by the one ", k, " places on in the alphabet, a by ", F.substring(low, k + 1, F.lit(1)), ", with a following z"),
            "the two halves of the alphabet change places, a with n and so on to m with z",
            "each letter is replaced by the one as far from the alphabet's other end, a by z and b by y",
            "each word is written backwards where it stands",
            "characters change places two by two from the left; a last one without a partner stays",
        ],
        [lambda s: F.call_function("translate", s, F.concat(up, low), F.concat(turned(up), turned(low))), lambda s: ciphers.caesar(s, 13), ciphers.atbash, ciphers.reverse_words, ciphers.swap_pairs],
        lambda s: s,
        lambda s: s,
    )


def _linear(d: Draw) -> Rules:
    a, b = F.col("a"), F.col("b")
    xs = F.transform(d.walk("x", 40, N_DEMOS + 1), lambda v: v - 20 + (v >= 20).cast("long"))  # -20 to 20 without 0
    return Rules(
        [{"which": F.lit(0), "a": d.of("a", SLOPES).cast("long"), "b": d.below("b", 21) - 10, "inputs": xs}],
        [_text("f(x) = ", a, "·x + (", b, ")")],
        [_text("a number is multiplied by ", a, " and ", b, " is added")],
        [lambda x: a * x + b],
        lambda x: x.cast("string"),
        lambda y: y.cast("string"),
    )


def _roman(d: Draw) -> Rules:
    which = F.col("which")

    def operands(i: int) -> Column:
        one = d.below(f"n{i}", 3999) + 1
        a = d.below(f"a{i}", 1998) + 2  # 2 to 1999, half the range
        b = F.when(which == 2, d.below(f"b{i}", 3999 - a) + 1).otherwise(d.below(f"b{i}", a - 1) + 1)
        return F.when(which < 2, F.struct(one.alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(F.struct(a.alias("a"), b.alias("b")))

    roman = numerals.to_roman

    def shown(x: Column) -> Column:
        pair = [F.concat(roman(x["a"]), F.lit(sign), roman(x["b"])) for sign in (" + ", " - ")]
        return _choose(which, [x["a"].cast("string"), roman(x["a"]), *pair])

    return Rules(
        [{"which": d.below("rule", 4)}, {"inputs": F.array(*map(operands, range(N_DEMOS + 1)))}],
        ["int_to_roman", "roman_to_int", "roman_add", "roman_subtract"],
        [
            "a number is written in Roman numerals",
            "a Roman numeral is written as a number in digits",
            "the sum of both numerals is written in Roman numerals",
            "what the first numeral exceeds the second by is written in Roman numerals",
        ],
        [lambda x: roman(x["a"]), lambda x: x["a"].cast("string"), lambda x: roman(x["a"] + x["b"]), lambda x: roman(x["a"] - x["b"])],
        shown,
        lambda y: y,
    )


def _sequence(d: Draw) -> Rules:
    p, q, r = F.col("p"), F.col("q"), F.col("r")
    steps = (*range(-10, 0), *range(1, 11))

    def by_rule(*options: Column) -> Column:
        return _choose(F.col("which"), [o.cast("long") for o in options])

    zero = F.lit(0)
    n = N_TERMS + 1
    terms = _choose(
        F.col("which"),
        [
            sequences.arithmetic(p, q, n),
            sequences.geometric(p, q, n),
            F.transform(F.sequence(zero.cast("long"), F.lit(n - 1).cast("long")), lambda i: p * i * i + q * i + r),
            sequences.fibonacci_like(p, q, n),
            F.transform(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")), lambda i: F.when(p == 2, i * i).otherwise(i * i * i) + q),
        ],
    )
    return Rules(
        [
            {"which": d.below("rule", 5)},
            {
                "p": by_rule(d.below("start", 41) - 20, d.of("g", GEOMETRIC_STARTS), d.of("square", (-3, -2, -1, 1, 2, 3)), d.below("f0", 10) + 1, d.below("exp", 2) + 2),
                "q": by_rule(d.of("step", steps), d.of("ratio", RATIOS), d.below("line", 11) - 5, d.below("f1", 10) + 1, d.below("offset", 6)),
                "r": by_rule(zero, zero, d.below("const", 21) - 10, zero, zero),
            },
            {"terms": terms, "inputs": F.sequence(F.lit(0), F.lit(N_TERMS))},
        ],
        [_text("arithmetic(start=", p, ", d=", q, ")"), _text("geometric(start=", p, ", r=", q, ")"), _text("quadratic(a=", p, ",b=", q, ",c=", r, ")"), _text("fibonacci_like(f0=", p, ",f1=", q, ")"), _text("power(k=", p, ",offset=", q, ")")],
        [
            _text("each term is the one before plus ", q, ", from ", p, " on: a(n) = ", p, " + (", q, ")·n"),
            _text("each term is the one before times ", q, ", from ", p, " on: a(n) = ", p, "·(", q, ")^n"),
            _text("the steps from term to term grow by ", p * 2, " each time: a(n) = ", p, "·n² + (", q, ")·n + (", r, ")"),
            _text("from the third on, each term is the two before added up; the first two are ", p, " and ", q),
            _text("each term is its place, counted from 1, to the power of ", p, ", plus ", q),
        ],
        [lambda i: F.get(F.col("terms"), i)] * 5,
        lambda i: _text("term ", i + 1),
        lambda y: y.cast("string"),
    )


def _list(d: Draw) -> Rules:
    k = F.col("k")

    def one(i: int) -> Column:
        n = (d.below("length", 3) + 4).cast("int")
        # One value more than shown could be distinct: for dedupe, a drawn one stands again at a drawn place.
        values = F.transform(F.slice(d.walk(f"v{i}", 61, 6), F.lit(1), n), lambda v: (v - 30).cast("int"))
        fewer = F.slice(values, F.lit(1), n - 1)
        again = F.get(fewer, d.below(f"dup{i}", n - 1).cast("int"))
        at = (d.below(f"at{i}", n) + 1).cast("int")
        return F.when(F.col("which") == 5, F.array_insert(fewer, at, again)).otherwise(values)

    return Rules(
        [{"which": d.below("rule", 6)}, {"k": (d.below("k", 3) + 1).cast("int"), "inputs": F.array(*map(one, range(N_DEMOS + 1)))}],
        ["sort_asc", "sort_desc", "reverse", _text("rotate_left_", k), _text("rotate_right_", k), "dedupe"],
        [
            "the numbers are put in order, the least one first",
            "the numbers are put in order, the greatest one first",
            "the numbers are read from the end",
            _text("as many as ", k, " numbers leave the beginning and follow the last one, in their order"),
            _text("as many as ", k, " numbers leave the end and go before the first one, in their order"),
            "a number that was there before is left out",
        ],
        [F.sort_array, lambda x: F.sort_array(x, False), F.reverse, lambda x: sequences.rotated_left(x, k), lambda x: sequences.rotated_right(x, k), F.array_distinct],
        sequences.rendered,
        sequences.rendered,
    )


def _modular(d: Draw) -> Rules:
    n, k, c, e = F.col("n"), F.col("k"), F.col("c"), F.col("e")
    which = F.col("which")
    by_modulus = [d.of("c", sequences.units(m)) for m in MODULI]
    pairs = [d.walk("pair", m * m, N_DEMOS + 1) for m in MODULI]
    singles = [d.walk("one", m, N_DEMOS + 1) for m in MODULI]
    place = F.col("modulus_ix")
    inputs = F.when(which < 3, F.transform(_choose(place, pairs), lambda v: F.struct(F.floor(v / n).alias("a"), (v % n).alias("b")))).otherwise(F.transform(_choose(place, singles), lambda v: F.struct(v.alias("a"), F.lit(0).cast("long").alias("b"))))

    def signed(x: Column, sign: str) -> Column:
        return _text(x["a"], f" {sign} ", x["b"])

    def power(x: Column) -> Column:
        a = x["a"]
        return F.when(k == 2, a * a).when(k == 3, a * a * a).otherwise(a * a * a * a) % n

    return Rules(
        [
            {"which": d.below("rule", 5), "modulus_ix": d.below("modulus", len(MODULI))},
            {"n": F.element_at(F.array(*map(F.lit, MODULI)), (place + 1).cast("int")).cast("long"), "k": (d.below("k", 3) + 2).cast("int"), "c": _choose(place, by_modulus).cast("long")},
            {"e": d.below("e", n), "inputs": inputs},
        ],
        [_text("add_mod_", n), _text("sub_mod_", n), _text("mul_mod_", n), _text("pow", k, "_mod_", n), _text("linear_mod_", n, "(c=", c, ",d=", e, ")")],
        [
            _text("both numbers are added up and what is left after division by ", n, " is kept"),
            _text("the second number is taken from the first, and ", n, " is added where that is below 0"),
            _text("the product of both is divided by ", n, " and the remainder is kept"),
            _text("the number to the power of ", k, " is divided by ", n, " and the remainder is kept"),
            _text("of ", c, " times the number plus ", e, ", the remainder of division by ", n, " is kept"),
        ],
        [lambda x: F.pmod(x["a"] + x["b"], n), lambda x: F.pmod(x["a"] - x["b"], n), lambda x: F.pmod(x["a"] * x["b"], n), power, lambda x: F.pmod(c * x["a"] + e, n)],
        lambda x: _choose(which, [signed(x, "+"), signed(x, "-"), signed(x, "×"), x["a"].cast("string"), x["a"].cast("string")]),
        lambda y: y.cast("string"),
    )


DOMAINS: dict[str, Callable[[Draw], Rules]] = {"binary_ops": _binary, "cipher": _cipher, "linear_eq": _linear, "roman": _roman, "number_seq": _sequence, "list_ops": _list, "modular_arith": _modular}


def _lines(*parts: Column | str) -> Column:
    """Texts and arrays of texts as lines."""
    return F.array_join(F.flatten(F.array(*(F.array(F.lit(p)) if isinstance(p, str) else p for p in parts))), "\n")


def _one(*parts) -> Column:
    return F.array(_text(*parts))


def _numbered(pairs: Column, line: Callable[[Column, Column], Column]) -> Column:
    return F.transform(pairs, lambda p, i: line(p, i + 1))


def prompt_of(pairs: Column, query: Column, hint: str) -> Column:
    """Numbered examples and the query, in the fixed wording; pairs is array<struct<inp,out>>."""
    return _lines(HEADER, *[hint] * bool(hint), "", "Examples:", _numbered(pairs, lambda p, i: _text("  ", i, ". Input: ", p["inp"], "  →  Output: ", p["out"])), "", _one("Query input: ", query), "What is the output?")


#: What a trace says of an example that its rule doesn't give.
REFUTED = "not as shown"


def _trace(domain: str) -> Column:
    """What is shown, the rule, each example held against it, and the answer, from the columns demos (inp, out, holds), about, query and answer."""
    demos, about, query, answer = (F.col(c) for c in ("demos", "about", "query", "answer"))

    def checked(p: Column) -> Column:
        return _text("- ", p["inp"], " has to give ", p["out"], ": ", F.when(p["holds"], "it does").otherwise(REFUTED))

    why = F.array().cast("array<string>")
    if domain == "linear_eq":
        one, two = demos[0], demos[1]
        rise, run = two["out"].cast("long") - one["out"].cast("long"), two["inp"].cast("long") - one["inp"].cast("long")
        why = F.array(_text("From ", one["inp"], " to ", two["inp"], " the input grows by ", run, " and the output by ", rise, ", which is ", F.col("a"), " for each 1."), _text("At ", one["inp"], " that leaves ", F.col("b"), " to be added."))
    elif domain == "modular_arith":
        why = _one("No output reaches ", F.col("n"), ", so numbers go round after ", F.col("n"), ".")
    elif domain == "number_seq":
        why = _one("The terms are ", F.array_join(F.transform(demos, lambda p: p["out"]), ", "), ".")
    # Fixed value: "All examples verified." is looked for in traces.
    return _lines(f"This is a {LABELS[domain]} puzzle.", why, _one("The rule seems to be that ", about, "."), F.transform(demos, checked), "All examples verified.", _one("By the same rule ", query, " gives ", answer, "."), _one("\\boxed{", answer, "}"))


def generated(rows: DataFrame, domain: str, seed: int = 42) -> DataFrame:
    """pos, rule, prompt, answer, trace and verified for each row's pos; verified says that every output, the answer too, follows from its
    input by a check of its own (proofs)."""
    r = DOMAINS[domain](Draw(seed, domain))
    df = rows.select("pos")
    for stage in r.params:
        df = df.withColumns(stage)
    which = F.col("which")
    df = df.withColumn("outs", F.transform("inputs", lambda x: r.told(_choose(which, [f(x) for f in r.apply]))))
    pairs = F.transform("inputs", lambda x, i: F.struct(r.shown(x).alias("inp"), F.get(F.col("outs"), i).alias("out")))
    df = df.withColumn("pairs", pairs)
    pairs = F.transform("pairs", lambda p: p.withField("holds", proved(domain, which, p["inp"], p["out"])))
    df = df.withColumns({"rule": _choose(which, r.names), "about": _choose(which, r.about), "pairs": pairs})
    n = N_TERMS if domain == "number_seq" else N_DEMOS
    df = df.withColumns({"demos": F.slice("pairs", 1, n), "query": F.col("pairs")[n]["inp"], "answer": F.col("pairs")[n]["out"]})
    verified = F.forall("pairs", lambda p: p["holds"])
    return df.select("pos", "rule", prompt_of(F.col("demos"), F.col("query"), HINTS[domain]).alias("prompt"), "answer", _trace(domain).alias("trace"), verified.alias("verified"))


def records(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A training record of each domain for each row of positions 0 to n - 1, with ids counted through all domains; no shuffle."""
    out = None
    for k, domain in enumerate(DOMAINS):
        one = generated(rows.select((F.col("pos") + k * n).alias("pos")), domain, seed + SEED_STEP * k).select(
            F.format_string(f"synthetic_{domain}_%06d", "pos").alias("id"), F.lit(domain).alias("domain"), "prompt", F.when(F.col("verified"), F.col("trace")).otherwise(F.raise_error(F.lit(f"{domain}: a rule doesn't give its own examples"))).alias("trace"), F.col("answer").alias("extracted_answer"), F.col("answer").alias("gold_answer")
        )
        out = one if out is None else out.unionByName(one)
    return out


def build_synthetic(spark: SparkSession, n_per_domain: int, seed: int = 42) -> DataFrame:
    """n_per_domain training records of each domain."""
    return records(spark.range(n_per_domain).withColumnRenamed("id", "pos"), n_per_domain, seed)
