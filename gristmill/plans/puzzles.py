"""Puzzle views over the table part, as SQL that Spark and DuckDB both read: whole numbers only, no random numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.operators.staging import staged
from gristmill.plans.catalog import table

_A = "In Alice''s Wonderland, "


def _dec(x: str) -> str:
    """Hundredths as text."""
    return f"(CAST(CAST(floor(({x}) / 100.0) AS BIGINT) AS STRING) || '.' || lpad(CAST(({x}) % 100 AS STRING), 2, '0'))"


def _bits(v: str) -> str:
    return "(" + " || ".join(f"CAST((({v}) >> {k}) & 1 AS STRING)" for k in range(7, -1, -1)) + ")"


def _xor(a: str, b: str) -> str:
    return f"((({a}) | ({b})) - (({a}) & ({b})))"


def _t(i: int) -> str:
    return f"(100 + (k * 13 + {i * 97}) % 400)"


def _distance(i: int) -> str:
    return f"CAST(floor(((500 + (k * 37) % 1500) * {_t(i)} * {_t(i)} + 10000) / 20000.0) AS BIGINT)"


def _x(i: int) -> str:
    return f"(500 + (k * 29 + {i * 613}) % 4500)"


def _converted(i: int) -> str:
    return f"CAST(floor(((50 + k % 150) * {_x(i)} + 50) / 100.0) AS BIGINT)"


def _byte(i: int) -> str:
    return f"((k * 37 + {i * 91} + {i * i * 7}) % 256)"


def _bit_out(i: int) -> str:
    rotated = f"((({_byte(i)} << 1) | ({_byte(i)} >> 7)) & 255)"
    masked = _xor(rotated, "(k * 11) % 256")
    return f"(CASE WHEN k % 4 = 3 THEN ({_byte(i)} & ({_byte(i)} >> 1)) ELSE {masked} END)"


def _shifted(w: str) -> str:
    """A substitution by k % 5 letters."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return "(CASE k % 5 " + " ".join(f"WHEN {n} THEN translate({w}, '{letters}', '{letters[n + 1 :] + letters[: n + 1]}')" for n in range(5)) + " END)"


_WORDS = ("dragon castle", "queen found magical key", "hatter watches turtle", "wizard explores ancient cave")
_QUERIES = ("alice reads story", "cat sees bird", "king found golden map", "mouse follows silver door")


def _pick(words: tuple[str, ...], at: str) -> str:
    return f"(CASE ({at}) % {len(words)} " + " ".join(f"WHEN {n} THEN '{w}'" for n, w in enumerate(words)) + " END)"


def _operand(i: int, salt: int) -> str:
    return f"(10 + (k * {7 + salt} + {i * 31 + salt}) % 90)"


def _symbol_out(i: int) -> str:
    a, b = _operand(i, 0), _operand(i, 5)
    return f"(CASE k % 4 WHEN 0 THEN CAST({a} + {b} AS STRING) WHEN 1 THEN CAST({a} * {b} AS STRING) WHEN 2 THEN CAST(abs({a} - {b}) AS STRING) ELSE CAST({a} AS STRING) || CAST({b} AS STRING) END)"


def _lines(pairs: list[tuple[str, str]], arrow: str) -> str:
    return " || chr(10) || ".join(f"{a} || '{arrow}' || {b}" for a, b in pairs)


def _roman(n: str) -> str:
    """Numerals of 1 to 3999, place by place."""

    def place(power: int, one: str, five: str, ten: str) -> str:
        digits = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return f"rtrim(substr('{''.join(x.ljust(4) for x in digits)}', CAST(1 + 4 * (CAST(floor(({n}) / {power}.0) AS BIGINT) % 10) AS INTEGER), 4))"

    return "(" + " || ".join(place(*x) for x in ((1000, "M", "", ""), (100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X"))) + ")"


#: family: (prompt, answer) as SQL over k.
VIEWS = {
    "gravitational": (
        f"'{_A}the gravitational constant has been secretly changed. Here are some example observations:' || chr(10) || "
        + " || chr(10) || ".join(f"'For t = ' || {_dec(_t(i))} || 's, distance = ' || {_dec(_distance(i))} || ' m'" for i in range(4))
        + f" || chr(10) || 'Now, determine the falling distance for t = ' || {_dec(_t(9))} || 's given d = 0.5*g*t^2.'",
        _dec(_distance(9)),
    ),
    "unit_conversion": (
        f"'{_A}a secret unit conversion is applied to measurements. For example:' || chr(10) || "
        + " || chr(10) || ".join(f"{_dec(_x(i))} || ' m becomes ' || {_dec(_converted(i))}" for i in range(4))
        + f" || chr(10) || 'Now, convert the following measurement: ' || {_dec(_x(9))} || ' m'",
        _dec(_converted(9)),
    ),
    "numeral": (
        f"'{_A}numbers are secretly converted into a different numeral system. Some examples are given below:' || chr(10) || "
        + " || chr(10) || ".join(f"CAST(1 + (k * 11 + {i * 1217}) % 3999 AS STRING) || ' -> ' || {_roman(f'1 + (k * 11 + {i * 1217}) % 3999')}" for i in range(3))
        + " || chr(10) || 'Now, write the number ' || CAST(1 + (k * 7) % 3999 AS STRING) || ' in the Wonderland numeral system.'",
        _roman("1 + (k * 7) % 3999"),
    ),
    "encrypt": (
        f"'{_A}secret encryption rules are used on text. Here are some examples:' || chr(10) || "
        + _lines([(_shifted(_pick(_WORDS, f"k + {i}")), _pick(_WORDS, f"k + {i}")) for i in range(3)], " -> ")
        + f" || chr(10) || 'Now, decrypt the following text: ' || {_shifted(_pick(_QUERIES, 'k'))}",
        _pick(_QUERIES, "k"),
    ),
    "bitmanip": (
        f"'{_A}a secret bit manipulation rule transforms 8-bit binary numbers. Here are some examples of input -> output:' || chr(10) || "
        + _lines([(_bits(_byte(i)), _bits(_bit_out(i))) for i in range(8)], " -> ")
        + f" || chr(10) || 'Now, determine the output for: ' || {_bits(_byte(9))}",
        _bits(_bit_out(9)),
    ),
    "symbol": (
        f"'{_A}a secret set of transformation rules is applied to equations. Below are a few examples:' || chr(10) || "
        + _lines([(f"CAST({_operand(i, 0)} AS STRING) || '@' || CAST({_operand(i, 5)} AS STRING)", _symbol_out(i)) for i in range(3)], " = ")
        + f" || chr(10) || 'Now, determine the result for: ' || CAST({_operand(9, 0)} AS STRING) || '@' || CAST({_operand(9, 5)} AS STRING)",
        _symbol_out(9),
    ),
}


def _letters(i: int) -> str:
    """Six letters, at each place one of two that no other place has."""
    return "(" + " || ".join(f"substr('{'abcdefghijkl'[2 * j : 2 * j + 2]}', 1 + (((k * 5 + {i * 11 + i * i * 3}) >> {j}) & 1), 1)" for j in range(6)) + ")"


def _shortened(word: str) -> str:
    """Without two of the places, by k, and with every other letter replaced."""
    first, second = "k % 6", "(k % 6 + 1 + CAST(floor(k / 6.0) AS BIGINT) % 5) % 6"
    return "(" + " || ".join(f"CASE WHEN {j} IN ({first}, {second}) THEN '' ELSE translate(substr({word}, {j + 1}, 1), 'abcdefghijkl', 'PQRSTUVWXYZA') END" for j in range(6)) + ")"


#: Left sides of which the same two places are dropped everywhere.
DELETED = {
    "symbol_deletion": (
        f"'{_A}a secret set of transformation rules is applied to equations. Below are a few examples:' || chr(10) || "
        + _lines([(_letters(i), _shortened(_letters(i))) for i in range(5)], " = ")
        + f" || chr(10) || 'Now, determine the result for: ' || {_letters(9)}",
        _shortened(_letters(9)),
    ),
}

_ASKED = ("cat sees quartz", "hatter reads", "king zebra", "mouse dreams", "island near xylophones", "turtle found the map")

#: One example only, so that the vocabulary leaves words with no candidate, one or several.
OPEN = {
    "encrypt_open": (
        f"'{_A}secret encryption rules are used on text. Here are some examples:' || chr(10) || "
        + _lines([(_shifted(_pick(_WORDS, "k")), _pick(_WORDS, "k"))], " -> ")
        + f" || chr(10) || 'Now, decrypt the following text: ' || {_shifted(_pick(_ASKED, 'k'))}",
        _pick(_ASKED, "k"),
    ),
}

#: Conversions that allow no common constant, so that least squares have to give one.
NOISY = {
    "unit_noisy": (
        f"'{_A}a secret unit conversion is applied to measurements. For example:' || chr(10) || "
        + " || chr(10) || ".join(f"{_dec(_x(i))} || ' m becomes ' || {_dec(f'({_converted(i)} + ((k + {i}) % 3) * 7)')}" for i in range(4))
        + f" || chr(10) || 'Now, convert the following measurement: ' || {_dec(_x(9))} || ' m'",
        _dec(_converted(9)),
    ),
}


def view_sql(family: str, part: str = "part") -> str:
    prompt, answer = {**VIEWS, **NOISY, **DELETED, **OPEN}[family]
    return f"SELECT '{family}-' || CAST(k AS STRING) AS id, k AS pos, {prompt} AS prompt, {answer} AS answer FROM (SELECT p_partkey AS k FROM {part}) v"


def puzzles_sql(part: str = "part") -> str:
    """All families, each part in the family of its key, and every seventh outside of all."""
    cases = "".join(f" WHEN k % 7 = {n} THEN {{{n}}}" for n in range(len(VIEWS)))
    prompt = "CASE" + cases.format(*(p for p, _ in VIEWS.values())) + " ELSE 'What is ' || CAST(k AS STRING) || ' + 2?' END"
    answer = "CASE" + cases.format(*(a for _, a in VIEWS.values())) + " ELSE CAST(k + 2 AS STRING) END"
    return f"SELECT 'p-' || CAST(k AS STRING) AS id, k AS pos, {prompt} AS prompt, {answer} AS answer FROM (SELECT p_partkey AS k FROM {part}) v"


def view(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """The puzzles of one family."""
    return spark.sql(view_sql(family, "{part}"), part=table(spark, sf_dir, "part"))


def puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of puzzles_sql(), written once: a family's expressions are evaluated for its own keys, each in code of its own."""
    part = table(spark, sf_dir, "part")
    cases = [(f"k % 7 = {n}", p, a) for n, (p, a) in enumerate(VIEWS.values())] + [(f"k % 7 >= {len(VIEWS)}", "'What is ' || CAST(k AS STRING) || ' + 2?'", "CAST(k + 2 AS STRING)")]
    union = " UNION ALL ".join(f"SELECT 'p-' || CAST(k AS STRING) AS id, k AS pos, {p} AS prompt, {a} AS answer FROM (SELECT p_partkey AS k FROM {{part}}) v WHERE {keys}" for keys, p, a in cases)
    return staged(spark.sql(union, part=part), "puzzles")
