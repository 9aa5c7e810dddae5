"""Rule inference from prompts (P13-P19, R1-R16): each solver adds predicted, status, how and steps to rows of its family.

status: derived_match or derived_mismatch (a rule was found; does it give the known answer?), underdetermined (the
examples leave no rule or the query open), parse_error, unmatched. No answer is ever taken from the known one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import bits, ciphers, classify, numerals, sequences, symbols
from gristmill.functions.scoring import is_correct
from gristmill.functions.text import bound, strip
from gristmill.operators.staging import staged

HEADER = "In Alice's Wonderland, "


def _numbers(prompt: Column, pattern: str) -> Column:
    """array<struct<x,y>> of the two captures of each match."""
    xs, ys = (F.regexp_extract_all(prompt, F.lit(pattern), k) for k in (1, 2))
    return F.zip_with(xs, ys, lambda x, y: F.struct(x.try_cast("double").alias("x"), y.try_cast("double").alias("y")))


def _first(prompt: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(prompt, pattern, 1), F.lit(""))


def gravity_parts(prompt: Column) -> tuple[Column, Column]:
    return _numbers(prompt, r"t = ([\d.]+)s, distance = ([\d.]+)"), _first(prompt, r"(?i)for t = ([\d.]+)s given").try_cast("double")


def unit_parts(prompt: Column) -> tuple[Column, Column]:
    return _numbers(prompt, r"([\d.]+) m becomes ([\d.]+)"), _first(prompt, r"convert the following measurement: ([\d.]+) m").try_cast("double")


def numeral_query(prompt: Column) -> Column:
    return _first(prompt, r"write the number (\d+)").try_cast("bigint")


def bit_parts(prompt: Column) -> tuple[Column, Column]:
    """(examples, query) for the functions of bits."""
    pattern = r"([01]{8})\s*->\s*([01]{8})"
    pairs = F.arrays_zip(F.regexp_extract_all(prompt, F.lit(pattern), 1).alias("i"), F.regexp_extract_all(prompt, F.lit(pattern), 2).alias("o"))
    return F.transform(pairs, lambda p: F.struct(bits.numbered(p["i"]).alias("x"), p["o"].alias("out"))), bits.numbered(_first(prompt, r"output for:\s*([01]{8})"))


def line_pairs(prompt: Column, arrow: str) -> Column:
    """array<struct<inp,out>> of the lines before the query that hold the arrow; a line is cut at the first one."""
    body = F.substring_index(prompt, "\nNow,", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: F.contains(x, F.lit(arrow)))
    return F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, arrow, 1)).alias("inp"), strip(F.substring(x, F.instr(x, arrow) + len(arrow), F.length(x))).alias("out")))


def cipher_parts(prompt: Column) -> tuple[Column, Column]:
    return line_pairs(prompt, " -> "), strip(_first(prompt, r"(?is)Now, decrypt the following text:\s*(.*?)\z"))


def symbol_parts(prompt: Column) -> tuple[Column, Column]:
    return line_pairs(prompt, " = "), strip(_first(prompt, r"(?is)Now, determine the result for:\s*(.*?)\z"))


def _closed(rows: DataFrame, parsed: Column, predicted: Column, how: Column, steps: Column) -> DataFrame:
    """rows with predicted, status, how (the method that found the rule) and steps (what was done, line by line)."""
    df = rows.withColumn("predicted", predicted)
    good = is_correct(F.col("answer"), F.col("predicted"))
    df = df.withColumn("status", F.when(~F.coalesce(parsed, F.lit(False)), "parse_error").when(F.col("predicted").isNull(), "underdetermined").when(good, "derived_match").otherwise("derived_mismatch"))
    found = F.col("predicted").isNotNull()
    return df.withColumns({"how": F.when(found, how), "steps": F.when(found, steps)})


def _lines(*parts) -> Column:
    """Texts and arrays of texts as lines."""
    return F.array_join(F.concat(*(F.array(F.lit(x)) if isinstance(x, str) else x for x in parts)), "\n")


def _line(*parts) -> Column:
    return F.array(F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts)))


def _ratio_solver(parts: Callable[[Column], tuple[Column, Column]], square: bool) -> Callable[[DataFrame], DataFrame]:
    def solve(rows: DataFrame) -> DataFrame:
        pairs, query = parts(F.col("prompt"))
        df = rows.withColumn("__pairs", pairs).withColumn("__q", query)
        df = df.withColumn("__s", sequences.shared_interval(F.col("__pairs"), square))
        k, q = F.col("__s.k"), F.col("__q")
        value = k * (0.5 * q * q if square else q)
        law = "y = k x^2 / 2" if square else "y = k x"
        each = F.transform("__pairs", lambda p: F.concat(F.lit("x = "), numerals.two_decimals(p["x"]), F.lit(", y = "), numerals.two_decimals(p["y"]), F.lit(": k is about "), F.coalesce(F.round(p["y"] / (0.5 * p["x"] * p["x"] if square else p["x"]), 6).cast("string"), F.lit("unknown"))))
        steps = _lines(f"The examples follow {law} with one unknown constant k.", each, _line(F.when(F.col("__s.how") == "interval", "All of them allow the same k; the middle of what rounding leaves is ").otherwise("They allow no common k; least squares give "), F.round(k, 6), "."), _line("For x = ", numerals.two_decimals(q), ", y = ", numerals.two_decimals(value), "."))
        out = _closed(df, (F.size("__pairs") > 0) & q.isNotNull(), numerals.two_decimals(value), F.col("__s.how"), steps)
        return out.drop("__pairs", "__q", "__s")

    return solve


def solve_numeral(rows: DataFrame) -> DataFrame:
    df = rows.withColumn("__q", numeral_query(F.col("prompt")))
    steps = _lines("The examples write numbers in Roman numerals.", _line(F.col("__q"), " is taken apart from the largest value down: ", F.array_join(numerals.greedy_steps(F.col("__q")), ", "), "."), _line("Put together: ", numerals.to_roman(F.col("__q")), "."))
    return _closed(df, F.col("__q").isNotNull(), numerals.to_roman(F.col("__q")), F.lit("roman"), steps).drop("__q")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as shuffles have: by a number, since partitions by a column alone are merged again where rows are few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def solve_bits(rows: DataFrame) -> DataFrame:
    """Rows are dealt out first: the search is heavy and a small input would be one task."""
    examples, query = bit_parts(F.col("prompt"))
    df = _dealt(rows).withColumn("__e", examples).withColumn("__q", query)
    parsed = (F.size("__e") > 0) & F.col("__q").isNotNull()
    df = df.withColumn("__d", F.when(parsed, bits.derived(F.col("__e"), F.col("__q"))))
    affine = F.coalesce(F.col("__d.affine"), F.array().cast("array<boolean>"))
    each = F.transform(affine, lambda x, i: F.concat(F.lit("Bit "), (i + 1).cast("string"), F.when(x, ": an exclusive or of input bits fits every example; the query gives ").otherwise(": a table over a few input bits fits every example; the query gives "), F.substring(F.col("__d.out"), i + 1, F.lit(1)), F.lit(".")))
    steps = _lines("Each output bit is looked for as an exclusive or of input bits, or else as a table of at most three of them.", each, _line("Together: ", F.col("__d.out"), "."))
    how = F.when(F.forall(affine, lambda x: x), "affine").otherwise("table")
    return _closed(df, parsed, F.col("__d.out"), how, steps).drop("__e", "__q", "__d")


def solve_cipher(rows: DataFrame) -> DataFrame:
    pairs, query = cipher_parts(F.col("prompt"))
    df = rows.withColumn("__pairs", pairs).withColumn("__q", query)
    df = df.withColumn("__f", ciphers.fill(F.col("__q"), F.col("__pairs")))
    known = F.array_sort(F.transform(F.map_entries(ciphers.char_map(F.col("__pairs"))), lambda x: F.concat(x["key"], F.lit(" is "), x["value"])))
    words = F.zip_with(F.filter(F.split("__q", " +"), lambda w: w != ""), F.split(F.col("__f.text"), " "), lambda c, p: F.concat(c, F.lit(" reads "), p))
    steps = _lines("Letters at equal places of the examples give the substitution.", _line("Known letters: ", F.array_join(known, ", "), "."), words, _line(F.when(F.col("__f.by_map"), "All letters were known.").otherwise("Letters not seen are settled by the one word of the vocabulary that fits.")))
    found = F.when(F.col("__f.solved"), F.col("__f.text"))
    return _closed(df, (F.size("__pairs") > 0) & F.col("__q").isNotNull(), found, F.when(F.col("__f.by_map"), "map").otherwise("dictionary"), steps).drop("__pairs", "__q", "__f")


def cipher_candidates(rows: DataFrame) -> DataFrame:
    """(id, nth, word, n, least): for each word of the query whose letters the examples don't all show, how many words of the
    vocabulary it may stand for, and the first of them (J5)."""
    pairs, query = cipher_parts(F.col("prompt"))
    df = rows.select("id", pairs.alias("pairs"), query.alias("query")).withColumn("m", ciphers.char_map(F.col("pairs")))
    df = df.select("id", F.struct(F.map_keys("m").alias("c"), F.map_values("m").alias("p")).alias("known"), F.posexplode(F.filter(F.split("query", " +"), lambda w: w != "")).alias("nth", "word"))
    df = df.filter(~F.forall(F.split("word", ""), lambda c: (c == "") | F.array_contains("known.c", c)))
    df = df.withColumn("fits", ciphers.candidates(F.col("word"), F.col("known")))
    return df.select("id", "nth", "word", F.size("fits").alias("n"), F.get("fits", F.lit(0)).alias("least"))


_ARITHMETIC = r"^(\d{2})(.)(\d{2})\z"


def _operation(text: Column, results: Callable[[Column, Column], Column]) -> Column:
    """struct<op, results> of two numbers around a sign; op is null for other texts."""
    a, b = (F.regexp_extract(text, _ARITHMETIC, k).try_cast("bigint") for k in (1, 3))
    return F.struct(F.nullif(F.regexp_extract(text, _ARITHMETIC, 2), F.lit("")).alias("op"), bound(F.struct(a.alias("a"), b.alias("b")), lambda x: results(x["a"], x["b"])).alias("results"))


def operator_rules(pairs: Column, results: Callable[[Column, Column], Column] = symbols.results) -> Column:
    """array<struct<op, rules>>: of each operator of the examples, the places of all candidates that give its examples.

    The op null stands for left sides that are no operation; it has no rules.
    """
    examples = F.transform(pairs, lambda p: F.struct(_operation(p["inp"], results).alias("x"), p["out"].alias("out")))

    def ruled(es: Column) -> Column:
        def rules(op: Column) -> Column:
            own = F.filter(es, lambda e: e["x"]["op"].eqNullSafe(op))
            fits = F.filter(F.sequence(F.lit(0), F.size(own[0]["x"]["results"]) - 1), lambda k: F.forall(own, lambda e: F.coalesce(F.get(e["x"]["results"], k) == e["out"], F.lit(False))))
            return F.struct(op.alias("op"), F.when(op.isNotNull(), fits).otherwise(F.array().cast("array<int>")).alias("rules"))

        return F.transform(F.array_distinct(F.transform(es, lambda e: e["x"]["op"])), rules)

    return bound(examples, ruled)


def by_arithmetic(pairs: Column, query: Column) -> Column:
    """struct<predicted, rule>: every left side and the query are two numbers around a sign, and every operator has a rule;
    of several, the first is taken. predicted is null otherwise."""

    def answered(x: Column) -> Column:
        of = F.get(F.filter(x["rules"], lambda r: r["op"] == x["q"]["op"]), F.lit(0))["rules"]
        rule = F.when(F.forall(x["rules"], lambda r: F.size(r["rules"]) > 0), F.get(of, F.lit(0)))
        return F.struct(F.get(x["q"]["results"], rule).alias("predicted"), symbols.rule_name(rule).alias("rule"))

    return bound(F.struct(operator_rules(pairs).alias("rules"), _operation(query, symbols.results).alias("q")), answered)


def older_candidates(rows: DataFrame) -> DataFrame:
    """(id, n_candidates, answers): the older, smaller set of candidates without an order among them.

    answers are the distinct results of all candidates that fit the query's operator: more than one means that the examples
    leave the answer open, and none of them is preferred.
    """
    pairs, query = symbol_parts(F.col("prompt"))
    x = bound(F.struct(operator_rules(pairs, symbols.older_results).alias("rules"), _operation(query, symbols.older_results).alias("q")), lambda x: F.when(F.forall(x["rules"], lambda r: F.size(r["rules"]) > 0), F.transform(F.get(F.filter(x["rules"], lambda r: r["op"] == x["q"]["op"]), F.lit(0))["rules"], lambda k: F.get(x["q"]["results"], k))))
    df = rows.select("id", F.coalesce(x, F.array().cast("array<string>")).alias("all"))
    return df.select("id", F.size("all").alias("n_candidates"), F.array_sort(F.array_distinct(F.array_compact("all"))).alias("answers"))


def solve_symbol(rows: DataFrame) -> DataFrame:
    pairs, query = symbol_parts(F.col("prompt"))
    df = _dealt(rows).withColumn("__pairs", pairs).withColumn("__q", query).withColumn("__a", by_arithmetic(F.col("__pairs"), F.col("__q")))
    df = df.withColumn("__d", symbols.deletion_answer(F.when(F.col("__a.predicted").isNull(), F.col("__pairs")), F.col("__q")))
    each = F.transform("__pairs", lambda p: F.concat(p["inp"], F.lit(" gives "), p["out"]))
    by_rule = F.concat(F.lit("Every operator has a rule that gives all its examples; the query's is "), F.col("__a.rule"), F.lit("."))
    steps = _lines("The examples are held against the known rules.", each, _line(F.coalesce(by_rule, F.lit("No arithmetic rule fits. Deleting the same places from each left side leaves one substitution of letters."))), _line("For ", F.col("__q"), " it gives ", F.coalesce("__a.predicted", "__d"), "."))
    how = F.when(F.col("__a.predicted").isNotNull(), "arithmetic").otherwise("deletion")
    return _closed(df, (F.size("__pairs") > 0) & F.col("__q").isNotNull(), F.coalesce("__a.predicted", "__d"), how, steps).drop("__pairs", "__q", "__a", "__d")


@dataclass(frozen=True)
class Solver:
    """A solver for a family of prompts; more can be registered under other names."""

    family: str
    solve: Callable[[DataFrame], DataFrame]


SOLVERS: dict[str, Solver] = {}


def register_solver(family: str, solve: Callable[[DataFrame], DataFrame]) -> None:
    SOLVERS[family] = Solver(family, solve)


for _name, _solve in (("gravitational", _ratio_solver(gravity_parts, True)), ("unit_conversion", _ratio_solver(unit_parts, False)), ("numeral", solve_numeral), ("encrypt", solve_cipher), ("bitmanip", solve_bits), ("symbol", solve_symbol)):
    register_solver(_name, _solve)


def solve_all(puzzles: DataFrame) -> DataFrame:
    """Route each puzzle to the solver that takes its beginning (R15, P19); the rest are 'unmatched'.

    The input is read once: rows are tagged with their family and written in a folder for each, and every solver reads its
    own. A solver tries its methods from the strongest to the weakest and says in `how` which one found the rule.
    """
    df = staged(puzzles.withColumn("family", classify.routed_family(F.col("prompt"))), "routed", "family")
    none = F.lit(None).cast("string")
    out = df.filter(~F.col("family").isin(*SOLVERS)).withColumns({"predicted": none, "status": F.lit("unmatched"), "how": none, "steps": none})
    for s in SOLVERS.values():
        out = out.unionByName(s.solve(df.filter(F.col("family") == s.family)))
    return out


def solution_counts(rows: DataFrame) -> DataFrame:
    """(id, bit, n): how many affine rules each output character leaves open."""
    examples, _ = bit_parts(F.col("prompt"))
    return rows.select("id", examples.alias("e")).select("id", F.posexplode(bits.affine_counts(F.col("e"))).alias("bit", "n"))


def affine_only(rows: DataFrame) -> DataFrame:
    """(id, predicted): the older bit rule, affine in all characters or none, and proved on every example."""
    examples, query = bit_parts(F.col("prompt"))
    df = rows.select("id", examples.alias("e"), query.alias("q"))
    return df.select("id", F.when(F.col("q").isNotNull(), bits.affine_only(F.col("e"), F.col("q"))).alias("predicted"))
