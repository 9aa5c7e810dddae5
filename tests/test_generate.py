import re
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from gristmill.operators import generate, profile, report, tokens
from gristmill.plans import catalog, registry  # noqa: F401

ROMAN = dict(zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True))


def roman_value(s):
    v = [ROMAN[c] for c in s]
    return sum(-a if a < max(v[i + 1 :], default=0) else a for i, a in enumerate(v))


def caesar(s, k):
    return "".join(chr((ord(c) - 97 + k) % 26 + 97) if c.islower() else c for c in s)


def right(domain, rule, inp, out):
    """Whether out follows from inp by the rule, in plain Python."""
    number = [int(x) for x in re.findall(r"\d+", rule)]
    if domain == "binary_ops":
        k = int(rule[4:], 2 if rule.startswith("XOR") else 10) if "-" in rule else 0
        turned = {"NOT": lambda s: "".join("10"[int(c)] for c in s), "ROL": lambda s: s[k:] + s[:k], "ROR": lambda s: s[-k:] + s[:-k], "XOR": lambda s: f"{int(s, 2) ^ k:08b}", "SHL": lambda s: (s + "0" * k)[k:], "SHR": lambda s: ("0" * k + s)[:8]}
        return out == turned[rule[:3]](inp)
    if domain == "cipher":
        swapped = "".join(inp[i : i + 2][::-1] for i in range(0, len(inp), 2))
        return out == {"C": caesar(inp, number[0] if number else 0), "RO": caesar(inp, 13), "A": "".join(chr(219 - ord(c)) if c != " " else c for c in inp), "RE": " ".join(w[::-1] for w in inp.split(" ")), "S": swapped}[next(p for p in ("C", "RO", "A", "RE", "S") if rule.upper().startswith(p))]
    if domain == "linear_eq":
        a, b = (int(x) for x in re.findall(r"-?\d+", rule))
        return int(out) == a * int(inp) + b
    if domain == "roman":
        values = [int(x) if x.isdigit() else roman_value(x) for x in re.split(r" [+-] ", inp)]
        want = values[0] + (values[1] if "add" in rule else -values[1] if "subtract" in rule else 0)
        return want == (int(out) if out.isdigit() else roman_value(out)) and out.isdigit() == (rule == "roman_to_int") and 1 <= want <= 3999
    if domain == "list_ops":
        xs, k = inp.split(", "), number[0] if number else 0
        want = {"sort_asc": lambda: sorted(xs, key=int), "sort_desc": lambda: sorted(xs, key=int)[::-1], "reverse": lambda: xs[::-1], "rotate_left": lambda: xs[k:] + xs[:k], "rotate_right": lambda: xs[-k:] + xs[:-k], "dedupe": lambda: list(dict.fromkeys(xs))}[re.sub(r"_\d+$", "", rule)]()
        return out.split(", ") == want and (rule == "dedupe") == (len(set(xs)) < len(xs)) and 4 <= len(xs) <= 6
    if domain == "modular_arith":
        v = [int(x) for x in re.findall(r"\d+", inp)]
        n = int(re.search(r"_mod_(\d+)", rule)[1])
        want = {"add": lambda: v[0] + v[1], "sub": lambda: v[0] - v[1], "mul": lambda: v[0] * v[1], "pow": lambda: v[0] ** number[0], "lin": lambda: number[1] * v[0] + number[2]}[rule[:3]]()
        return int(out) == want % n
    p = [int(x) for x in re.findall(r"=(-?\d+)", rule)]
    i = int(inp.split()[1]) - 1
    fib = p[:2]
    while len(fib) <= i:
        fib.append(fib[-1] + fib[-2] if len(p) > 1 else 0)
    want = {"a": lambda: p[0] + i * p[1], "g": lambda: p[0] * p[1] ** i, "q": lambda: p[0] * i * i + p[1] * i + p[2], "f": lambda: fib[i], "p": lambda: (i + 1) ** p[0] + p[1]}[rule[0]]()
    return int(out) == want


@pytest.mark.parametrize("domain", generate.DOMAINS)
def test_generated_puzzles_follow_their_rules(spark, domain):
    rows = generate.generated(spark.range(120).withColumnRenamed("id", "pos"), domain).collect()
    assert len({re.split(r"[-(]|_mod|_\d", r.rule)[0] for r in rows}) == {"binary_ops": 6, "cipher": 5, "linear_eq": 1, "roman": 4, "number_seq": 5, "list_ops": 6}.get(domain, len({re.split(r"[-(]|_mod|_\d", r.rule)[0] for r in rows}))
    for r in rows:
        pairs = re.findall(r"^  \d+\. Input: (.*)  →  Output: (.*)$", r.prompt, re.M)
        query = re.search(r"^Query input: (.*)$", r.prompt, re.M)[1]
        assert len(pairs) == (5 if domain == "number_seq" else 4) and query not in [p for p, _ in pairs] or domain in ("roman", "cipher", "list_ops")
        assert all(right(domain, r.rule, a, b) for a, b in [*pairs, (query, r.answer)]), r
        assert r.verified and generate.REFUTED not in r.trace and "\nAll examples verified.\n" in r.trace and r.trace.endswith(f" gives {r.answer}.\n\\boxed{{{r.answer}}}")


@pytest.mark.parametrize("domain", generate.DOMAINS)
def test_wrong_outputs_are_not_verified(spark, domain, monkeypatch):
    """Outputs and predictions that are wrong alike: only a check of another kind can tell."""
    make = generate.DOMAINS[domain]
    rows = spark.range(60).withColumnRenamed("id", "pos")

    def wrong(draw):
        rules = make(draw)
        return replace(rules, told=lambda y: F.concat(rules.told(y), F.lit("1")))

    monkeypatch.setitem(generate.DOMAINS, domain, wrong)
    got = generate.generated(rows, domain).collect()
    assert len(got) == 60 and not any(r.verified for r in got) and all(generate.REFUTED in r.trace for r in got)


def test_a_rule_that_gives_the_wrong_text_stops_the_build(spark, monkeypatch):
    """Each rule of a domain put in the place of the next: a rotation to the left is no rotation to the right."""

    def turned(draw):
        rules = generate._list(draw)
        return replace(rules, apply=rules.apply[1:] + rules.apply[:1])

    monkeypatch.setitem(generate.DOMAINS, "list_ops", turned)
    with pytest.raises(Exception, match="list_ops: a rule doesn't give its own examples"):
        generate.build_synthetic(spark, 30).collect()


def test_generated_puzzles_do_not_depend_on_partitions(spark):
    rows = spark.range(60).withColumnRenamed("id", "pos")
    a, b = (sorted(map(str, generate.generated(x, "list_ops").collect())) for x in (rows.coalesce(1), rows.repartition(7)))
    assert a == b


def test_report_text(spark):
    rows = spark.createDataFrame([("a", "binary flip 101", "10110011", 0), ("b", "binary flip 111", "101", 1), ("c", "other", "", 2)], "id string, prompt string, answer string, pos long")
    text = report.render(profile.profiled(rows))
    assert "binary_ops: 2 of 3\n" in text and "1 of width 8" in text and "uncovered: 1 of 3 (no generator makes these)" in text and "don't cover (" in text
    accuracy = spark.createDataFrame([("roman", 4, 3, 0.75), ("__all__", 5, 3, 0.6)], "group string, total long, n_correct long, accuracy double")
    assert report.evaluation_text(accuracy, 1, (0.2, 0.9)).split("\n") == ["all: 3 of 5 right (0.6000)", "roman: 3 of 4 right (0.7500)", "without a prediction: 1", "interval of the accuracy: 0.2000 to 0.9000"]
    counts = spark.createDataFrame([("symbol", "none", 0), ("roman", "derived_match", 2), ("roman", "parse_error", 1)], "family string, status string, n long")
    assert report.build_text(counts).split("\n") == ["3 records", "roman: 3 records, 2 derived_match, 1 parse_error", "symbol: 0 records"]


def chat(thinks):
    """Defined within a function, so that it travels to workers that can't import this module."""

    class Chat:
        def apply_chat_template(self, said, tokenize, add_generation_prompt, **extra):
            if extra and thinks is None:
                raise TypeError
            return f"<u>{said[0]['content']}<a>" + "<think>" * bool(extra and thinks)

        def encode(self, text, add_special_tokens):
            return [ord(c) for c in text]

    return Chat()


def test_token_pairs(spark):
    made = chat(True)
    rows = spark.createDataFrame([("p", "t"), ("p", "t" * 300), ("p" * 300, "t"), (None, "t")], "prompt string, trace string")
    got = [r.pair for r in tokens.tokenised(rows, lambda: made, 200).collect()]
    assert [p.reject for p in got] == [None, "total_too_long", "prompt_too_long", "missing"]
    ids, labels = got[0].input_ids, got[0].labels
    assert "".join(map(chr, ids)).endswith("<a><think>t") and labels == [-100] * (len(ids) - 1) + [ord("t")]
    assert [tokens.honours_thinking(chat(x)) for x in (True, False, None)] == [True, False, False]


def test_ids_beyond_six_digits_are_shown_as_in_sql_and_stay_whole_in_records(spark, tmp_path):
    spark.range(150_000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    sql = catalog.ORACLES["synthetic_ids"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, catalog.QUERIES["synthetic_ids"](spark, str(tmp_path)).collect())) == sorted(con.execute(sql).fetchall())
    ids = [r.id for r in generate.records(spark.range(2).withColumnRenamed("id", "pos"), 1_000_000).select("id").collect()]
    assert "synthetic_linear_eq_2000001" in ids and len(set(ids)) == 14
