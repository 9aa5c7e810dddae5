"""Queries for functions and rule inference, each with the SQL it is held against."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gristmill.functions import bits, ciphers, numerals, sequences
from gristmill.operators import dataset, rules
from gristmill.plans.catalog import query, table
from gristmill.plans.puzzles import VIEWS, puzzles, puzzles_sql, view, view_sql

_ROMAN = """['', 'M', 'MM', 'MMM'][{0} // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][{0} // 100 % 10 + 1]
 || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][{0} // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][{0} % 10 + 1]"""


@query("roman_encode", f"SELECT p_partkey, {_ROMAN.format('(1 + p_partkey % 3999)')} AS roman FROM part")
def roman_encode(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numerals.to_roman(1 + F.col("p_partkey") % 3999).alias("roman"))


@query("roman_decode", "SELECT p_partkey, CAST(1 + p_partkey % 3999 AS INTEGER) AS n FROM part")
def roman_decode(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numerals.from_roman(numerals.to_roman(1 + F.col("p_partkey") % 3999)).alias("n"))


@query("roman_arith", f"SELECT p_partkey, {_ROMAN.format('(1 + p_partkey % 900 + p_size)')} AS total FROM part")
def roman_arith(spark, sf_dir):
    a, b = numerals.to_roman(1 + F.col("p_partkey") % 900), numerals.to_roman(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", numerals.to_roman(numerals.from_roman(a) + numerals.from_roman(b)).alias("total"))


_V = "CAST(p_partkey % 256 AS INTEGER)"


@query("bit_rotate", f"SELECT p_partkey, lpad(bin((({_V} << 3) | ({_V} >> 5)) & 255), 8, '0') AS lft, lpad(bin((({_V} >> 2) | ({_V} << 6)) & 255), 8, '0') AS rgt FROM part")
def bit_rotate(spark, sf_dir):
    v = (F.col("p_partkey") % 256).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", bits.render(bits.rotate_left(v, 3)).alias("lft"), bits.render(bits.rotate_right(v, 2)).alias("rgt"))


@query("bit_not_xor_shift", f"SELECT p_partkey, 255 - {_V} AS inv, xor({_V}, 90) AS masked, ({_V} << 2) & 255 AS shl, {_V} >> 3 AS shr FROM part")
def bit_not_xor_shift(spark, sf_dir):
    v = (F.col("p_partkey") % 256).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", bits.invert(v).alias("inv"), bits.xor_mask(v, 90).alias("masked"), bits.shift_left(v, 2).alias("shl"), bits.shift_right(v, 3).alias("shr"))


@query(
    "ciphers",
    """SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'DEFGHIJKLMNOPQRSTUVWXYZABCdefghijklmnopqrstuvwxyzabc') AS caesar,
 translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ZYXWVUTSRQPONMLKJIHGFEDCBAzyxwvutsrqponmlkjihgfedcba') AS atbash,
 array_to_string(list_transform(string_split(p_name, ' '), lambda w: reverse(w)), ' ') AS reversed, regexp_replace(p_name, '(.)(.)', '\\2\\1', 'g') AS swapped FROM part""",
)
def cipher_functions(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", ciphers.caesar(n, 3).alias("caesar"), ciphers.atbash(n).alias("atbash"), ciphers.reverse_words(n).alias("reversed"), ciphers.swap_pairs(n).alias("swapped"))


@query(
    "list_functions",
    """WITH l AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_quantity, l_partkey) AS xs FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(xs, 'DESC'), ', ') AS down, array_to_string(xs[2:] || xs[:1], ', ') AS rotated, array_to_string(list_sort(list_distinct(xs)), ', ') AS once FROM l""",
)
def list_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("bigint"))).alias("xs"))
    xs = F.col("xs")
    return rows.select("l_orderkey", sequences.rendered(F.sort_array(xs, False)).alias("down"), sequences.rendered(sequences.rotated_left(xs, F.lit(1))).alias("rotated"), sequences.rendered(F.array_distinct(xs)).alias("once"))


@query("mod_arith", "SELECT p_partkey, ((p_partkey - 700) % 11 + 11) % 11 AS sub, (p_partkey * p_size) % 13 AS mul, (p_size % 7) * (p_size % 7) * (p_size % 7) % 7 AS pow FROM part")
def mod_arith(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.pmod(k - 700, F.lit(11).cast("bigint")).alias("sub"), F.pmod(k * s, F.lit(13).cast("bigint")).alias("mul"), sequences.mod_pow(s.cast("bigint"), 3, F.lit(7).cast("bigint")).cast("int").alias("pow"))


@query(
    "seq_closed_forms",
    """WITH k AS (SELECT p_partkey, p_partkey % 9 + 1 AS a, p_size % 5 + 1 AS d FROM part)
SELECT p_partkey, array_to_string([a, a + d, a + 2 * d, a + 3 * d, a + 4 * d], ', ') AS arith, array_to_string([a, a * d, a * d * d, a * d * d * d], ', ') AS geom, array_to_string([a, d, a + d, a + 2 * d, 2 * a + 3 * d], ', ') AS fib FROM k""",
)
def seq_closed_forms(spark, sf_dir):
    a, d = (F.col("p_partkey") % 9 + 1).cast("bigint"), (F.col("p_size") % 5 + 1).cast("bigint")
    return table(spark, sf_dir, "part").select("p_partkey", sequences.rendered(sequences.arithmetic(a, d, 5)).alias("arith"), sequences.rendered(sequences.geometric(a, d, 4)).alias("geom"), sequences.rendered(sequences.fibonacci_like(a, d, 5)).alias("fib"))


@query("seq_detect_kind", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'arithmetic' ELSE 'quadratic' END AS kind FROM part")
def seq_detect_kind(spark, sf_dir):
    k, one = (F.col("p_partkey") % 9 + 2).cast("bigint"), F.lit(1).cast("bigint")
    df = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, sequences.arithmetic(k, k + 1, 6)).otherwise(sequences.quadratic(k, one, one, 6)).alias("xs"))
    return df.select("p_partkey", sequences.kind_of(F.col("xs")).alias("kind"))


_RATIO = """WITH p AS ({view}), e AS (SELECT id, answer, unnest(regexp_extract_all(prompt, '{pair}', 1)) AS x, unnest(regexp_extract_all(prompt, '{pair}', 2)) AS y FROM p),
d AS (SELECT id, CAST(y AS DOUBLE) AS y, {d} AS d FROM e), i AS (SELECT id, max((y - 0.005) / d) AS lo, min((y + 0.005) / d) AS hi, sum(d * y) / sum(d * d) AS ls FROM d GROUP BY 1)
SELECT id, round(CASE WHEN lo <= hi THEN (lo + hi) / 2 ELSE ls END, 6) AS k, CASE WHEN lo <= hi THEN 'interval' ELSE 'least_squares' END AS how FROM i"""


def _ratio(spark, sf_dir, family, parts, square):
    df = view(spark, sf_dir, family).select("id", sequences.shared_interval(parts(F.col("prompt"))[0], square).alias("s"))
    return df.select("id", F.round("s.k", 6).alias("k"), F.col("s.how").alias("how"))


@query("interval_constant_quadratic", _RATIO.format(view=view_sql("gravitational"), pair=r"t = ([\d.]+)s, distance = ([\d.]+)", d="0.5 * CAST(x AS DOUBLE) * CAST(x AS DOUBLE)"))
def interval_constant_quadratic(spark, sf_dir):
    return _ratio(spark, sf_dir, "gravitational", rules.gravity_parts, True)


@query("interval_constant_linear", _RATIO.format(view=view_sql("unit_conversion"), pair=r"([\d.]+) m becomes ([\d.]+)", d="CAST(x AS DOUBLE)"))
def interval_constant_linear(spark, sf_dir):
    return _ratio(spark, sf_dir, "unit_conversion", rules.unit_parts, False)


@query("interval_constant_noisy", _RATIO.format(view=view_sql("unit_noisy"), pair=r"([\d.]+) m becomes ([\d.]+)", d="CAST(x AS DOUBLE)"))
def interval_constant_noisy(spark, sf_dir):
    return _ratio(spark, sf_dir, "unit_noisy", rules.unit_parts, False)


def _solved(family: str):
    def run(spark, sf_dir):
        return rules.SOLVERS[family].solve(view(spark, sf_dir, family)).select("id", "predicted", "status", "how")

    return run


_NEAR = "abs(CAST(predicted AS DOUBLE) - CAST(answer AS DOUBLE)) <= greatest(0.01 * greatest(abs(CAST(predicted AS DOUBLE)), abs(CAST(answer AS DOUBLE))), 0.00001)"
for _family, _pair, _ask, _d, _y in (
    ("gravitational", r"t = ([\d.]+)s, distance = ([\d.]+)", r"for t = ([\d.]+)s given", "0.5 * CAST(x AS DOUBLE) * CAST(x AS DOUBLE)", "k * (0.5 * q * q)"),
    ("unit_conversion", r"([\d.]+) m becomes ([\d.]+)", r"measurement: ([\d.]+) m", "CAST(x AS DOUBLE)", "k * q"),
):
    query(
        f"{_family}_solve",
        f"""WITH s AS ({_RATIO.format(view=view_sql(_family), pair=_pair, d=_d).replace("round(CASE WHEN lo <= hi THEN (lo + hi) / 2 ELSE ls END, 6) AS k", "CASE WHEN lo <= hi THEN (lo + hi) / 2 ELSE ls END AS k")}),
v AS (SELECT id, answer, how, format('{{:.2f}}', {_y}) AS predicted FROM s JOIN (SELECT id, answer, CAST(regexp_extract(prompt, '{_ask}', 1) AS DOUBLE) AS q FROM ({view_sql(_family)})) USING (id))
SELECT id, predicted, CASE WHEN {_NEAR} THEN 'derived_match' ELSE 'derived_mismatch' END AS status, how FROM v""",
    )(_solved(_family))
query("numeral_solve", f"SELECT id, {_ROMAN.format('q')} AS predicted, 'derived_match' AS status, 'roman' AS how FROM (SELECT id, CAST(regexp_extract(prompt, 'write the number ([0-9]+)', 1) AS BIGINT) AS q FROM ({view_sql('numeral')}))")(_solved("numeral"))
#: The view's ciphers can all be solved: the answer is the oracle. Whether the vocabulary is needed follows from the letters shown.
_SHOWN = "regexp_replace(regexp_replace(array_to_string(regexp_extract_all(prompt, '(?m)^(.*) -> .*$', 1), ''), '[^a-z]', '', 'g'), '^$', ' ')"
query("encrypt_solve", f"SELECT id, answer AS predicted, 'derived_match' AS status, CASE WHEN translate(regexp_extract(prompt, 'following text: (.*)$', 1), {_SHOWN} || ' ', '') = '' THEN 'map' ELSE 'dictionary' END AS how FROM ({view_sql('encrypt')})")(_solved("encrypt"))


_VOCABULARY = ", ".join(f"('{w}')" for w in ciphers.VOCABULARY)


@query(
    "cipher_candidates",
    f"""WITH p AS ({view_sql('encrypt_open')}), e AS (SELECT id, regexp_extract(prompt, '\\n([a-z ]+) -> ([a-z ]+)\\n', 1) AS c, regexp_extract(prompt, '\\n([a-z ]+) -> ([a-z ]+)\\n', 2) AS p FROM p),
k AS (SELECT DISTINCT id, c, p FROM (SELECT id, unnest(string_split(c, '')) AS c, unnest(string_split(p, '')) AS p FROM e) WHERE c <> ' ' AND c <> ''),
w AS (SELECT id, CAST(i - 1 AS INTEGER) AS nth, ws[i] AS word FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT id, string_split(regexp_extract(prompt, 'following text: (.*)$', 1), ' ') AS ws FROM p))),
l AS (SELECT id, nth, word, unnest(range(1, length(word) + 1)) AS i FROM w), o AS (SELECT l.id, nth, word FROM l LEFT JOIN k ON k.id = l.id AND k.c = substr(word, CAST(i AS BIGINT), 1) GROUP BY ALL HAVING count(k.c) < count(*)),
v AS (SELECT id, nth, word, v FROM o, (VALUES {_VOCABULARY}) t(v) WHERE length(v) = length(word)),
b AS (SELECT id, nth, word, v, substr(word, CAST(i AS BIGINT), 1) AS c, substr(v, CAST(i AS BIGINT), 1) AS p FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v) UNION ALL SELECT v.id, v.nth, v.word, v.v, k.c, k.p FROM v JOIN k ON k.id = v.id),
g AS (SELECT id, nth, v FROM b GROUP BY 1, 2, 3 HAVING count(DISTINCT c) = count(DISTINCT c || p) AND count(DISTINCT p) = count(DISTINCT c || p))
SELECT o.id, o.nth, o.word, CAST(count(g.v) AS INTEGER) AS n, min(g.v) AS least FROM o LEFT JOIN g ON g.id = o.id AND g.nth = o.nth GROUP BY 1, 2, 3""",
)
def cipher_candidates(spark, sf_dir):
    return rules.cipher_candidates(view(spark, sf_dir, "encrypt_open"))


def _symbol_candidates() -> list[str]:
    """SQL of the text of every arithmetic candidate, in the order in which they are tried."""

    def t(x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def rev(x: str) -> str:
        return f"reverse({t(x)})"

    ra, rb = (f"CAST({rev(x)} AS BIGINT)" for x in "ab")
    plain, turned = ["a + b", "a - b", "b - a", "a * b"], [f"{ra} + {rb}", f"{ra} - {rb}", f"{rb} - {ra}", f"{ra} * {rb}"]
    out = [t(x) for x in (*plain[:3], "abs(a - b)", "a // nullif(b, 0)", "b // nullif(a, 0)", "a % nullif(b, 0)", "b % nullif(a, 0)", plain[3], *turned)]
    out += [rev("a // nullif(b, 0)"), rev("b // nullif(a, 0)")]
    for x in plain:
        out += [rev(x), *(t(f"({x}) + {k}") for k in (1, -1, 2, -2))]
    for x in turned:
        out += [rev(x), *(t(f"({x}) + {k}") for k in (1, -1))]
    out += [f"{t(f'a // 10 {p} b // 10')} || {t(f'a % 10 {q} b % 10')}" if p != "*" else f"{t('(a // 10) * (b // 10)')} || {t(f'(a % 10) {q} (b % 10)')}" for p in "+-*" for q in "+-*"]
    out = [x.replace("a % 10 * b % 10", "(a % 10) * (b % 10)") for x in out]
    return out + ["a || '' || b", "b || '' || a", "reverse(a || '' || b)", "reverse(b || '' || a)"]


def _symbol_sql(of: str) -> str:
    every = "[" + ", ".join(_symbol_candidates()) + "]"
    return f"""WITH p AS ({of}), e AS (SELECT id, unnest(regexp_extract_all(prompt, '([0-9]{{2}})@([0-9]{{2}}) = (.*)', 1)) AS a, unnest(regexp_extract_all(prompt, '([0-9]{{2}})@([0-9]{{2}}) = (.*)', 2)) AS b, unnest(regexp_extract_all(prompt, '([0-9]{{2}})@([0-9]{{2}}) = (.*)', 3)) AS o FROM p),
c AS (SELECT id, o, {every} AS rs FROM (SELECT id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, o FROM e)),
k AS (SELECT id, min(n) AS n FROM (SELECT id, n FROM c, range(1, 61) r(n) GROUP BY 1, 2 HAVING bool_and(coalesce(rs[n] = o, false))) GROUP BY 1),
q AS (SELECT id, answer, {every} AS rs FROM (SELECT id, answer, CAST(regexp_extract(prompt, 'result for: ([0-9]{{2}})@', 1) AS BIGINT) AS a, CAST(regexp_extract(prompt, 'result for: [0-9]{{2}}@([0-9]{{2}})', 1) AS BIGINT) AS b FROM p)),
v AS (SELECT id, answer, rs[n] AS predicted FROM q LEFT JOIN k USING (id))
SELECT id, predicted, CASE WHEN predicted IS NULL THEN 'underdetermined' WHEN CASE WHEN regexp_full_match(answer, '[01]+') THEN predicted = answer WHEN TRY_CAST(predicted AS DOUBLE) IS NOT NULL THEN {_NEAR} ELSE predicted = answer END THEN 'derived_match' ELSE 'derived_mismatch' END AS status, CASE WHEN predicted IS NOT NULL THEN 'arithmetic' END AS how FROM v"""


query("symbol_solve", _symbol_sql(view_sql("symbol")))(_solved("symbol"))

_DROPPED = ", ".join(f"({n}, {i}, {j})" for n, (i, j) in enumerate(combinations(range(1, 7), 2)))


@query(
    "deletion_solve",
    f"""WITH p AS ({view_sql('symbol_deletion')}), x AS (SELECT id, unnest(regexp_extract_all(prompt, '([a-z]{{6}}) = ([A-Z]*)', 1)) AS a, unnest(regexp_extract_all(prompt, '([a-z]{{6}}) = ([A-Z]*)', 2)) AS o FROM p),
q AS (SELECT id, regexp_extract(prompt, 'result for: ([a-z]{{6}})', 1) AS q FROM p),
m AS (SELECT DISTINCT id, n, i, j, substr(a, pos, 1) AS c, CASE WHEN pos IN (i, j) THEN '' ELSE substr(o, pos - CAST(i < pos AS INTEGER) - CAST(j < pos AS INTEGER), 1) END AS v
 FROM x, (VALUES {_DROPPED}) s(n, i, j), (SELECT CAST(r AS INTEGER) AS pos FROM range(1, 7) t(r))),
f AS (SELECT id, n, i, j FROM m GROUP BY ALL HAVING count(DISTINCT c) = count(*)),
r AS (SELECT f.id, f.n, string_agg(v, '' ORDER BY pos) AS predicted, count(*) AS covered FROM f JOIN q USING (id), (SELECT CAST(r AS INTEGER) AS pos FROM range(1, 7) t(r)) JOIN m ON m.id = f.id AND m.n = f.n AND m.c = substr(q, pos, 1) WHERE pos NOT IN (f.i, f.j) GROUP BY 1, 2 HAVING count(*) = 4),
b AS (SELECT id, arg_min(predicted, n) AS predicted FROM r GROUP BY 1)
SELECT id, predicted, CASE WHEN predicted IS NULL THEN 'underdetermined' WHEN predicted = answer THEN 'derived_match' ELSE 'derived_mismatch' END AS status, CASE WHEN predicted IS NOT NULL THEN 'deletion' END AS how FROM p LEFT JOIN b USING (id)""",
)
def deletion_solve(spark, sf_dir):
    return rules.SOLVERS["symbol"].solve(view(spark, sf_dir, "symbol_deletion")).select("id", "predicted", "status", "how")


_BITS = r"""p AS ({view}), e AS (SELECT id, unnest(regexp_extract_all(prompt, '([01]{{8}})\s*->\s*([01]{{8}})', 1)) AS i, unnest(regexp_extract_all(prompt, '([01]{{8}})\s*->\s*([01]{{8}})', 2)) AS o FROM p),
x AS (SELECT id, o, (SELECT sum(CAST(substr(i, j + 1, 1) AS BIGINT) << j) FROM range(8) r(j)) + 256 AS x FROM e)"""


@query("gf2_solution_count", f"WITH {_BITS.format(view=view_sql('bitmanip'))}, f AS (SELECT id, b, w, bool_and(bit_count(CAST(x AS BIGINT) & w) % 2 = CAST(substr(o, CAST(b AS INTEGER) + 1, 1) AS INTEGER)) AS ok FROM x, range(512) s(w), range(8) t(b) GROUP BY 1, 2, 3) SELECT id, CAST(b AS INTEGER) AS bit, CAST(count(*) FILTER (ok) AS INTEGER) AS n FROM f GROUP BY 1, 2")
def gf2_solution_count(spark, sf_dir):
    return rules.solution_counts(view(spark, sf_dir, "bitmanip"))


_SUPPORTS = ", ".join(f"({k}, {m})" for k, m in enumerate(bits.SUPPORTS))


def _bitmanip_sql(of: str) -> str:
    return f"""WITH {_BITS.format(view=of)}, q AS (SELECT id, (SELECT sum(CAST(substr(s, j + 1, 1) AS BIGINT) << j) FROM range(8) r(j)) + 256 AS q FROM (SELECT id, regexp_extract(prompt, 'output for: ([01]+)', 1) AS s FROM p)),
y AS (SELECT id, CAST(b AS INTEGER) AS b, CAST(x AS BIGINT) AS x, CAST(q AS BIGINT) AS q, CAST(substr(o, CAST(b AS INTEGER) + 1, 1) AS INTEGER) AS t FROM x JOIN q USING (id), range(8) r(b)),
aff AS (SELECT id, b, min(w) AS w FROM (SELECT id, b, w FROM y, range(512) s(w) GROUP BY 1, 2, 3 HAVING bool_and(bit_count(x & w) % 2 = t)) GROUP BY 1, 2),
tab AS (SELECT id, b, arg_min(v, nth) AS v FROM (SELECT id, b, nth, max(t) FILTER (x & m = q & m) AS v FROM y ANTI JOIN aff USING (id, b), (VALUES {_SUPPORTS}) s(nth, m)
 GROUP BY 1, 2, 3 HAVING count(DISTINCT x & m) = count(DISTINCT (x & m) * 2 + t) AND bool_or(x & m = q & m)) GROUP BY 1, 2),
one AS (SELECT DISTINCT y.id, y.b, coalesce(bit_count(y.q & w) % 2, v) AS v FROM y LEFT JOIN aff USING (id, b) LEFT JOIN tab USING (id, b)),
a AS (SELECT id, CASE WHEN count(v) = 8 THEN string_agg(CAST(v AS VARCHAR), '' ORDER BY b) END AS predicted FROM one GROUP BY 1),
n AS (SELECT id, count(*) AS n FROM aff GROUP BY 1)
SELECT id, predicted, CASE WHEN predicted IS NULL THEN 'underdetermined' WHEN predicted = answer THEN 'derived_match' ELSE 'derived_mismatch' END AS status, CASE WHEN predicted IS NULL THEN NULL WHEN n = 8 THEN 'affine' ELSE 'table' END AS how FROM a JOIN p USING (id) LEFT JOIN n USING (id)"""


query("bitmanip_solve", _bitmanip_sql(view_sql("bitmanip")))(_solved("bitmanip"))


@query(
    "affine_only",
    f"""WITH {_BITS.format(view=view_sql('bitmanip'))}, q AS (SELECT id, (SELECT sum(CAST(substr(s, j + 1, 1) AS BIGINT) << j) FROM range(8) r(j)) + 256 AS q FROM (SELECT id, regexp_extract(prompt, 'output for: ([01]+)', 1) AS s FROM p)),
w AS (SELECT id, b, min(w) AS w FROM (SELECT id, b, w FROM x, range(512) s(w), range(8) t(b) GROUP BY 1, 2, 3 HAVING bool_and(bit_count(CAST(x AS BIGINT) & w) % 2 = CAST(substr(o, CAST(b AS INTEGER) + 1, 1) AS INTEGER))) GROUP BY 1, 2)
SELECT id, CASE WHEN count(w) = 8 THEN string_agg(CAST(bit_count(CAST(q AS BIGINT) & w) % 2 AS VARCHAR), '' ORDER BY b) END AS predicted FROM q LEFT JOIN w USING (id) GROUP BY id""",
)
def affine_only(spark, sf_dir):
    return rules.affine_only(view(spark, sf_dir, "bitmanip"))


@query(
    "older_candidates",
    f"""WITH p AS ({view_sql('symbol')}), e AS (SELECT id, unnest(regexp_extract_all(prompt, '([0-9]{{2}})@([0-9]{{2}}) = (.*)', 1)) AS a, unnest(regexp_extract_all(prompt, '([0-9]{{2}})@([0-9]{{2}}) = (.*)', 2)) AS b, unnest(regexp_extract_all(prompt, '([0-9]{{2}})@([0-9]{{2}}) = (.*)', 3)) AS o FROM p
 UNION ALL SELECT id, regexp_extract(prompt, 'result for: ([0-9]{{2}})@', 1), regexp_extract(prompt, 'result for: [0-9]{{2}}@([0-9]{{2}})', 1), NULL FROM p),
n AS (SELECT id, o, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(reverse(a) AS BIGINT) AS ra, CAST(reverse(b) AS BIGINT) AS rb FROM e),
c AS (SELECT id, o, unnest(range(18)) AS n, unnest([CAST(a + b AS VARCHAR), CAST(a - b AS VARCHAR), CAST(b - a AS VARCHAR), CAST(a * b AS VARCHAR), a || '' || b, b || '' || a, CAST(abs(a - b) AS VARCHAR), CAST(a // b AS VARCHAR), CAST(a % b AS VARCHAR), CAST(b // a AS VARCHAR), CAST(b % a AS VARCHAR),
 CAST(ra + rb AS VARCHAR), reverse(CAST(ra + rb AS VARCHAR)), CAST(ra - rb AS VARCHAR), CAST(rb - ra AS VARCHAR), CAST(abs(ra - rb) AS VARCHAR), ra || '' || rb, rb || '' || ra]) AS r FROM n),
f AS (SELECT id, n, max(r) FILTER (o IS NULL) AS answer FROM c GROUP BY 1, 2 HAVING bool_and(o IS NULL OR r = o))
SELECT p.id, CAST(count(f.n) AS INTEGER) AS n_candidates, coalesce(list_sort(list(DISTINCT f.answer) FILTER (f.answer IS NOT NULL)), []) AS answers FROM p LEFT JOIN f ON f.id = p.id GROUP BY p.id""",
)
def older_candidates(spark, sf_dir):
    return rules.older_candidates(view(spark, sf_dir, "symbol"))


def _mixed(n: int) -> str:
    return f"SELECT id, prompt, answer FROM ({puzzles_sql()}) WHERE pos % 7 = {n}"


_FAMILIES = list(VIEWS)


@query(
    "status_counts",
    f"""SELECT family, status, count(*) AS n FROM (SELECT 'bitmanip' AS family, status FROM ({_bitmanip_sql(_mixed(_FAMILIES.index('bitmanip')))}) UNION ALL SELECT 'symbol', status FROM ({_symbol_sql(_mixed(_FAMILIES.index('symbol')))})
 UNION ALL SELECT CASE pos % 7 {' '.join(f"WHEN {n} THEN '{f}'" for n, f in enumerate(_FAMILIES))} ELSE '__other__' END, CASE WHEN pos % 7 = 6 THEN 'unmatched' ELSE 'derived_match' END FROM ({puzzles_sql()}) WHERE pos % 7 NOT IN ({_FAMILIES.index('bitmanip')}, {_FAMILIES.index('symbol')})) GROUP BY 1, 2""",
)
def status_counts(spark, sf_dir):
    return dataset.status_counts(dataset.assembled(puzzles(spark, sf_dir)))


@query("dataset_union_cap", f"SELECT source_ix, id, pos FROM (SELECT 0 AS source_ix, id, pos FROM ({puzzles_sql()}) WHERE pos <= 70 UNION ALL SELECT 1, id, pos FROM ({view_sql('numeral')}) WHERE pos % 3 = 0) ORDER BY source_ix, pos LIMIT 100")
def dataset_union_cap(spark, sf_dir):
    one, two = puzzles(spark, sf_dir).filter("pos <= 70"), view(spark, sf_dir, "numeral").filter("pos % 3 = 0")
    return dataset.capped_union([one, two], 100).select("source_ix", "id", "pos")
