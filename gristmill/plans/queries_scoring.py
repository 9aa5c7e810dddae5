"""Queries for scoring, profiling, evaluation and splits, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import classify, scoring
from gristmill.functions.classify import DOMAIN_KEYWORDS, EVAL_KEYWORDS, EXPECTED_FORMATS
from gristmill.operators import dataset, evaluate, experiments, profile, report, staging
from gristmill.plans.catalog import query, table
from gristmill.plans.puzzles import puzzles, puzzles_sql


def _keyword_case(column: str, keywords, default: str) -> str:
    def quoted(w: str) -> str:
        return "'" + w.replace("'", "''") + "'"

    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({column}), {quoted(w)})' for w in ws)} THEN '{d}'" for d, ws in keywords) + f" ELSE '{default}' END"


_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_VERIFY = """CASE WHEN regexp_full_match({g}, '[01]+') THEN lower({p}) = lower({g})
 WHEN try_cast({g} AS DOUBLE) IS NOT NULL AND try_cast({p} AS DOUBLE) IS NOT NULL
 THEN abs(try_cast({g} AS DOUBLE) - try_cast({p} AS DOUBLE)) <= greatest(0.01 * greatest(abs(try_cast({g} AS DOUBLE)), abs(try_cast({p} AS DOUBLE))), 0.00001)
 ELSE lower({p}) = lower({g}) END"""
_FORMAT = r"""CASE WHEN {0} = '' THEN 'empty' WHEN length({0}) >= 2 AND regexp_full_match({0}, '[01]+') THEN 'binary'
 WHEN regexp_full_match({0}, '-?\d+') THEN 'int' WHEN regexp_full_match({0}, '-?\d+\.\d+') THEN 'float'
 WHEN regexp_full_match({0}, '(?i)[IVXLCDM]+') THEN 'roman' WHEN regexp_full_match({0}, '[A-Za-z]+(?:\s+[A-Za-z]+)+') THEN 'phrase'
 WHEN regexp_full_match({0}, '[A-Za-z]+') THEN 'word' WHEN regexp_full_match({0}, '[0-9A-Fa-f]+') THEN 'hex' ELSE 'other' END"""
_SIGNATURE = r"""substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\b[01]{{3,}}\b', '<BIN>', 'g'), '-?\d+(?:\.\d+)?', '<NUM>', 'g'), '\s*(?:->|=>|→|:)\s*', ' : ', 'g'), '\s+', ' ', 'g'), 1, 140)"""


@query(
    "score_numeric_tolerance",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS g, CAST(CAST(l_quantity AS BIGINT) * 1000 + (l_orderkey % 5 - 2) * 7 AS VARCHAR) AS q FROM lineitem)
SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN {_VERIFY.format(g="g", p="(q || 'e-3')")} THEN 1 ELSE 0 END) AS BIGINT) AS n_correct FROM v GROUP BY 1""",
)
def score_numeric_tolerance(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint")
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", q.cast("string").alias("g"), F.concat((q * 1000 + (F.col("l_orderkey") % 5 - 2) * 7).cast("string"), F.lit("e-3")).alias("p"))
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(scoring.is_correct(F.col("g"), F.col("p"))).alias("n_correct"))


@query(
    "score_binary_strict",
    f"""WITH v AS (SELECT p_partkey, bin(p_size) AS g, CASE p_partkey % 3 WHEN 0 THEN bin(p_size) WHEN 1 THEN lpad(bin(p_size), 8, '0') ELSE bin(p_size) || '.0' END AS p FROM part)
SELECT p_partkey, p AS predicted, {_VERIFY.format(g="g", p="p")} AS correct FROM v""",
)
def score_binary_strict(spark, sf_dir):
    g, k = F.bin("p_size"), F.col("p_partkey") % 3
    df = table(spark, sf_dir, "part").select("p_partkey", g.alias("g"), F.when(k == 0, g).when(k == 1, F.lpad(g, 8, "0")).otherwise(F.concat(g, F.lit(".0"))).alias("predicted"))
    return df.select("p_partkey", "predicted", scoring.is_correct(F.col("g"), F.col("predicted")).alias("correct"))


@query(
    "score_casefold",
    f"""WITH v AS (SELECT p_partkey, p_name AS g, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || lower(p_name) || ' ' ELSE p_name || '!' END AS p FROM part)
SELECT p_partkey, {_VERIFY.format(g="g", p=_STRIP.format("p"))} AS correct FROM v""",
)
def score_casefold(spark, sf_dir):
    n, k = F.col("p_name"), F.col("p_partkey") % 3
    p = F.when(k == 0, F.upper(n)).when(k == 1, F.concat(F.lit("  "), F.lower(n), F.lit(" "))).otherwise(F.concat(n, F.lit("!")))
    return table(spark, sf_dir, "part").select("p_partkey", scoring.is_correct(n, p).alias("correct"))


_COMPLETION = r"""CASE o_orderkey % 6
 WHEN 0 THEN 'first \boxed{' || o_orderkey || '} then \boxed{' || o_custkey || '} done'
 WHEN 1 THEN 'empty \boxed{} but The final answer is: ' || o_custkey || chr(10) || 'end'
 WHEN 2 THEN 'nested \boxed{\frac{' || o_orderkey || '}{2}} text'
 WHEN 3 THEN 'got ' || o_orderkey || ', then ' || o_custkey || ' at last'
 WHEN 4 THEN 'line one' || chr(10) || chr(10) || '  ' || o_orderpriority || chr(10) || chr(10)
 ELSE 'Final answer: ' || o_orderstatus END"""


def _completions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(_COMPLETION.replace("\\", "\\\\")).alias("completion"))


_BOXED = r"""list_filter(list_transform(string_split(completion, '\boxed{')[2:], lambda w: trim(CASE WHEN contains(w, '}') THEN regexp_extract(w, '(?s)^(.*)\}', 1) ELSE w END)), lambda x: x <> '')[-1]"""
_PHRASE = r"""list_filter(list_transform(list_concat(list_concat(regexp_extract_all(completion, '(?i)The final answer is:\s*([^\n]+)', 1), regexp_extract_all(completion, '(?i)Final answer is:\s*([^\n]+)', 1)), regexp_extract_all(completion, '(?i)Final answer\s*[:：]\s*([^\n]+)', 1)), lambda x: trim(x)), lambda x: x <> '')[-1]"""
_NUMBER = r"regexp_extract_all(completion, '-?\d+(?:\.\d+)?')[-1]"
_LINE = "list_filter(list_transform(string_split(completion, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1]"
_EXTRACT = f"coalesce({_BOXED}, {_PHRASE}, {_NUMBER}, {_LINE}, 'NOT_FOUND')"


@query("extract_boxed_last", f"SELECT o_orderkey, {_BOXED} AS boxed FROM (SELECT o_orderkey, {_COMPLETION} AS completion FROM orders)")
def extract_boxed_last(spark, sf_dir):
    return _completions(spark, sf_dir).select("o_orderkey", scoring.boxed_answer(F.col("completion")).alias("boxed"))


@query("extract_phrase", f"SELECT o_orderkey, {_PHRASE} AS phrase FROM (SELECT o_orderkey, {_COMPLETION} AS completion FROM orders)")
def extract_phrase(spark, sf_dir):
    return _completions(spark, sf_dir).select("o_orderkey", scoring.phrase_answer(F.col("completion")).alias("phrase"))


@query("extract_last_number", f"SELECT o_orderkey, {_NUMBER} AS number, {_LINE} AS line FROM (SELECT o_orderkey, {_COMPLETION} AS completion FROM orders)")
def extract_last_number(spark, sf_dir):
    c = F.col("completion")
    return _completions(spark, sf_dir).select("o_orderkey", scoring.last_number(c).alias("number"), scoring.last_line(c).alias("line"))


@query("extract_last_line", "SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1], '') AS line FROM documents")
def extract_last_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(scoring.last_line(F.col("text")), F.lit("")).alias("line"))


@query(
    "extract_then_verify",
    f"""WITH c AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS gold, {_EXTRACT} AS answer FROM (SELECT o_orderkey, o_custkey, {_COMPLETION} AS completion FROM orders))
SELECT o_orderkey, answer, {_VERIFY.format(g="gold", p="answer")} AS correct FROM c""",
)
def extract_then_verify(spark, sf_dir):
    df = _completions(spark, sf_dir).select("o_orderkey", F.col("o_custkey").cast("string").alias("gold"), scoring.extract_answer(F.col("completion")).alias("answer"))
    return df.select("o_orderkey", "answer", scoring.is_correct(F.col("gold"), F.col("answer")).alias("correct"))


_ANSWERS = "SELECT p_size, CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN p_name WHEN 2 THEN p_brand WHEN 3 THEN lpad(CAST(p_partkey AS STRING), 8, '0') WHEN 4 THEN ' 1' || CAST(p_size AS STRING) || '.5 ' WHEN 5 THEN 'XI' ELSE 'a' || CAST(p_size AS STRING) END AS answer FROM {part}"


@query("classify_answer_format", f"WITH a AS ({_ANSWERS.format(part='part')}) SELECT {_FORMAT.format(_STRIP.format('answer'))} AS format, count(*) AS n FROM a GROUP BY 1")
def classify_answer_format(spark, sf_dir):
    df = spark.sql(_ANSWERS, part=table(spark, sf_dir, "part"))
    return df.groupBy(classify.answer_format(F.col("answer")).alias("format")).agg(F.count("*").alias("n"))


@query("classify_domain_profile", f"SELECT {_keyword_case('prompt', DOMAIN_KEYWORDS, 'uncovered')} AS domain, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({puzzles_sql()}) GROUP BY 1")
def classify_domain_profile(spark, sf_dir):
    return profile.domain_shares(profile.profiled(puzzles(spark, sf_dir)))


@query("infer_domain_eval", f"SELECT doc_id, {_keyword_case('text', EVAL_KEYWORDS, 'other')} AS domain FROM documents")
def infer_domain_eval(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.eval_domain(F.col("text")).alias("domain"))


_PROFILED = f"SELECT id, pos, answer, {_keyword_case('prompt', DOMAIN_KEYWORDS, 'uncovered')} AS domain, {_FORMAT.format('answer')} AS format, {_SIGNATURE.format('prompt')} AS signature FROM ({puzzles_sql()})"


@query(
    "profile_histograms",
    f"""WITH r AS ({_PROFILED})
SELECT domain, 'rows' AS dimension, '' AS key, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT domain, 'format', format, count(*) FROM r GROUP BY 1, 3
UNION ALL SELECT domain, 'width', CAST(length(answer) AS VARCHAR), count(*) FROM r WHERE format = 'binary' GROUP BY 1, 3 UNION ALL SELECT domain, 'template', signature, count(*) FROM r GROUP BY 1, 3""",
)
def profile_histograms(spark, sf_dir):
    return profile.histograms(profile.profiled(puzzles(spark, sf_dir)))


@query("bit_width_histogram", f"WITH r AS ({_PROFILED}) SELECT domain, length(answer) AS width, count(*) AS n FROM r WHERE format = 'binary' GROUP BY 1, 2")
def bit_width_histogram(spark, sf_dir):
    rows = profile.profiled(puzzles(spark, sf_dir)).filter(F.col("width").isNotNull())
    return rows.groupBy("domain", F.col("width").cast("bigint").alias("width")).agg(F.count("*").alias("n"))


@query("template_clusters", f"SELECT {_SIGNATURE.format('url')} AS signature, count(*) AS n FROM pages GROUP BY 1")
def template_clusters(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(classify.template_signature(F.col("url")).alias("signature")).agg(F.count("*").alias("n"))


@query(
    "template_topk",
    f"""WITH c AS (SELECT domain, signature, count(*) AS n, min(pos) AS first_pos FROM ({_PROFILED}) GROUP BY 1, 2)
SELECT domain, signature, n, first_pos, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY domain ORDER BY n DESC, first_pos) AS INTEGER) AS rank FROM c) WHERE rank <= 5""",
)
def template_topk(spark, sf_dir):
    return profile.most_common(profile.profiled(puzzles(spark, sf_dir)), "signature", 5)


@query(
    "recon_report",
    f"""WITH r AS ({_PROFILED}), f AS (SELECT domain, format, count(*) AS n, min(pos) AS first_pos FROM r GROUP BY 1, 2), w AS (SELECT domain, length(answer) AS width, count(*) AS n FROM r WHERE format = 'binary' GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, first_pos) AS rank FROM (SELECT domain, signature, count(*) AS n, min(pos) AS first_pos FROM r GROUP BY 1, 2))
SELECT domain, CAST(sum(n) AS BIGINT) AS n, string_agg(format || '=' || n, ', ' ORDER BY n DESC, first_pos) AS answer_formats, coalesce((SELECT string_agg(width || '=' || n, ', ' ORDER BY width) FROM w WHERE w.domain = f.domain), '') AS binary_widths,
 (SELECT count(*) FROM t WHERE t.domain = f.domain) AS distinct_templates, (SELECT string_agg(signature || '=' || n, ', ' ORDER BY rank) FROM t WHERE t.domain = f.domain AND rank <= 5) AS top_templates FROM f GROUP BY domain""",
)
def recon_report(spark, sf_dir):
    df = report.domain_report(profile.profiled(puzzles(spark, sf_dir)))
    return df.select("domain", "n", report.listed("answer_formats").alias("answer_formats"), report.listed("binary_widths").alias("binary_widths"), "distinct_templates", report.listed("top_templates").alias("top_templates"))


_KNOWN = ", ".join(f"('{d}')" for d, _ in EXPECTED_FORMATS)
_KNOWN_FORMATS = ", ".join(f"('{d}', '{f}')" for d, fs in EXPECTED_FORMATS for f in fs)


@query(
    "coverage_gaps",
    f"""WITH r AS ({_PROFILED})
SELECT 'covered' AS kind, '' AS domain, '' AS detail, count(*) FILTER (domain <> 'uncovered') AS n FROM r
UNION ALL SELECT 'uncovered', domain, '', count(*) FROM r WHERE domain = 'uncovered' GROUP BY 2
UNION ALL SELECT 'not_seen', d, '', 0 FROM (VALUES {_KNOWN}) k(d) WHERE d NOT IN (SELECT domain FROM r)
UNION ALL SELECT 'format', domain, format, count(*) FROM r WHERE format <> 'empty' AND domain <> 'uncovered' AND (domain, format) NOT IN (SELECT d, f FROM (VALUES {_KNOWN_FORMATS}) k(d, f)) GROUP BY 2, 3
UNION ALL SELECT 'width', domain, CAST(length(answer) AS VARCHAR), count(*) FROM r WHERE domain = 'binary_ops' AND format = 'binary' AND length(answer) <> 8 GROUP BY 2, 3""",
)
def coverage_gaps(spark, sf_dir):
    return profile.coverage_gaps(profile.profiled(puzzles(spark, sf_dir)))


@query("first_ids_per_source", "SELECT source, CAST(rank AS INTEGER) AS rank, id FROM (SELECT source, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3")
def first_ids_per_source(spark, sf_dir):
    return profile.first_ids(table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.col("doc_id").alias("pos")), "source")


def _predictions(spark, sf_dir):
    """Predictions of a label's quality by length; ids divisible by 7 have two, of which the last counts."""
    docs = table(spark, sf_dir, "documents")
    one = docs.select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 300, "1").otherwise("0").alias("prediction"), F.lit(0).alias("pos"))
    two = docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("id"), F.lit("0").alias("prediction"), F.lit(1).alias("pos"))
    return one.unionByName(two).filter("id % 11 <> 3")


def _scored(spark, sf_dir):
    solutions = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("answer"), "lang")
    return evaluate.scored(solutions, _predictions(spark, sf_dir))


_SCORED = """SELECT CAST(l.doc_id AS VARCHAR) AS id, lang, l.doc_id % 11 = 3 AS missing,
 l.doc_id % 11 <> 3 AND CAST(quality AS VARCHAR) = CASE WHEN l.doc_id % 7 = 0 THEN '0' WHEN n_chars > 300 THEN '1' ELSE '0' END AS correct FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""


@query(
    "cv_accuracy_rollup",
    f"""SELECT CASE WHEN grouping(lang) = 1 THEN '__all__' ELSE lang END AS "group", count(*) AS total, count(*) FILTER (correct) AS n_correct, round(count(*) FILTER (correct) / count(*), 6) AS accuracy
FROM ({_SCORED}) GROUP BY ROLLUP (lang)""",
)
def cv_accuracy_rollup(spark, sf_dir):
    return evaluate.accuracy_rollup(_scored(spark, sf_dir), "lang")


@query("cv_missing_ids", f"SELECT id FROM ({_SCORED}) WHERE missing")
def cv_missing_ids(spark, sf_dir):
    return _scored(spark, sf_dir).filter("missing").select("id")


@query("cv_last_prediction_wins", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN '0' WHEN n_chars > 300 THEN '1' ELSE '0' END AS prediction FROM documents WHERE doc_id % 11 <> 3")
def cv_last_prediction_wins(spark, sf_dir):
    return evaluate.last_predictions(_predictions(spark, sf_dir))


@query(
    "bootstrap_ci_hashed",
    """WITH n AS (SELECT count(*) AS n, count(*) FILTER (quality = 1) AS k FROM labels),
m AS (SELECT r, count(*) FILTER (('0x' || substr(md5(r || '-' || j), 1, 8))::BIGINT % n < k) / any_value(n) AS m FROM range(1000) a(r), n, range(n) b(j) GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""",
)
def bootstrap_ci_hashed(spark, sf_dir):
    return evaluate.bootstrap_interval(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("correct")))


_SPLIT = """SELECT doc_id, lang, CASE WHEN rank <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS n FROM documents)"""


@query("stratified_split", _SPLIT)
def stratified_split(spark, sf_dir):
    return evaluate.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("split_train_val_counts", f"SELECT lang, split, count(*) AS n FROM ({_SPLIT}) GROUP BY 1, 2")
def split_train_val_counts(spark, sf_dir):
    return stratified_split(spark, sf_dir).groupBy("lang", "split").agg(F.count("*").alias("n"))


def _turn_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.length("text").cast("string").alias("answer"), F.length("text").alias("n"))


_ACCEPTED = """SELECT id, ix AS sample_ix, CASE WHEN ix % 2 = 0 THEN n WHEN ix = 1 THEN n + 1 ELSE 2 * n + 9 END AS said, n FROM
 (SELECT conv_id || '-' || turn AS id, length(text) AS n FROM conversations WHERE role = 'assistant'), range(4) r(ix)"""


@query("accept_traces", f"SELECT id, CAST(sample_ix AS INTEGER) AS sample_ix, CAST(said AS VARCHAR) AS extracted_answer FROM ({_ACCEPTED}) WHERE CASE WHEN regexp_full_match(CAST(n AS VARCHAR), '[01]+') THEN said = n ELSE abs(said - n) <= 0.01 * greatest(said, n) END")
def accept_traces(spark, sf_dir):
    return _accepted(spark, sf_dir).select("id", "sample_ix", "extracted_answer")


def _accepted(spark, sf_dir):
    rows = dataset.replicated(_turn_pairs(spark, sf_dir), 4)
    said = F.when(F.col("sample_ix") % 2 == 0, F.col("n")).when(F.col("sample_ix") == 1, F.col("n") + 1).otherwise(2 * F.col("n") + 9)
    return dataset.accepted(rows.withColumn("completion", F.concat(F.lit("so \\boxed{"), said.cast("string"), F.lit("}"))))


@query("acceptance_rate", f"SELECT id, count(*) FILTER (CASE WHEN regexp_full_match(CAST(n AS VARCHAR), '[01]+') THEN said = n ELSE abs(said - n) <= 0.01 * greatest(said, n) END) AS n_accepted FROM ({_ACCEPTED}) GROUP BY 1")
def acceptance_rate(spark, sf_dir):
    return dataset.acceptance(_turn_pairs(spark, sf_dir), _accepted(spark, sf_dir))


_CORRUPT = """WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(quality AS VARCHAR) || CAST(doc_id % 5 AS VARCHAR) AS answer FROM labels),
a AS (SELECT answer, md5('7:' || answer) AS h FROM (SELECT DISTINCT answer FROM r)),
g AS (SELECT answer, coalesce(lead(answer) OVER w, first_value(answer) OVER w) AS other FROM a WINDOW w AS (ORDER BY h, answer))
SELECT id, CASE WHEN c THEN other ELSE answer END AS answer, c AS corrupted FROM (SELECT id, answer, other, ('0x' || substr(md5('7:' || id), 1, 8))::BIGINT < 1288490188 AND other <> answer AS c FROM r JOIN g USING (answer))"""


@query("corrupt_labels", _CORRUPT)
def corrupt_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.col("quality").cast("string"), (F.col("doc_id") % 5).cast("string")).alias("answer"))
    return dataset.corrupted(rows, 0.3)


@query("budget_prefix", "WITH r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS k FROM labels) SELECT CAST(b AS INTEGER) AS budget, id FROM r, (VALUES (20), (50), (100)) v(b) WHERE k <= b")
def budget_prefix(spark, sf_dir):
    return dataset.budget_prefixes(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), [20, 50, 100])


@query(
    "mask_and_pad_tokens",
    """WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM documents), s AS (SELECT doc_id, ids[1:4] AS p, ids[5:] AS a FROM t)
SELECT doc_id, CASE WHEN len(p) >= 512 THEN 'prompt_too_long' WHEN len(p) + len(a) > 512 THEN 'total_too_long' END AS reject,
 CAST(len(p) + len(a) + greatest(512 - len(p) - len(a), 0) AS BIGINT) AS n, md5(array_to_string(list_transform(p, lambda x: -100) || a || list_transform(range(greatest(512 - len(p) - len(a), 0)), lambda x: -100), ',')) AS labels FROM s""",
)
def mask_and_pad_tokens(spark, sf_dir):
    ids = F.transform(F.split("text", " "), F.length)
    df = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    pair = dataset.masked_pair(F.slice("ids", 1, 4), F.slice("ids", F.lit(5), F.size("ids")), 512)
    return df.select("doc_id", pair.alias("r")).select("doc_id", F.col("r.reject").alias("reject"), F.size("r.input_ids").cast("bigint").alias("n"), F.md5(F.array_join(F.col("r.labels").cast("array<string>"), ",")).alias("labels"))


_BUDGETS = (25, 50, 100, 200)


@query(
    "experiment_budgets",
    f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality FROM labels), r AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || id), id) AS rank FROM l)
SELECT 'budget-' || b AS step, CAST(b AS INTEGER) AS budget, count(*) AS n, round(avg(quality), 6) AS share, round(abs(avg(quality) - (SELECT avg(quality) FROM l)), 6) AS error
FROM r, (VALUES {', '.join(f'({b})' for b in _BUDGETS)}) v(b) WHERE rank <= b GROUP BY b""",
)
def experiment_budgets(spark, sf_dir):
    """How near samples of growing size come to the share of good documents: a step for each size, each step's result kept."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")

    def step(budget: int):
        sample = dataset.budget_prefixes(rows, [budget]).join(rows, "id")
        whole = rows.agg(F.avg("quality").alias("whole"))  # one row
        found = sample.groupBy("budget").agg(F.count("*").alias("n"), F.avg("quality").alias("share")).join(F.broadcast(whole))
        return found.select("budget", "n", F.round("share", 6).alias("share"), F.round(F.abs(F.col("share") - F.col("whole")), 6).alias("error"))

    return experiments.run_steps(spark, staging.shared_path(spark, "experiment"), [(f"budget-{b}", lambda b=b: step(b)) for b in _BUDGETS])
