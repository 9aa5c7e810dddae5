"""Training sets: sampling, verification, assembly, tokens."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.classify import UNMATCHED
from gristmill.functions.scoring import extract_answer, is_correct
from gristmill.operators.joins import spread_join
from gristmill.operators.profile import require_columns
from gristmill.operators.rules import SOLVERS, solve_all
from gristmill.operators.staging import write_observed

# Fixed value: what is added to a prompt before a model sees it.
PROMPT_SUFFIX = "\nPlease put your final answer inside `\\boxed{}`. For example: `\\boxed{your answer}`"
IGNORED = -100


def model_prompt(prompt: Column) -> Column:
    return F.concat(prompt, F.lit(PROMPT_SUFFIX))


def trace(status: Column, steps: Column, predicted: Column) -> Column:
    """The steps of a derivation and its boxed answer; without a derivation it says so and claims none."""
    derived = F.concat(steps, F.lit("\nThe final answer is: \\boxed{"), predicted, F.lit("}"))
    return F.when(status.startswith("derived"), derived).otherwise(F.concat(F.lit("No rule was derived ("), status, F.lit(").")))


def ends_boxed(text: Column, answer: Column) -> Column:
    """Whether a trace ends with the boxed answer (P20)."""
    return F.coalesce(F.endswith(text, F.concat(F.lit("\\boxed{"), answer, F.lit("}"))), F.lit(False))


def assembled(puzzles: DataFrame) -> DataFrame:
    """id, family, status, how, prompt, trace, extracted_answer, gold_answer for every puzzle.

    A derived trace that does not end with its boxed answer is an error, not a record.
    """
    df = solve_all(puzzles).withColumn("trace", trace(F.col("status"), F.col("steps"), F.col("predicted")))
    derived = F.col("status").startswith("derived")
    broken = F.concat(F.lit("the trace of "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(" doesn't end with its boxed answer"))
    df = df.withColumn("trace", F.when(~derived | ends_boxed(F.col("trace"), F.col("predicted")), F.col("trace")).otherwise(F.raise_error(broken)))
    return df.select("id", "family", "status", "how", "prompt", "trace", F.when(derived, extract_answer(F.col("trace"))).alias("extracted_answer"), F.col("answer").alias("gold_answer"))


def self_check(records: DataFrame) -> DataFrame:
    """The records whose extracted answer isn't the gold one."""
    return records.filter(_failed())


def _failed() -> Column:
    return ~is_correct(F.col("gold_answer"), F.coalesce("extracted_answer", F.lit("NOT_FOUND")))


def write_checked(records: DataFrame, path: str, max_share: float = 0.0) -> int:
    """Write records as JSON lines if no more than max_share fail the check; else ValueError, and what was at path stays.

    Records are evaluated once: they are counted, and some that fail are named, while they are written (A20).
    """
    counts = {"n": F.count("*"), "bad": F.count_if(_failed()), "least": F.min(F.when(_failed(), F.col("id"))), "most": F.max(F.when(_failed(), F.col("id")))}

    def check(r: dict) -> None:
        if r["bad"] > max_share * r["n"]:
            raise ValueError(f"{r['bad']} of {r['n']} records fail the check, such as {r['least']}" + f" and {r['most']}" * (r["least"] != r["most"]))

    return write_observed(records, path, "json", counts, check)["n"]


def status_counts(records: DataFrame) -> DataFrame:
    """(family, status, n), and a row with n = 0 for each family without records."""
    counts = records.groupBy("family", "status").agg(F.count("*").alias("n"))
    every = records.sparkSession.range(1).select(F.explode(F.array(*(F.lit(f) for f in (*SOLVERS, UNMATCHED)))).alias("family"))
    absent = every.join(counts.select("family").distinct(), "family", "left_anti").select("family", F.lit("none").alias("status"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(absent)


def match_rates(records: DataFrame) -> DataFrame:
    """One row: n, the shares of records with a family, with a rule, and with a rule that gives the gold answer."""

    def share(of: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(F.count_if(of), F.count("*")), 6), F.lit(0.0))

    return records.agg(F.count("*").alias("n"), share(F.col("family") != UNMATCHED).alias("matched"), share(F.col("status").startswith("derived")).alias("derived"), share(F.col("status") == "derived_match").alias("right"))


def check_skips(pairs: DataFrame, max_share: float = 0.2) -> float:
    """The share of token pairs with a reject reason; ValueError above max_share (A19), or if there is none to train on."""
    r = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("pair.reject").isNotNull()).alias("skipped")).first()
    if r.n and r.skipped == r.n:
        raise ValueError(f"all of {r.n} records are skipped")
    if r.skipped > max_share * r.n:
        raise ValueError(f"{r.skipped} of {r.n} records are skipped, more than {100 * max_share:g} %")
    return r.skipped / r.n if r.n else 0.0


def replicated(rows: DataFrame, k: int) -> DataFrame:
    """Each row k times, with sample_ix 0 to k-1."""
    return rows.withColumn("sample_ix", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def generated(rows: DataFrame, generate: Callable[[list[str]], list[str]] | None = None, batch: int = 8, set_up: Callable[[], Callable[[list[str]], list[str]]] | None = None) -> DataFrame:
    """rows with completion: generate() gets batches of prompts (T6). set_up, in its place, makes it, once for each task.

    A task's prompts fill batches of the size given whatever the Arrow batches they come in; only a task's last one may be
    smaller. ValueError in the task if generate() gives another number of completions than it got prompts.
    """
    if (generate is None) == (set_up is None):
        raise ValueError("give either generate or set_up")

    @F.pandas_udf("string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = generate or set_up()
        # Series that wait for their last rows' batch, with how many rows each still has to get; answers not yet handed out.
        waiting: deque[int] = deque()
        asked: list[str] = []
        answers: list[str] = []

        def answer() -> None:
            out = list(call(asked))
            if len(out) != len(asked):
                raise ValueError(f"{len(out)} completions of {len(asked)} prompts")
            answers.extend(out)
            asked.clear()

        def ready() -> Iterator[pd.Series]:
            while waiting and waiting[0] <= len(answers):
                n = waiting.popleft()
                yield pd.Series(answers[:n], dtype="object")
                del answers[:n]

        for part in prompts:
            waiting.append(len(part))
            for p in part:
                asked.append(p)
                if len(asked) == batch:
                    answer()
            yield from ready()
        if asked:
            answer()
        yield from ready()

    return rows.withColumn("completion", run(model_prompt(F.col("prompt"))))


def accepted(completions: DataFrame) -> DataFrame:
    """completions (id, answer, completion) whose extracted answer is right, with extracted_answer."""
    require_columns(completions, "id", "answer", "completion")
    return completions.withColumn("extracted_answer", extract_answer(F.col("completion"))).filter(is_correct(F.col("answer"), F.col("extracted_answer")))


def acceptance(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, n_accepted) for every row, zeros too."""
    n = kept.groupBy("id").agg(F.count("*").alias("n_accepted"))
    return rows.select("id").distinct().join(n, "id", "left").select("id", F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"))


def capped_union(sources: list[DataFrame], cap: int, position: str = "pos") -> DataFrame:
    """All rows of the sources in order, the first `cap` of them (U1, W6). Each source has its own positions."""
    out = None
    for k, s in enumerate(sources):
        one = s.withColumn("source_ix", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("source_ix", position).limit(cap)


def _following(answers: DataFrame) -> DataFrame:
    """(answer, other): distinct answers, each with the next one in the order of h and, of the last, the first.

    The order is cut into 256 ranges of h, each a task; the least answer of each range, 256 rows at most, says where the
    range before it goes on.
    """
    ranges = answers.withColumn("range", F.substring("h", 1, 2))
    within = Window.partitionBy("range").orderBy("h", "answer")
    firsts = ranges.groupBy("range").agg(F.min(F.struct("h", "answer"))["answer"].alias("first"))
    order = Window.orderBy("range")  # 256 rows at most
    onward = firsts.select("range", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("onward"))
    return ranges.withColumn("next", F.lead("answer").over(within)).join(F.broadcast(onward), "range").select("answer", F.coalesce("next", "onward").alias("other"))


def corrupted(rows: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    """rows with answer replaced, at the rate given, by the answer of another row that differs.

    The next different answer in the order of a hash is taken; rows whose answers are all equal or null stay as they are.
    """
    names = rows.columns
    counts = rows.filter("answer is not null").groupBy("answer").agg(F.count("*").alias("n")).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "answer")))
    ring = _following(counts.select("answer", "h")).join(counts.select("answer", "n"), "answer")
    hit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") < int(rate * (1 << 32))
    out = spread_join(rows.filter("answer is not null"), ring, "answer", "n", rows.count()).withColumn("corrupted", F.coalesce(hit, F.lit(False)) & (F.col("other") != F.col("answer")))
    out = out.withColumn("answer", F.when(F.col("corrupted"), F.col("other")).otherwise(F.col("answer"))).select(*names, "corrupted")
    return out.unionByName(rows.filter("answer is null").withColumn("corrupted", F.lit(False)))


def budget_prefixes(rows: DataFrame, budgets: list[int], seed: int = 7) -> DataFrame:
    """(budget, id): nested samples of so many rows."""
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), F.col("id")]
    top = rows.select("id", order[0].alias("h")).orderBy(*order).limit(max(budgets))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("h", "id")))  # the largest budget's rows at most
    return ranked.select(F.explode(F.filter(F.array(*map(F.lit, sorted(budgets))), lambda b: F.col("rank") <= b)).alias("budget"), "id")


def masked_pair(prompt_ids: Column, answer_ids: Column, max_length: int) -> Column:
    """struct<input_ids, labels, attention_mask, reject>: the prompt masked, padded on the right."""
    n, total = F.size(prompt_ids), F.size(prompt_ids) + F.size(answer_ids)
    reject = F.when(n >= max_length, "prompt_too_long").when(total > max_length, "total_too_long")
    pad = F.greatest(F.lit(max_length) - total, F.lit(0))
    return F.struct(
        F.concat(prompt_ids, answer_ids, F.array_repeat(F.lit(0), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(IGNORED), n), answer_ids, F.array_repeat(F.lit(IGNORED), pad)).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), total), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
        reject.alias("reject"),
    )
