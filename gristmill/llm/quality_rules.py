"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base statistics of the whole text fail a document outright. Beyond them, rules compare ratios with cutoffs. Cutoffs of
all rules together form one ladder of levels, fixed beforehand and stricter from level to level; a document's level is
the first at which some rule rejects it. For each stratum (language), the level in force is chosen by test. The
hypothesis at a level is that the rules together reject more than ALPHA of the stratum's good documents; the labelled
good documents are the holdout (no cutoff is fitted to them), and the hypothesis falls if the exact binomial tail
P(Bin(n, ALPHA) <= rejected) is at most DELTA divided by the number of strata (Bonferroni). Levels are tested from the
most lenient on and the first that doesn't pass ends it (fixed sequence), so the levels need no further division. With
probability 1 - DELTA, no stratum loses more than ALPHA of its good documents to the rules. With four strata, 217 good
labels are enough; a stratum with fewer gets no level.

Defined results: a null or empty text has no words and fails the base; a null stratum is a stratum of its own; a ratio
equal to its cutoff is not rejected; repeated rows are judged each; labels with a null id or value are none, and a
document labelled good counts as often as it stands in the table; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import SPACE, labels_once, materialise

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: Good documents of a stratum that all rules together may reject, as a share, and the risk of being wrong.
ALPHA, DELTA = 0.02, 0.05
#: The ladder of cutoffs, lenient first: at a level, each rule rejects a document above its cutoff.
LEVELS: dict[str, tuple[float, ...]] = {
    "symbols": (0.50, 0.30, 0.20, 0.10, 0.05, 0.02),
    "dup_lines": (0.90, 0.70, 0.50, 0.30, 0.20, 0.10),
    "repeats": (0.28, 0.25, 0.20, 0.15, 0.10, 0.05),
    "capitals": (0.95, 0.90, 0.70, 0.50, 0.40, 0.30),
    "word_length": (30.0, 25.0, 20.0, 17.0, 15.0, 12.0),
}
N_LEVELS = 6


def _zipped(h: Column, n: Column, step: int) -> Column:
    """Hashes of windows twice as long: h[i] with h[i + step]."""
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The base statistics of each document, beside the columns in keep.

    Windows of 8 words are compared by 64-bit hashes built by doubling (2, 4, 8 words). Only a text in which some hash
    repeats has its windows sorted to find the words that they cover.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    d = docs.select(
        *keep,
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
        lines.alias("__lines"),
        F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, SPACE + "+"), lambda w: F.xxhash64(w))).alias("__h1"),
    )
    first = [*keep, "word_chars", "n_symbols", "n_capitals"]
    n = F.size("__h1")
    none = F.array().cast("array<bigint>")
    d = d.select(*first, n.cast("long").alias("n_words"), F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), "__h1")
    first += ["n_words", "n_lines", "n_dup_lines"]
    d = d.select(*first, F.when(n >= REPEAT_WINDOW, _zipped(F.col("__h1"), n - 1, 1)).otherwise(none).alias("__h"))
    d = d.select(*first, F.when(F.size("__h") > 0, _zipped(F.col("__h"), F.size("__h") - 2, 2)).otherwise(none).alias("__h"))
    d = d.select(*first, F.when(F.size("__h") > 0, _zipped(F.col("__h"), F.size("__h") - 4, 4)).otherwise(none).alias("__h"))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.select(*first, F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty).alias("__s"))
    s, m = F.col("__s"), F.size("__s")

    def twice(k: Column) -> Column:
        return ((k > 0) & (s[k]["h"] == F.get(s, k - 1)["h"])) | ((k < m - 1) & (s[k]["h"] == F.get(s, k + 1)["h"]))

    at = F.when(m > 0, F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), twice), lambda k: s[k]["i"]))).otherwise(F.array().cast("array<int>"))
    d = d.select(*first, at.alias("__at"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("__at", start, lambda a, i: F.struct((a["n"] + i + REPEAT_WINDOW - F.greatest(i, a["end"])).alias("n"), (i + REPEAT_WINDOW).alias("end")), lambda a: a["n"])
    return d.select(*first, covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """What each rule compares with its cutoff."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars"), "word_length": share("word_chars", "n_words")}


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k at most n * p, exactly: the last term in logarithms, the others by their ratio to it."""
    log_choose = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))
    last = log_choose + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.aggregate(
        F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("t")),
        lambda a, i: F.struct((a["sum"] + a["t"] * i / (n - i + 1) * ((1 - p) / p)).alias("sum"), (a["t"] * i / (n - i + 1) * ((1 - p) / p)).alias("t")),
        lambda a: a["sum"],
    )
    return F.exp(last) * terms


def level() -> Column:
    """The first level at which a rule rejects the document; N_LEVELS if none does."""
    out = F.lit(N_LEVELS)
    for k in reversed(range(N_LEVELS)):
        above = F.lit(False)
        for rule, value in ratios().items():
            above = above | (value > LEVELS[rule][k])
        out = F.when(above, k).otherwise(out)
    return out


def select_levels(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, in_force): the strictest level that passes, from (stratum, level) of labelled good documents.

    Strata without one are left out. Documents are counted first: what is tested has a row for each stratum and level.
    """
    counts = materialise(good.groupBy("stratum", "level").agg(F.count("*").alias("n")), "counts")
    strata = max(1, counts.select("stratum").distinct().count())
    by_level = counts.groupBy("stratum").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col("level") <= k, F.col("n"))), F.lit(0)).alias(f"k{k}") for k in range(N_LEVELS)))
    tried = by_level.select("stratum", "n", F.posexplode(F.array(*(f"k{k}" for k in range(N_LEVELS)))).alias("level", "k"))
    passes = F.when(F.col("k") > F.col("n") * alpha, F.lit(False)).otherwise(binomial_tail(F.col("n"), F.col("k"), alpha) <= delta / strata)
    in_order = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    held = tried.withColumn("held", F.min(passes).over(in_order)).filter("held")
    return held.groupBy("stratum").agg(F.max("level").alias("in_force"))


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The statistics, stratum and level, beside internal columns in keep; other columns of docs may have any names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "text")
    return statistics(rows, "stratum", *keep)


def _judged(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """measured, a written table, with base_failed and kept. Levels in force are a written table too: its known size tells the planner how to join it."""
    good = materialise(labels_once(labels, "quality").filter("y = 1").select("doc_id"), "good")
    levels = measured.withColumn("level", level())
    in_force = materialise(select_levels(levels.select("doc_id", "stratum", "level").join(good, "doc_id", "left_semi")), "levels")
    strict = F.col("level") <= F.coalesce("in_force", F.lit(-1))
    return levels.join(in_force, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~strict)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for every document."""
    measured = materialise(_measured(docs, "doc_id"), "statistics")
    return _judged(measured, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents kept, with all their columns.

    Each row is measured once and written beside its statistics; levels are chosen from the statistics alone, and each
    row is judged where it stands, so that no text is shuffled and rows with equal or no ids are judged each by itself.
    """
    measured = materialise(_measured(docs, "doc_id", "__row"), "statistics")
    return _judged(measured, labels).filter("kept").select("__row.*")
