"""Mixing sources to target weights along a curriculum, in which a source's weight changes with training's progress.

Each source has a schedule, its weight at points of progress 0 to 1, linear between them. Its integral is the source's
weight as a whole, by which sources share the mix's words; none gives more than CAP times its own words, and what it would
have given beyond that is shared by the others, until none is above. The part of the integral reached at a progress, times
the source's target, is its cumulative demand there. Documents of a source stand in an order of their hashes; word by word
they meet its demand, each for once before any for a second time, and a copy's middle word is met at the progress at which
that demand is reached: the integral is inverted. Sorted by progress, the copies are the training order, and the prefix sum
of their words is each one's position.

Targets are met to the word: the copy in which a source's demand ends is taken up to there, so at most one copy a source is
taken in part. What is chosen, and the order, depend on the rows and SEED alone.

Sources are a table, never a list on the driver: their order is a range sort, and the level to which all fill up is found
by a few sums over them. A source of any share of the documents is many ranges.

Defined results: null texts have no words; documents without words are taken never; a null source is a source, the last; a
source without words has target 0; repeated rows are documents each, as are rows of one doc_id; rows that agree in source,
doc_id and size are alike, so which of them is taken makes no difference; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import SPACE, materialise
from gristmill.llm.ranges import ordered, with_key

#: (progress, weight) at two points or more, the first at 0 and the last at 1.
Schedule = Sequence[tuple[float, float]]

#: Words of the mix for each word of the documents, and times that a source may be repeated.
SHARE, CAP = 1.5, 2
SEED = "gristmill"
#: The contract's weights 5, 2 and 1 as integrals: broad sources recede, others hold, rare ones come in late.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))


def segments(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(start, weight there, slope, integral before, integral after) of each linear part."""
    if len(schedule) < 2 or schedule[0][0] != 0 or schedule[-1][0] != 1 or any(w < 0 for _, w in schedule):
        raise ValueError("a schedule leads from progress 0 to 1 with weights of 0 or more")
    out, area = [], 0.0
    for (t, w), (u, v) in zip(schedule, schedule[1:]):
        if u <= t:
            raise ValueError("the points of a schedule ascend")
        after = area + (w + v) / 2 * (u - t)
        out.append((t, w, (v - w) / (u - t), area, after))
        area = after
    if area <= 0:
        raise ValueError("a schedule has a weight above 0 somewhere")
    return out


def integral(schedule: Schedule) -> float:
    """The weight of a schedule as a whole."""
    return segments(schedule)[-1][-1]


def inverted(schedule: Schedule, part: Column) -> Column:
    """The progress at which this part of the schedule's integral is reached."""
    parts = segments(schedule)
    need = part * F.lit(parts[-1][-1])
    out = None
    for start, weight, slope, before, after in reversed(parts):
        left = F.greatest(need - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2 * slope) * left, F.lit(0.0)))
        here = F.when(F.lit(weight) + root > 0, F.lit(start) + F.lit(2.0) * left / (F.lit(weight) + root)).otherwise(F.lit(start))
        out = here if out is None else F.when(need < F.lit(after), here).otherwise(out)
    return out


def _levelled(sources: DataFrame, total: float, cap: int) -> float:
    """What a weight of 1 gets so that the sources' targets sum to total: each round keeps those at their cap, and ends when none joins them.

    A round is one sum over the table of sources, and the level only rises; a round that adds no source is the last.
    """
    level, most = 0.0, F.col("source_size") * F.lit(cap)
    while True:
        full = F.lit(level) * F.col("weight") > most
        held, weight = sources.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).head()
        if not weight:
            return level
        new = (total - held) / weight
        if not new > level:
            return level
        level = new


def plan(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row for each document: row, doc_id, source, size, source_size, target, taken and copies (start in its source's demand, words, progress).

    Schedules are dealt to the sources in their order, from the first again after the last.
    """
    if not 0 < share <= cap or cap != int(cap):
        raise ValueError("the share is above 0 and at most the cap, a whole number")
    weights = [integral(s) for s in schedules]
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))  # null last
    sized = docs.select(key.alias("key"), "source", "doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACE.replace("[", "[^") + "+")).cast("long").alias("size"))
    # Written once: texts are read once, and the row number tells equal rows apart in the range sort.
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    sources = ordered(sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), ["key"], "sources")
    kind = F.pmod("at", F.lit(len(schedules))).cast("int")
    sources = materialise(sources.select("key", "source_size", "n", kind.alias("kind"), F.element_at(F.array(*map(F.lit, weights)), kind + 1).alias("weight")), "weighed")
    words, rows = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).head()
    level = _levelled(sources, share * words, cap)
    sources = sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), (F.col("source_size") * F.lit(cap)).cast("double")))
    sources = sources.withColumn("quota", F.floor(F.col("target") + F.lit(0.5)).cast("long"))

    drawn = sized.withColumn("draw", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    placed = ordered(drawn, ["key", "draw", "doc_id", "size", "row"], "drawn", "size")
    first = placed.groupBy("key").agg(F.min("before").alias("base"))
    met = with_key(placed, sources.join(first, "key"), "key", "n", rows)
    begin = F.col("before") - F.col("base")

    def copy(k: int) -> Column:
        start = begin + F.lit(k) * F.col("source_size")
        length = F.greatest(F.least(F.col("quota") - start, F.col("size")), F.lit(0).cast("long"))
        part = (start.cast("double") + length.cast("double") / F.lit(2.0)) / F.greatest(F.col("quota"), F.lit(1).cast("long")).cast("double")
        at = None
        for i, s in reversed(list(enumerate(schedules))):
            at = inverted(s, part) if at is None else F.when(F.col("kind") == i, inverted(s, part)).otherwise(at)
        return F.struct(start.alias("start"), length.alias("words"), at.alias("progress"))

    copies = F.filter(F.array(*[copy(k) for k in range(int(cap))]), lambda c: c["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return met.select("row", "doc_id", "source", "key", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", taken)


def curriculum(planned: DataFrame) -> DataFrame:
    """The copies in training order: row, doc_id, source, words (of the document's first ones), progress and position, the mix's words before it."""
    copies = planned.select("row", "doc_id", "source", "key", F.inline("copies"))
    return ordered(copies, ["progress", "key", "start", "row"], "curriculum", "words").withColumnRenamed("before", "position").drop("at", "key", "start")


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, and first_position, where the mix has it first; read back from the curriculum."""
    planned = materialise(plan(docs, **options), "plan")
    read = curriculum(planned).groupBy(F.col("row").alias("of")).agg(F.sum("words").alias("taken"), F.min("position").alias("first_position"))
    joined = planned.drop("taken").join(read, F.col("row") == F.col("of"), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_position")
