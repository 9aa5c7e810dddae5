"""Chat formatting in budgeted windows, in DataFrame functions only.

Turns of a conversation stand in the order of turn (null first), then role and text. Prefix sums of their tokens choose
the windows: they are runs of whole turns that, with the conversation's system turn and repeated history, hold at most
BUDGET tokens. Every window begins with the system turn and, but for the first, repeats the turns that start at most
HISTORY tokens before its own first one. Repeated turns are marked and masked; of the others, the loss mask has the texts of
assistants. So each assistant text is under the mask once.

Prefix sums are taken in two steps, within ranges of the sorted turns and over the ranges' sums, so that a conversation that
holds a large share of all turns is many tasks' work. By its prefix sum a turn belongs to a chunk of CHUNK tokens, and a
chunk, which is of bounded size, is cut into windows from its first turn on; only a chunk's last window may hold much less
than the budget allows.

Tokens are counted by a native pattern (see tokens_of), as no tokenizer runs in DataFrame functions; the count is a parameter.
Markers begin with '<|'. In roles and texts '&', '<' and '[' become '&amp;', '&lt;' and '&#91;', so no text holds a
marker, a '</s>' or an '[INST]', and reading turns them back.

Defined results: null text and role are empty; a null conversation id is a conversation; a conversation of one turn is
one window; a turn that doesn't fit beside system turn and history stands alone in a window without history, whole, so
that window alone may exceed the budget; a system turn is a first turn of that role, and one of more than a quarter
of the budget is a turn like any other, not repeated; repeated rows are turns each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import materialise

#: Tokens of a window, and how many of them may repeat earlier turns.
BUDGET, HISTORY = 2048, 256
#: Tokens counted for a turn's markers.
OVERHEAD = 4
#: Tokens of a chunk, in budgets.
CHUNK = 8
# The template.
TURN, AGAIN, TEXT, END = "<|turn|>", "<|again|>", "<|text|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def tokens_of(text: Column) -> Column:
    """About as many tokens as byte-pair vocabularies of 50,000 give: up to three letters, a digit or a sign each, other characters by their bytes."""
    return F.regexp_count(text, F.lit(r"[A-Za-z]{1,3}|[0-9]|[!-/:-@\[-`{-~]")) + F.octet_length(text) - F.length(F.regexp_replace(text, r"[^\x00-\x7F]+", ""))


def _prefixed(turns: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    """conv_id, role, text, tokens, nth (from 1) and before (tokens of the turns before it) of every turn."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    t = t.select("conv_id", "role", "text", (count(F.col("text")) + OVERHEAD).cast("long").alias("tokens"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"))
    t = materialise(t, "turns")
    sums = t.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("s"))
    over = Window.partitionBy("conv_id").orderBy("part")  # a conversation's ranges: as many as there are partitions at most
    sums = sums.select(F.col("conv_id").alias("id"), F.col("part").alias("p"), (F.sum("n").over(over) - F.col("n")).alias("n0"), (F.sum("s").over(over) - F.col("s")).alias("s0"))
    within = Window.partitionBy("conv_id", "part").orderBy("pos")
    t = t.withColumn("nth", F.row_number().over(within)).withColumn("before", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    t = t.join(sums, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("part") == F.col("p")))
    return t.select("conv_id", "role", "text", "tokens", (F.col("nth") + F.col("n0")).alias("nth"), (F.col("before") + F.col("s0")).alias("before"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[Column], Column] = tokens_of) -> DataFrame:
    """conv_id, window, text, loss (start and length of each masked-in span, in characters of text) and tokens.

    Windows of a conversation are numbered in their order, with gaps.
    """
    width = CHUNK * budget
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    t = materialise(_prefixed(turns, count).withColumn("chunk", F.floor(F.col("before") / width).cast("long")), "prefixed")
    system = (F.col("nth") == 1) & (F.col("role") == "system") & (F.col("tokens") <= budget // 4)

    def turn(kind: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), "nth", "before", "tokens", "role", "text").alias("m")

    own = t.filter(~system).select("conv_id", "chunk", turn(2))
    ahead = t.filter(~system & (F.col("before") >= (F.col("chunk") + 1) * width - history)).select("conv_id", F.col("chunk") + 1, turn(1))
    chunks = t.groupBy(F.col("conv_id").alias("id")).agg(F.max("chunk").alias("last"))
    heads = t.filter(system).join(chunks, F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk"), turn(0))  # a row of each conversation at most
    # A chunk has the turns of its tokens, of HISTORY tokens before, one that goes on beyond it, and the system turn.
    met = own.union(ahead).union(heads).groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("m")).alias("ms"))

    def of(kind: int) -> Column:
        return F.filter("ms", lambda m: m["kind"] == kind)

    met = met.select("conv_id", "chunk", F.get(of(0), F.lit(0)).alias("sys"), of(1).alias("ahead"), of(2).alias("own"))
    met = met.withColumn("room", F.lit(budget - history) - F.coalesce("sys.tokens", F.lit(0)))
    none = F.array().cast("array<bigint>")
    begun = F.aggregate("own", none, lambda a, m: F.when((F.size(a) == 0) | (m["before"] + m["tokens"] - F.element_at(a, -1) > F.col("room")), F.array_append(a, m["before"])).otherwise(a))
    alone = (F.size("own") == 0) & F.col("sys").isNotNull() & (F.col("chunk") == 0)  # a conversation that is its system turn
    met = met.withColumn("starts", F.when(alone, F.array(F.lit(0).cast("long"))).otherwise(begun))

    def window(s: Column, i: Column) -> Column:
        new = F.filter("own", lambda m: (m["before"] >= s) & (m["before"] < F.coalesce(F.get("starts", i + 1), F.lit(1 << 62))))
        back = F.filter(F.concat("ahead", "own"), lambda m: (m["before"] >= s - history) & (m["before"] < s))
        fits = F.coalesce(F.get(new, F.lit(0))["tokens"] <= F.col("room"), F.lit(True))
        return F.struct((F.col("chunk") * (1 << 20) + i).alias("window"), ((F.col("chunk") > 0) | (i > 0)).alias("later"), F.when(fits, back).otherwise(F.slice(back, 1, 0)).alias("back"), new.alias("new"))

    w = met.select("conv_id", "sys", F.explode(F.transform("starts", window)).alias("w"))

    def piece(m: Column, again: Column) -> Column:
        head = F.concat(F.when(again, F.lit(AGAIN)).otherwise(F.lit(TURN)), escaped(m["role"]), F.lit(TEXT))
        return F.struct(head.alias("head"), escaped(m["text"]).alias("body"), (~again & (m["role"] == "assistant")).alias("learnt"), m["tokens"].alias("tokens"))

    first = F.when(F.col("sys").isNotNull(), F.array(piece(F.col("sys"), F.col("w.later"))))
    pieces = F.concat(F.coalesce(first, F.slice(F.transform("w.new", lambda m: piece(m, F.lit(False))), 1, 0)), F.transform("w.back", lambda m: piece(m, F.lit(True))), F.transform("w.new", lambda m: piece(m, F.lit(False))))
    w = w.select("conv_id", "w.window", pieces.alias("pieces"))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["learnt"], F.array_append(a["spans"], F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return w.select("conv_id", "window", text.alias("text"), spans.alias("loss"), F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("tokens"))


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text, repeated ones left out) and loss_text, from what was formatted."""
    marked = F.filter(F.split("text", r"<\|end\|>"), lambda x: F.startswith(x, F.lit(TURN)))
    turns = F.transform(marked, lambda x: F.struct(unescaped(F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), TEXT, 1)).alias("role"), unescaped(F.substring_index(x, TEXT, -1)).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "")
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_text"), F.length("text").cast("long").alias("formatted_chars"))


def digests(windows: DataFrame) -> DataFrame:
    """What the formatted windows of each conversation say, read back: the contract's digests over whole conversations."""
    read = read_windows(windows)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select("conv_id", F.struct("window", F.size("turns").cast("long").alias("n"), line.alias("said"), F.col("loss_text").alias("loss")).alias("w"), "formatted_chars")
    # A digest is over the whole conversation, so its windows meet here, and only here.
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sum("w.n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("ws", lambda w: w["loss"]), "")
    out = whole.select("conv_id", "n_turns", F.array_join(F.transform("ws", lambda w: w["said"]), "").alias("said"), loss.alias("loss"), "formatted_chars")
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
