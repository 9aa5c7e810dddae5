"""Repair of the structure of conversations: the cheapest edits after which roles read `(s?(ua)+)?`.

The grammar has four states: nothing read yet, after a system, a user, an assistant turn; first and last accept. A turn is
kept (cost 0) or given the role that the state asks for, user or assistant (2); a blank or repeated one has to be deleted, any
other may be (3); an empty turn of the role asked for may be inserted anywhere (2); a truncated turn costs 1 more unless it is
deleted. From the last turn to the first, bitsets hold the states from which the rest can be accepted, one layer of four bits
for each cost; layers are packed in one integer, so each edit moves all layers at once, by a shift of its cost. The first
layer that has the beginning's bit gives the cost. The trace walks the layers: at each turn it takes the first of the edits, in the order of their
letters (Delete, Insert, Keep, Rerole), after which the rest can be accepted at the cost that is left. A state and a letter
determine the next state, so this is the ASCII-least of the cheapest audits.

Eight layers from the first that isn't empty are enough: what one state can accept at a cost, any other from which that end
can be reached accepts at up to 7 more (a system turn left out 3, two insertions 4).

Conversations are cut into pieces of at most PIECE turns. A piece's layers are found for each state at its end, which gives
its cost between any two states; a conversation's pieces, one row of 16 numbers each, are put together from the last to the
first; then each piece is traced from every state; and the states at the pieces' beginnings follow from the first to the last. So of a
conversation of any length a task holds one piece, or a few numbers of each piece.

Faults are counted by a turn's first: blank (no character but white space), duplicate (same role and text earlier in the
conversation), truncated (the last character that isn't white space is none of `.!?`).

Defined results: null role and null text are one space, so a turn of null text is blank; turns stand in the order of turn
(null first), then role and text; a null conversation id is a conversation; a role counts by its first character, and one that is neither s, u nor a can't be kept;
repeated rows are duplicates but for the first; a conversation without rows, or all of whose rows are deleted, is empty,
which the grammar accepts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from gristmill.llm.common import SPACE, materialise
from gristmill.llm.ranges import ordered

#: Turns of a piece at most.
PIECE = 1024
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Letters of roles by their code; any other role has code 3.
ROLES = "sua"
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Cost from each state to acceptance, and the insertions it takes.
END, TAILS = (0, 4, 2, 0), ("", "II", "I", "")

_LAYERS = 8
_MASK = (1 << 4 * _LAYERS) - 1
_ONE = int("1" * 32, 16)
#: The state after a user or assistant turn is asked for: from 0, 1 and 3 a user's (2), from 2 an assistant's (3).
_NEXT = (2, 2, 3, 2)
_INTS = ArrayType(IntegerType())


def _asked(word: int) -> int:
    """All layers at once: the states that get into these ones by the user or assistant turn that they ask for."""
    user, assistant = (word >> 2) & _ONE, (word >> 3) & _ONE
    return user | user << 1 | user << 3 | assistant << 2


def _kept(word: int, role: int) -> int:
    """The states that get into these ones by keeping a turn of this role."""
    if role == 0:
        return (word >> 1) & _ONE
    if role == 1:
        user = (word >> 2) & _ONE
        return user | user << 1 | user << 3
    return ((word >> 3) & _ONE) << 2 if role == 2 else 0


def _settled(word: int, base: int) -> tuple[int, int]:
    """With insertions before the turn, and without empty layers at the bottom; base is the lowest layer's cost."""
    for _ in range(2):  # from any state two insertions lead to user and assistant
        word |= _asked(word) << 4 * INSERT
    while word and not word & 15:
        word, base = word >> 4, base + 1
    return word & _MASK, base


def _layers(codes: str, after: Sequence[int]) -> list[tuple[int, int]]:
    """(layers, cost of the lowest) before each turn and at the end, from each state's cost after it (-1: it has none)."""
    base = min((c for c in after if c >= 0), default=0)
    word = sum(1 << 4 * (c - base) + q for q, c in enumerate(after) if 0 <= c < base + _LAYERS)
    out = [(word, base)]
    for code in reversed(codes):
        fault, role = divmod(int(code, 16), 4)
        word, base = out[-1]
        new = word << 4 * DELETE
        if fault in (NONE, CUT):
            extra = 4 * TRUNCATED * (fault == CUT)
            new |= _kept(word, role) << extra | _asked(word) << extra + 4 * REROLE
        out.append(_settled(new, base))
    return out[::-1]


def _cost(layers: tuple[int, int], state: int) -> int:
    word, base = layers
    at = (word >> state) & _ONE
    return -1 if not at else base + ((at & -at).bit_length() - 1) // 4


def _has(layers: tuple[int, int], state: int, cost: int) -> bool:
    word, base = layers
    return 0 <= cost - base < _LAYERS and bool(word >> 4 * (cost - base) + state & 1)


@lru_cache(100_000)
def between(codes: str) -> tuple[int, ...]:
    """The least cost of a piece from each state before it to each after it, -1 where there is none; not counting insertions at its end."""
    ends = [_layers(codes, [0 if p == q else -1 for p in range(4)])[0] for q in range(4)]
    return tuple(_cost(ends[q], p) for p in range(4) for q in range(4))


@lru_cache(100_000)
def traced(codes: str, after: tuple[int, ...], last: bool) -> tuple[tuple[str, str, int], ...]:
    """From each state before a piece: (letters, role letter after each edit or - , state after it) of the cheapest, ASCII-least edits."""
    layers = _layers(codes, after)
    out = []
    for state in range(4):
        cost, letters, roles, i = _cost(layers[0], state), [], [], 0
        while cost >= 0 and i < len(codes):
            fault, role = divmod(int(codes[i], 16), 4)
            may, extra = fault in (NONE, CUT), TRUNCATED * (fault == CUT)
            kept = {0: 1 if state == 0 else -1, 1: -1 if state == 2 else 2, 2: 3 if state == 2 else -1}.get(role, -1)
            # D, I, K, R: the letter, the state after it, its cost, whether the turn is used up.
            for letter, to, price, used in (("D", state, DELETE, 1), ("I", _NEXT[state], INSERT, 0), ("K", kept if may else -1, extra, 1), ("R", _NEXT[state] if may else -1, REROLE + extra, 1)):
                if to >= 0 and _has(layers[i + used], to, cost - price):
                    letters.append(letter)
                    roles.append("-" if letter == "D" else "-sua"[to])
                    state, cost, i = to, cost - price, i + used
                    break
            else:
                raise AssertionError("the layers lack the rest of a cheapest repair")
        if last and cost >= 0:
            for letter in TAILS[state]:
                state = _NEXT[state]
                letters.append(letter)
                roles.append("-sua"[state])
        out.append(("".join(letters), "".join(roles), state if cost >= 0 else -1))
    return tuple(out)


@F.pandas_udf(_INTS)
def _between(codes: pd.Series) -> pd.Series:
    return codes.map(lambda c: list(between(c)))


@F.pandas_udf(StructType().add("cost", LongType()).add("pieces", ArrayType(StructType().add("piece", LongType()).add("after", _INTS).add("last", BooleanType()))))
def _after(pieces: pd.Series) -> pd.DataFrame:
    """Each state's cost after each of a conversation's pieces, from the last to the first."""
    costs, rows = [], []
    for ps in pieces:
        after, out = list(END), []
        for k in range(len(ps) - 1, -1, -1):
            out.append({"piece": ps[k]["piece"], "after": after, "last": k == len(ps) - 1})
            m = ps[k]["m"]
            after = [min((m[4 * p + q] + after[q] for q in range(4) if m[4 * p + q] >= 0 and after[q] >= 0), default=-1) for p in range(4)]
        costs.append(after[0])
        rows.append(out)
    return pd.DataFrame({"cost": costs, "pieces": rows})


@F.pandas_udf(ArrayType(StructType().add("letters", StringType()).add("roles", StringType()).add("to", IntegerType())))
def _traced(codes: pd.Series, after: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("letters", "roles", "to"), x)) for x in traced(c, tuple(int(v) for v in a), bool(z))] for c, a, z in zip(codes, after, last)])


@F.pandas_udf(ArrayType(StructType().add("piece", LongType()).add("state", IntegerType())))
def _entered(pieces: pd.Series) -> pd.Series:
    """The state before each of a conversation's pieces, from the first to the last."""
    out = []
    for ps in pieces:
        state, row = 0, []
        for p in ps:
            row.append({"piece": p["piece"], "state": state})
            state = int(p["tos"][state])
        out.append(row)
    return pd.Series(out)


def _last_sign(text: Column) -> Column:
    return F.right(F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), F.lit(1))


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, at (the row's place among all, in the order of conversations) and fault of every turn."""
    t = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    t = materialise(t.withColumn("row", F.monotonically_increasing_id()), "turns")
    t = ordered(t, ["conv_id", "turn", "role", "text", "row"], "sorted").drop("row")
    # Equal turns are told by a digest of role and text; of each, the first is a row of this table, whatever their number.
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = t.groupBy("conv_id", said).agg(F.min("at").alias("first")).select("first")
    t = t.join(first, F.col("at") == F.col("first"), "left")
    blank = ~F.col("text").rlike("[^" + SPACE[1:])
    fault = F.when(blank, F.lit(BLANK)).when(F.col("first").isNull(), F.lit(DUPLICATE)).when(~_last_sign(F.col("text")).isin(".", "!", "?"), F.lit(CUT)).otherwise(F.lit(NONE))
    return t.withColumn("fault", fault).drop("first")


def _pieces(marked: DataFrame, piece: int) -> DataFrame:
    """conv_id, piece, start (at of its first turn) and codes, a hexadecimal digit for each turn (4 * fault + role)."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.lower(F.hex((F.col("fault") * 4 + role).cast("long")))
    # Rows of a conversation stand side by side, so a piece is what it has of a run of `piece` rows.
    rows = marked.select("conv_id", F.floor(F.col("at") / piece).cast("long").alias("piece"), F.struct("at", code.alias("c")).alias("x"))
    met = rows.groupBy("conv_id", "piece").agg(F.min("x.at").alias("start"), F.sort_array(F.collect_list("x")).alias("xs"))
    return met.select("conv_id", "piece", "start", F.array_join(F.transform("xs", lambda x: x["c"]), "").alias("codes"))


def repair(turns: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The edits, and a row for each conversation.

    Edits: conv_id, piece, nth (their order), edit (D, I, K or R), turn (null for an inserted one), role (after the edit) and text.
    Conversations: conv_id, blank, duplicate, truncated, illegal and cost.
    """
    marked = materialise(faults(turns), "marked")
    pieces = materialise(_pieces(marked, piece), "pieces")
    # A conversation's pieces meet here, 16 numbers of each, and below, 4 numbers of each.
    costs = pieces.select("conv_id", F.struct("piece", _between("codes").alias("m")).alias("p")).groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    costs = materialise(costs.select("conv_id", _after("ps").alias("a")), "costs")
    after = costs.select(F.col("conv_id").alias("id"), F.inline("a.pieces")).withColumnRenamed("piece", "of")
    same = F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("piece") == F.col("of"))
    walks = pieces.join(after, same).select("conv_id", "piece", "start", "codes", _traced("codes", "after", "last").alias("walks"))
    walks = materialise(walks, "walks")
    entered = walks.select("conv_id", F.struct("piece", F.transform("walks", lambda w: w["to"]).alias("tos")).alias("p")).groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    entered = entered.select(F.col("conv_id").alias("id"), F.inline(_entered("ps"))).withColumnRenamed("piece", "of")
    chosen = walks.join(entered, same).select("conv_id", "piece", "start", F.get("walks", F.col("state")).alias("w"))

    letters = F.split("w.letters", "")  # one element for each letter
    steps = F.filter(F.transform(letters, lambda c, i: F.struct(c.alias("edit"), F.substring("w.roles", i + 1, F.lit(1)).alias("to"), i.alias("nth"))), lambda s: s["edit"] != "")
    used = F.transform(steps, lambda s: F.struct(s["nth"], s["edit"], s["to"], (F.col("start") + s["nth"] - F.regexp_count(F.substring("w.letters", F.lit(1), s["nth"]), F.lit("I"))).alias("at")))
    edits = chosen.select("conv_id", "piece", F.inline(used))
    role = F.when(F.col("to") == "u", "user").when(F.col("to") == "a", "assistant")
    added = edits.filter("edit = 'I'").select("conv_id", "piece", "nth", "edit", F.lit(None).cast("long").alias("turn"), role.alias("role"), F.lit("").alias("text"))
    others = edits.filter("edit <> 'I'").drop("conv_id").join(marked.select("conv_id", "turn", "at", F.col("role").alias("was"), "text"), "at")
    others = others.select("conv_id", "piece", "nth", "edit", "turn", F.when(F.col("edit") == "R", role).otherwise(F.col("was")).alias("role"), "text")

    # Neighbours' role codes: within a piece, and where one piece follows another of its conversation.
    def illegal(a: Column, b: Column) -> Column:
        pair = F.concat((F.conv(a, 16, 10).cast("int") % 4).cast("string"), (F.conv(b, 16, 10).cast("int") % 4).cast("string"))
        return (~pair.isin("01", "12", "21")).cast("long")

    inner = F.aggregate(F.sequence(F.lit(1), F.length("codes")), F.lit(0).cast("long"), lambda n, i: n + F.when(i > 1, illegal(F.substring("codes", i - 1, F.lit(1)), F.substring("codes", i, F.lit(1)))).otherwise(F.lit(0).cast("long")))
    ends = pieces.select("conv_id", F.struct("piece", inner.alias("inner"), F.substring("codes", 1, 1).alias("first"), F.right("codes", F.lit(1)).alias("last"), *[(F.length("codes") - F.length(F.translate("codes", "0123456789abcdef"[4 * f : 4 * f + 4], ""))).cast("long").alias(n) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))]).alias("p"))
    ends = ends.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"), *[F.sum(f"p.{n}").alias(n) for n in ("blank", "duplicate", "truncated")])
    joints = F.aggregate("ps", F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("last")), lambda a, p: F.struct((a["n"] + p["inner"] + F.when(a["last"] == "", F.lit(0).cast("long")).otherwise(illegal(a["last"], p["first"]))).alias("n"), p["last"].alias("last")), lambda a: a["n"])
    counts = ends.select("conv_id", "blank", "duplicate", "truncated", joints.alias("illegal"))
    counts = counts.join(costs.select(F.col("conv_id").alias("id"), F.col("a.cost").alias("cost")), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    return added.unionByName(others), counts


def gaps(turns: DataFrame) -> DataFrame:
    """conv_id and gaps: turn numbers that are missing between a conversation's first and last."""
    # Distinct turns by two sums, so that a long conversation isn't one task's work.
    once = turns.filter(F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.lit(1))
    return once.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage, chosen by crc32 of conv_id:turn."""
    space = F.lit(" ")
    t = turns.select("conv_id", "turn", *[F.coalesce(c, space).alias(c) for c in ("role", "text")])
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    t = t.withColumn("kind", F.crc32(name.cast("binary")) % 20).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("again")).drop("again")


def digests(turns: DataFrame, repaired: tuple[DataFrame, DataFrame], all_ids: DataFrame) -> DataFrame:
    """The contract's row for each conversation of all_ids."""
    edits, counts = repaired
    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    # A digest is over the whole conversation, so its turns meet here, and only here.
    whole = edits.select("conv_id", F.struct("piece", "nth", "edit", line.alias("line")).alias("e")).groupBy("conv_id").agg(F.sort_array(F.collect_list("e")).alias("es"))
    whole = whole.select("conv_id", F.array_join(F.transform("es", lambda e: e["edit"]), "").alias("audit"), F.sha2(F.array_join(F.transform("es", lambda e: e["line"]), "\n"), 256).alias("repaired_sha256"))
    out = all_ids.select("conv_id").distinct()
    for k, part in enumerate((gaps(turns), counts, whole)):
        out = out.join(part.withColumnRenamed("conv_id", f"id{k}"), F.col("conv_id").eqNullSafe(F.col(f"id{k}")), "left").drop(f"id{k}")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
