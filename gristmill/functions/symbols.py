"""Symbol rules: the search over arithmetic candidates and the deletion-substitution rule."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType



def _text(x: Column) -> Column:
    return x.cast("string")


def _rev(x: Column) -> Column:
    return F.reverse(_text(x))


def _rev_int(x: Column) -> Column:
    return _rev(x).cast("long")


def _floor_div(x: Column, y: Column) -> Column:
    return F.when(y != 0, F.floor(x / y).cast("long"))


def _mod(x: Column, y: Column) -> Column:
    return F.when(y != 0, F.pmod(x, y))


_OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}


def catalogue(a: Column, b: Column) -> list[tuple[str, Column]]:
    """(name, text of the result) of each rule for non-negative whole operands, in the order in which they are tried.

    The order is a fixed value: it decides between rules that explain the same examples.
    """
    basic = [("a+b", a + b), ("a-b", a - b), ("b-a", b - a), ("a*b", a * b)]
    ra, rb = _rev_int(a), _rev_int(b)
    turned = [("rev(a)+rev(b)", ra + rb), ("rev(a)-rev(b)", ra - rb), ("rev(b)-rev(a)", rb - ra), ("rev(a)*rev(b)", ra * rb)]
    rules = [(n, _text(x)) for n, x in basic[:3]] + [("|a-b|", _text(F.abs(a - b)))]
    rules += [("a//b", _text(_floor_div(a, b))), ("b//a", _text(_floor_div(b, a))), ("a%b", _text(_mod(a, b))), ("b%a", _text(_mod(b, a)))]
    rules += [("a*b", _text(a * b))] + [(n, _text(x)) for n, x in turned]
    rules += [("rev(a//b)", _rev(_floor_div(a, b))), ("rev(b//a)", _rev(_floor_div(b, a)))]
    for shifts, family in (((1, -1, 2, -2), basic), ((1, -1), turned)):
        for n, x in family:
            rules += [(f"rev({n})", _rev(x))] + [(f"{n}{k:+d}", _text(x + k)) for k in shifts]
    tens, ones = (F.floor(a / 10).cast("long"), F.floor(b / 10).cast("long")), (a % 10, b % 10)
    rules += [(f"d1{p}e1|d2{q}e2", F.concat(_text(_OPERATIONS[p](*tens)), _text(_OPERATIONS[q](*ones)))) for p, q in product("+-*", repeat=2)]
    ab, ba = F.concat(_text(a), _text(b)), F.concat(_text(b), _text(a))
    return rules + [("str(a)+str(b)", ab), ("str(b)+str(a)", ba), ("rev(str(a)+str(b))", F.reverse(ab)), ("rev(str(b)+str(a))", F.reverse(ba))]


def results(a: Column, b: Column) -> Column:
    """The results of all rules, as array<string> in order; null where a rule is not defined."""
    return F.array(*(x for _, x in catalogue(a, b)))


def rule_name(at: Column) -> Column:
    """The name of the rule at a place of the catalogue."""
    names = [n for n, _ in catalogue(F.lit(1).cast("long"), F.lit(1).cast("long"))]
    return F.get(F.array(*map(F.lit, names)), at)


# The names of the older, smaller set of candidates.
OLDER = ("a+b", "a-b", "b-a", "a*b", "str(a)+str(b)", "str(b)+str(a)", "|a-b|", "a//b", "a%b", "b//a", "b%a", "rev(a)+rev(b)", "rev(rev(a)+rev(b))", "rev(a)-rev(b)", "rev(b)-rev(a)", "|rev(a)-rev(b)|", "rev(a)rev(b)", "rev(b)rev(a)")


def older_results(a: Column, b: Column) -> Column:
    """The results of the older candidates, in the order of OLDER."""
    ra, rb = _rev_int(a), _rev_int(b)
    named = dict(catalogue(a, b))
    named |= {"|rev(a)-rev(b)|": _text(F.abs(ra - rb)), "rev(a)rev(b)": F.concat(_text(ra), _text(rb)), "rev(b)rev(a)": F.concat(_text(rb), _text(ra))}
    return F.array(*(named[n] for n in OLDER))


def deletion_answer(pairs: Column, query: Column) -> Column:
    """The query under the first set of deleted positions whose other letters follow one substitution in all examples and
    cover the query's; null if there is none (R13, J10).

    Sets are tried in the order of their positions; a deleted letter is mapped to nothing. All left sides and the query have
    to be of one length. Examples that lose another number of letters than most count for nothing. The search is a walk that
    ends with the first set, so it runs in a function of Python over batches; null pairs cost nothing there.
    """
    # Said to be non-deterministic, so that the optimizer leaves it in a projection of its own, never in a lambda function.
    return _walked.asNondeterministic()(pairs, query)


@F.pandas_udf(StringType())
def _walked(pairs: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or q is None else deletion(list(p), q) for p, q in zip(pairs, query)], dtype=object)


def modal_deletion(pairs: list[dict]) -> int:
    """The most frequent loss of length; of equals, the one seen first."""
    return Counter(len(p["inp"]) - len(p["out"]) for p in pairs).most_common(1)[0][0]


def deletion(pairs: list[dict], query: str) -> str | None:
    """deletion_answer() of one row."""
    n, lost = len(query), modal_deletion(pairs) if pairs else -1
    if not 0 <= lost < n or any(len(p["inp"]) != n for p in pairs):
        return None
    used = [p for p in pairs if len(p["inp"]) - len(p["out"]) == lost]
    return first_deletion([p["inp"] for p in used], [p["out"] for p in used], query)


#: States that a walk remembers as dead ends at most; beyond them it may walk into one again.
_DEAD_ENDS = 50_000


def first_deletion(lefts: list[str], rights: list[str], query: str) -> str | None:
    """The answer of deletion_answer() for left sides and a query of one length and right sides that lack equally many letters.

    Positions that share a letter in any example are deleted together or not at all, so the walk, from left to right and
    deleting before keeping, decides class by class, and only where the sizes of the classes to come can still add up to
    what is to be deleted. Every letter of the examples gets a meaning, so a class with a query letter that none of
    them has is deleted. A state that has failed, as far as later positions can tell states apart, is not entered again.
    """
    n, d = len(query), len(lefts[0]) - len(rights[0])
    columns = [[a[i] for a in lefts] for i in range(n)]
    first: dict[str, int] = {}
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, column in enumerate(columns):
        for c in column:
            x, y = find(i), find(first.setdefault(c, i))
            root[max(x, y)] = min(x, y)
    kind = [find(i) for i in range(n)]
    size = {c: kind.count(c) for c in set(kind)}
    decided: dict[int, bool] = {kind[i]: True for i, c in enumerate(query) if c not in first}
    total = sum(size[c] for c in decided)
    sums, after = 1, {}  # bit s: some of the open classes from here on have s positions in all
    for c in sorted(set(size) - set(decided), reverse=True):
        after[c] = sums
        sums |= sums << size[c]
    if total > d or not sums >> d - total & 1:
        return None
    later = [sorted({c for column in columns[i:] for c in column}) for i in range(n)]
    meaning: dict[str, str] = {}
    dead: set = set()

    def options(i: int) -> list[bool]:
        c = kind[i]
        if c in decided:
            return [decided[c]]
        return [x for x in (True, False) if total + x * size[c] <= d and after[c] >> d - total - x * size[c] & 1]

    def state(i: int, k: int) -> tuple:
        return (i, k, *[meaning.get(c) for c in later[i]])

    # A frame is a position: what is left to try, how many are deleted before, its state, the letters and class it has settled.
    frames = [[iter(options(0)), 0, state(0, 0), [], None]]
    while frames:
        i = len(frames) - 1
        left, k, at, new, own = frames[-1]
        for c in new:
            del meaning[c]
        new.clear()
        if own is not None:
            total -= decided.pop(own) * size[own]
            frames[-1][4] = None
        gone = next(left, None)
        if gone is None:
            frames.pop()
            if len(dead) < _DEAD_ENDS:
                dead.add(at)
            continue
        if kind[i] not in decided:
            decided[kind[i]], frames[-1][4] = gone, kind[i]
            total += gone * size[kind[i]]
        fits = gone or i - k < n - d
        for c, out in zip(columns[i], rights) if fits else ():
            to = "" if gone else out[i - k]
            if c not in meaning:
                meaning[c] = to
                new.append(c)
            elif meaning[c] != to:
                fits = False
                break
        if not fits:
            continue
        if i + 1 == n:
            return "".join(meaning[c] for i, c in enumerate(query) if not decided[kind[i]])
        following = state(i + 1, k + gone)
        if following not in dead:
            frames.append([iter(options(i + 1)), k + gone, following, [], None])
    return None
