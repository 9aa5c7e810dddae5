"""Text helpers with the white-space and line rules of Python strings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python counts as white space, as a Java character class.
PYWS = r"[\s\u0009-\u000D\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same characters as text, for trimming.
_WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(_WHITE))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def splitlines(c: Column) -> Column:
    """Lines at every line boundary that Python knows; a trailing boundary adds an empty line, which callers filter."""
    return F.split(c, _LINE_END, -1)


def last(items: Column) -> Column:
    """The last of an array, or null if it is empty."""
    return F.try_element_at(items, F.lit(-1))


def not_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def first_keyword(c: Column, table: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The name of the first entry one of whose keywords stands in the lower-cased text."""
    low, out = F.lower(c), F.lit(default)
    for name, words in reversed(table):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def first_prefix(c: Column, table: Sequence[tuple[str, str]], default: str) -> Column:
    """The name of the first entry with whose prefix the text begins."""
    out = F.lit(default)
    for prefix, name in reversed(table):
        out = F.when(F.startswith(c, F.lit(prefix)), name).otherwise(out)
    return out
