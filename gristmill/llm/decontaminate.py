"""Benchmark decontamination: one Aho-Corasick automaton over the normalised questions and answers of a benchmark.

Normalising lower-cases A-Z and keeps words of ASCII letters, digits and non-ASCII characters. A window is 13
consecutive words of an item, or a shorter item whole. Every window of a longer item holds one of its blocks, 7 words that
begin at a multiple of 7; the automaton holds those and the short items, so it has about as many nodes as the benchmark
has letters. Each text is scanned once; from a block that is found, what the text and the item have in common is
followed to both sides, and a run of 13 words or more is just what windows hit. Hits are mapped to words and, where spans
are asked for, to character offsets of the original text.

A benchmark is an evaluation set and so small. Its bytes are summed before any of it is read: beyond MAX_BENCHMARK_BYTES
the operators refuse it with ValueError, since each worker holds its automaton, of up to 50 bytes for each byte of it.

Defined results: null or empty text has no words, no hits and is clean; items without words have no window; items with a
null id are not listed but their windows count; repeated documents are judged each by itself; repeated items count once.
An empty benchmark hits nothing. Columns of the inputs other than those named are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ALNUM_TABLE, map_batches, text_bytes

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
HIT_SHARE = 20
#: Words of a block: each WINDOW of words holds a whole one that begins at a multiple of BLOCK.
BLOCK = (WINDOW + 1) // 2
#: Bytes of benchmark text that are taken at most.
MAX_BENCHMARK_BYTES = 8 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of UTF-8 text."""
    return text.translate(ALNUM_TABLE).split()


class Matcher:
    """The automaton; a pattern is ' w1 w2 ... ', so that it begins and ends at words."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        held: dict[str, tuple[int, dict[int, list[int]]]] = {}
        self.ids, self.words, self.short = [], [], []
        known: dict[bytes, bytes] = {}
        for item, text in items:
            words = [known.setdefault(w, w) for w in words_of(text)]
            if not words:
                continue
            short = len(words) <= WINDOW
            for k in (0,) if short else range(0, len(words) - BLOCK + 1, BLOCK):
                part = words if short else words[k : k + BLOCK]
                held.setdefault(" " + b" ".join(part).decode("latin-1") + " ", (len(part), {}))[1].setdefault(len(self.ids), []).append(k)
            self.ids.append(item)
            self.words.append(words)
            self.short.append(short)
        self.automaton = ahocorasick.Automaton()
        for pattern, (n, places) in held.items():
            self.automaton.add_word(pattern, (len(pattern), n, places))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def _run(self, words: list[bytes], at: int, item: int, k: int) -> tuple[int, int]:
        """Words (start, end) that a text has in common with an item, around a block at word `at` of the one and k of the other."""
        own = self.words[item]
        start, end, j = at, at + BLOCK, k + BLOCK
        while start > 0 and k > 0 and words[start - 1] == own[k - 1]:
            start, k = start - 1, k - 1
        while end < len(words) and j < len(own) and words[end] == own[j]:
            end, j = end + 1, j + 1
        return start, end

    def scan(self, words: list[bytes]) -> list[tuple[int, int, str | None]]:
        """(first word, end, item id) of runs of words that windows hit."""
        if self.empty or not words:
            return []
        text = f" {b' '.join(words).decode('latin-1')} "  # one character for each byte
        found = list(self.automaton.iter(text))
        if not found:
            return []
        spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        starts = np.searchsorted(spaces, [end - size + 1 for end, (size, _, _) in found])
        # followed: the end of the last run on a diagonal of an item; covered: words in a row, the last ones found, that an item's runs cover.
        out, followed, covered, total = [], {}, {}, len(words)
        for s, (_, (_, n, places)) in sorted(zip(starts.tolist(), found, strict=True), key=lambda x: x[0]):
            for item, ks in places.items():
                if self.short[item]:
                    out.append((s, s + n, self.ids[item]))
                    continue
                own = len(self.words[item])
                left, right = covered.get(item, (1, 0))
                # A run reaches no further than the item does on its diagonal: within what is covered it adds nothing.
                if left <= max(0, s - ks[-1]) and min(total, s + own - ks[0]) <= right:
                    continue
                for k in ks:
                    if left <= max(0, s - k) and min(total, s + own - k) <= right or followed.get((item, s - k), -1) > s:
                        continue
                    start, end = self._run(words, s, item, k)
                    followed[item, s - k] = end
                    if end - start >= WINDOW:
                        out.append((start, end, self.ids[item]))
                        left, right = (min(left, start), max(right, end)) if start <= right and left <= end else (start, end)
                        covered[item] = left, right
        return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets (start, end) of each word in the original text."""
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


_matchers: dict[str, Matcher] = {}


def _matcher_of(key: str, items: list) -> Matcher:
    """The automaton is built once in each Python worker."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items)
    return _matchers[key]


def judge(text: bytes, matcher: Matcher) -> tuple[int, np.ndarray | None, set]:
    """Number of words, which of them are hit (None: none), ids of the items found."""
    words, hit, items = words_of(text), None, set()
    for start, end, item in matcher.scan(words):
        if hit is None:
            hit = np.zeros(len(words), bool)
        hit[start:end] = True
        items.add(item)
    return len(words), hit, items


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and HIT_SHARE * n_hit >= n_words


def load_items(benchmark: DataFrame) -> tuple[str, list[tuple[str | None, bytes]]]:
    """The benchmark's distinct items and a key for them; ValueError beyond MAX_BENCHMARK_BYTES, before they are read."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), text_bytes().alias("body")).distinct()
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text, more than {MAX_BENCHMARK_BYTES}: judge it in parts")
    held = sorted(((r.id, bytes(r.body)) for r in items.collect()), key=lambda x: (x[0] is None, x))  # of the size just summed
    return hashlib.sha256(repr(held).encode()).hexdigest(), held


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and RESULT for every document."""
    key, items = load_items(benchmark)
    sent = docs.sparkSession.sparkContext.broadcast(items)  # of MAX_BENCHMARK_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher_of(key, sent.value)
        for batch in batches:
            rows = []
            for body in batch.column("body"):
                n, hit, met = judge(body.as_py(), matcher)
                n_hit, ids = 0 if hit is None else int(hit.sum()), sorted(x for x in met if x is not None)
                rows.append((n, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), is_contaminated(n, n_hit)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    source = docs.select("doc_id", text_bytes().alias("body"))
    return map_batches(source, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def hit_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, start, end: runs of hit words as character offsets of the original text, end exclusive."""
    key, items = load_items(benchmark)
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher_of(key, sent.value)
        for batch in batches:
            ids, starts, ends = [], [], []
            for k, body in enumerate(batch.column("body")):
                _, hit, _ = judge(body.as_py(), matcher)
                if hit is None:
                    continue
                spans = word_spans(body.as_py().decode("utf-8", "surrogateescape"))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    ids.append(k)
                    starts.append(spans[a][0])
                    ends.append(spans[b - 1][1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start", "end"])

    source = docs.select("doc_id", text_bytes().alias("body"))
    return map_batches(source, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, end long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns, in one pass and without a shuffle."""
    key, items = load_items(benchmark)
    sent = docs.sparkSession.sparkContext.broadcast(items)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher_of(key, sent.value)
        for batch in batches:
            keep = []
            for text in batch.column(at):
                n, hit, _ = judge((text.as_py() or "").encode(), matcher)
                keep.append(hit is None or not is_contaminated(n, int(hit.sum())))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)
