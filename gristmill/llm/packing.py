"""Best-fit packing of tokenised documents into sequences of fixed size.

Documents become ids and an end id; longer ones are cut into pieces. How many pieces of each length there are is a
histogram of at most `capacity` rows, whatever the corpus. Over it a configuration linear program is solved: columns are
multisets of lengths that fit into one sequence, found by a knapsack dynamic program under prices that multiplicative
weights keep for each length class. The program's solution is rounded to whole sequences, solved again for what is left,
and the rest goes best-fit-decreasing (in bulk, by histogram) into the gaps and into new sequences; sequences that
rounding left with wide gaps, and short pieces, are taken apart for that where it needs fewer in all. Every length
enters the program, and it is solved for every histogram, however small. The plan's size follows the histogram, not the
corpus; each piece then finds its place by its rank among the pieces of its length.

Defined results: null and empty texts are the end id alone; repeated rows are packed each for itself; an empty table
gives no pieces; other columns of the input are left alone.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gristmill.llm.common import BoundedCache, map_batches, materialise, text_bytes

CAPACITY = 2048
END_ID = 0
#: Entries of each generation of a worker's token cache.
CACHE = 250_000
#: Bytes of text whose distinct chunks are looked up together, and ids that are put in place together.
RUN_BYTES, RUN_IDS = 8_000_000, 1_000_000


class Encoder:
    """Token ids of texts, from white-space separated chunks and their parts through a bounded cache.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its chunks in order.
    Chunks of plain Latin letters, digits and signs are cut by the tokenizer's own rule and meet its model directly;
    any other chunk goes through the whole tokenizer. Texts are encoded many at a time: each of their distinct chunks is
    looked at once, and the ids are put in their places by numpy.
    """

    _PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
    _ALL_PLAIN = re.compile(r"[\n!-~À-ÖØ-öø-ÿ]*")
    _PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+|\n")

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        # The byte alphabet of byte-level BPE; printable bytes stand for themselves, others follow from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in shown else next(rest)) for b in range(256)}
        self.parts = BoundedCache(self._part, CACHE)

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
        ids = [] if part == "\n" else [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and how many each has. A line feed, which no chunk has, parts them."""
        text = b"\n".join([*chunks, b""]).decode("utf-8", "replace")
        other = {}
        if not self._ALL_PLAIN.fullmatch(text) or "<|" in text:
            words = text.split("\n")[:-1]
            other = {k: w for k, w in enumerate(words) if not self._PLAIN.fullmatch(w) or "<|" in w}
            text = "\n".join(["" if k in other else w for k, w in enumerate(words)] + [""])
        self.parts.turn()
        found = self._PARTS.findall(text.lower())
        ids = list(map(self.parts.__getitem__, found))
        ends = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
        upto = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)[ends]
        flat = np.frombuffer(b"".join(ids), "<u4")
        if not other:
            return flat, np.diff(upto, prepend=0)
        own = np.split(flat, upto[:-1])
        for k, w in other.items():
            own[k] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4")
        return np.concatenate(own), np.array([len(x) for x in own], np.int64)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (UTF-8 bytes) and the end id."""
        large = pa.types.is_large_binary(texts.type)
        split = pc.ascii_split_whitespace(texts.view(pa.large_string() if large else pa.string()))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.view(pa.large_binary() if large else pa.binary()).to_pylist()
        flat, counts = self._chunks(chunks)
        flat, counts = np.append(flat, np.uint32(END_ID)), np.append(counts, 1)  # the end id is one chunk more
        starts = np.cumsum(counts) - counts
        last = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False), last, len(chunks))
        last += np.arange(1, len(last) + 1)
        bounds = np.concatenate([[0], np.cumsum(counts[codes])[last - 1]])
        first, of_chunks = 0, np.concatenate([[0], last])
        while first < len(texts):  # texts of about RUN_IDS ids together
            to = max(first + 1, int(np.searchsorted(bounds, bounds[first] + RUN_IDS, "right")) - 1)
            block = codes[of_chunks[first] : of_chunks[to]]
            each = counts[block]
            ids = flat[np.repeat(starts[block] - np.cumsum(each) + each, each) + np.arange(each.sum())]
            yield from np.split(ids, bounds[first + 1 : to] - bounds[first])
            first = to

    def encode(self, text: bytes) -> bytes:
        """Ids of one text as bytes of little-endian 32-bit numbers, without the end id."""
        return next(self.encode_all(pa.array([text], pa.binary())))[:-1].tobytes()


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of all batches again, in tables of about RUN_BYTES of body; a longer body stands alone."""
    held, size = [], 0
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(upto):
            before = upto[at - 1] if at else 0
            to = int(np.searchsorted(upto, before + RUN_BYTES - size, "right"))
            if to == at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(upto[to - 1] - before)
                at = to
            if at < len(upto):
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_encoders: dict[str, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """One encoder for each Python worker."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    with open(tokenizer_file, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # one tokenizer file
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        for rows in runs_of(batches):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            texts = rows.column("body").combine_chunks()
            for k, data in enumerate(encoder.encode_all(texts)):
                for p, at in enumerate(range(0, len(data), capacity)):
                    part = data[at : at + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            doc_ids = rows.column("doc_id").combine_chunks()
            cols = [doc_ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_batches(docs.select("doc_id", text_bytes().alias("body")), run, schema)


# -- the plan, over a histogram


def length_classes(histogram: dict[int, int], n_classes: int) -> list[list[int]]:
    """Lengths in ascending order, cut into classes that hold about as many tokens each (linear grouping)."""
    total, out, held = sum(s * n for s, n in histogram.items()), [], 0
    for s in sorted(histogram):
        if not out or held >= total / n_classes:
            out.append([])
            held = 0
        out[-1].append(s)
        held += s * histogram[s]
    return out


def best_configuration(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[tuple[int, int], ...]:
    """The multiset of classes of most worth that fits into room: a knapsack, class by class over all fillings at once.

    A class may be taken any number of times: it is offered once, twice, four times, ... as far as the room goes.
    """
    worth, offers, taken = np.zeros(room + 1), [], []
    for k in range(len(sizes)):
        left, n = room // int(sizes[k]), 1
        while left > 0:
            n = min(n, left)
            width = n * int(sizes[k])
            tried = worth[: room + 1 - width] + n * prices[k]
            better = tried > worth[width:] + 1e-12
            worth[width:][better] = tried[better]
            offers.append((k, n, width))
            taken.append(better)
            left -= n
            n *= 2
    found, c = defaultdict(int), room
    for (k, n, width), better in zip(reversed(offers), reversed(taken), strict=True):
        if c >= width and better[c - width]:
            found[k] += n
            c -= width
    return tuple(sorted(found.items()))


def configuration_program(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int) -> dict[tuple, float]:
    """Fractional configurations that cover the demand: multiplicative weights over classes, knapsack pricing.

    Each round answers the present prices with the best configuration and uses as much of it as covers a small part of
    the scarcest of its classes; prices of classes fall exponentially with the share of their demand that is covered.
    """
    covered, used = np.zeros(len(sizes)), defaultdict(float)
    rate = np.log(max(2, len(sizes))) * 2
    for _ in range(rounds):
        prices = np.exp(-rate * (covered - covered.min())) / demand  # a piece of a class in small demand counts for more of it
        config = best_configuration(sizes, prices / prices.max(), room)
        if not config:
            break
        kinds, times = np.array([k for k, _ in config]), np.array([n for _, n in config])
        step = float((demand[kinds] / times).min()) * 0.1
        covered[kinds] += step * times / demand[kinds]
        used[config] += step
        if covered.min() >= 1:
            break
    scale = max(1.0, covered.max())
    return {c: x / scale for c, x in used.items()}


def plan(histogram: dict[int, int], capacity: int = CAPACITY, n_classes: int = 128, rounds: int = 600, solves: int = 4) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(number of sequences, ((length, pieces of it), ...)) with exactly the pieces of the histogram.

    n_classes, rounds and solves bound the linear programs; they are the same for every corpus. Whole multiples of the
    program's configurations are used; once all are below one, each is used once as far as pieces are left for it.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("a piece has to have 1 to capacity tokens")
    done: list[tuple[int, tuple[int, ...]]] = [(left.pop(capacity), (capacity,))] if capacity in left else []
    stages = []  # what stands and what is left after each solve
    for _ in range(solves):
        if not left:
            break
        classes = length_classes(left, n_classes)
        sizes = np.array([max(c) for c in classes])
        demand = np.array([sum(left[s] for s in c) for c in classes], float)
        solved = sorted(configuration_program(sizes, demand, capacity, rounds).items(), key=lambda i: (-i[1], i[0]))
        whole = any(x >= 1 for _, x in solved)
        for config, x in solved:
            *slots, last = [k for k, n in config for _ in range(n)][::-1]
            need = {k: slots.count(k) for k in set(slots)}
            m = min(int(x) if whole else 1, *(sum(left.get(s, 0) for s in classes[k]) // n for k, n in need.items()), *([sum(left.get(s, 0) for s in classes[last])] if not slots else []))
            if m > 0:
                done += _topped(_filled([classes[k] for k in slots], m, left) if slots else [(m, ())], left, capacity)
        left = {s: n for s, n in left.items() if n > 0}
        stages.append((list(done), dict(left)))
    # Best fit for the rest. Sequences that rounding left with a gap, late solves and short pieces are taken apart again for
    # it, as far as that needs fewer sequences in all.
    best, least = None, -(-sum(s * n for s, n in histogram.items()) // capacity)
    for held, free in reversed(stages or [(done, left)]):
        for short in (0, *(capacity >> k for k in (7, 5, 3, 2, 1))):
            for gap in (capacity, capacity >> 3, capacity >> 6, 0):
                runs = _best_fit(*_kept(held, free, capacity, gap, short), capacity)
                if best is None or sum(n for n, _ in runs) < sum(n for n, _ in best):
                    best = runs
                if sum(n for n, _ in best) == least:
                    break  # as few as the tokens allow
    return [(n, tuple(sorted({s: c.count(s) for s in c}.items(), reverse=True))) for n, c in best]


def _kept(done: list[tuple[int, tuple[int, ...]]], left: dict[int, int], capacity: int, gap: int, short: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """The sequences whose gap is at most `gap`, without pieces below `short`, and with those left the pieces of all others."""
    kept, free = [], dict(left)
    for n, content in done:
        stay = content if capacity - sum(content) <= gap else ()
        if short and stay:
            stay = tuple(s for s in content if s >= short)
        if stay:
            kept.append((n, stay))
        for s in content if not stay else (s for s in content if s < short):
            free[s] = free.get(s, 0) + n
    return kept, free


def _filled(slots: list[list[int]], m: int, left: dict[int, int]) -> list[tuple[int, tuple[int, ...]]]:
    """m sequences whose slots take the largest lengths left of each slot's class, in runs of like sequences."""
    runs = []
    for lengths in slots:
        run, n = [], m
        for s in reversed(lengths):
            got = min(n, left.get(s, 0))
            if got:
                left[s] -= got
                n -= got
                run.append([s, got])
        runs.append(run)
    out, at = [], [0] * len(runs)
    while m > 0:
        n = min(r[a][1] for r, a in zip(runs, at, strict=True))
        out.append((n, tuple(r[a][0] for r, a in zip(runs, at, strict=True))))
        m -= n
        for k, r in enumerate(runs):
            r[at[k]][1] -= n
            at[k] += r[at[k]][1] == 0 and at[k] + 1 < len(r)
    return out


def _topped(runs: list[tuple[int, tuple[int, ...]]], left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Each sequence's last slot takes the largest length left that fits: what rounding to classes wastes is used here."""
    out, lengths = [], sorted(s for s, n in left.items() if n > 0)
    for n, content in runs:
        gap = capacity - sum(content)
        while n:
            k = bisect_right(lengths, gap) - 1
            if k < 0:
                out.append((n, content))
                break
            s = lengths[k]
            m = min(n, left[s])
            if m:
                out.append((m, (*content, s)))
                left[s] -= m
                n -= m
            if not left[s]:
                lengths.pop(k)
    return out


def _best_fit(filled: list[tuple[int, tuple[int, ...]]], left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit decreasing in bulk: like pieces go into like gaps together."""
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for n, content in filled:
        gaps[capacity - sum(content)].append((n, content))
    for s in sorted(left, reverse=True):
        n = left[s]
        for gap in sorted(g for g in gaps if g >= s):
            while n and gaps[gap]:
                m, content = gaps[gap].pop()
                each = min(gap // s, n)  # pieces for each of these sequences
                full = min(m, n // each)
                n -= full * each
                if full:
                    gaps[gap - each * s].append((full, content + (s,) * each))
                if m > full:
                    gaps[gap].append((m - full, content))
            if not n:
                break
        each = capacity // s
        if n >= each:
            gaps[capacity - each * s].append((n // each, (s,) * each))
        if n % each:
            gaps[capacity - n % each * s].append((1, (s,) * (n % each)))
    return [x for gap in sorted(gaps) for x in gaps[gap]]


def _places(planned: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[str, np.ndarray]:
    """Runs of ranks within a length: where each run's pieces stand."""
    rows, given, first = [], defaultdict(int), 0
    for n, content in planned:
        offset = 0
        for s, each in content:
            rows.append((s, given[s], first, each, offset))
            given[s] += n * each
            offset += s * each
        first += n
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": a[:, 0] << 44 | a[:, 1], "rank": a[:, 1], "first": a[:, 2], "each": a[:, 3], "offset": a[:, 4]}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of pieces() with sequence_id and offset. cut is read more than once: it should be a written table."""
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    sent = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))  # bounded by the histogram
    salts = max(8, sum(histogram.values()) // 100_000)  # a length that a third of all pieces have is ranked in so many groups
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    group = Window.partitionBy("length", "__salt")
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = sizes.select("length", "__salt", (F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    ranked = salted.withColumn("__in", F.row_number().over(group.orderBy("doc_id", "piece", "ids_crc32")) - 1).join(before, ["length", "__salt"]).withColumn("__rank", F.col("__in") + F.col("__before"))
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            k = np.searchsorted(at["key"], length << 44 | rank, "right") - 1
            within = rank - at["rank"][k]
            places = at["first"][k] + within // at["each"][k], at["offset"][k] + within % at["each"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, places)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_batches(ranked.select(*names, "__rank"), run, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(materialise(pieces(docs, tokenizer_file, capacity), "pieces"), capacity)
