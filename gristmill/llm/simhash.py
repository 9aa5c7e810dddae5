"""SimHash near-duplicate detection with bit-sliced comparison.

A fingerprint is taken over XXH64 (seed 42) of 3-word shingles of the whole text. Equal fingerprints are one from the
start. Fingerprints within `RADIUS` bits are found exactly: of k blocks of bits, at least k - RADIUS are equal, so each
choice of k - RADIUS blocks is a table and its value a bucket. Inside a bucket, fingerprints stand vertically: 64 of them
make a block of 64 words, one for each bit plane. A query is held against a whole block at once by exclusive or with
each plane; carry-save counters of two bits and an overflow count the differing bits of all 64 lanes together, and a
block is left as soon as every lane is beyond the radius. Buckets of more than BUCKET fingerprints are cut into parts,
and each pair of parts is a task of its own. A task returns a spanning forest of what it found, never all pairs.

Defined results: a text without words has fingerprint zero and is linked like any other; repeated rows share a
component; a row with null doc_id is a row of the result but names no component; other columns are left alone; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import map_batches, materialise, spread_join, text_bytes
from gristmill.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a bucket that one task compares at most twice over; larger buckets are cut.
BUCKET = 4096
#: Lanes and pairs handled at once within a task.
CHUNK = 32_768
#: Rows gathered before a task's buckets are compared together.
BUFFER = 65_536

_PLANES = np.arange(64, dtype=np.uint64)
_BYTE = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of the word shingles of UTF-8 text, A-Z lower-cased; bytes methods touch ASCII alone."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it. Bits are summed by byte lanes, 255 rows at a time."""
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros((8, 8), np.int64)  # shift, byte
    for at in range(0, n, 255 * 64):
        part = hashes[at : at + 255 * 64]
        pad = -len(part) % 255
        block = np.concatenate((part, np.zeros(pad, np.uint64))).reshape(-1, 255) if pad else part.reshape(-1, 255)
        for k in range(8):
            lanes = ((block >> np.uint64(k)) & _BYTE).sum(axis=1, dtype=np.uint64)
            counts[k] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = 2 * counts > n
    return sum(1 << (8 * byte + k) for k in range(8) for byte in range(8) if bits[k, byte])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(x.as_py())) for x in batch.column("body")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", text_bytes().alias("body")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


# -- comparison within a task


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """(blocks, 64) words: word j of a block has bit j of its 64 lanes; lanes is (blocks, 64)."""
    bits = (lanes[:, :, None] >> _PLANES) & np.uint64(1)  # block, lane, plane
    return (bits << _PLANES[None, :, None]).sum(axis=1, dtype=np.uint64)


def near_lanes(queries: np.ndarray, planes: np.ndarray, block: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """For each query and the block it is held against, the lanes within RADIUS bits, as a word of 64 lanes."""
    out = np.zeros(len(queries), np.uint64)
    live = np.arange(len(queries))
    ones, twos, over = (np.zeros(len(queries), np.uint64) for _ in range(3))
    over |= ~valid[block]
    q, at = queries, block
    for j in range(64):
        differ = planes[at, j] ^ (np.uint64(0) - ((q >> np.uint64(j)) & np.uint64(1)))
        carry = ones & differ
        ones ^= differ
        over |= twos & carry  # four differing bits or more
        twos ^= carry
        if j % 8 == 7:
            keep = ~over != 0
            if not keep.all():
                live, q, at, ones, twos, over = (x[keep] for x in (live, q, at, ones, twos, over))
                if not len(live):
                    return out
    out[live] = ~over
    return out


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; label[x] is the least index of x's component."""
    a, b = label[a], label[b]
    while len(a):
        far = a != b
        a, b = a[far], b[far]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        a, b = label[low], label[high]


def forest(fp: np.ndarray, group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, fingerprint) that join what is near within each group. Rows of a group stand together.

    side: 0 compares a row with all of its group; 1 and 2 are the two parts of a cut bucket, compared across only.
    """
    n = len(fp)
    u = fp.view(np.uint64)
    order = np.lexsort((side, group))
    u, group, side = u[order], group[order], side[order]
    # Blocks of 64 lanes, each of rows of one group; of cut buckets, part 2 stands in lanes and part 1 asks.
    lane_rows = np.flatnonzero(side != 1)
    new = np.concatenate(([True], group[lane_rows][1:] != group[lane_rows][:-1])) if len(lane_rows) else np.empty(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(lane_rows)])))
    n_blocks = -(-size // 64)
    base = np.concatenate(([0], np.cumsum(n_blocks)))
    which = np.repeat(np.arange(len(first)), size)
    within = np.arange(len(lane_rows)) - first[which]
    lanes, valid = np.zeros((int(base[-1]), 64), np.uint64), np.zeros((int(base[-1]), 64), bool)
    row_at = np.zeros((int(base[-1]), 64), np.int64)
    at = (base[which] + within // 64, within % 64)
    lanes[at], valid[at], row_at[at] = u[lane_rows], True, lane_rows
    planes = np.concatenate([planes_of(lanes[k : k + 512]) for k in range(0, len(lanes), 512)]) if len(lanes) else np.zeros((0, 64), np.uint64)
    good = (valid.astype(np.uint64) << _PLANES).sum(axis=1, dtype=np.uint64)
    # Each asking row meets every block of its group.
    ask = np.flatnonzero(side != 2)
    place = np.searchsorted(group[lane_rows][first], group[ask]) if len(first) else np.zeros(len(ask), np.int64)
    place = np.minimum(place, max(0, len(first) - 1))
    ask, place = (x[group[lane_rows][first][place] == group[ask]] if len(first) else x[:0] for x in (ask, place))
    times = n_blocks[place] if len(first) else np.zeros(0, np.int64)
    label = np.arange(n)
    ends = np.cumsum(times)
    k = 0
    while k < len(ask):
        m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CHUNK, "right")))
        rows = np.repeat(ask[k:m], times[k:m])
        start = ends[k:m] - times[k:m]
        block = base[place[k:m]].repeat(times[k:m]) + np.arange(len(rows)) - np.repeat(start - start[0], times[k:m])
        near = near_lanes(u[rows], planes, block, good)
        hit = np.flatnonzero(near)
        for c in range(0, len(hit), CHUNK):
            h = hit[c : c + CHUNK]
            t, lane = np.nonzero((near[h][:, None] >> _PLANES) & np.uint64(1))
            hook(label, rows[h][t], row_at[block[h][t], lane])
        k = m
    far = np.flatnonzero(label != np.arange(n))
    signed = u.view(np.int64)
    return signed[far], signed[label[far]]


def _tables(n: int) -> list[tuple[int, ...]]:
    """Masks of the pigeonhole tables: more and narrower blocks as fingerprints grow in number; each choice is exact."""
    k = RADIUS + (1 if n <= 1 << 22 else 2 if n <= 1 << 31 else 3)
    edges = [round(64 * i / k) for i in range(k + 1)]
    blocks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(k)]
    return [sum(c) for c in combinations(blocks, k - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join distinct fingerprints (column fp) within RADIUS bits; enough for their components."""
    total = distinct.count()
    masks = _tables(total)
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("t", "key")).select("fp", F.struct("t", "key").alias("bucket"))
    parts = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / BUCKET))
    here = F.pmod(F.xxhash64("fp"), F.col("parts"))
    met = spread_join(keyed, parts, "bucket", "n", total * len(masks)).withColumn("here", here).select("bucket.t", "bucket.key", "fp", "here", F.explode(F.expr("sequence(0L, parts - 1)")).alias("other"))
    tasks = met.select("t", "key", F.least("here", "other").alias("i"), F.greatest("here", "other").alias("j"), F.when(F.col("here") == F.col("other"), 0).when(F.col("here") < F.col("other"), 1).otherwise(2).cast("int").alias("side"), "fp")
    dealt = tasks.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compared(rows: np.ndarray) -> pa.RecordBatch:
            change = np.concatenate(([0], np.cumsum((rows[1:, :4] != rows[:-1, :4]).any(axis=1))))
            a, b = forest(np.ascontiguousarray(rows[:, 5]), change, rows[:, 4])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            if sum(map(len, held)) >= BUFFER:
                rows = np.concatenate(held)
                cut = int(np.flatnonzero(np.concatenate(([True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1))))[-1])  # the last group may go on
                held = [rows[cut:]]
                if cut:
                    yield compared(rows[:cut])
        rows = np.concatenate(held) if held else np.empty((0, 6), np.int64)
        if len(rows):
            yield compared(rows)

    return map_batches(dealt, run, "a long, b long")


def _rooted(own: DataFrame) -> DataFrame:
    """fp, n (rows with it), first (the struct column of own that is least among them) and root of its component.

    own is a written table.
    """
    distinct = materialise(own.groupBy("fp").agg(F.count("*").alias("n"), F.min("first").alias("first")), "distinct")
    roots = components(near_links(distinct.select("fp")))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every document."""
    own = materialise(fingerprints(docs), "fingerprints")
    rooted = materialise(_rooted(own.select("fp", F.col("doc_id").alias("first"))), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_fp"))
    classes = spread_join(rooted.select("root", "fp", "n"), least, "root", "n_fp", rooted.count()).select("fp", "n", "component_id")
    return spread_join(own, classes, "fp", "n", own.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprints(docs: DataFrame, text: str) -> DataFrame:
    """docs and, as column fp, the fingerprint of each row's column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(text).cast(pa.binary())
            fps = np.array([fingerprint(shingle_hashes(x.as_py() or b"")) for x in bodies], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*batch.schema.names, "fp"])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns, whatever their names: the one of least id, null last; of equal ids any one.

    Rows get a number of their own when they are written with their fingerprints, so ids may repeat or be null. The
    numbers of the rows that go are a table of one column, whose known size tells the planner whether it is broadcast
    or texts have to be shuffled.
    """
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = _with_fingerprints(docs.toDF(*names.values()), names["text"])
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(names["doc_id"]).isNull().alias("none"), F.col(names["doc_id"]).alias("id"), "row").alias("first")
    stay = _rooted(rows.select("fp", order)).groupBy("root").agg(F.min("first")["row"].alias("row"))
    go = materialise(rows.select("row").join(stay, "row", "left_anti"), "go")
    return rows.join(go, "row", "left_anti").select(*names.values()).toDF(*names)
