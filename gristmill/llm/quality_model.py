"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

Words go to WORD_BUCKETS buckets with their share of the text as value; statistics of structure (symbols, capitals,
digits, repeated lines and words, lengths) go to buckets of their own, one for each statistic and step. The machine scores
w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the pairs are summed in linear time as half of the square of the sum
less the sum of squares, factor by factor.

Fitting takes at most 2 * SAMPLE labelled documents, whole, to the driver. Scoring takes every document.

Defined results: null and empty texts have statistics but no words and a score like any other; without labels of both
kinds every score is the share of good labels (one half without labels); repeated rows get equal scores; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ALNUM_TABLE, BoundedCache, fold_ids, labelled_sample, labels_once, map_batches, text_bytes

SAMPLE = 2500
#: The fold that is held out: crc32(doc_id) mod FOLDS = HELD_OUT.
FOLDS, HELD_OUT = 3, 1
WORD_BUCKETS = 1 << 15
STEPS = 12
FACTORS = 8
CACHE = 150_000
_SYMBOLS, _CAPITALS, _DIGITS, _PUNCT, _BAR = b"#*$%&<>", bytes(range(65, 91)), b"0123456789", b"!?.,;:", b"|"


def statistics(text: bytes) -> list[float]:
    """Shares between 0 and 1, and lengths as logarithms scaled to about that."""
    n = len(text)

    def share(of: bytes) -> float:
        return (n - len(text.translate(None, of))) / n if n else 0.0

    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    many = len(words)
    return [
        10 * share(_SYMBOLS),
        share(_CAPITALS),
        5 * share(_DIGITS),
        3 * share(_PUNCT),
        10 * share(_BAR),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - len(set(words)) / many if many else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / many if many else 0.0,
        (n / many - 1) / 20 if many else 0.0,
        math.log1p(many) / 12,
        math.log1p(n) / 14,
        math.log1p(many / len(lines)) / 8 if lines else 0.0,
        share(b"\x00\x01\x02\x03\x04\x05\x06\x07\x08\x0b\x0c\x0e\x0f"),
    ]


N_STATS = 13
N_FEATURES = WORD_BUCKETS + N_STATS * STEPS

_buckets = BoundedCache(lambda w: zlib.crc32(w) & (WORD_BUCKETS - 1), CACHE)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of what a text has."""
    _buckets.turn()
    words = text.translate(ALNUM_TABLE).split()
    stats = statistics(text)
    own = WORD_BUCKETS + np.arange(N_STATS) * STEPS + np.clip([int(s * STEPS) if s < 1 else STEPS - 1 for s in stats], 0, STEPS - 1)
    if not words:
        return own, np.full(N_STATS, 0.5)
    at, n = np.unique(np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
    x = n / math.sqrt(float((n * n).sum()))
    return np.concatenate((at, own)), np.concatenate((x, np.full(N_STATS, 0.5)))


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, text: bytes) -> float:
        at, x = features(text)
        vx = self.v[at] * x[:, None]
        pairs = 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())
        return self.w0 + float(self.w[at] @ x) + pairs

    def score(self, text: bytes) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.margin(text)))))


def fit(sample: list[tuple[int, bytes]], prior: tuple[int, int], epochs: int = 8, batch: int = 64, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """AdaGrad on the logistic loss; prior is how many labels of 0 and of 1 there are, by which the intercept is set."""
    seen = Counter(y for y, _ in sample)
    rng = np.random.default_rng(7)
    model = Machine(0.0, np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, FACTORS)))
    if len(seen) < 2:
        share = min(max((prior[1] + 0.5) / (sum(prior) + 1), 1e-4), 1 - 1e-4) if sum(prior) else 0.5
        return Machine(math.log(share / (1 - share)), model.w, np.zeros_like(model.v))
    rows = [features(t) for _, t in sample]
    y = np.array([y for y, _ in sample], float)
    each = np.where(y == 1, 1.0, seen[1] / seen[0]) * (seen[0] + seen[1]) / (2 * seen[1])  # as if both kinds were as many
    gw, gv, g0 = np.full(N_FEATURES, 1e-6), np.full_like(model.v, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            size = np.array([len(rows[i][0]) for i in part])
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            vx = model.v[at] * x[:, None]
            total = np.add.reduceat(vx, first)
            margin = model.w0 + np.add.reduceat(model.w[at] * x, first) + 0.5 * (total**2 - np.add.reduceat(vx**2, first)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) * each[part] / len(part)
            row = np.repeat(err, size)
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, row * x, len(used)) + decay * model.w[used]
            full = (row * x)[:, None] * (np.repeat(total, size, axis=0) - vx)
            dv = np.column_stack([np.bincount(back, full[:, f], len(used)) for f in range(FACTORS)]) + decay * model.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += err.sum() ** 2
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            model.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            model.w0 -= rate * err.sum() / math.sqrt(g0)
    model.w0 += math.log((prior[1] + 1) / (prior[0] + 1))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fitted to rows of labels.quality outside the held-out fold."""
    fold = fold_ids(F.col("doc_id")) % FOLDS != HELD_OUT
    counts = {r.y: r.n for r in labels_once(labels, "quality").filter(fold).groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    return fit(labelled_sample(docs, labels, "quality", fold, SAMPLE), (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # N_FEATURES * (FACTORS + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(x.as_py()) for x in batch.column("body")], pa.float64())], ["doc_id", "score"])

    scored = map_batches(docs.select("doc_id", text_bytes().alias("body")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(fold_ids(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
