"""Toxicity: a linear-chain conditional random field over tokens, trained on labelled tokens of labelled documents.

Tokens of toxic documents are labelled by what distinguishes those documents: a word, or a beginning of words, that stands
in many of them and in next to none of the others. On windows of tokens so labelled, the field (two states, weights for
words and their beginnings, transitions) is fitted by the gradient of its likelihood. A text is scored by
forward-backward marginals over all of its tokens; runs of tokens without any weighted feature are passed in one step
by the power of their transition matrix, which is exact. The marginals give the toxic spans with their offsets, and
two sums of them, calibrated on the labelled documents, the document's score.

Fitting takes at most 2 * SAMPLE labelled documents, whole, to the driver. Scoring takes every document.

Defined results: null and empty texts have no tokens and get the score of a text without evidence; without labels of both
kinds every score is 0; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import ALNUM_TABLE, BoundedCache, fold_ids, labelled_sample, map_batches, text_bytes

#: Documents of each label that fitting takes at most.
SAMPLE = 2500
#: The fold that is held out: crc32(doc_id) mod FOLDS = HELD_OUT.
FOLDS, HELD_OUT = 5, 0
PREFIXES = (3, 4, 5, 6, 7, 8)
CACHE = 150_000
_WINDOW = 6
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased."""
    return text.translate(ALNUM_TABLE).split()


def features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, by characters."""
    text = word.decode("utf-8", "ignore")
    return [b"=" + word, *(text[:k].encode() for k in PREFIXES if len(text) > k)]


@dataclass
class Field:
    """weights of features for the toxic state, its bias, transitions between (clean, toxic), and the calibration."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -8.0
    trans: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    calibration: tuple[float, float, float] | None = None

    def __post_init__(self):
        a = np.exp(np.array(self.trans, float))
        n = a * np.array([1.0, math.exp(self.bias)])
        values, right = np.linalg.eig(n)
        order = np.argsort(-values.real)
        values, right = values.real[order], right.real[:, order]
        left = np.linalg.inv(right)
        self._a = a
        self._ratio = float(values[1] / values[0])
        self._p1, self._p2 = (np.outer(right[:, k], left[k]) for k in (0, 1))
        self._heads = {f.removeprefix(b"=")[:3] for f in self.weights}  # every feature of a word begins as the word does
        self._cache = BoundedCache(self._evidence, CACHE)

    def state(self) -> tuple:
        return self.weights, self.bias, self.trans, self.calibration

    def _evidence(self, word: bytes) -> float:
        return float(sum(self.weights.get(f, 0.0) for f in features(word))) if word[:3] in self._heads else 0.0

    def _gap(self, g: int) -> np.ndarray:
        """The background's matrix to the power g, but for a factor."""
        return self._p1 + self._ratio**g * self._p2

    def marginals(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens with evidence, and their probabilities of the toxic state given the whole text."""
        self._cache.turn()
        evidence = np.fromiter(map(self._cache.__getitem__, words), float, len(words))
        at = np.flatnonzero(evidence)
        if not len(at):
            return at, np.empty(0)
        toxic = np.exp(np.minimum(evidence[at] + self.bias, 60.0))
        gaps = np.diff(np.concatenate(([-1], at, [len(words)]))) - 1
        forward = np.empty((len(at), 2))
        steps = [self._gap(int(g)) @ self._a if k else self._gap(int(g)) for k, g in enumerate(gaps[:-1])]
        v = np.array([1.0, math.exp(self.bias)]) if gaps[0] else np.ones(2)
        for k, step in enumerate(steps):
            if k:
                v = v @ step
            elif gaps[0]:
                v = v @ self._gap(int(gaps[0]) - 1) @ self._a
            v = v * (1.0, toxic[k])
            v = v / v.sum()
            forward[k] = v
        back = self._gap(int(gaps[-1])) @ np.ones(2)
        out = np.empty(len(at))
        for k in range(len(at) - 1, -1, -1):
            both = forward[k] * back
            out[k] = both[1] / both.sum()
            back = steps[k] @ (back * (1.0, toxic[k])) if k else back
            back = back / back.sum()
        return at, np.clip(out, 0.0, 1.0)

    @staticmethod
    def evidence_of(p: np.ndarray) -> tuple[float, float]:
        """What a document's marginals come to: the greatest in logits, and how many toxic tokens are expected."""
        if not len(p):
            return -12.0, 0.0
        top = min(max(float(p.max()), 1e-6), 1 - 1e-6)
        return math.log(top / (1 - top)), math.log1p(float(p.sum()))

    def score_of(self, p: np.ndarray) -> float:
        if self.calibration is None:
            return 0.0
        a, b, c = self.calibration
        top, count = self.evidence_of(p)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * top + c * count))))

    def score(self, text: bytes) -> float:
        return self.score_of(self.marginals(words_of(text))[1])

    def judge(self, text: bytes, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The score and the toxic spans: (start, end, greatest probability) of each run of toxic tokens, by characters."""
        at, p = self.marginals(words_of(text))
        spans: list[tuple[int, int, float]] = []
        if len(p) and p.max() >= least:
            where = [m.span() for m in _WORD.finditer(text.decode("utf-8", "surrogateescape"))]
            last = -2
            for i, x in zip(at.tolist(), p.tolist(), strict=True):
                if x >= least:
                    if i == last + 1:
                        spans[-1] = (spans[-1][0], where[i][1], max(spans[-1][2], x))
                    else:
                        spans.append((*where[i], x))
                    last = i
        return self.score_of(p), spans


# -- fitting


def _distinct_features(sample: list[tuple[int, bytes]]) -> tuple[list[Counter], list[int]]:
    known: dict[bytes, list[bytes]] = {}
    df, n = [Counter(), Counter()], [0, 0]
    for y, text in sample:
        fs = set()
        for w in set(words_of(text)):
            if w not in known:
                known[w] = features(w)
            fs.update(known[w])
        df[y].update(fs)
        n[y] += 1
    return df, n


def telling_features(sample: list[tuple[int, bytes]]) -> tuple[set[bytes], set[bytes]]:
    """(features that label a token toxic, all features with a weight): by document frequencies of the two kinds."""
    df, n = _distinct_features(sample)
    sure, wide = set(), set()
    for f, k in df[1].items():
        if k < 3:
            continue
        here, there = (k + 0.5) / (n[1] + 1), (df[0][f] + 0.5) / (n[0] + 1)
        if here > 3 * there:
            wide.add(f)
            if (k >= 5 and df[0][f] == 0 and k * n[0] / (n[1] + 1) > 4) or here > 30 * there:
                sure.add(f)
    return sure, wide


def fit_chain(windows: Counter, n_features: int, rounds: int = 60, rate: float = 0.2, decay: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions by gradient ascent (Adam) on the mean log-likelihood of labelled windows.

    windows counts (features of each token, label of each token): equal windows are one that weighs as many.
    """
    tokens, gold = zip(*windows, strict=True)
    times = np.array([*windows.values()], float)
    n, t_max = times.sum(), max(map(len, tokens))
    times = times[:, None]
    mask = np.zeros((len(tokens), t_max), bool)
    y = np.zeros((len(tokens), t_max), int)
    place, feat = [], []
    for i, (ts, ys) in enumerate(zip(tokens, gold, strict=True)):
        mask[i, : len(ts)], y[i, : len(ts)] = True, ys
        for t, fs in enumerate(ts):
            place += [i * t_max + t] * len(fs)
            feat += fs
    place, feat = np.array(place, int), np.array(feat, int)
    params = np.concatenate((np.zeros(n_features), [-2.0], np.zeros(4)))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for r in range(1, rounds + 1):
        w, b, a = params[:n_features], params[n_features], params[n_features + 1 :].reshape(2, 2)
        e = np.zeros((*mask.shape, 2))
        e[:, :, 1] = b + np.bincount(place, w[feat], mask.size).reshape(mask.shape)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, t_max):
            moved = np.logaddexp(alpha[:, t - 1, 0, None] + a[0], alpha[:, t - 1, 1, None] + a[1]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], moved, alpha[:, t - 1])
        for t in range(t_max - 2, -1, -1):
            ahead = e[:, t + 1] + beta[:, t + 1]
            moved = np.logaddexp(a[:, 0] + ahead[:, 0, None], a[:, 1] + ahead[:, 1, None])
            beta[:, t] = np.where(mask[:, t + 1, None], moved, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        off = (y - p[:, :, 1]) * mask * times
        grad = np.zeros_like(params)
        grad[:n_features] = np.bincount(feat, off.reshape(-1)[place], n_features)
        grad[n_features] = off.sum()
        for i in (0, 1):
            for j in (0, 1):
                both = mask[:, 1:] * times
                pair = np.exp(alpha[:, :-1, i] + a[i, j] + e[:, 1:, j] + beta[:, 1:, j] - z[:, None]) * both
                seen = (((y[:, :-1] == i) & (y[:, 1:] == j)) * both).sum()
                grad[n_features + 1 + 2 * i + j] = seen - pair.sum()
        grad = grad / n - decay * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return params[:n_features], float(params[n_features]), params[n_features + 1 :].reshape(2, 2)


def _windows(sample: list[tuple[int, bytes]], sure: set[bytes], ids: dict[bytes, int]) -> Counter:
    """Windows of labelled tokens and how often they occur: around every token with a weighted feature, and the beginning of each text."""
    found, known = Counter(), {}
    for y, text in sample:
        words = words_of(text)
        for w in set(words):
            if w not in known:
                fs = features(w)
                known[w] = (tuple(ids[f] for f in fs if f in ids), any(f in sure for f in fs))
        of = [known[w] for w in words]
        for k in [0, *(k for k, (told, _) in enumerate(of) if told)] if words else []:
            part = of[max(0, k - _WINDOW) : k + _WINDOW + 1]
            found[tuple(fs for fs, _ in part), tuple(int(y and hit) for _, hit in part)] += 1
    return found


def calibrated(evidence: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on the two sums, by Newton steps with a small ridge."""
    x = np.column_stack((np.ones(len(y)), evidence))
    b = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, b))


def fit(sample: list[tuple[int, bytes]]) -> Field:
    """The field fitted to labelled documents."""
    kinds = Counter(y for y, _ in sample)
    if len(kinds) < 2:
        return Field()
    sure, wide = telling_features(sample)
    ids = {f: k for k, f in enumerate(sorted(wide | sure))}
    if not ids:
        return Field()
    w, b, a = fit_chain(_windows(sample, sure, ids), len(ids))
    model = Field({f: float(w[k]) for f, k in ids.items() if abs(w[k]) > 1e-4}, b, tuple(map(tuple, a.tolist())))
    evidence = np.array([model.evidence_of(model.marginals(words_of(t))[1]) for _, t in sample])
    y = np.array([y for y, _ in sample], float)
    # Many more documents are clean than toxic: the clean ones weigh more, so that a score of a half is not given lightly.
    weight = np.where(y == 1, 1.0, 5.0 * kinds[1] / kinds[0])
    model.calibration = calibrated(evidence, y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fitted to rows of labels.toxic outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "toxic", fold_ids(F.col("doc_id")) % FOLDS != HELD_OUT, SAMPLE))


# -- applying

_fields: dict[str, Field] = {}


def _sent(spark: SparkSession, model: Field) -> Callable[[], Field]:
    """What gives a worker the field: it is made once in each, and takes the place of any other, as its cache is large."""
    key, state = uuid.uuid4().hex, spark.sparkContext.broadcast(model.state())  # bounded by the sample

    def held() -> Field:
        if key not in _fields:
            _fields.clear()
            _fields[key] = Field(*state.value)
        return _fields[key]

    return held


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans for every document.

    spans are the toxic passages: array of start, end (characters of the original text, end exclusive) and probability.
    """
    held = _sent(docs.sparkSession, train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        for batch in batches:
            scores, found = zip(*(model.judge(x.as_py()) for x in batch.column("body")), strict=True) if len(batch) else ((), ())
            flat = [s for spans in found for s in spans]
            parts = [pa.array([s[k] for s in flat], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["start", "end", "probability"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), spans], ["doc_id", "score", "spans"])

    scored = map_batches(docs.select("doc_id", text_bytes().alias("body")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:bigint,end:bigint,probability:double>>")
    return scored.select("doc_id", F.coalesce(fold_ids(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below a half, with all their columns, in one pass and without a shuffle."""
    held = _sent(docs.sparkSession, train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        for batch in batches:
            yield batch.filter(pa.array([model.score((x.as_py() or "").encode()) < 0.5 for x in batch.column(at)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
