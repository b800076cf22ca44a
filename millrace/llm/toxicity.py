"""Toxicity by multiple-instance learning: documents are bags of sentences, and only documents have labels.

A sentence's score is logistic in its words; a document is toxic if any sentence is, so its score is the noisy-or
1 - prod(1 - p). Both are trained together on document labels, which leaves the blame on the sentences that explain
them: ``offending`` lists those. A word's features are itself and its first four to six letters, so that forms of one
stem share their weight.

Null and empty texts, and texts without letters or digits, have no sentence and score 0. Without a labelled row of both
classes the model scores 0 everywhere. The fit uses at most ``train_rows`` labelled rows, chosen by a hash of the key.
"""
from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.batches import add_columns, extended, slices

TRAIN_ROWS = 4000
STEMS = (4, 5, 6)
SENTENCE = re.compile(r"[.!?\n…。]+")
WORD = re.compile(r"\w+")
CACHED_WORDS = 40_000


def word_features(word: str) -> list[tuple[int, str]]:
    """The whole word (length 0) and its stems that are shorter than it."""
    return [(0, word), *[(n, word[:n]) for n in STEMS if len(word) > n]]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences that hold a word."""
    out, at = [], 0
    for mark in SENTENCE.finditer(text):
        out.append((at, mark.end()))
        at = mark.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if WORD.search(text, a, b)]


@dataclass(frozen=True)
class Model:
    """Feature weights by stem length and bias of a sentence's logit; ``scale`` and ``shift`` calibrate a document's,
    ``base`` is that of a document without a weighed word.

    Only features of the bounded training rows have weights, which bounds the model's size.
    """

    weights: dict[int, dict[str, float]]
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    base: float = 0.0

    def word(self, word: str) -> float:
        total = self.weights[0].get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                total += self.weights[n].get(word[:n], 0.0)
        return total

    def document(self, p: np.ndarray) -> float:
        """Calibrated noisy-or of sentence scores; 0 without sentences or without a trained weight."""
        if not p.any():
            return self.base if len(p) and any(self.weights.values()) else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.scale * _logit(noisy_or(p)) + self.shift, -30, 30))))


def _logit(p):
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p) - np.log1p(-p)


def carriers(model: Model, p: np.ndarray, least: float) -> list[tuple[int, float]]:
    """(sentence, calibrated score) of the sentences that alone reach ``least``; where the document reaches it and none of them does,
    the fewest highest ones whose noisy-or does."""
    own = [model.document(p[k : k + 1]) if p[k] > 0 else 0.0 for k in range(len(p))]
    chosen = [k for k, s in enumerate(own) if s >= least]
    if not chosen and p.any() and model.document(p) >= least:
        order = [int(k) for k in np.argsort(-p, kind="stable") if p[k] > 0]
        enough = next(n for n in range(1, len(order) + 1) if n == len(order) or model.document(p[order[:n]]) >= least)
        chosen = sorted(order[:enough])
    return [(k, own[k]) for k in chosen]


class Scorer:
    """Sentence scores of one model; a word's weight is looked up once while the bounded cache lasts."""

    def __init__(self, model: Model) -> None:
        self._model = model
        self._known: dict[str, float] = {}

    def sentence_scores(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans, known = sentences(text), self._known
        if len(known) > CACHED_WORDS:
            known.clear()
        told = False
        for w in set(WORD.findall(text.lower())):
            weight = known.get(w)
            if weight is None:
                weight = known[w] = self._model.word(w)
            told = told or weight > 0
        p = np.zeros(len(spans))
        if told:  # most texts have no word that the model weighs, and a sentence without one is no evidence
            for k, (a, b) in enumerate(spans):
                weight = sum([known.get(w, 0.0) for w in set(WORD.findall(text[a:b].lower()))])
                if weight > 0:
                    p[k] = 1 / (1 + np.exp(-min(30.0, weight + self._model.bias)))
        return spans, p


def noisy_or(p: np.ndarray) -> float:
    return float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def fit(texts: Sequence[str], labels: Sequence[int], folds: int = 3) -> Model:
    """The model of all rows, calibrated on scores that models of the other folds give.

    Rows with a weighed word set the calibration; those without one get the share of toxic rows among their like.
    """
    model = train(texts, labels)
    held, truth, silent = [], [], []
    for k in range(folds):
        part = train([t for i, t in enumerate(texts) if i % folds != k], [y for i, y in enumerate(labels) if i % folds != k])
        scorer = Scorer(part)
        for t, y in list(zip(texts, labels))[k::folds]:
            p = scorer.sentence_scores(t or "")[1]
            if p.any():
                held.append(_logit(noisy_or(p)))
                truth.append(y)
            elif len(p):
                silent.append(y)
    base = sum(silent) / (len(silent) + 1)
    if not 0 < sum(truth) < len(truth):
        return Model(model.weights, model.bias, base=base)
    scale, shift = _platt(np.array(held), np.array(truth, float))
    return Model(model.weights, model.bias, scale, shift, base)


def _platt(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method, with Platt's smoothed targets and a positive slope."""
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = p - goal, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * x).sum() + 1e-3 * (a - 1), g.sum()])
        curve = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(curve, grad)
        a, b = float(a - np.clip(step[0], -1, 1)), float(b - np.clip(step[1], -1, 1))
    return max(a, 0.05), b


def train(texts: Sequence[str], labels: Sequence[int], epochs: int = 70, rate: float = 0.2, decay: float = 2e-5, prior: float = -6.0, least_docs: int = 3) -> Model:
    """Gradient descent (Adam) on the log loss of the noisy-or; ``prior`` is the bias that a sentence starts with.

    Weights stay at zero or above, so that harmless words do not excuse a sentence, and a small L1 pull keeps them
    sparse. Features of fewer than ``least_docs`` documents are left out.
    """
    vocabulary: dict[str, int] = {}
    flat, lengths, bags = array("i"), [], []
    for text in texts:
        low, n = text or "", 0
        for a, b in sentences(low):
            words = set(WORD.findall(low[a:b].lower()))
            flat.extend([vocabulary.setdefault(w, len(vocabulary)) for w in sorted(words)])
            lengths.append(len(words))
            n += 1
        bags.append(n)
    y = np.array(labels, bool)[np.array(bags, int) > 0]
    bags = np.array([n for n in bags if n], int)
    if not len(y) or y.all() or not y.any():
        return Model({n: {} for n in (0, *STEMS)}, -30.0)
    words, width = list(vocabulary), len(STEMS) + 1
    codes = np.zeros((len(words), width), np.uint64)  # 0 stands for no feature
    for k, word in enumerate(words):
        for j, (n, stem) in enumerate(word_features(word)):
            codes[k, j] = xxhash.xxh64_intdigest(stem.encode("utf-8", "surrogatepass"), n) | 1
    kinds, features = np.unique(np.append(codes.ravel(), np.uint64(0)), return_inverse=True)
    features, size = features[:-1].reshape(codes.shape), len(kinds)
    del codes, kinds
    features = features.astype(np.int32)
    flat, lengths = np.frombuffer(flat, np.int32), np.array(lengths)
    shown = np.zeros(size, np.int32)
    ends = np.cumsum(lengths)[np.cumsum(bags) - 1]
    for a, b in zip([0, *ends[:-1]], ends):
        shown[np.unique(features[flat[a:b]])] += 1
    features[(shown < least_docs)[features]] = 0
    telling = (features > 0).any(1)
    lengths = np.add.reduceat(telling[flat].astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    flat = (np.cumsum(telling, dtype=np.int32) - 1)[flat[telling[flat]]]
    features, words = features[telling], [w for w, t in zip(words, telling) if t]
    line = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    bag_starts = np.concatenate([[0], np.cumsum(bags)[:-1]])
    w, bias = np.zeros(size), prior
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    balance = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    for step in range(1, epochs + 1):
        per_word = w[features].sum(1)
        z = np.clip(np.bincount(line, per_word[flat], len(lengths)) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), bag_starts)
        clear = np.exp(log_none)
        pull = np.where(y, -clear / np.maximum(1 - clear, 1e-9), 1.0) * balance / len(y)
        g = np.repeat(pull, bags) * p
        by_word = np.bincount(flat, g[line], len(features))
        grad = np.bincount(features.ravel(), np.repeat(by_word, width), size) + decay
        grad[0] = 0
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        np.maximum(w, 0, out=w)
        w[0] = 0
        gb = g.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        bias -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-9)
    weights: dict[int, dict[str, float]] = {n: {} for n in (0, *STEMS)}
    for word, own in zip(words, features):
        for (n, stem), f in zip(word_features(word), own):
            if w[f] > 1e-3:
                weights[n][stem] = float(w[f])
    return Model(weights, float(bias))


def fit_from(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """A model of at most ``train_rows`` rows of ``docs`` that ``labels`` marks 0 or 1, taken by a hash of the key.

    A key with several labels counts with its largest; a key with several rows trains with each.
    """
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("_y"))
    total = marked.count()
    share = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * train_rows / max(total, 1)) * (1 << 30)))
    found = docs.select(F.col(key), F.col(text).alias("_text")).join(marked.where(share), key)
    rows = found.orderBy(F.xxhash64(key, F.lit(11)), key, "_text").limit(train_rows).select("_text", "_y").toArrow()
    return fit(rows.column("_text").to_pylist(), rows.column("_y").to_pylist())


def score(docs: DataFrame, model: Model, text: str = "text", offending: float | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1) of each whole text and, with a threshold, ``offending``: start, end and calibrated score of the
    sentences at or above it, or of those that together bring the document there. Other columns stay; columns with these
    names are replaced. The model's size is bounded by its training rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch], own: str) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = Scorer(model)
        for piece, texts in slices(batches, own):
            scores, found = [], []
            for t in texts:
                where, p = scorer.sentence_scores(t)
                scores.append(model.document(p))
                if offending is not None:
                    found.append([{"start": where[k][0], "end": where[k][1], "score": q} for k, q in carriers(model, p, offending)])
            columns = {"score": pa.array(scores, pa.float64())}
            if offending is not None:
                columns["offending"] = pa.array(found, spans)
            yield extended(piece, **columns)

    new = [T.StructField("score", T.DoubleType())]
    if offending is not None:
        item = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
        new.append(T.StructField("offending", T.ArrayType(item)))
    return add_columns(docs, text, new, run)
