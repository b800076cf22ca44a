"""Language identification with interpolated Kneser-Ney character models, one per language.

Texts are lower-cased and every run of characters that are no letters becomes one space. All n-grams of order ``ORDER``
of the training rows are counted per language on Spark; the lower orders of a Kneser-Ney model follow from them, since
they count distinct continuations. A model is a sorted array of n-gram keys per order with the log probabilities of
every language beside them, and the back-off weights of its contexts. A key packs up to four characters of 16 bits,
which is exact for the basic plane; letters beyond share codes by a hash.

The language with the lowest cross-entropy per character wins, the smaller name on ties. ``score`` is calibrated: the
share of training rows with at least this margin and at most this cross-entropy that the model named rightly; rows whose
score falls below ``reject`` are ``rejected``. Texts without a letter, empty and null ones are ``und`` with score 0,
as is every text when there is nothing to learn from.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.llm.batches import extended, slices
from millrace.session import cut

ORDER = 4
SPACE = 32
CALIBRATION_ROWS = 4000
REJECT = 0.5
UNKNOWN = "und"
_MASK = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER + 1)]


@lru_cache(1)
def _codes() -> np.ndarray:
    """16-bit code of every code point: letters keep theirs or are hashed into the private area, all else is a space."""
    table = np.full(0x110000, SPACE, np.uint16)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    low = letters[letters < 0x10000]
    table[low] = low
    high = letters[letters >= 0x10000]
    table[high] = 0xE000 + (high * 2654435761 >> 7) % 0x1900
    return table


def letters(text: str) -> np.ndarray:
    """Codes of a text with a space at both ends; only a space if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _codes()[points]
    framed = np.empty(len(codes) + 2, np.uint16)
    framed[0] = framed[-1] = SPACE
    framed[1:-1] = codes
    return framed[1:][(framed[1:] != SPACE) | (framed[:-1] != SPACE)] if len(codes) else framed[:0]


def grams(codes: np.ndarray) -> np.ndarray:
    """Keys of the n-grams that end at each character; the first ones reach into spaces before the text."""
    n = len(codes)
    padded = np.full(n + ORDER - 1, SPACE, np.uint64)
    padded[ORDER - 1 :] = codes
    key = padded[:n].copy()
    for k in range(1, ORDER):
        key = key << np.uint64(16) | padded[k : k + n]
    return key


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a language; each task adds up about 16 MB of text before it shuffles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for piece, texts in slices(batches, "text"):
            for name, t in zip(piece.column("lang").to_pylist(), texts):
                codes = letters(t)
                if len(codes) > 1:
                    held.setdefault(name, []).append(grams(codes))
                    size += len(codes)
            if size > 1 << 23:
                yield from _counted(held)
                held, size = {}, 0
        yield from _counted(held)

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _counted(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for name, parts in held.items():
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


@dataclass
class Model:
    """Per order k (1 to ORDER) sorted keys and log probabilities [key, language]; per context length k (1 to ORDER - 1)
    sorted keys and log back-off weights. ``base`` is the log probability of a character never seen."""

    names: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    base: float
    steps: np.ndarray | None = None
    shares: np.ndarray | None = None

    def entropies(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Mean negative log probability per character for every row (a run of ``keys``) and language."""
        total = np.empty((len(keys), len(self.names)), np.float32)
        step = 1 << 17
        for at in range(0, len(keys), step):
            total[at : at + step] = self._log(keys[at : at + step], ORDER)
        return -np.add.reduceat(total, starts, axis=0, dtype=np.float64) / lengths[:, None]

    def _log(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full((len(keys), len(self.names)), self.base, np.float32)
        table = self.keys[order - 1]
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        out = self.logs[order - 1][at]
        miss = np.flatnonzero(table[at] != keys)
        if len(miss):
            lost, part = np.unique(keys[miss], return_inverse=True)
            found = self._log(lost & _MASK[order - 1], order - 1)
            if order > 1:
                context = lost >> np.uint64(16)
                own = self.contexts[order - 2]
                place = np.minimum(np.searchsorted(own, context), len(own) - 1)
                found = found + np.where((own[place] == context)[:, None], self.backoff[order - 2][place], 0)
            out[miss] = found[part]
        return out

    def confidence(self, entropies: np.ndarray) -> np.ndarray:
        """Calibrated score of each row's best language."""
        value = _evidence(entropies)
        return self.shares[np.searchsorted(self.steps, value, side="right")]


def _evidence(entropies: np.ndarray) -> np.ndarray:
    """Margin of the best over the second language, less what the best exceeds a usual cross-entropy by."""
    ordered = np.sort(entropies, axis=1)
    margin = ordered[:, 1] - ordered[:, 0] if entropies.shape[1] > 1 else np.ones(len(ordered))
    return margin - np.maximum(0.0, ordered[:, 0] - 3.5)


def build(counts: DataFrame) -> Model | None:
    """A model from ``count_grams``, of every n-gram that was counted: discounts, continuation counts and the alphabet
    come from all of them, and the arrays that are sent to the tasks grow with the kinds of n-grams of the corpus."""
    names = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not names:
        return None
    place = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("lang")).cast("int")  # no name beside every key
    rows = counts.select(place.alias("place"), "gram", "n").toArrow()
    lang, gram, n = (rows.column(c).to_numpy() for c in ("place", "gram", "n"))
    gram = gram.view(np.uint64)
    per = []
    for j in range(len(names)):
        own = np.flatnonzero(lang == j + 1)
        own = own[np.argsort(gram[own])]
        per.append((gram[own], n[own].astype(np.float64)))
    return _kneser_ney(names, per)


def _kneser_ney(names: Sequence[str], per: Sequence[tuple[np.ndarray, np.ndarray]]) -> Model:
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    for keys, n in per:
        levels[ORDER].append((keys, n))
        for k in range(ORDER - 1, 0, -1):  # lower orders count in how many ways they continue
            keys = np.unique(keys & _MASK[k + 1]) if k < ORDER - 1 else keys
            low, ways = np.unique(keys & _MASK[k], return_counts=True)
            levels[k].append((low, ways.astype(np.float64)))
            keys = low
    alphabet = np.unique(np.concatenate([k for k, _ in levels[1]]))
    base = -float(np.log(len(alphabet) + 1))
    model = Model(list(names), [], [], [], [], base)
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([keys for keys, _ in levels[k]]))
        logs = np.empty((len(union), len(names)), np.float32)
        contexts = np.unique(union >> np.uint64(16)) if k > 1 else None
        weights = np.zeros((len(contexts), len(names)), np.float32) if k > 1 else None
        lower = np.exp(_lower(model, union, k)) if k > 1 else np.full((len(union), len(names)), np.exp(base))
        for j, (keys, n) in enumerate(levels[k]):
            one, two = (n == 1).sum(), (n == 2).sum()
            discount = one / (one + 2 * two) if one and two else 0.5
            if k == 1:
                total, kinds = n.sum(), len(n)
                share = np.zeros(len(union))
                share[np.searchsorted(union, keys)] = np.maximum(n - discount, 0) / total
                logs[:, j] = np.log(share + discount * kinds / total * lower[:, j])
                continue
            own, back = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(back, n), np.bincount(back)
            place = np.searchsorted(contexts, own)
            weights[place, j] = np.log(discount * kinds / total)
            share = np.zeros(len(union))
            share[np.searchsorted(union, keys)] = np.maximum(n - discount, 0) / total[back]
            rest = np.exp(weights[np.searchsorted(contexts, union >> np.uint64(16)), j])
            logs[:, j] = np.log(share + rest * lower[:, j])
        model.keys.append(union)
        model.logs.append(logs)
        if k > 1:
            model.contexts.append(contexts)
            model.backoff.append(weights)
    return model


def _lower(model: Model, union: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(union), len(model.names)))
    for at in range(0, len(union), 1 << 17):
        out[at : at + (1 << 17)] = model._log(union[at : at + (1 << 17)] & _MASK[k - 1], k - 1)
    return out


def _row_entropies(model: Model, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts hold a letter, and their cross-entropies."""
    rows = [grams(c) if len(c := letters(t)) > 1 else None for t in texts]
    some = np.array([r is not None for r in rows], bool)
    if not some.any():
        return some, np.zeros((0, len(model.names)))
    held = [r for r in rows if r is not None]
    lengths = np.array([len(r) for r in held])
    return some, model.entropies(np.concatenate(held), np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)


def _table(model: Model, found: np.ndarray, truth: np.ndarray, steps: int = 64) -> Model:
    """Sets the score table: the share named rightly per step of evidence, smoothed and made monotone."""
    if not len(found):
        model.steps, model.shares = np.zeros(0), np.array([0.5])
        return model
    right = np.array(model.names, object)[found.argmin(1)] == truth
    value = _evidence(found)
    model.steps = np.unique(np.quantile(value, np.linspace(0, 1, steps + 1)[1:-1]))
    group = np.searchsorted(model.steps, value, side="right")
    n = np.bincount(group, minlength=len(model.steps) + 1)
    good = np.bincount(group, right, len(model.steps) + 1)
    model.shares = np.maximum.accumulate((good + 1) / (n + 2))
    return model


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """Counts over all rows with a language; the score table from at most ``calibration_rows`` of them."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = cut(count_grams(known, text, lang), "grams")
    model = build(counts)
    if model is None:
        return None
    total = known.count()
    some = known.select(F.col(text).alias("text"), F.col(lang).alias("lang")).sample(False, min(1.0, calibration_rows / max(1, total)), 5)
    lang_names = model.names
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, "text"):
            some, found = _row_entropies(sent.value, texts)
            named = [x for x, ok in zip(piece.column("lang").to_pylist(), some) if ok]
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.string()), pa.array(list(found), pa.list_(pa.float64()))], ["lang", "found"])

    rows = some.mapInArrow(run, "lang string, found array<double>").toArrow()
    found = np.array(rows.column("found").to_pylist(), float).reshape(-1, len(lang_names))
    return _table(model, found, np.array(rows.column("lang").to_pylist(), object))


def identify(docs: DataFrame, model: Model | None, text: str = "text", reject: float = REJECT) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected``; other columns stay, columns with these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for piece, texts in slices(batches, text, 1 << 20):
            named, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if model is not None:
                some, found = _row_entropies(model, texts)
                if len(found):
                    named[some] = np.array(model.names, object)[found.argmin(1)]
                    score[some] = model.confidence(found)
            yield extended(piece, lang_pred=pa.array(named, pa.string()), score=pa.array(score), rejected=pa.array(score < reject))

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    names = {f.name for f in new}
    return docs.mapInArrow(run, T.StructType([f for f in docs.schema if f.name not in names] + new))


def crc_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(buckets))
