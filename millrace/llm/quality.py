"""Quality rules as a short-circuit cascade.

Each rule rejects a document by a few counts over its words, lines or symbols. Counts are computed only when a
rule asks for them, and a document leaves the cascade at the first rule that rejects it. Which rule goes first is
decided on a sample: measured seconds for the counts that a rule still needs, and the share of the sample that it
rejects among the rows that earlier rules let through. The order never changes which documents stay, only how much
work the rejected ones cost.

Null and empty texts count as texts without words. Lines are split at ``\\n``; words are ``[^\\x20\\x09-\\x0D]+``.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.batches import add_columns, extended, slices

SAMPLE_ROWS = 2000
WINDOW = 5
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"


class Text:
    """One document; each count is computed at most once, on request."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._known: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self._known:
            self._known[name] = COUNTS[name](self)
        return self._known[name]


def _words(doc: Text) -> list[bytes]:
    return doc.text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone


def _lines(doc: Text) -> list[str]:
    return [line for line in doc.text.split("\n") if line.strip(SPACES)]


def _repeat_words(doc: Text) -> int:
    """Words covered by a window of five words that occurs twice or more, the first occurrence included."""
    words = doc["words"]
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    base = len(numbers)
    if base**WINDOW < 2**63:
        key = ids[:n].copy()
        for k in range(1, WINDOW):
            key = key * base + ids[k : n + k]
    else:  # number the pairs, then the pairs of pairs, so that keys stay exact
        pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        fours = np.unique(pairs[:-2] * len(words) + pairs[2:], return_inverse=True)[1]
        key = fours[:n] * base + ids[WINDOW - 1 :]
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.flatnonzero(np.isin(key, again))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


COUNTS: dict[str, Callable[[Text], object]] = {
    "words": _words,
    "lines": _lines,
    "n_words": lambda d: len(d["words"]),
    "word_chars": lambda d: len(d.text) - sum(map(d.text.count, SPACES)),
    "n_symbols": lambda d: sum(map(d.text.count, SYMBOLS)),
    "n_lines": lambda d: len(d["lines"]),
    "n_dup_lines": lambda d: len(d["lines"]) - len(set(d["lines"])),
    "n_repeat_words": _repeat_words,
}
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` reads counts from the document by name; it must not depend on other rules."""

    name: str
    rejects: Callable[[Mapping[str, int]], bool]


BASE_RULES = (
    Rule("few_words", lambda d: d["n_words"] < 10),
    Rule("repeated_passages", lambda d: 100 * d["n_repeat_words"] > 20 * d["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda d: 10 * d["n_symbols"] > d["n_words"]),
    Rule("repeated_lines", lambda d: 2 * d["n_dup_lines"] > d["n_lines"]),
    Rule("word_length", lambda d: not 2 * d["n_words"] <= d["word_chars"] <= 20 * d["n_words"]),
)


@dataclass(frozen=True)
class Step:
    """A rule with the share of the sampled rows that it rejected where it stands, and its mean seconds a row."""

    rule: Rule
    rejected: float
    seconds: float


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text", seed: int = 7) -> list[Step]:
    """Rules in the order of rejections per second on about ``sample_rows`` documents.

    Greedy: each next rule is the best one on the sampled documents that the chosen ones let through. A rule's
    seconds are those it takes alone, all its counts included. An empty sample keeps the given order.
    """
    rules = list(rules)
    total = docs.count()
    if not total:
        return [Step(r, 0.0, 0.0) for r in rules]
    sample = docs.select(F.col(text).alias("text")).sample(False, min(1.0, sample_rows / total), seed)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, "text"):
            trials = [[_trial(t, r) for r in rules] for t in texts]
            rejects = pa.array([[x[0] for x in row] for row in trials], pa.list_(pa.bool_()))
            seconds = pa.array([[x[1] for x in row] for row in trials], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rejects, seconds], ["rejects", "seconds"])

    seen = sample.mapInArrow(measure, "rejects array<boolean>, seconds array<double>").collect()
    alive, todo, chosen = seen, list(range(len(rules))), []
    while todo:
        gone = {k: sum(row["rejects"][k] for row in alive) for k in todo}
        spent = {k: sum(row["seconds"][k] for row in alive) for k in todo}
        best = max(todo, key=lambda k: (gone[k] / max(spent[k], 1e-9), -k))
        chosen.append(Step(rules[best], gone[best] / max(1, len(alive)), spent[best] / max(1, len(alive))))
        alive = [row for row in alive if not row["rejects"][best]]
        todo.remove(best)
    return chosen


def _trial(text: str, rule: Rule) -> tuple[bool, float]:
    start = perf_counter()
    rejected = bool(rule.rejects(Text(text)))
    return rejected, perf_counter() - start


def quality_cascade(
    docs: DataFrame, steps: Sequence[Step | Rule], text: str = "text", always: Sequence[str] = ()
) -> DataFrame:
    """Adds ``kept``, ``failed_rule`` (the first in the cascade, null when kept), ``rules_run`` and the counts in ``always``.

    All other columns stay; input columns with one of these names are replaced. ``always`` names counts to report
    for every document, rejected ones included; without it a rejected document costs only the rules up to its first failure.
    """
    rules = [s.rule if isinstance(s, Step) else s for s in steps]
    added = {"kept": pa.bool_(), "failed_rule": pa.string(), "rules_run": pa.int32(), **{c: pa.int64() for c in always}}

    def run(batches: Iterator[pa.RecordBatch], own: str) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, own):
            found: dict[str, list] = {c: [] for c in added}
            for t in texts:
                doc, failed, ran = Text(t), None, 0
                for rule in rules:
                    ran += 1
                    if rule.rejects(doc):
                        failed = rule.name
                        break
                found["kept"].append(failed is None)
                found["failed_rule"].append(failed)
                found["rules_run"].append(ran)
                for c in always:
                    found[c].append(doc[c])
            yield extended(piece, **{c: pa.array(v, added[c]) for c, v in found.items()})

    types = {"kept": T.BooleanType(), "failed_rule": T.StringType(), "rules_run": T.IntegerType(), **{c: T.LongType() for c in always}}
    return add_columns(docs, text, [T.StructField(n, t) for n, t in types.items()], run)
