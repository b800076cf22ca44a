"""Byte-pair encoding as a streaming transducer with a bounded lookahead, and decoding as a state machine.

Two facts settle tokens early. No rule reaches beyond the end of a word, so whatever stands before the last white space read
is final. Inside a word, let L be the length of the longest string that a rule makes. The tokens of a word up to one of their
ends are the tokens of the word cut off there. Every continuation has such an end among the last L places read, so it begins
with the tokens of one of the last L prefixes: tokens that all of these share are final. L is the lookahead; a word of any
length needs one window, which grows only while those prefixes disagree. They are compared on the last few tokens alone,
because a row of tokens is an encoding if and only if each two neighbours are the encoding of their own string.

Memory is a window, the text's longest run without white space, a cache bounded in bytes and one set of arrays of the merge list,
which the driver reads once and sends to the tasks.

Vocabulary files are those of the public ``tokenizers`` library: a BPE model with byte-level symbols, an optional
end-of-word suffix, no dropout and no decoder (decoded text is then the token strings joined by one space).
"""
from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.batches import add_columns, extended, quoted, slices

CACHE_BYTES = 16 << 20
ENTRY_BYTES = 190
PART = 1 << 16
GROUP = 1 << 19
SHORT = 48
CELLS = 1 << 18
WINDOW = 2048
IDS = 1 << 14
SLICE = 1 << 20
_MARK = " "  # no chunk holds white space, so a marked special token meets no text


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(plain)))
    return [table[b] for b in range(256)]


@dataclass(frozen=True)
class Tables:
    """A merge list and vocabulary as arrays. ``keys`` are the rules as left * size + right, sorted, ``ranks`` their ranks; ``made``
    is by rank; ``lengths`` counts the symbols of each id; token i is ``blob[bounds[i]:bounds[i + 1]]``."""

    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    inner: np.ndarray
    last: np.ndarray
    lengths: np.ndarray
    lookahead: int
    special: dict[str, int]
    suffix: str
    pattern: str
    blob: bytes
    bounds: np.ndarray

    @classmethod
    def of(cls, spec: dict) -> Tables:
        model = spec["model"]
        suffix: str = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*ids.values(), *special.values()]) + 1
        symbols = byte_symbols()
        lengths = np.zeros(size, np.int32)
        for c in symbols:
            lengths[[ids[c], ids[c + suffix]]] = 1
        keys, made = [], []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, both = ids[a], ids[b], ids[a + b]
            keys.append(left * size + right)
            made.append(both)
            lengths[both] = lengths[left] + lengths[right]
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        tokens = [b""] * size
        for token, i in {**ids, **special}.items():
            tokens[i] = token.encode()
        return cls(
            np.array(keys, np.int64)[order], order.astype(np.int32), np.array(made, np.int32), np.array([ids[c] for c in symbols], np.int32),
            np.array([ids[c + suffix] for c in symbols], np.int32), lengths, int(lengths.max()), special, suffix,
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], b"".join(tokens), np.cumsum([0, *map(len, tokens)]),
        )

    def token(self, i: int) -> bytes | None:
        """The token's string; null for an id that is none."""
        known = 0 <= i < len(self.bounds) - 1 and self.bounds[i] < self.bounds[i + 1]
        return self.blob[self.bounds[i] : self.bounds[i + 1]] if known else None


def load(path: str) -> Tables:
    with open(path, encoding="utf-8") as file:
        return Tables.of(json.load(file))


class Transducer:
    """Text to token ids. ``push`` takes a text part by part and returns what is settled; ``close`` ends the text.

    Chunks between white space are remembered in two generations of at most ``CACHE_BYTES``: when the young one is full it
    becomes the old one, whose chunks come back as they are met.
    """

    def __init__(self, tables: Tables) -> None:
        self.tables = tables
        self.lookahead = tables.lookahead
        self._special = re.compile("|".join(map(re.escape, sorted(tables.special, key=len, reverse=True))) or r"(?!)")
        self._pieces = regex.compile(tables.pattern)
        self._keys = array("q", tables.keys.tobytes())
        self._marks = {_MARK + t: np.int32(i).tobytes() for t, i in tables.special.items()}
        self._young: dict[str, bytes] = dict(self._marks)
        self._old: dict[str, bytes] = {}
        self._held = 0
        self._rest = ""

    def push(self, part: str) -> bytes:
        """Ids, as the bytes of 32-bit integers, that whatever follows leaves as they are."""
        text = self._rest + part
        cut = max((m.end() for m in _SPACE.finditer(text, max(0, len(self._rest) - 1))), default=0)
        self._rest = text[cut:]
        return self._coded([text[:cut]])[0] if cut else b""

    def close(self) -> bytes:
        text, self._rest = self._rest, ""
        return self._coded([text])[0] if text else b""

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], np.int32).tolist()

    def encode_many(self, texts: Sequence[str]) -> list[bytes]:
        """All ids of each text; parts of several texts go through together, as many as fit a bounded group."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, str]] = []
        held = 0
        for k, text in enumerate(texts):
            for part in _parts(text):
                group.append((k, part))
                held += len(part)
                if held >= GROUP:
                    self._emit(group, out)
                    group, held = [], 0
        self._emit(group, out)
        return [b"".join(parts) for parts in out]

    def _emit(self, group: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        for (k, _), ids in zip(group, self._coded([part for _, part in group])):
            out[k].append(ids)

    def _coded(self, parts: list[str]) -> list[bytes]:
        rows = [self._marked(part) for part in parts]
        known = self._known({c for row in rows for c in row})
        return [b"".join([known[c] for c in row]) for row in rows]

    def _marked(self, text: str) -> list[str]:
        """Chunks between white space; special tokens are marked chunks of their own, found before the text is normalised."""
        if "<|" not in text:
            return _chunks(text)
        out, at = [], 0
        for found in self._special.finditer(text):
            out += [*_chunks(text[at : found.start()]), _MARK + found[0]]
            at = found.end()
        return out + _chunks(text[at:])

    def _split(self, chunk: str) -> list[str]:
        # lower() has one rule that looks at neighbours, for the last sigma of a word; normalisation is per character
        plain = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("\u03a3", "\u03c3")
        plain = plain.lower()
        if max(plain) < _LATIN:  # letters, or letters and one sign after them
            if plain.isalpha():
                return [plain]
            if plain[:-1].isalpha() and plain[-1] in _SIGNS:
                return [plain[:-1], plain[-1]]
        return self._pieces.findall(plain)

    def _known(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of every chunk, all of them in the young generation when this returns."""
        if self._held > CACHE_BYTES:
            self._old, self._young, self._held = self._young, dict(self._marks), 0
        young, old = self._young, self._old
        missing = chunks - young.keys()
        found = {c: old[c] for c in missing & old.keys()}
        fresh = list(missing - old.keys())
        split = [self._split(c) for c in fresh]
        words = sorted({w for row in split for w in row}, key=len)
        ids = dict(zip(words, self.words([w.encode() for w in words])))
        found.update(zip(fresh, [ids[row[0]] if len(row) == 1 else b"".join([ids[w] for w in row]) for row in split]))
        self._held += ENTRY_BYTES * len(found) + sum(map(len, found)) + sum(map(len, found.values()))
        young.update(found)
        return young

    def words(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of each word; words of similar length side by side use the batches best."""
        out: list[bytes] = []
        at = 0
        while at < len(words):
            if len(words[at]) > SHORT:
                out.append(b"".join(self.long_word(words[at])))
                at += 1
                continue
            group = words[at : at + max(1, CELLS // (len(words[at]) + 9))]
            group = group[: next((k for k, w in enumerate(group) if len(w) > SHORT), len(group))]
            out += self._merge_all(group)
            at += len(group)
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, the number of rules where there is none."""
        t = self.tables
        if not len(t.keys):
            return np.zeros(len(left), np.int32)
        key = left.astype(np.int64) * (len(t.bounds) - 1) + right
        at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        return np.where(t.keys[at] == key, t.ranks[at], np.int32(len(t.keys)))

    def _merge_all(self, words: list[bytes]) -> list[bytes]:
        """Merges of many whole words at once: each round applies every word's first rule at its leftmost place."""
        t = self.tables
        count = np.array([len(w) for w in words], np.int32)
        width, none = int(count.max()), len(t.keys)
        flat = np.frombuffer(b"".join(words), np.uint8)
        cells = np.arange(width) < count[:, None]
        ids = np.full((len(words), width + 1), -1, np.int32)
        ids[:, :width][cells] = t.inner[flat]
        some = np.flatnonzero(count)
        ids[some, count[some] - 1] = t.last[flat[np.cumsum(count)[some] - 1]]
        follow = np.tile(np.arange(1, width + 2, dtype=np.int16), (len(words), 1))
        before = np.tile(np.arange(-1, width, dtype=np.int16), (len(words), 1))
        ranks = np.full((len(words), width + 1), none, np.int32)
        r, c = np.nonzero(np.arange(width) < (count - 1)[:, None])
        ranks[r, c] = self._rank(ids[r, c], ids[r, c + 1])
        del r, c, cells
        rows = np.arange(len(words))
        while True:
            k = ranks[rows].argmin(1)
            best = ranks[rows, k]
            going = best < none
            rows, k, best = rows[going], k[going], best[going]
            if not len(rows):
                break
            gone = follow[rows, k]
            ids[rows, k] = t.made[best]
            ids[rows, gone] = -1
            ranks[rows, gone] = none
            after = follow[rows, gone]
            follow[rows, k] = after
            inside = after < count[rows]
            before[rows[inside], after[inside]] = k[inside]
            ranks[rows, k] = none
            x, a, b = rows[inside], k[inside], after[inside]
            ranks[x, a] = self._rank(ids[x, a], ids[x, b])
            prior = before[rows, k]
            inside = prior >= 0
            x, a, b = rows[inside], prior[inside], k[inside]
            ranks[x, a] = self._rank(ids[x, a], ids[x, b])
        kept = ids >= 0
        data = ids[kept].tobytes()
        stops = (4 * np.cumsum(kept.sum(1))).tolist()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops)]

    def long_word(self, word: bytes) -> Iterator[bytes]:
        """Ids of one word in parts: read a window, emit what is settled, go on from there."""
        at, window = 0, WINDOW
        inner = self.tables.inner
        while len(word) - at > window:
            tokens = self.settled(inner[np.frombuffer(word, np.uint8, window, at)].tolist())
            if not tokens:
                window *= 2
                continue
            yield np.array(tokens, np.int32).tobytes()
            at += int(self.tables.lengths[tokens].sum())
            window = WINDOW
        if at < len(word):
            symbols = inner[np.frombuffer(word, np.uint8, offset=at)].tolist()
            symbols[-1] = int(self.tables.last[word[-1]])
            yield np.array(self.merged(symbols), np.int32).tobytes()

    def settled(self, symbols: list[int]) -> list[int]:
        """Tokens at the start of a word that stay whatever follows the symbols read; none if that is not known yet."""
        reach = self.lookahead
        tokens = self.merged(symbols)
        ends = np.cumsum(self.tables.lengths[tokens]).tolist()
        n = bisect_right(ends, len(symbols) - 4 * reach)  # where the comparison starts, a token's end
        start, before = (ends[n - 1], ends[n - 2] if n > 1 else 0) if n else (0, 0)
        shared: list[int] | None = None
        for end in range(max(start + 1, len(symbols) - reach + 1), len(symbols) + 1):
            tail = self.merged(symbols[start:end])
            if n and self.merged(symbols[before : start + int(self.tables.lengths[tail[0]])]) != [tokens[n - 1], tail[0]]:
                return []
            shared = tail if shared is None else [a for k, a in enumerate(shared) if shared[: k + 1] == tail[: k + 1]]
        return tokens[:n] + (shared or [])

    def merged(self, symbols: list[int]) -> list[int]:
        """Merges in rank order, leftmost first within a rank."""
        keys, ranks, made, size, n = self._keys, self.tables.ranks, self.tables.made, len(self.tables.bounds) - 1, len(symbols)

        def rank(a: int, b: int) -> int:
            key = a * size + b
            at = bisect_left(keys, key)
            return int(ranks[at]) if at < len(keys) and keys[at] == key else -1

        left, right, ids = [*range(-1, n - 1)], [*range(1, n + 1)], list(symbols)
        queue = [(r, k) for k in range(n - 1) if (r := rank(symbols[k], symbols[k + 1])) >= 0]
        heapq.heapify(queue)
        while queue:
            best, k = heapq.heappop(queue)
            j = right[k] if ids[k] >= 0 else n
            if j >= n or rank(ids[k], ids[j]) != best:
                continue
            ids[k], ids[j] = int(made[best]), -1
            right[k] = right[j]
            if right[j] < n:
                left[right[j]] = k
            for a, b in ((left[k], k), (k, right[k])):
                if a >= 0 and b < n and (r := rank(ids[a], ids[b])) >= 0:
                    heapq.heappush(queue, (r, a))
        return [i for i in ids if i >= 0]


_RARE_SPACE = re.compile(r"[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")
_LATIN = "\u0250"
_SIGNS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def _chunks(text: str) -> list[str]:
    """Text between Unicode white space; ``str.split`` also cuts at four control characters that are none."""
    return [c for c in _SPACE.split(text) if c] if _RARE_SPACE.search(text) else text.split()


def _parts(text: str) -> Iterator[str]:
    """The text cut at white space into parts of about ``PART`` characters."""
    at = 0
    while len(text) - at > PART:
        space = _SPACE.search(text, at + PART)
        end = space.end() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class Decoder:
    """Ids to text, id by id. ``joined``: token strings with one space between, as a file without a decoder reads.
    Otherwise the bytes behind the tokens as UTF-8, a space after each end of word; characters cut between tokens
    come out when their last byte arrives, broken ones as U+FFFD."""

    def __init__(self, tables: Tables, joined: bool) -> None:
        strings = [tables.token(i) for i in range(len(tables.bounds) - 1)]
        if not joined:
            back, ends = {s: b for b, s in enumerate(byte_symbols())}, tables.suffix.encode()
            special = set(tables.special.values())
            for i, token in enumerate(strings):
                if token is not None and i not in special:
                    last = bool(ends) and token.endswith(ends)
                    core = token[: -len(ends)] if last else token
                    strings[i] = bytes(back[c] for c in core.decode()) + b" " * last
        self._bytes = strings
        self._between = b" " if joined else b""
        self.reset()

    def reset(self) -> None:
        self._state = codecs.getincrementaldecoder("utf-8")("replace")
        self._first = True

    def push(self, ids: Iterable[int]) -> str:
        """Text that is complete after these ids; unknown ids add nothing."""
        known = self._bytes
        data = self._between.join([b for i in ids if 0 <= i < len(known) and (b := known[i]) is not None])
        if data and not self._first:
            data = self._between + data
        self._first &= not data
        return self._state.decode(data)

    def close(self) -> str:
        rest = self._state.decode(b"", True)
        self.reset()
        return rest

    def text(self, ids: np.ndarray) -> str:
        """The whole text of an array of ids, which the machine takes ``IDS`` at a time."""
        return "".join([self.push(ids[at : at + IDS].tolist()) for at in range(0, len(ids), IDS)]) + self.close()


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text as an array; null and empty texts have none.

    ``vocabulary`` is a file that the driver reads; tasks get its arrays. Other columns stay; a column named as ``ids`` is
    replaced.
    """
    return _coded(docs, vocabulary, text, ids, None)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode``, and the text that its ids decode to, in one pass over the rows."""
    return _coded(docs, vocabulary, text, ids, decoded)


def _coded(docs: DataFrame, vocabulary: str, text: str, ids: str, decoded: str | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch], own: str) -> Iterator[pa.RecordBatch]:
        coder, machine = Transducer(sent.value), Decoder(sent.value, True) if decoded else None
        for piece, texts in slices(batches, own, SLICE):
            rows = [np.frombuffer(r, np.int32) for r in coder.encode_many(texts)]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            columns = {ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))}
            if machine:
                columns[decoded] = pa.array([machine.text(r) for r in rows], pa.string())
            yield extended(piece, **columns)

    new = [T.StructField(ids, T.ArrayType(T.IntegerType())), *[T.StructField(c, T.StringType()) for c in [decoded] if c]]
    return add_columns(docs, text, new, run)





def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded", joined: bool = True) -> DataFrame:
    """Adds the text of an array of ids; a null array decodes to the empty text, null elements are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch], own: str) -> Iterator[pa.RecordBatch]:
        machine = Decoder(sent.value, joined)
        for batch in batches:
            texts = [machine.text(np.array([i for i in (r or ()) if i is not None], np.int64)) for r in batch.column(own).to_pylist()]
            yield extended(batch, **{text: pa.array(texts, pa.string())})

    return add_columns(rows, ids, [T.StructField(text, T.StringType())], run)


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of rows from ``encode_decode``; ids and texts are dropped."""
    return coded.select(
        *[F.col(quoted(c)) for c in coded.columns if c not in ("ids", "decoded")],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
