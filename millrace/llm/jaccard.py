"""Set-similarity join of documents on word shingles by a token-group matrix.

Documents are sets of hashed shingles. Equal sets are one set. Similar sets are put into groups, by the smallest hash among
their shingles that many documents share (all their shingles if there is none); a group that outgrows a block is cut into
several. The token-group matrix holds, per group, the union of its tokens.

A set can only be similar to a member of a group if enough of its tokens are in that group's union. The first bound uses a
part of the tokens: order all tokens the same way, frequent ones last; two sets A and B with similarity s then share at
least k tokens among the first |A| - ceil(s * |A|) + k of A and the same of B, and their sizes differ by a factor of s at
most. So the matrix is first kept for those tokens alone, with the sizes of the sets that show each, and joined with
itself: a join on rare tokens, whose counts say which groups a set has to open. In a task that holds two groups the full bound
follows: sets with fewer than ceil(s * n) tokens in the other group's union leave, and only what remains is compared, as
a product of two token matrices in slices of bounded size. Tasks return one row per set and component, never all pairs.

The order only decides how much work there is: it comes from a sample of the documents. Links are exact up to collisions
of 64-bit shingle hashes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.batches import extended, slices
from millrace.llm.components import connected_components
from millrace.session import cut

SHINGLE = 4
SIMILARITY = 85
BLOCK_SETS = 512
BLOCK_TOKENS = 1 << 19
SAMPLE_SHARE = 16
FREQUENT_AT = 3
MAX_FREQUENT = 1 << 18
FILTER_BITS = 1 << 23
CACHED_WORDS = 60_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Shingler:
    """Sorted distinct shingle hashes of a text; words are hashed once while the bounded cache lasts."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size = size
        self._known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self._known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.size + 1)
        out = np.full(n, min(len(words), self.size), np.uint64)  # a short sequence is no prefix of a longer one
        for k in range(min(len(words), self.size)):
            out = _mixed(out * _MIX[0] + codes[k : k + n])
        return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def least_common(n: int) -> int:
    """Tokens that the prefixes of two similar sets share at least, both being of ``n`` tokens or more."""
    return 1 + n // 32


def prefix_length(n: int, similarity: int) -> int:
    return min(n, n - -(-similarity * n // 100) + least_common(n))


def frequent_tokens(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of shingles that ``FREQUENT_AT`` or more documents of a hashed sample share, at most ``MAX_FREQUENT``.

    They only set the order of tokens, so neither the sample nor the bound changes a result.
    """
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE_SHARE)) == 0).select(F.col(text).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for _, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t) for t in texts]).view(np.int64))], ["token"])

    counted = sample.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= FREQUENT_AT)
    rows = counted.orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().view(np.uint64))


def sketches(docs: DataFrame, key: str, text: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(key, n_shingles, print, group, prefix): size and 128-bit print of every set, its group key and its first tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, text, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, frequent = Shingler(size), sent.value
        for piece, texts in slices(batches, "text"):
            counts, prints, groups, firsts = [], [], [], []
            for t in texts:
                tokens = shingles(t)
                n = len(tokens)
                counts.append(n)
                prints.append(xxhash.xxh128_digest(tokens.tobytes()) if n else None)
                often = _within(tokens, frequent)
                ordered = np.concatenate([tokens[~often], tokens[often]])
                groups.append(int((tokens[often] if often.any() else tokens)[0].view(np.int64)) if n else None)
                firsts.append(ordered[: prefix_length(n, similarity)].view(np.int64) if n else None)
            yield extended(
                piece.select([key]), n_shingles=pa.array(counts, pa.int64()), print=pa.array(prints, pa.binary()),
                group=pa.array(groups, pa.int64()), prefix=pa.array(firsts, pa.list_(pa.int64())),
            )

    schema = T.StructType([docs.schema[key], T.StructField("n_shingles", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("group", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def _within(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(tokens):
        return np.zeros(len(tokens), bool)
    return table[np.minimum(np.searchsorted(table, tokens), len(table) - 1)] == tokens


def group_pairs(sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(id, g1, g2, g): the pairs of groups in whose comparison a set has to take part; g is its own, one of the two.

    ``sets`` has id, n_shingles, group and prefix. Sets without a token that another one shows leave at once. Groups
    above a block are cut by a hash of the id.
    """
    tokens = sets.select("id", F.explode("prefix").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("_n")).where("_n > 1").select("token")
    query = cut(tokens.join(held, "token", "left_semi"), "tokens")
    part = sets.select("id", "n_shingles", "group").join(query.select("id").distinct(), "id", "left_semi")
    sizes = part.groupBy("group").agg(F.count("*").alias("_sets"), F.sum("n_shingles").alias("_tokens"))
    cuts = F.greatest(F.ceil(F.col("_sets") / BLOCK_SETS), F.ceil(F.col("_tokens") / BLOCK_TOKENS))
    placed = part.join(sizes.select("group", cuts.alias("_cuts")), "group")
    placed = cut(placed.select("id", F.col("n_shingles").alias("n"), F.xxhash64("group", F.pmod(F.xxhash64("id"), F.col("_cuts"))).alias("g")), "groups")
    query = query.join(placed, "id")
    matrix = query.groupBy("token", "g").agg(F.count("*").alias("shown"), F.min("n").alias("low"), F.max("n").alias("high")).withColumnRenamed("g", "o")
    fits = (100 * F.col("high") >= similarity * F.col("n")) & (similarity * F.col("low") <= 100 * F.col("n"))
    met = query.join(matrix, "token").where(fits & ((F.col("g") != F.col("o")) | (F.col("shown") > 1)))
    met = met.groupBy("id", "g", "o", "n").agg(F.count("*").alias("common"))
    least = 1 + F.floor(F.ceil(similarity * F.col("n") / 100) / 32)  # as least_common says of the smallest set that fits
    return met.where(F.col("common") >= least).select("id", F.least("g", "o").alias("g1"), F.greatest("g", "o").alias("g2"), "g")


def compare_groups(members: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(a, b): every set with the first set of its component, per pair of groups; ``members`` has g1, g2, g, id and ``tokens``."""
    def run(table: pa.Table) -> pa.Table:
        own = table.column("g").to_numpy()
        first = own == table.column("g1")[0].as_py()
        ids = table.column("id").to_numpy()
        sets = [row.values.to_numpy().view(np.uint64) for row in table.column("tokens")]
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        if not len(right) and table.column("g1")[0].as_py() == table.column("g2")[0].as_py():
            right = left
        links = _links(sets, left, right, similarity)
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

    return members.groupBy("g1", "g2").applyInArrow(run, "a long, b long")


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: int, width: int = 512) -> list[tuple[int, int]]:
    """Components of the links between the two sides, as (member, first) rows; sides may be the same.

    Beside the tokens themselves this holds a sorted copy of them, then 8 bytes for every token that two sets share, then one
    slice of ``width`` tokens of the product.
    """
    same = left is right
    if not len(left) or not len(right):
        return []
    need = lambda k: -(-similarity * len(sets[k]) // 100)
    if not same:  # open only for sets with enough tokens in the other group's union
        for _ in range(2):
            union = np.unique(np.concatenate([sets[k] for k in right]))
            left = np.array([k for k in left if _within(sets[k], union).sum() >= need(k)], int)
            if not len(left):
                return []
            left, right = right, left
        del union
    sides = left if same else np.concatenate([left, right])
    shared = _repeated(np.concatenate([sets[k] for k in sides]))
    row, column = _cells([sets[k] for k in sides], shared)
    n_left = len(left)
    common = np.zeros((n_left, n_left if same else len(right)), np.float32)
    dense = np.zeros((len(sides), width), np.float32)
    for at in range(0, len(shared), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense[row[lo:hi], column[lo:hi] - at] = 1
        common += dense @ dense.T if same else dense[:n_left] @ dense[n_left:].T
        dense[row[lo:hi], column[lo:hi] - at] = 0
    size_left = np.array([len(sets[k]) for k in left])
    size_right = size_left if same else np.array([len(sets[k]) for k in right])
    hit = common >= -(-similarity * (size_left[:, None] + size_right[None, :]) // (100 + similarity))
    return _forest(hit, left, left if same else right, same)


def _repeated(tokens: np.ndarray) -> np.ndarray:
    """Sorted tokens that stand there twice or more; ``tokens`` is sorted in place."""
    tokens.sort()
    again = tokens[1:][tokens[1:] == tokens[:-1]]
    return again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again


def _cells(sets: list[np.ndarray], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the tokens of ``sets`` that are in ``shared``, by column: 32-bit numbers, dealt by counting."""
    ends = np.zeros(len(shared) + 1, np.int32)
    for own in sets:
        ends[1:][_columns(own, shared)] += 1
    np.cumsum(ends, out=ends)
    free, row = ends[:-1].copy(), np.zeros(int(ends[-1]), np.int32)
    for k, own in enumerate(sets):
        columns = _columns(own, shared)
        row[free[columns]] = k
        free[columns] += 1
    return row, np.repeat(np.arange(len(shared), dtype=np.int32), np.diff(ends))


def _columns(tokens: np.ndarray, shared: np.ndarray) -> np.ndarray:
    if not len(shared):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
    return at[shared[at] == tokens]


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links every element to the first of its component: labels spread along the rows and columns of the hits."""
    far = len(left) + len(right)
    of_left = np.arange(len(left))
    of_right = of_left if same else np.full(len(right), far)
    while True:
        new_right = np.minimum(of_right, np.where(hit, of_left[:, None], far).min(0))
        new_left = np.minimum(of_left, np.where(hit, new_right[None, :], far).min(1))
        if (new_left == of_left).all() and (new_right == of_right).all():
            break
        of_left, of_right = new_left, (new_left if same else new_right)
    out = [(int(left[i]), int(left[k])) for i, k in enumerate(of_left) if k != i]
    return out if same else out + [(int(right[j]), int(left[k])) for j, k in enumerate(of_right) if k < far]


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(key, n_shingles, component_id) of every row: component_id is the smallest key that links lead to.

    Two rows link if 100 * |A and B| >= similarity * |A or B|. Null texts and texts without words have no shingle and link
    with nothing. ``key`` must be an integer; rows that share a key are one document with several sets, and a null key
    stays null.
    """
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = cut(sketches(own, "id", "text", size, similarity), "sketches")
    some = rows.where("print is not null and id is not null")
    copies = some.groupBy(F.col("print").alias("_print")).agg(F.min("id").alias("_first"))
    paired = some.join(copies, F.col("print") == F.col("_print"))
    chosen = cut(paired.where("id = _first").select("id", "n_shingles", "group", "prefix", "print").dropDuplicates(["id", "print"]), "sets")
    same = some.select("id", "print").join(copies, F.col("print") == F.col("_print")).where("id <> _first")
    opened = cut(group_pairs(chosen.select("id", "n_shingles", "group", "prefix"), similarity), "opened")
    members = opened.join(_token_sets(own, opened, size), "id").select("g1", "g2", "g", "id", "tokens")
    links = compare_groups(members, similarity)
    found = connected_components(links.union(same.select("id", "_first")))
    out = rows.select("id", "n_shingles").join(found, "id", "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _token_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, tokens) of the texts whose id is in ``wanted``, and of a few others.

    A bitmap of ``FILTER_BITS`` hashed ids, a fixed size, keeps most other texts out of the join that follows; where it is
    full it lets all pass and the join decides alone.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = wanted.select(slot("id").alias("slot")).groupBy(F.floor(F.col("slot") / 32).alias("word"))
    rows = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, words = Shingler(size), sent.value
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            kept = batch.filter(pa.array((words[slots // 32] >> (slots % 32).astype(np.uint32) & 1) > 0))
            for piece, found in slices([kept], "text"):
                yield extended(piece.select(["id"]), tokens=pa.array([shingles(t).view(np.int64) for t in found], pa.list_(pa.int64())))

    return texts.where("id is not null").select("id", "text", slot("id").alias("slot")).mapInArrow(run, "id long, tokens array<long>")
