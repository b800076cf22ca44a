"""Prefix trie, whitening and license scans against brute force, and awkward inputs."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses, prefix_trie, queries, whitening

TURNS = "conv_id long, turn long, role string, text string, conv string, depth int"


def written(spark, tmp_path, name, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), mark, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        full[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * words
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(
        (min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p], digest(p)) for p, who in members.items()
    )


def trie_rows(spark, tmp_path, frame, rows):
    sf = written(spark, tmp_path, "conversations", frame(TURNS, [(*r, "x", 1) for r in rows]))
    return sorted(map(tuple, queries.op11_prefix_trie(spark, sf).collect()))


def test_trie_against_brute_force(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 8)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 16)
    rng = random.Random(5)
    say = lambda: rng.choice(["yes", "no  no", "a b c", "", None, "\t one two "])
    rows = []
    for c in rng.sample(range(-45, 400), 220):
        for k in range(rng.choice([0, 1, 2, 3, 5])):
            rows.append((c, rng.choice([k, k, None, 1]), rng.choice(["user", "bot", None]), say()))
    for c in (1003, 1004, 1005, 1044):  # copies in hundreds of turns, which part late; and one of a segment exactly
        rows += [(c, k, "user", f"turn {k}") for k in range(150)]
    rows += [(1004, 150, "user", "more"), (1005, 150, "user", "less"), (1005, 151, "bot", "end")]
    rows += [(1100, k, "user", f"turn {k}") for k in range(64)] + [(None, 1, "user", "nobody's")] + rows[:5]
    assert trie_rows(spark, tmp_path, frame, rows) == brute_trie(rows)


def test_trie_of_one_beginning_and_of_nothing(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 8)
    rows = [(c, 0, "user", "hello there") for c in range(300)] + [(c, 1, "bot", f"no {c % 7}") for c in range(0, 300, 3)]
    rows += [(c, 2, "bot", "bye") for c in range(300)]
    assert trie_rows(spark, tmp_path / "some", frame, rows) == brute_trie(rows)
    assert trie_rows(spark, tmp_path / "none", frame, []) == []


def brute_whitening(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float))
    centred = x - x.mean(0)
    values, turns = np.linalg.eigh(centred.T @ centred / len(x))
    values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
    return values, centred @ turns / np.sqrt(values), values / (centred**2).sum() * len(x), x


@pytest.mark.parametrize("dimension", [5, 48, 150])
def test_whitening_against_numpy(frame, dimension):
    rng = np.random.default_rng(dimension)
    vectors = rng.normal(size=(400, dimension)) * np.exp(-np.arange(dimension) / dimension * 3) + 2
    rows = [(i, v.tolist(), "c") for i, v in enumerate(vectors.astype(np.float32))]
    got = sorted(whitening.whiten(frame("vec_id long, embedding array<float>, component string", rows)).collect())
    values, white, explained, x = brute_whitening([r[1] for r in rows])
    k = len(values)
    assert [(r.vec_id, r.component) for r in got] == [(i, c) for i in range(400) for c in range(1, k + 1)]
    own = np.array([r.whitened for r in got]).reshape(400, k)
    own *= np.sign((own * white).sum(0))
    assert np.abs(own - white).max() < 1e-8
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-12)
    shifted, n = [[int(v) + 1_000_000 for v in row] for row in x.tolist()], len(x)
    sums = [sum(c) for c in zip(*shifted)]
    assert [r.deviation for r in got[::k]] == [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in shifted]
    assert {r.n for r in got} == {400} and max(r.identity_error for r in got) < 1e-10


def test_solver_needs_few_products_and_handles_low_rank():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 12)) @ rng.normal(size=(12, 200))
    count = 0

    def product(block):
        nonlocal count
        count += 1
        return x.T @ (x @ block) / len(x)

    values, vectors, residual = whitening.jacobi_davidson(product, 200, 32)
    assert np.allclose(values[:12], np.linalg.eigvalsh(x.T @ x / len(x))[::-1][:12], rtol=1e-12)
    assert residual <= whitening.RESIDUAL * values[0] and np.allclose(vectors.T @ vectors, np.eye(32), atol=1e-12) and count < 100


def test_partial_sums_are_added_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rows = spark.range(0, 500, 1, 29).select(F.array("id", F.col("id") * 2).alias("x"))
    assert whitening._summed(rows, lambda x: x.sum(0), (2,)).tolist() == [124750.0, 249500.0]


def test_whitening_of_awkward_rows(frame):
    schema = "vec_id long, embedding array<double>, n string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, "a"), (2, [1.0, None], "a"), (3, [nan, 1.0], "a"), (4, [1.0, -inf], "a"), (5, [], "a"), (6, [1.0], "a"), (7, [1e300, 0.0], "a")]
    good = [(8, [1.0, 2.0], "a"), (8, [1.0, 2.0], "a"), (None, [-3.5, 0.25], "b"), (9, [0.0, 7.0], None)]
    got = whitening.whiten(frame(schema, rows + good)).collect()
    assert collections.Counter(r.vec_id for r in got) == {8: 4, None: 2, 9: 2} and {r.n for r in got} == {4}
    assert whitening.whiten(frame(schema, rows[:5])).count() == 0 and whitening.whiten(frame(schema, [])).count() == 0
    assert whitening.whiten(frame(schema, [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "b")])).count() == 0
    line = whitening.whiten(frame(schema, [(i, [float(i), 2.0 * i, 5.0], "a") for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 3], [5, 6]])
    assert whitening._deviations(x, 1 << 20, (7, 8)) == [None, (5 * (1 << 20) - 7) ** 2 + (6 * (1 << 20) - 8) ** 2]


PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in starts]
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted({label for _, label in starts})


def test_license_phrases_against_brute_force(frame):
    rng = random.Random(3)
    bits = ["all", "rights", "Reserved", "general", "PUBLIC", "license", "cc", "by", "été", "all-rights", "x y", "42", "K", "_", "."]
    texts = ["".join(w + rng.choice([" ", "-", "\n", "--", "\x00"]) for w in rng.choices(bits, k=rng.randrange(60))) for _ in range(300)]
    texts += [None, "", " \n", "CC BY " * 3000, "all rights " * 5000, "x" * 100_000, texts[0]]
    rows = [(i, t, "extra", 1) for i, t in enumerate(texts)]
    got = licenses.find_licenses(frame("doc_id long, text string, labels string, `a.b` int", rows))
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in sorted(got.collect(), key=lambda r: r.doc_id)] == [brute_licenses(t) for t in texts]
    assert "a.b" in got.columns and got.columns.count("labels") == 1
    assert licenses.find_licenses(frame("text string", [])).count() == 0


def test_templates_are_found_with_small_changes_and_only_with_their_phrases(frame):
    texts, wanted = [], []
    prose = "the software of this and the license for any person or use in the work " * 40
    for t in licenses.TEMPLATES:
        words = t.text.split()
        texts.append(f"{prose} {t.text} {prose}")
        wanted.append(t.label)
        changed = " ".join(words[:9] + words[10:20] + ["inserted", "words"] + words[20:])
        if len(words) > 30 and all(b" ".join(licenses.words_of(p)) in b" ".join(licenses.words_of(changed)) for p in t.phrases):
            texts.append(changed)
            wanted.append(t.label)
    texts += [prose, " ".join(reversed(licenses.TEMPLATES[4].text.split())), "mit license"]
    wanted += [None] * 2 + [None]
    got = sorted(licenses.find_licenses(frame("doc_id long, text string", list(enumerate(texts)))).collect())
    for r, label in zip(got, wanted):
        found = set(r.labels)
        assert (label in found) if label else not found - set(r.base_labels), (texts[r.doc_id][:80], r.labels)
        assert 0 <= r.score <= 1 and set(r.base_labels) <= found
    assert got[0].matches[0].first_word == len(prose.split())


def test_document_frequencies_count_rows(spark, frame):
    index = licenses.Index()
    found, rows = licenses.document_frequencies(frame("text string", [("license license",), ("The LICENSE",), (None,), ("other",)]).repartition(3), index)
    assert rows == 4 and found == {index.words[b"license"]: 2, index.words[b"the"]: 1}
