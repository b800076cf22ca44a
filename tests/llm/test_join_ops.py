"""Similarity join, embeddings, components and token encoding against brute force, and awkward inputs."""
import collections
import random

import numpy as np
import pytest

from millrace.llm import bpe, embeddings, jaccard
from millrace.llm.components import connected_components
from millrace.llm.queries import vocabulary


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size, similarity):
    own, sets = {i: shingles(t, size) for i, t in rows}, Sets()
    for a in own:
        for b in own:
            both = len(own[a] & own[b])
            if a < b and both and 100 * both >= similarity * (len(own[a]) + len(own[b]) - both):
                sets.join(a, b)
    return {i: (len(s), sets.root(i)) for i, s in own.items()}


def families(seed, n):
    """Copies, chains of edits, short texts and a passage that many texts share."""
    rng, rows = random.Random(seed), []
    passage = [f"shared{k}" for k in range(12)]
    for k in range(n):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 4, 5, 8, 40, 90]))] + (passage if k % 2 else [])
        rows.append(text)
        for _ in range(rng.choice([0, 0, 1, 5])):
            text = list(text)
            for _ in range(rng.choice([0, 1, 2])):
                text[rng.randrange(len(text))] = f"w{rng.randrange(3000)}"
            rows.append(text)
    rng.shuffle(rows)
    return [(i, rng.choice([" ", "\n"]).join(w.upper() if i % 3 == 0 else w for w in t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size,similarity,block", [(4, 85, 1024), (5, 80, 1024), (4, 85, 4)])
def test_similarity_join_against_brute_force(frame, monkeypatch, size, similarity, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rows = families(size, 60)
    got = jaccard.similar_documents(frame("doc_id long, text string, g long", [(*r, 0) for r in rows]), size=size, similarity=similarity)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, size, similarity)


def test_prefixes_of_similar_sets_share_enough():
    rng = random.Random(3)
    for _ in range(600):
        a = set(rng.sample(range(300), rng.randrange(1, 250)))
        b = {x for x in a if rng.random() < 0.95} | set(rng.sample(range(300), rng.randrange(0, 6)))
        both = len(a & b)
        if b and 100 * both >= 85 * len(a | b):
            shared = set(sorted(a)[: jaccard.prefix_length(len(a), 85)]) & set(sorted(b)[: jaccard.prefix_length(len(b), 85)])
            assert len(shared) >= jaccard.least_common(-(-85 * len(a) // 100)) and len(shared) >= jaccard.least_common(-(-85 * len(b) // 100))


def test_similarity_join_of_awkward_rows(frame):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "same words here"), (5, "SAME words\there"), (5, "same words here"), (None, "same words here"), (6, "x " * 50_000), (7, "x " * 50_000)]
    got = sorted(map(tuple, jaccard.similar_documents(frame("doc_id long, text string", rows)).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, None), (6, 1, 6), (7, 1, 6)]
    assert got == sorted(want, key=str)
    assert jaccard.similar_documents(frame("doc_id long, text string", [])).count() == 0


def test_components_of_chains_and_stars(frame):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1060)] + [(7, 7), (1059, 2000), (1059, 2000)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r.id: r.component for r in connected_components(frame("a long, b long", edges)).collect()}
    assert got == {i: sets.root(i) for i in sets.up}
    assert connected_components(frame("a long, b long", [])).count() == 0


def brute_links(rows, least=0.9):
    usable = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, sets = collections.Counter(), Sets()
    for a, x in usable.items():
        for b, y in usable.items():
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a] += 1
                sets.join(a, b)
    return {i: (links[i], sets.root(i)) for i, _ in rows}


def test_audit_sees_small_families_beside_a_hot_one(spark):
    """A graph that reaches only the hot family: most pairs are found, but every small family would be lost."""
    rng = np.random.default_rng(3)
    near = lambda k, n: embeddings._unit(np.repeat(rng.normal(size=(k, 16)), n, axis=0) + 0.02 * rng.normal(size=(k * n, 16)))
    all_rows = np.concatenate([near(1, 400), near(50, 2)])
    schema = "id long, copies long, embedding array<float>, dim int, shard long, block long"
    dealt = spark.createDataFrame([(i, 1, v.tolist(), 16, 0, 0) for i, v in enumerate(all_rows)], schema)
    built = embeddings.build_shards(dealt.drop("block"))
    row = built.first()
    base = np.frombuffer(row.layers[0], np.int32).reshape(len(all_rows), -1).copy()
    base[400:], base[base >= 400] = -1, -1
    cut_off = spark.createDataFrame([(16, 0, bytes(row.ids), bytes(row.copies), bytes(row.vectors), [base.tobytes()], 0)], built.schema)
    links = {r.id: r.links for r in embeddings.query_shards(dealt, cut_off).where("links > 0").collect()}
    assert all(links.get(i, 0) >= 1 for i in range(400, 500)) and all(links[i] == 399 for i in range(400))


def test_embeddings_against_brute_force(frame):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 30] + rng.normal(size=16) * (0.02 if i % 3 else 0.4)]) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0, None] + [0.0] * 14), (2005, [float("inf")] + [1.0] * 15), (2006, rows[0][1][:8]), (2007, rows[0][1][:8])]
    got = embeddings.near_duplicates(frame("vec_id long, embedding array<float>, label int, shard long", [(*r, 1, 2) for r in rows]))
    want = brute_links(rows)
    found = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
    assert set(found) == set(want)
    assert sum(f[0] for f in found.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert all(found[i][0] <= want[i][0] for i in want) and [found[i] for i in range(2000, 2006)] == [(0, i) for i in range(2000, 2006)]
    assert found[2006] == (1, 2006) and found[2007] == (1, 2006)
    assert embeddings.near_duplicates(frame("vec_id long, embedding array<float>", [])).count() == 0


def test_beams_widen_over_a_clique(frame):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(600, 24)), rng.normal(size=24) + 0.05 * rng.normal(size=(500, 24))]).astype(np.float32)
    unit = embeddings._unit(vectors[rng.permutation(len(vectors))])
    graph = embeddings.Graph.build(unit)
    q, p = graph.within(unit, 0.9, 16)
    true = np.argwhere(unit @ unit.T >= 0.9)
    assert len(np.intersect1d(q * 2000 + p, true[:, 0] * 2000 + true[:, 1])) >= 0.99 * len(true)
    alone = embeddings.Graph.build(unit[:1])
    assert [list(x) for x in alone.within(unit[:1], 0.9, 16)] == [[0], [0]]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


TEXTS = [
    None, "", " \n\t", "Hello  World's 123 ÀÉ", "a<|endoftext|>B <|startoftext|>", "<|endoftext|>", "Σίσυφος ΟΔΟΣ", "x\x1cy \x85z", "ǅ İstanbul", "a\u0338 \u0301b >\u0338",
    "日本語 test…!!", "don'T  'S we'LL", "a" * 30_000, "!?" * 9_000, "é" * 8_000 + "zz", "thethethe" * 3_000, "\u200b\u3000 \U0001F600\U0001F468\u200d\U0001F469", "0123456789" * 20,
]


def test_encoding_and_decoding_equal_the_library(spark, frame, library, data):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcdefgthein<|> '\u00df1!") for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    docs = frame("i int, text string, ids string", [(i, t, "old") for i, t in enumerate(texts)])
    for row in bpe.encode_decode(docs, vocabulary()).collect():
        ids = library.encode(texts[row.i] or "", add_special_tokens=False).ids
        assert list(row.ids) == ids and row.decoded == library.decode(ids, skip_special_tokens=False)
    coded = bpe.encode(docs, vocabulary())
    assert [tuple(r) for r in bpe.decode(coded, vocabulary()).orderBy("i").select("i", "decoded").limit(5).collect()] == [
        (i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in enumerate(texts[:5])
    ]
    assert bpe.encode_decode(frame("i int, text string", []), vocabulary()).count() == 0


def test_round_trip_to_plain_text():
    tables = bpe.load(vocabulary())
    coder, machine = bpe.Transducer(tables), bpe.Decoder(tables, joined=False)
    text = "naïve café 日本語 straße \U0001F600"
    ids = coder.encode(text)
    whole = "".join(machine.push([i]) for i in ids) + machine.close()
    assert whole.split() == text.split()
    assert machine.push([int(tables.inner[0xE6])]) == "" and machine.close() == "\ufffd"


def test_tokens_are_emitted_before_the_text_ends(library):
    """What ``push`` returns is final and comes early: a text of any length leaves at most a word open."""
    coder = bpe.Transducer(bpe.load(vocabulary()))
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdehiorstßé'!") for _ in range(rng.randrange(1, 14))) for _ in range(4000))
    want = library.encode(text, add_special_tokens=False).ids
    got = []
    for at in range(0, len(text), 100):
        got += np.frombuffer(coder.push(text[at : at + 100]), np.int32).tolist()
        assert got == want[: len(got)]
    assert len(want) - len(got) < 20 and got + np.frombuffer(coder.close(), np.int32).tolist() == want
    parts = list(coder.long_word(("thethinghe" * 3000).encode()))  # one word, window by window
    assert len(parts) > 10 and np.frombuffer(b"".join(parts), np.int32).tolist() == library.encode("thethinghe" * 3000, add_special_tokens=False).ids


def test_cache_is_bounded_in_bytes(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    coder = bpe.Transducer(bpe.load(vocabulary()))
    for k in range(40):
        text = " ".join(f"word{k}x{i}" for i in range(50)) + " again and again"
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert len(coder._young) < 250 and len(coder._old) < 250


def test_lookahead_settles_every_token():
    """On a small merge list: settled tokens of a beginning are those of every continuation, and most tokens are settled."""
    merges = [("a", "b"), ("b", "a"), ("ab", "ab"), ("c", "a"), ("abab", "c"), ("ba", "c")]
    vocab = {s: i for i, s in enumerate(dict.fromkeys([*bpe.byte_symbols(), *[a + b for a, b in merges]]))}
    spec = {"model": {"vocab": vocab, "merges": merges}, "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": r"\S+"}}]}}
    coder = bpe.Transducer(bpe.Tables.of(spec))
    assert coder.lookahead == 5
    rng, early = random.Random(2), 0
    for _ in range(300):
        text = [vocab[rng.choice("abc")] for _ in range(80)]
        whole = coder.merged(text)
        for cut in (10, 20, 30, 60):
            settled = coder.settled(text[:cut])
            assert settled == whole[: len(settled)]
            early += len(settled) > 0
    assert early > 1100
