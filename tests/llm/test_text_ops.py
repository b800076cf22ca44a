"""Quality, toxicity, language and mixing: hand-made cases, brute force and awkward inputs."""
import collections
import math
import re
import zlib

import numpy as np
import pytest

from millrace.llm import language, mixing, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, kept string, score string, size string"
LONG = "word " * 60_000 + "end."
ODD = [
    (1, None, None, None, "x", "y", "z"), (2, "", "en", "a", None, None, None), (3, " \t\n\x0b\x0c\r", None, "a", "x", "y", "z"),
    (4, "one two three", "en", None, "x", "y", "z"), (4, "one two three", "en", None, "x", "y", "z"), (None, "a key that is null", "en", "b", None, None, None),
    (5, LONG, "en", "b", None, None, None), (6, "\x1c  café naïve \U0001F600", "fr", "é", None, None, None),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_counts(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdict_against_brute_force(spark, frame, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += [r[1] for r in ODD] + ["a b c d e " * 3, "x\ny\nx\nx\n\n y", "## ** ## $$ word " * 4]
    docs = frame("doc_id long, text string, kept string", [(i, t, "old") for i, t in enumerate(texts)])
    got = quality.quality_cascade(docs, quality.RULES, always=quality.REPORTED).collect()
    assert len(got) == len(texts) and set(got[0].asDict()) == {"doc_id", "text", "kept", "failed_rule", "rules_run", *quality.REPORTED}
    for row in got:
        n, chars, symbols, dup, repeat = brute_counts(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, dup, repeat)
        n_lines = sum(bool(words(x)) for x in (texts[row.doc_id] or "").split("\n"))
        bad = n < 10 or 100 * repeat > 20 * n or 10 * symbols > n or 2 * dup > n_lines or not 2 * n <= chars <= 20 * n
        assert row.kept == (not bad) and (row.failed_rule is None) == row.kept


def test_order_of_rules_changes_no_verdict_but_the_work(spark, frame, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    steps = quality.plan_cascade(docs, sample_rows=100)
    assert {s.rule.name for s in steps} == {r.name for r in quality.RULES}
    one = {r.doc_id: r.kept for r in quality.quality_cascade(docs, steps).select("doc_id", "kept").collect()}
    two = {r.doc_id: r.kept for r in quality.quality_cascade(docs, steps[::-1]).select("doc_id", "kept").collect()}
    assert one == two
    rejected = quality.quality_cascade(frame("text string", [("one two",)]), quality.RULES).collect()
    assert [(r.failed_rule, r.rules_run) for r in rejected] == [("few_words", 1)]


def test_cascade_puts_a_cheap_sharp_rule_first(frame):
    docs = frame("text string", [("short",)] * 50 + [("plain words " * 200,)] * 50)
    dear = quality.Rule("dear", lambda d: d["n_repeat_words"] > 10**9)
    assert quality.plan_cascade(docs, [dear, quality.BASE_RULES[0]])[0].rule.name == "few_words"


def test_quality_without_rows(spark, frame):
    empty = frame(DOCS, [])
    assert [s.rule for s in quality.plan_cascade(empty)] == list(quality.RULES)
    assert quality.quality_cascade(empty, quality.RULES).count() == 0


def test_toxicity_learns_words_and_finds_sentences(frame):
    calm = ["The river runs past the old mill. Birds rest there.", "We walked home. It rained all day long.", "Bread and tea. The garden is green."]
    docs = [(i, calm[i % 3] + (" You are a grumbling scoundrel." if i % 4 == 0 else "") + f" Note {i}.", None, None, None, "old", None) for i in range(160)]
    marks = frame("doc_id long, toxic int", [(i, int(i % 4 == 0)) for i in range(100)] + [(None, 1), (5, None)])
    model = toxicity.fit_from(frame(DOCS, docs), marks)
    got = {r.doc_id: r for r in toxicity.score(frame(DOCS, docs + ODD), model, offending=0.5).collect() if r.doc_id is not None and r.doc_id > 99}
    assert all((r.score >= 0.7) == (i % 4 == 0) for i, r in got.items())
    hit = got[104]
    assert [hit.text[s.start : s.end].strip() for s in hit.offending] == ["You are a grumbling scoundrel."]


def test_a_toxic_document_always_has_an_offending_sentence():
    model = toxicity.Model({0: {}}, 0.0, 2.0, 1.0)
    p = np.array([0.1, 0.5, 0.0, 0.45])
    assert model.document(p) > 0.85 and [k for k, _ in toxicity.carriers(model, p, 0.85)] == [1, 3]
    assert [k for k, _ in toxicity.carriers(model, p, 0.7)] == [1] and toxicity.carriers(model, p, 0.99) == []
    assert toxicity.carriers(model, np.zeros(3), 0.5) == [] and toxicity.carriers(model, np.zeros(0), 0.5) == []


def test_toxicity_of_awkward_rows(spark, frame):
    model = toxicity.fit_from(frame(DOCS, ODD), frame("doc_id long, toxic int", []))
    got = toxicity.score(frame(DOCS, ODD), model)
    assert got.count() == len(ODD) and got.where("score <> 0").count() == 0 and dict(got.dtypes)["score"] == "double"
    assert toxicity.score(frame(DOCS, []), model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = language.crc_bucket(docs.doc_id, 3) == 1
    model = toxicity.fit_from(docs.where(~held), labels)
    rows = toxicity.score(docs.where(held).join(labels, "doc_id"), model).select("toxic", "score").collect()
    right = sum((r.score >= 0.7) == (r.toxic == 1) for r in rows)
    assert right / len(rows) > 0.97


def test_language_against_hand_counted_model(frame):
    rows = [(i, t, g, None, None, "old", None) for i, (t, g) in enumerate([("the then there", "en"), ("der die das dem", "de")] * 20)]
    docs = frame(DOCS, rows)
    counts = {(r.lang, r.gram): r.n for r in language.count_grams(docs).collect()}
    codes = language.letters("the then there")
    assert counts["en", int(language.grams(codes)[-1])] == 20 and counts["en", int(language.grams(codes)[2])] == 60 and len(codes) == len(" the then there ") - 1
    model = language.learn(docs)
    got = language.identify(docs, model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)


def test_kneser_ney_probabilities_sum_to_one(frame):
    import numpy as np

    docs = frame(DOCS, [(i, t, "en", None, None, None, None) for i, t in enumerate(["abba abab", "baab ab", "bb a"])])
    model = language.build(language.count_grams(docs))
    alphabet = np.unique(model.keys[0])
    for before in (" ab", "  b", "xyz"):
        context = language.grams(np.array([ord(c) for c in before] + [0], np.uint64))[-1] & ~np.uint64(0xFFFF)
        p = np.exp(model._log(context | alphabet, language.ORDER)[:, 0])
        assert p.sum() <= 1 + 1e-5 and p.sum() > 0.7  # the rest is kept for characters never seen


def test_language_model_keeps_every_gram(spark):
    """300 000 n-grams of one language, three in four of them seen once: all are held and set the discount."""
    counts = spark.range(300_000).selectExpr("'xx' lang", "id gram", "if(id % 4 = 0, 2L, 1L) n")
    model = language.build(counts)
    assert [len(k) for k in model.keys[::-1]] == [300_000] * 2 + [300_000, 65_536]
    discount = 225_000 / (225_000 + 2 * 75_000)
    assert abs(model.backoff[-1][0, 0] - math.log(discount * 65_536 / (65_536 * 1.25))) < 1e-6


def test_language_of_awkward_rows(frame):
    docs = frame(DOCS, ODD)
    for model in (language.learn(docs), language.learn(frame(DOCS, []))):
        got = language.identify(docs, model).collect()
        assert len(got) == len(ODD)
        assert all((r.lang_pred == "und") == (model is None or not any(c.isalpha() for c in r.text or "")) for r in got)
    assert language.identify(frame(DOCS, []), None).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.crc_bucket(docs.doc_id, 4) == 2
    model = language.learn(docs.where(~held))
    got = language.identify(docs.where(held), model).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert language.crc_bucket(docs.doc_id, 4) is not None and zlib.crc32(b"12") % 4 == docs.where("doc_id = 12").select(language.crc_bucket(docs.doc_id, 4)).first()[0]


def brute_targets(sizes, epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    open_, goal, total = set(order), dict.fromkeys(order, 0.0), float(sum(sizes.values()))
    while open_:
        level = (total - sum(goal[s] for s in order if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        for s in open_:
            goal[s] = epochs * sizes[s] if s in over else level * weight[s]
        if not over:
            break
        open_ -= over
    return goal


@pytest.mark.parametrize("shares", [[(1, 50), (2, 5), (3, 1)], [(5, 40), (1, 1), (1, 2), (30, 3)]])
def test_mixture_against_iterated_targets(frame, shares):
    rows = [(k * 1000 + i, "w " * (1 + i % 17) * n, None, f"s{k}" if k else None, None, None, "old") for k, (n, m) in enumerate(shares) for i in range(m * 3)]
    got = mixing.mix(frame(DOCS, rows)).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    goal, taken = brute_targets(sizes), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes)
    again = sorted(map(tuple, mixing.mix(frame(DOCS, rows[::-1])).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)


def test_every_stretch_of_the_schedule_follows_the_targets(frame):
    sized = frame("source string, size long", [("a", 6000), ("b", 6000), (None, 6000)])
    plan = mixing.schedule(mixing.targets(sized), 300, 64).orderBy("slot").collect()
    for at in range(0, 240, 60):
        part = collections.Counter(r.source for r in plan if at <= r.slot < at + 60)
        assert abs(part["a"] - 10) <= 2 and abs(part["b"] - 20) <= 2 and abs(part[None] - 30) <= 2
    for source in ("a", "b", None):
        assert [r["rank"] for r in plan if r.source == source] == list(range(sum(r.source == source for r in plan)))


def test_mixture_of_awkward_rows(frame):
    got = mixing.mix(frame(DOCS, ODD)).collect()
    assert len(got) == len(ODD) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(frame(DOCS, [])).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(frame(DOCS, ODD[:3])).collect())
    out = mixing.repeated(frame(DOCS, ODD))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")] and out.where("doc_id = 5").count() in (1, 2, 3)


def test_slots_follow_what_sources_need(frame):
    """A source of one word beside a large one costs one slot, not a schedule as fine as its share of words."""
    sized = frame("source string, size long", [("a", 1000)] * 400 + [("b", 1)])
    goals = mixing.targets(sized)
    assert mixing.enough_slots(goals) <= 2 * (400_000 // 64 + 2) + 1
    rows = [(i, "w " * 1000, None, "a", None, None, None) for i in range(40)] + [(99, "w", None, "b", None, None, None)]
    got = {r.doc_id: r.taken for r in mixing.mix(frame(DOCS, rows)).collect()}
    assert got.pop(99) == 3 and sum(got.values()) == 39_998


@pytest.mark.parametrize("needs", [[1] * 30, [1, 2, 500], [7, 1, 1, 90, 3]])
def test_enough_slots_fill_every_source(frame, needs):
    sized = frame("source string, size long", [(f"s{k:02}", 64 * n) for k, n in enumerate(needs)])
    goals = mixing.targets(sized, weights=(1,), max_epochs=1)
    plan = mixing.schedule(goals, mixing.enough_slots(goals), 64).groupBy("source").sum("tokens").collect()
    assert {r.source: r["sum(tokens)"] for r in plan} == {f"s{k:02}": 64 * n for k, n in enumerate(needs)}
