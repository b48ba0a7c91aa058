"""Quality, toxicity, language and token counts: brute force, gradients, held-out accuracy, edge cases."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import language, quality_net, token_count, toxicity
from tablewright.llm.common import bounded_sample, held_out
from tablewright.llm.pieces import parse_model, read_model

DATA = "/root/testdata/sf0.01"


def greedy(words: list[bytes], pieces: set[bytes]) -> int:
    longest, n = max(map(len, pieces)), 0
    for word in words:
        word, at = "▁".encode() + word, 0
        while at < len(word):
            size = next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces or k == 1)
            at, n = at + size, n + 1
    return n


def test_token_counts_equal_greedy_longest_match(spark, edge):
    model = read_model()
    pieces = {p.encode() for p in parse_model(model).ids}
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()] + ["aab" * 50, "\U0001f600▁▁x"]
    words, tokens = token_count.count_batch(token_count._automaton(model), [t.encode() for t in texts])
    for t, w, n in zip(texts, words, tokens):
        assert w == len(t.encode().split()) and n == greedy(t.encode().split(), pieces)
    rows = edge.select("text", token_count.token_counts(F.col("text"), model).alias("c")).collect()
    for r in rows:
        own = (r.text or "").encode().split()
        assert r.c.n_words == len(own)
        if len(own) < 100:
            assert r.c.n_tokens == greedy(own, pieces)


@pytest.mark.parametrize("pieces", [[b"ab", b"abc", b"bcd", b"cd"], [b"aaa", b"aa"], [], [b"abcdefgh", b"bc", b"cdef"]])
def test_automaton_pops_as_greedy_does(pieces):
    automaton = token_count.Automaton(pieces)
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 105, rng.integers(1, 14)).astype(np.uint8)) for _ in range(300)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    got = automaton.counts(data, ends - [len(w) for w in words], ends, b"")
    known = set(pieces) | {bytes([b]) for b in range(256)}
    for word, n in zip(words, got):
        at = count = 0
        while at < len(word):
            at += next(k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known)
            count += 1
        assert n == count


def test_gram_vectors_are_bound_letters():
    a, b, c = (language._letter_vector(ord(x), 64).astype(int) for x in "abc")
    code = np.array([ord("a") | ord("b") << 21 | ord("c") << 42], np.uint64)
    assert (language._gram_vectors(code, 64)[0] == a * np.roll(b, 1) * np.roll(c, 2)).all()
    whole = language.bundle(["abc"], 64)[0]
    grams = [np.array([x | y << 21 | z << 42], np.uint64) for x, y, z in ((0, 97, 98), (97, 98, 99), (98, 99, 0))]
    assert np.allclose(whole, sum(language._gram_vectors(g, 64)[0] for g in grams))


def test_language_on_held_out_documents(spark, edge, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    profiles = language.fit(docs, per_language=200)
    rows = docs.filter(held_out()).select("lang", language.predict(F.col("text"), profiles).alias("p")).collect()
    assert len(rows) > 100 and np.mean([r.lang == r.p.lang_pred for r in rows]) > 0.97
    got = {r.doc_id: r.p for r in edge.select("doc_id", language.predict(F.col("text"), profiles).alias("p")).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[9].lang_pred != "und" and 0 <= got[9].score <= 1
    nothing = language.fit(none)
    assert {r.p.lang_pred for r in edge.select(language.predict(F.col("text"), nothing).alias("p")).collect()} == {"und"}


def test_bundles_of_many_short_texts_stay_small_and_equal_their_own():
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, row)) for row in rng.integers(0x4E00, 0x9FA5, (10_000, 20))]
    language._letters()
    tracemalloc.start()
    found = language.bundle(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6, peak
    for k in (0, 1023, 1024, 9_999):
        grams, counts = language._grams(texts[k])
        assert (found[k] == (counts[:, None] * language._gram_vectors(grams, language.DIMENSIONS)).sum(0)).all()


def test_nearest_prototype_by_definition(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("der die das und", "de"), ("the and of a", "en"), ("el la los y", "es")] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    profiles = language.fit(docs)
    learnt = docs.filter(~held_out()).collect()
    unit = lambda v: v / np.linalg.norm(v)
    prototypes = {lang: unit(sum(unit(language.bundle([r.text])[0].astype(float)) for r in learnt if r.lang == lang)) for lang in ("de", "en", "es")}
    texts = ["die und", "of the", "los la", "x", ""]
    langs, scores = language.classify(profiles, texts)
    for t, lang, score in zip(texts[:4], langs, scores):
        cosines = {k: float(unit(language.bundle([t])[0].astype(float)) @ v) for k, v in prototypes.items()}
        assert cosines[lang] == max(cosines.values()) and abs(score - min(max(cosines[lang], 0), 1)) < 1e-5
    assert langs[4] == "und" and scores[4] == 0


def test_network_gradient_is_the_slope_of_the_loss():
    texts, labels = [b"some words here", b"x" * 700, b""], np.array([1, 0, 1], np.float32)
    net = quality_net.new_network(1)

    def loss():
        p = quality_net.scores(net, texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for part, slope in zip(net.parts()[2:], quality_net._gradients(net, texts, labels)[2:]):
        for k in range(min(4, part.size)):
            was = part.flat[k]
            part.flat[k] = was + 1e-2
            up = loss()
            part.flat[k] = was - 1e-2
            down = loss()
            part.flat[k] = was
            assert abs((up - down) / 2e-2 - slope.flat[k]) < 2e-3


def test_a_long_text_scores_the_same_in_pieces(monkeypatch):
    net, text = quality_net.new_network(2), bytes(np.random.default_rng(0).integers(32, 120, 5000).astype(np.uint8))
    whole = quality_net.scores(net, [text, b"short"])
    monkeypatch.setattr(quality_net, "STEP_BYTES", 1024)
    assert np.allclose(whole, quality_net.scores(net, [text, b"short"]), atol=1e-5)


@pytest.mark.parametrize("module, label, column", [(quality_net, "quality", "quality_score"), (toxicity, "toxic", "toxicity_score")])
def test_classifiers_on_held_out_documents(spark, edge, none, module, label, column):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = module.fit(docs, labels, 200)
    score = getattr(module, column)
    rows = docs.filter(held_out()).join(labels, "doc_id").select(label, score(F.col("text"), model).alias("score")).collect()
    right = np.mean([(r.score >= module.CUT) == bool(r[label]) for r in rows])
    assert right > 0.88
    got = {(r.doc_id, r.text): r.mine for r in edge.select("doc_id", "text", score(F.col("text"), model).alias("mine")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and abs(got[1, None] - got[2, ""]) < 1e-5
    bare = module.fit(none, labels)
    assert all(0 <= r[0] <= 1 for r in edge.select(score(F.col("text"), bare)).collect())


def test_forms_of_an_insult_that_were_never_met_are_toxic():
    rng = np.random.default_rng(3)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    word = lambda n=3: "".join(rng.choice(syllables, n))
    prose = lambda: [word() for _ in range(60)]
    bad = lambda: " ".join([*prose(), *("Zwilkrak" + word(2) for _ in range(3))]).encode()
    good = lambda: " ".join([*prose(), word(1) + "zwilkrak"]).encode()
    model = toxicity.train([bad() for _ in range(80)], [good() for _ in range(300)])
    assert np.mean(toxicity.scores(model, [bad() for _ in range(50)]) >= toxicity.CUT) > 0.9
    assert np.mean(toxicity.scores(model, [good() for _ in range(50)]) >= toxicity.CUT) < 0.1


def test_one_class_only():
    assert quality_net.scores(quality_net.train([b"a"], np.array([1], np.float32)), [b"x"])[0] > 0.9
    assert toxicity.scores(toxicity.train([], [b"fine"]), [b"x"])[0] < 0.1


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = {r.label: r.n for r in bounded_sample(rows, "doc_id", "label", 1000).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert all(900 < got[k] < 1100 for k in (0, 1))
