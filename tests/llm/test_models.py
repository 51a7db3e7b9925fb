"""Held-out accuracy and exactness of the learned operators, on the small tables."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from workpulse.llm import ann, common, crf, langid, lm, toxicity


def area(scores, labels) -> float:
    scores, labels = np.asarray(scores), np.asarray(labels)
    wins = scores[labels == 1][:, None] - scores[labels == 0][None]
    return float(((wins > 0) + 0.5 * (wins == 0)).mean())


def held(key, divisor: int) -> int:
    return zlib.crc32(str(key).encode()) % divisor


def test_crf_marginals_equal_enumeration():
    draw = np.random.default_rng(0)
    scores, moves, begin = draw.normal(size=(5, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    lengths = np.array([4, 1])
    found, pairs = crf.marginals(scores, lengths, moves, begin)
    totals = crf.log_totals(*crf.emissions(scores), np.arange(5), lengths, moves, begin)
    total, each, both = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        p = math.exp(begin[path[0]] + sum(scores[i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, s in enumerate(path):
            each[i, s] += p
        for a, b in zip(path, path[1:]):
            both[a, b] += p
    assert np.allclose(found[:4], each / total)
    assert np.allclose(pairs, both / total)
    assert np.isclose(totals[0], math.log(total))


def test_blocks_of_positions_give_the_same_marginals(monkeypatch):
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 60, 100)
    scores, moves, begin = draw.normal(size=(lengths.sum(), 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    whole, total = crf.marginals(scores, lengths, moves, begin), crf.log_totals(*crf.emissions(scores), np.arange(len(scores)), lengths, moves, begin)
    monkeypatch.setattr(crf.Layout.__init__, "__defaults__", (50,))
    assert len(crf.Layout(lengths)) > 20
    parts = crf.marginals(scores, lengths, moves, begin)
    assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])
    assert np.allclose(total, crf.log_totals(*crf.emissions(scores), np.arange(len(scores)), lengths, moves, begin))


def test_forgotten_words_get_the_same_marginals(monkeypatch):
    draw = np.random.default_rng(4)
    model = crf.Crf([0, 1], draw.normal(size=(1 << crf.BITS, 2)).astype(np.float32), np.zeros((2, 2), np.float32), np.zeros(2, np.float32))
    texts = [" ".join("".join(map(chr, draw.integers(97, 123, 4))) for _ in range(400)) for _ in range(20)]
    whole = list(model.tagged(texts))
    monkeypatch.setattr(crf, "WORDS_KEPT", 100)
    monkeypatch.setattr(crf, "TEXT_CHARS", 64)
    model.forget()
    parts = list(model.tagged(texts))
    assert [w for w, _, _ in whole] == [w for w, _, _ in parts]
    assert all(np.allclose(a[1], b[1], atol=1e-5) for a, b in zip(whole, parts))


def test_words_hold_letters_only():
    assert crf.words_of("½ ② Ⅷ abc x² d'été 日本") == ["abc", "x", "d", "été", "日本"]


def test_language_of_held_out_documents(spark, small):
    truth = {r["doc_id"]: r["lang"] for r in common.table(spark, small, "documents").collect() if r["lang"] and crf.words_of(r["text"])}
    rows = langid.op4_language_id(spark, small).collect()
    assert len(rows) == common.table(spark, small, "documents").count()
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (held(r["doc_id"], 4) == 2) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in tested]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_switched_words_get_their_own_language():
    texts = [("the cat sat on the mat with another cat " * 4, "en"), ("der hund lief mit einem anderen hund nach haus " * 4, "de")]
    sequences, labels = langid.training_sequences(texts)
    model = crf.fit(sequences, labels)
    words = "the cat sat on the mat der hund lief nach haus".split()
    [(_, found, _)] = model.tagged([" ".join(words)])
    assert [labels[i] for i in found.argmax(axis=1)] == ["en"] * 6 + ["de"] * 5


def test_toxic_documents_rank_above_clean_ones(spark, small):
    sf = small.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, sf, "labels").collect()}
    rows = toxicity.op5_toxicity(spark, sf).collect()
    tested = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    assert area([r["score"] for r in tested], [labels[r["doc_id"]] for r in tested]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxic_spans_point_at_the_words(spark):
    plain = [" ".join(f"{w}{x}" for x in "abcdef") for w in map("".join, itertools.product("rwsh", "aeiou"))]
    rows = [(t, 0) for t in plain] + [(t + " grotvile " + t, 1) for t in plain]
    model = toxicity.fit_model(rows)
    text = "İ think Grotvile weather"
    found = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, with_spans=True).first()
    assert [text[s["start"] : s["end"]] for s in found["spans"]] == ["Grotvile"]


def test_nearest_neighbours_reach_recall(spark, small):
    sf = small.replace("0.001", "0.01")
    table = common.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    usable = [r for r in table if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in usable}
    found: dict[int, list] = {}
    for r in sorted(ann.op6_multi_index_hashing(spark, sf).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == {i for i in vectors if i % 20 == 0}
    ids = np.array(list(vectors))
    hits = 0
    for q, near in found.items():
        scores = np.array([vectors[q] @ vectors[i] if i != q else -np.inf for i in ids])
        truth = set(ids[np.lexsort((ids, -scores))[:20]])
        hits += len(truth & {i for i, _ in near})
        assert len(near) == 20 and near == sorted(near, key=lambda p: (-p[1], p[0]))
        assert all(abs(vectors[q] @ vectors[i] - s) < 1e-9 for i, s in near)
    assert hits / (20 * len(found)) >= 0.9


def test_probing_retrieves_every_code_within_a_radius():
    codes = np.random.default_rng(1).integers(0, 256, (300, 8), dtype=np.uint8)
    index = ann.Index(codes)
    for radius in (0, 5, 13, 24, 32):
        query, row = index.within(codes[:20], radius)
        apart = np.array([[sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(x, y)) for y in codes] for x in codes[:20]])
        assert set(zip(query.tolist(), row.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(apart <= radius))))


def test_probing_is_selective_among_clusters():
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(50, 64))
    vectors = np.repeat(centres, 40, axis=0) + draw.normal(0, 0.25, (2000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    coder = ann.Coder(vectors, 20)
    codes = coder.codes(vectors)
    index = ann.Index(codes)
    share = np.unpackbits(index.probed(codes[::20], coder.radius), axis=1, count=2000).mean()
    ids = np.arange(2000)
    query, found, _ = ann.best(index, coder, vectors, ids, vectors[::20], ids[::20], 20)
    scores = vectors[::20] @ vectors.T
    scores[np.arange(100), ids[::20]] = -np.inf
    truth = {(q, i) for q, near in zip(ids[::20], np.argsort(-scores, axis=1)[:, :20]) for i in near}
    assert share < 0.2 and len(truth & set(zip(query.tolist(), found.tolist()))) >= 0.9 * len(truth)


def test_language_model_contract_and_gain(spark, small):
    docs = {r["doc_id"]: lm.words_of(r["text"]) for r in common.table(spark, small, "documents").collect()}
    counts: dict[bytes, int] = {}
    for key, words in docs.items():
        if held(key, 10):
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    rows = lm.op2_lm_scoring(spark, small).collect()
    assert len(rows) == len(docs)
    gain = []
    for r in rows:
        words = docs[r["doc_id"]]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"], 10) == 0, len(words), sum(w in counts for w in words), n)
        assert abs(r["base_score"] - base) <= 1e-9 * max(1, abs(base))
        if r["held_out"]:
            gain.append(r["score"] - r["base_score"])
    assert sum(gain) > 0


def test_language_model_scores_equal_brute_force(spark, monkeypatch):
    """The query's scores against a model trained and summed over paths step by step, with whole sequences."""
    draw = random.Random(2)
    docs = [(i, " ".join(draw.choices("abcde" if i % 2 else "vwxyz", k=draw.randint(0, 12))) + (" rare" if i == 3 else ""), i % 5 != 0) for i in range(40)]
    monkeypatch.setattr(lm, "LEAST_GAIN", -1.0)
    monkeypatch.setattr(lm, "SLICE_TOKENS", 20)
    rows = lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string, train boolean"), F.col("train"), states=2, passes=2).collect()
    counts = Counter(w for _, t, train in docs if train for w in lm.words_of(t))
    n, v = sum(counts.values()), len(counts)
    p = lambda w: (counts[w] + 0.1) / (n + 0.1 * (v + 1))
    kind = lambda w: zlib.crc32(w) % lm.HASHES if counts[w] >= lm.OWN_CLASS * n and counts[w] else lm.UNKNOWN_CLASS
    base = np.zeros(lm.CLASSES)
    for w in counts:
        base[kind(w)] += p(w)
    base[lm.UNKNOWN_CLASS] = 0.1 / (n + 0.1 * (v + 1))
    model = lm.tilted(base, 2)

    def walk(words):
        """Scaled forward values, the likelihood, and expected counts, a token at a time."""
        emit = np.exp(np.array([model.emissions[kind(w)] for w in words]))
        move, begin = np.exp(model.transitions), np.exp(model.begin)
        alpha = [begin * emit[0]]
        for e in emit[1:]:
            alpha.append(alpha[-1] @ move * e)
        beta = [np.ones(2)]
        for e in emit[:0:-1]:
            beta.insert(0, move @ (e * beta[0]))
        total = alpha[-1].sum()
        pairs = sum((np.outer(alpha[t], emit[t + 1] * beta[t + 1]) * move for t in range(len(words) - 1)), np.zeros((2, 2))) / total
        return [a * b / total for a, b in zip(alpha, beta)], pairs, total

    for _ in range(2):
        emit, move, first = np.zeros((lm.CLASSES, 2)), np.zeros((2, 2)), np.zeros(2)
        for _, text, train in docs:
            if train:
                gamma, pairs, _ = walk(lm.words_of(text))
                for w, g in zip(lm.words_of(text), gamma):
                    emit[kind(w)] += g
                move, first = move + pairs, first + gamma[0]
        model = lm.maximised(emit, move, first, base)
    texts = {i: t for i, t, _ in docs}
    for r in rows:
        words = lm.words_of(texts[r["doc_id"]])
        right = math.log10(walk(words)[2]) + sum(math.log10(p(w) / base[kind(w)]) for w in words)
        assert abs(r["score"] - right) < 1e-4 * max(1, abs(right)), (r, right)


def test_language_model_is_a_distribution(spark):
    """Probabilities of all texts of one word (every known word, or the unknown one), and of none, times what follows."""
    texts = ["a b c a", "b b a", "c a d", "a"] * 5
    known = ["a", "b", "c", "d", "zz"]
    pairs = [""] + known + [f"{x} {y}" for x in known for y in known]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(100 + i, t, False) for i, t in enumerate(pairs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    found = {r["doc_id"] - 100: 10 ** r["score"] for r in lm.score_documents(docs, F.col("train")).collect() if r["doc_id"] >= 100}
    p = {t: found[i] for i, t in enumerate(pairs)}
    # a text "x" is x then the end, a text "x y" is x, y, end: their sums stay under what is left after shorter texts
    assert 0 < sum(p.values()) < 1
    assert p[""] > 0 and all(v > 0 for v in p.values())


def test_forward_equals_enumeration():
    draw = np.random.default_rng(2)
    model = lm.Model(np.log(draw.dirichlet(np.ones(lm.CLASSES), 3).T), np.log(draw.dirichlet(np.ones(3), 3)), np.log(draw.dirichlet(np.ones(3))))
    tokens = np.array([5, 900, 5, 32768], dtype=np.uint16)
    total = sum(
        math.exp(model.begin[p[0]] + sum(model.emissions[t, s] for t, s in zip(tokens, p)) + sum(model.transitions[a, b] for a, b in zip(p, p[1:])))
        for p in itertools.product(range(3), repeat=4)
    )
    assert np.isclose(model.log_likelihoods([tokens])[0], math.log(total))
