import math

import numpy as np

from plumbline.llm import langid, lattice, lmscore
from tests.llm.conftest import DOCS, prose

TEXTS = ["Hello world, this is a tést \U0001f600 of things", "", "ciónador  xx\nüber straße", " \t ", "x" * 450, "thething" * 1100 + " " + "ab" * 25, "kathe" * 9 + " " + "lomi" * 9, "the the the", "a"]


def by_letters(text):
    """Words, each with a mark."""
    return [lattice.MARK + w for w in text.split()]


def brute(text, p, longest):
    total = 0.0
    for w in by_letters(text):
        a = [0.0] + [-math.inf] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - longest), j):
                q = p.get(w[i:j], lattice.UNKNOWN if i == j - 1 else None)
                if q is not None:
                    a[j] = np.logaddexp(a[j], a[i] + q)
        total += a[-1]
    return total


def all_segmentations(w, p):
    if not w:
        return [1.0]
    out = []
    for n in range(1, len(w) + 1):
        q = p.get(w[:n], lattice.UNKNOWN if n == 1 else None)
        if q is not None:
            out += [math.exp(q) * r for r in all_segmentations(w[n:], p)]
    return out


def test_forward_against_brute_force():
    v = lattice.Vocabulary().open()
    p = dict(zip(v.pieces, v.log_p, strict=True))
    memo = lattice.Memo()
    for _ in range(2):
        got, letters = lattice.word_scores(v, TEXTS, [lattice.with_unknown(v.log_p)] * 2, memo)
        assert np.allclose(got[:, 0], [brute(t, p, v.longest) for t in TEXTS]) and (got[:, 0] == got[:, 1]).all()
    assert letters.tolist() == [sum(map(len, by_letters(t))) for t in TEXTS]
    w = lattice.MARK + "things"
    assert math.isclose(lattice.word_scores(v, ["things"], [lattice.with_unknown(v.log_p)])[0][0, 0], math.log(sum(all_segmentations(w, p))))


def test_expected_counts(spark, docs):
    """One step of the fit against posteriors over all segmentations."""
    v = lattice.Vocabulary()
    p = dict(zip(v.pieces, v.log_p, strict=True))
    words = {"the": 5, "thing": 2}
    want = {}
    for w, n in words.items():
        def walk(rest, used, weight):
            if not rest:
                yield used, weight
            for k in range(1, len(rest) + 1):
                if rest[:k] in p:
                    yield from walk(rest[k:], [*used, rest[:k]], weight * math.exp(p[rest[:k]]))

        every = list(walk(lattice.MARK + w, [], 1.0))
        z = sum(x for _, x in every)
        for used, x in every:
            for piece in used:
                want[piece] = want.get(piece, 0) + n * x / z
    rows = lattice.word_counts(docs((1, "the the thing"), (2, "thing the the the")).selectExpr("'k' AS key", "text"), "key")
    assert {x.word: x.n for x in rows.collect()} == words
    got = np.exp(lattice.re_estimated(rows, "key", lattice.VOCABULARY, {"k": v.log_p}, prior=1.0)["k"])
    base = np.exp(v.log_p)
    for piece, n in want.items():
        k = v.pieces.index(piece)
        assert math.isclose(got[k], (n + base[k]) / (sum(want.values()) + 1), rel_tol=1e-5)


def test_expected_counts_of_long_words():
    """Words of several spans, and of differing lengths side by side, against a recursion by letters."""
    v = lattice.Vocabulary().open()
    log_p = lattice.with_unknown(v.log_p)
    p = dict(zip(v.pieces, v.log_p, strict=True))
    words = ["thething" * 600, "ofthe" * 9, "thatwas" * 6 + "x\U0001f600"]
    cp = np.array([ord(c) for w in words for c in w], np.uint32)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    times = np.array([2.0, 3.0, 5.0])
    got = sum(group.counts(log_p, times[own]) for own, group in lattice.groups(v, cp, start, end))
    want = np.zeros(len(log_p))
    for w, n in zip(words, times, strict=True):
        x = lattice.MARK + w
        edges = [(i, j, v.pieces.index(x[i:j]) if x[i:j] in p else -1) for j in range(1, len(x) + 1) for i in range(max(0, j - v.longest), j) if x[i:j] in p or i == j - 1]
        a, b = np.full(len(x) + 1, -np.inf), np.full(len(x) + 1, -np.inf)
        a[0] = b[-1] = 0
        for i, j, k in edges:
            a[j] = np.logaddexp(a[j], a[i] + log_p[k])
        for i, j, k in reversed(edges):
            b[i] = np.logaddexp(b[i], b[j] + log_p[k])
        for i, j, k in edges:
            want[k] += n * np.exp(a[i] + log_p[k] + b[j] - a[-1])
    assert np.allclose(got, want)


SENTENCES = {
    "en": "the house of the king was with this and that for which they were having other things",
    "de": "das haus des königs war mit diesem und jenem für welche sie andere dinge hatten nicht auch",
    "es": "la casa del rey estaba con este y aquel para los cuales ellos tenían otras cosas también",
}


def mixed(lang, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(SENTENCES[lang].split(), 30))


def test_held_out_accuracy(spark, docs):
    train = docs(*[(i, mixed(k, i), k) for i, k in enumerate(list(SENTENCES) * 40)])
    models = langid.fitted(train)
    test = docs(*[(1000 + i, mixed(k, 10_000 + i), k) for i, k in enumerate(list(SENTENCES) * 40)])
    rows = langid.identified(test, models).collect()
    assert np.mean([x.lang == x.predicted for x in rows]) >= 0.98


def test_language_oddities(odd, spark):
    models = langid.fitted(odd)
    rows = langid.identified(odd, models).collect()
    assert len(rows) == odd.count() and set(models) == {"en", "de"}
    assert all((x.predicted is None) == (x.doc_id in (3, 4, 5) or (x.doc_id is None and x.lang is None)) for x in rows)
    empty = spark.createDataFrame([], DOCS)
    assert langid.fitted(empty) == {} and langid.identified(empty, models).count() == 0
    assert {x.predicted for x in langid.identified(odd, {}).collect()} == {None}


def test_lm_scores(spark, docs, odd):
    d = docs(*[(i, prose(i, 30)) for i in range(30)], (99, "Zyx! qwv %%%"))
    log_p = lmscore.fitted(d)
    v = lattice.Vocabulary()
    p = dict(zip(v.pieces, log_p, strict=True))
    text = {x.doc_id: x.text for x in d.collect()}
    for x in lmscore.scored(d, log_p).collect():
        assert math.isclose(x.log_p, brute(text[x.doc_id], p, v.longest), rel_tol=1e-9)
        assert math.isclose(x.bits_per_char, -x.log_p / math.log(2) / x.chars)
    rows = lmscore.scored(odd, lmscore.fitted(odd)).collect()
    assert len(rows) == odd.count() and all(x.log_p is None for x in rows if x.doc_id in (3, 4, 5))
    empty = spark.createDataFrame([], DOCS)
    assert lmscore.scored(empty, lmscore.fitted(empty)).count() == 0
