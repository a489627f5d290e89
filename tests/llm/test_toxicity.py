from collections import Counter

import numpy as np

from plumbline.llm import toxicity
from plumbline.llm.common import Words
from tests.llm.conftest import DOCS, LABELS, prose

BAD = ["vile", "scumbag", "moronic", "filthy"]


def wide(seed, n):
    """Text over some thousands of words, few of them frequent."""
    r = np.random.default_rng([seed, 5])
    return " ".join(f"w{int(x)}" for x in 4000 * r.random(n) ** 3)


def data(n, seed=0):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = wide(seed + i, 60).split()
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w[int(r.integers(len(w)))] = str(r.choice(BAD))
        out.append((i, " ".join(w), bad))
    return out


def fitted(spark, docs, n=300):
    d = data(n)
    marks = spark.createDataFrame([(i, None, int(t)) for i, _, t in d], LABELS)
    return toxicity.examples(docs(*[(i, x) for i, x, _ in d]), marks)


def brute(index, texts):
    """The nearest examples of each text by the cosines with all of them."""
    dense = np.zeros((len(index.ids), len(index.keys)))
    for e, (a, b) in enumerate(zip(index.first, index.first[1:], strict=False)):
        dense[e, index.terms[a:b]] = index.weights[a:b]
    for text in texts:
        q = np.zeros(len(index.keys))
        for word, n in Counter(text.split()).items():
            if word in index.names:
                k = index.names.index(word)
                q[k] = (1 + np.log(n)) * index.weight[k]
        cosines = np.round(dense @ (q / max(np.linalg.norm(q), 1e-12)), 9)
        order = np.lexsort((np.arange(len(cosines)), -cosines))[: toxicity.K]
        yield order[cosines[order] > 0], cosines


def searched(index, texts):
    """Of texts of no more than a passage."""
    query, term, weight, base = index.queries(Words(texts), len(texts))
    assert base.tolist() == list(range(len(texts) + 1))
    return index.nearest(query, term, weight, len(texts))


def test_nearest_are_exact_over_thousands_of_words(spark, docs):
    index = fitted(spark, docs)
    assert len(index.keys) > 2000 and {x for t in data(300) for x in t[1].split()} == set(index.names)
    assert 0 < len(index.matrix) < len(index.keys)
    texts = [t for _, t, _ in data(60, 5000)] + [wide(7, 5), "vile " * 50 + wide(8, 300), wide(9, 400)]
    for (want, cosines), (ids, got) in zip(brute(index, texts), searched(index, texts), strict=True):
        assert ids.tolist() == want.tolist() and np.allclose(got, cosines[want])


def test_weights_are_of_rates_in_either_kind(spark, docs):
    index = fitted(spark, docs)
    d = [x for x in data(300) if x[0] in set(index.ids)]
    n1, n0 = sum(t for *_, t in d), sum(not t for *_, t in d)
    for word in ("vile", "filthy", *index.names[:20]):
        df1, df0 = (sum(word in x.split() for _, x, t in d if t == kind) for kind in (True, False))
        more = 2 * toxicity.SMOOTH / (n1 + n0)
        assert np.isclose(index.weight[index.names.index(word)], abs(np.log((df1 / n1 + more) / (df0 / n0 + more))))


def test_blocks_that_bounds_leave_out_hold_no_neighbour():
    r = np.random.default_rng(1)
    # four vocabularies, so that blocks differ
    texts = [" ".join(f"w{k % 4}x{int(x)}" for x in r.zipf(1.3, 80) % 3000) for k in range(1000)]
    toxic = np.arange(1000) % 3 == 0
    index = toxicity.Index(list(range(1000)), texts, toxic, (0.7, 0.3))
    few = texts[::25] + [" ".join(f"w{k % 4}x{int(x)}" for x in r.zipf(1.3, 60) % 3000) for k in range(40)]
    for (want, cosines), (ids, got) in zip(brute(index, few), searched(index, few), strict=True):
        assert np.allclose(got, cosines[want]) and ids.tolist() == want.tolist()


def test_a_copy_of_an_example_is_its_nearest(spark, docs):
    index = fitted(spark, docs)
    for e, (i, text, _) in enumerate(data(300)[:40]):
        if i in index.ids:
            ids, cosines = searched(index, [text])[0]
            assert index.ids[ids[0]] == i and np.isclose(cosines[0], 1), e


def test_labels_of_one_kind_and_of_two_texts(spark, docs):
    marks = spark.createDataFrame([(k, None, 1) for k in range(5)], LABELS)
    d = docs(*[(k, prose(k, 30)) for k in range(5)], (2, "aaa only"), (2, prose(50, 30)))
    index = toxicity.examples(d, marks)
    assert sorted(index.ids) == [0, 1, 2, 3, 4] and "only" in index.names
    rows = toxicity.rated(d, index).collect()
    assert len(rows) == 7 and all(x.toxic and x.score == 1 for x in rows)


def test_held_out_accuracy_and_evidence(spark, docs):
    index = fitted(spark, docs)
    test = data(200, 9000)
    rows = {x.doc_id: x for x in toxicity.rated(docs(*[(i, x) for i, x, _ in test]), index).collect()}
    assert np.mean([rows[i].toxic == t for i, _, t in test]) >= 0.98
    assert all("vile" in rows[i].evidence or any(b in rows[i].evidence for b in BAD) for i, _, t in test if t)
    assert all(0 <= x.score <= 1 for x in rows.values())


def test_long_texts_are_rated_whole(spark, docs):
    index = fitted(spark, docs)
    text = wide(1, 30_000) + " vile scumbag moronic"
    assert toxicity.rated(docs((1, text)), index).first().toxic


def test_isotonic():
    at, value = toxicity.isotonic(np.array([0.0, 0.2, 0.2, 0.5, 1.0]), np.array([0, 1, 0, 0, 1.0]), np.ones(5))
    assert at.tolist() == [0.0, 0.2, 1.0] and np.allclose(value, [0, 1 / 3, 1])


def test_oddities(odd, spark, docs):
    marks = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (6, 1, None), (None, 1, 1), (77, 0, 1), (10, 1, 0), (3, 1, 1)], LABELS)
    rows = toxicity.rated(odd, toxicity.examples(odd, marks)).collect()
    assert len(rows) == odd.count()
    rows = toxicity.rated(odd, fitted(spark, docs)).collect()
    assert all(not x.toxic and x.evidence is None for x in rows)
    none, empty = spark.createDataFrame([], LABELS), spark.createDataFrame([], DOCS)
    rows = toxicity.rated(odd, toxicity.examples(odd, none)).collect()
    assert all(x.score is None and not x.toxic for x in rows)
    assert toxicity.rated(empty, toxicity.examples(empty, none)).count() == 0
