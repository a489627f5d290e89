import random
from itertools import combinations

import numpy as np

from plumbline.llm import neardup
from plumbline.llm.common import Words
from tests.llm.conftest import DOCS, prose


def edited(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(prose(r.randrange(10**6), 1) if r.random() < share else w for w in text.split())


def sets(texts):
    out = []
    for t in texts:
        h, _ = neardup.element_hashes(Words([t]))
        out.append(set(h.tolist()))
    return out


def groups(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_recall_and_precision_against_brute_force(spark, docs):
    texts = [prose(i, 120) for i in range(60)]
    for i in range(60, 200):
        texts.append(edited(texts[i % 40], [0.0, 0.02, 0.05, 0.08][i % 4], i))
    shared = prose(999, 40)
    texts += [shared + " " + prose(2000 + i, 90) for i in range(40)]
    s = sets(texts)
    close = [(a, b) for a, b in combinations(range(len(s)), 2) if s[a] and len(s[a] & s[b]) / len(s[a] | s[b]) >= neardup.THRESHOLD]
    want = groups(len(texts), close)
    got = {x["node"].doc_id: x["root"].doc_id for x in neardup.copies_of(docs(*enumerate(texts))).collect()}
    found = [got.get(i, i) for i in range(len(texts))]
    assert np.mean([found[a] == found[b] for a, b in close]) >= 0.95
    assert all(want[a] == want[b] for a, b in got.items())
    assert not any(i in got for i in range(200, 240))


def test_a_large_group_of_near_copies(spark, docs):
    base = prose(1, 150)
    got = neardup.copies_of(docs(*[(i, edited(base, 0.03, i) if i else base) for i in range(400)])).collect()
    assert len(got) >= 396
    assert len({x["root"].doc_id for x in got}) <= 2


def test_likelihood_is_unbiased():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(30):
            n = 400
            shared = int(2 * n * j / (1 + j))
            pool = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
            a, b = pool[:n], pool[n - shared :]
            k = neardup.registers(np.concatenate([a, b]), np.repeat([0, 1], n), 2).astype(int)
            errors.append(neardup.estimated(k[:1], k[1:], np.array([n]), np.array([n]))[0] - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.03


def test_registers_merge():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, 50, dtype=np.uint64) for _ in range(2))
    one = lambda *x: neardup.registers(np.concatenate(x), np.zeros(50 * len(x), int), 1)[0]
    assert (np.maximum(one(a), one(b)) == one(a, b)).all()


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 103), (101, 103), (102, 100)]
    got = {x.node: x.root for x in neardup.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100, 103: 100}


def test_oddities(odd, spark):
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns
    got = [(x.doc_id, x.text) for x in kept.collect()]
    # the repeated row went, both null texts and both rows without doc_id stay; blank texts differ, so both stay
    assert len(got) == odd.count() - 1
    assert sum(t is None for _, t in got) == 2
    both = spark.createDataFrame([(1, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "one", "en", "s", 3), (4, "One!", "en", "s", 4), (None, "one", "en", "s", 3)], DOCS)
    assert sorted(map(repr, (x.doc_id for x in neardup.deduplicated(both).collect()))) == ["1", "None"]
    assert neardup.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_the_way_for_very_many_keys(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup.members, "__defaults__", (0,))
    d = docs(*[(i, prose(i // 2, 50)) for i in range(40)], (0, prose(0, 50)), (50, None))
    assert neardup.deduplicated(d).count() == 21


def test_a_copy_that_repeats_a_line(spark, docs):
    """Sets, and so sizes, are of distinct elements, however often a text repeats them."""
    texts = [prose(k, 60) for k in range(20)]
    line = " ".join(texts[0].split()[:6])
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100 + k, t + (" " + t) * 5) for k, t in enumerate(texts)]
    rows += [(200, texts[0] + (" " + line) * 100)]
    got = {x["node"].doc_id: x["root"].doc_id for x in neardup.copies_of(docs(*rows)).collect()}
    assert all(got.get(100 + k) == k for k in range(20)) and got.get(200) == 0


def test_near_copies_among_sharers_of_a_passage(spark, docs, monkeypatch):
    """Buckets full of documents under the threshold, in which pairs over it are far apart by id."""
    monkeypatch.setattr(neardup, "TILE", 50)
    passage = prose(7, 60)
    texts = [passage + " " + prose(100 + i % 100, 16) + " " + prose(1000 + i, 26) for i in range(200)]
    s = sets(texts)
    j = {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a, b in combinations(range(200), 2)}
    close = {p for p, x in j.items() if x >= neardup.THRESHOLD}
    assert close == {(i, i + 100) for i in range(100)} and np.mean([x > 0.36 for x in j.values()]) > 0.9
    _, pairs = neardup.verified(docs(*enumerate(texts)))
    got = [(x.a.doc_id, x.b.doc_id) for x in pairs.collect()]
    assert len(set(got)) == len(got) and set(got) <= close and len(got) >= 90
