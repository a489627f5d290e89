from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import quality
from tests.llm.conftest import DOCS, LABELS, prose

ORDER = 3


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over dicts, as in Chen and Goodman."""
    counts = Counter()
    for t in texts:
        s = " " * (order - 1) + "".join(" " if c.isspace() else c for c in t)
        counts.update(s[i : i + order] for i in range(len(t)))
    levels = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        levels[k] = dict(Counter(g[1:] for g in levels[k + 1]))
    d = {}
    for k, c in levels.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        d[k] = [0.0, 0.5, 1.0, 1.5]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            for i in (1, 2, 3):
                if n[i] and n[i + 1]:
                    d[k][i] = min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i - 0.1)
    follow = {k: defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, v in c.items():
            follow[k][g[:-1]].append(v)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(levels[1]) + 1)
        own = follow[k].get(gram[:-1])
        if not own:
            return p(gram[1:])
        take = lambda v: d[k][min(v, 3)]
        v = levels[k].get(gram, 0)
        return (v - take(v)) / sum(own) + sum(map(take, own)) / sum(own) * p(gram[1:])

    return p


def halves(text):
    """Code points from WIDE on as two characters, by arithmetic of this test's own."""
    return "".join(c if ord(c) < 0x700 else chr(0x700 + ord(c) // 1024) + chr(0xB40 + ord(c) % 1024) for c in text)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_model_against_brute_force(spark, docs, order):
    train = [prose(i, 30, 40) for i in range(12)] + ["Ünï 漢字漢\n\n x"]
    model = quality.fitted(quality.gram_counts(docs(*enumerate(train)), order), order)["en"].open()
    p = brute_model([halves(t) for t in train], order)
    for text in ["kalo mi", "zzz", "漢q kalomi", "a"]:
        cp, start, end = quality.symbols([text], order)
        code = quality.windows(cp, order)
        got = model.log_p(code)[quality.places(start, end, len(cp))[order - 1 :]]
        s = " " * (order - 1) + halves(text)
        want = [np.log(p(s[i : i + order])) for i in range(len(s) - order + 1)]
        assert np.allclose(got, want, atol=1e-5)


def test_all_code_points_are_told_apart():
    """Every code point has symbols of its own, all of them of 12 bits, and those of a text are read from its start to its end."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cp, start, end = quality.symbols(["".join(every)], 2)
    assert cp.max() < 4096
    own = cp[start[0] : end[0]].tolist()
    size = [1 if ord(c) < 0x700 or c.isspace() else 2 for c in every]
    assert sum(size) == len(own)
    seen, at = {}, 0
    for c, n in zip(every, size, strict=True):
        seen.setdefault(tuple(own[at : at + n]), []).append(c)
        at += n
    assert all(len(x) == 1 or all(c.isspace() for c in x) for x in seen.values())
    cp, start, end = quality.symbols(["a一", "", "嘀帀b"], 5)
    assert (end - start).tolist() == [3, 0, 5] and len({tuple(cp[s : s + 2].tolist()) for s in (start[0] + 1, start[2], start[2] + 2)}) == 3


def test_probabilities_add_up():
    p = brute_model([prose(i, 30, 40) for i in range(5)], ORDER)
    alphabet = sorted({c for i in range(5) for c in prose(i, 30, 40)})
    assert abs(sum(p("al" + c) for c in [*alphabet, "?"]) - 1) < 1e-9


def test_counts_are_of_all_texts(spark, docs):
    texts = [prose(i, 25) for i in range(20)]
    want = Counter()
    for t in texts:
        s = "  " + t
        want.update(s[i : i + 3] for i in range(len(t)))
    code = lambda g: sum(ord(c) << 12 * (2 - i) for i, c in enumerate(g))
    assert {x.code: x.n for x in quality.gram_counts(docs(*enumerate(texts)), 3).collect()} == {code(g): n for g, n in want.items()}


def test_junk_goes_and_prose_stays(spark, docs):
    good = [(i, prose(i, 80)) for i in range(120)]
    junk = [(1000 + i, " ".join(w.upper() + "!!%%" for w in prose(i, 80).split())) for i in range(20)]
    marks = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(1000, 0, 0), (None, 1, 0), (5, None, None)], LABELS)
    d = docs(*good, *junk)
    keep = {x.doc_id: x.keep for x in quality.judged(d, marks).collect()}
    assert all(keep[i] for i, _ in good) and not any(keep[i] for i, _ in junk)
    assert sorted(x.doc_id for x in quality.kept(d, marks).collect()) == [i for i, _ in good]


def test_oddities(odd, spark):
    marks = spark.createDataFrame([(1, 1, 0), (2, 1, None), (6, None, 1), (None, 1, 1), (1, 1, 0)], LABELS)
    rows = quality.judged(odd, marks).collect()
    assert len(rows) == odd.count()
    blank = {3, 4, 5}
    for x in rows:
        if x.doc_id in blank:
            assert x.perplexity is None and not x.keep
        if x.doc_id == 9:
            assert x.perplexity is None and x.keep
    kept = quality.kept(odd, marks)
    assert kept.columns == odd.columns and kept.count() == sum(x.keep for x in rows)
    none, empty = spark.createDataFrame([], LABELS), spark.createDataFrame([], DOCS)
    assert quality.judged(odd, none).count() == odd.count()
    assert quality.judged(empty, marks).count() == 0 and quality.kept(empty, none).count() == 0
