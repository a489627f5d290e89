import numpy as np
import pytest

from plumbline.llm import decontam
from plumbline.llm.common import Words
from tests.llm.conftest import DOCS, prose

ITEMS = "item_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words(seed, n):
    return prose(seed, n, 100_000).split()


def altered(item, k, seed):
    r = np.random.default_rng(seed)
    out = list(item)
    for _ in range(k):
        at, what = int(r.integers(len(out))), int(r.integers(3))
        if what == 0:
            out[at] = f"new{r.integers(10**6)}"
        elif what == 1:
            out.insert(at, f"new{r.integers(10**6)}")
        else:
            out.pop(at)
    return out


def test_recall_of_edited_passages_and_exact_distances(spark, docs):
    """Passages anywhere in a document, with any number of edits up to the budget."""
    items = {i: words(i, 12 + i % 30) for i in range(30)}
    data, want = [], {}
    for d in range(300):
        i = d % 30
        k = d // 30 * decontam.budget(len(items[i])) // 9
        body = altered(items[i], k, d)
        data.append((d, " ".join(words(5000 + d, d % 7 * 40) + body + words(9000 + d, d % 5 * 30))))
        want[d, i] = distance(items[i], body)
    data += [(1000 + d, prose(70_000 + d, 300)) for d in range(50)]
    bench = spark.createDataFrame([(i, " ".join(w).upper() + ".") for i, w in items.items()], ITEMS)
    got = {(x.doc_id, x.item_id): x for x in decontam.contaminated(docs(*data), bench).collect()}
    must = [p for p, k in want.items() if k <= decontam.budget(len(items[p[1]]))]
    assert np.mean([p in got for p in must]) >= 0.95
    assert all(p in want for p in got)
    for p, x in got.items():
        assert x.edits <= want[p]
        there = data[p[0]][1].split()[x.first_word : x.first_word + x.words]
        assert distance(items[p[1]], there) == x.edits


def test_edit_distance_and_best_part():
    r = np.random.default_rng(3)
    for _ in range(200):
        a, b = (r.integers(0, 4, r.integers(1, 9)).astype(np.uint64) for _ in range(2))
        assert decontam.edit_distance(a, b) == distance(a.tolist(), b.tolist())
        every = {(x, y): distance(a.tolist(), b[x:y].tolist()) for x in range(len(b) + 1) for y in range(x, len(b) + 1)}
        edits, at, size = decontam.best_part(a, b)
        assert edits == min(every.values()) == every[at, at + size]


@pytest.mark.parametrize("size", [8, 12, 20, 40, 80, 160, 320])
def test_recall_at_the_full_budget(size):
    """Copies at the largest distance, for items of any size, among items of other sizes."""
    items = [(k, " ".join(f"i{k}w{x}" for x in np.random.default_rng(k).integers(0, 5000, n))) for k, n in enumerate([size] * 6 + [9, 30, 100])]
    index = decontam.Index(items).open()
    k, found = decontam.budget(size), 0
    for c in range(60):
        body = altered(items[c % 6][1].split(), k, [size, c])
        text = " ".join(words(c, 30) + body + words(c + 100, 20))
        got = {i: edits for _, i, edits, *_ in decontam.matches([text], index)}
        assert got.get(c % 6, 0) <= k
        found += c % 6 in got
    assert found >= 0.97 * 60


def test_no_window_is_left_out():
    """The run filter passes a window at every place where a match within the budget begins."""
    item = words(1, 40)
    index = decontam.Index([(1, " ".join(item))]).open()
    for seed in range(40):
        body = altered(item, decontam.budget(40), seed)
        before = words(777 + seed, 25)
        w = Words([" ".join(before + body + words(888 + seed, 30))])
        starts = decontam.windows(w, index).get(40, [])
        best = min((min(decontam.edit_distance(index.words[0], w.hash[s : s + n]) for n in range(32, 49)) for s in starts), default=99)
        assert best <= decontam.budget(40)


def test_short_items_are_found_as_they_are(spark, docs):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Yes"), (3, "one two three four five six seven eight")], ITEMS)
    d = docs((1, "he asked, what is the CAPITAL of france? yes"), (2, "what is the capital of spain"), (3, "one two three four six seven eight"))
    got = {(x.doc_id, x.item_id, x.edits) for x in decontam.contaminated(d, bench).collect()}
    assert got == {(1, 1, 0), (1, 2, 0), (3, 3, 1)}
    # a short item is reported, but no reason to drop a document
    assert {x.doc_id for x in decontam.clean(d, bench).collect()} == {1, 2}
    assert {x.doc_id for x in decontam.clean(d, bench, least=1).collect()} == {2}


def test_items_in_blocks_give_the_same(spark, docs):
    items = [(k, " ".join(words(k, 20))) for k in range(12)]
    bench = spark.createDataFrame(items, ITEMS)
    d = docs(*[(k, "before " + items[k % 12][1] + " after") for k in range(24)], (99, "none of it"))
    one, many = (sorted(map(tuple, decontam.contaminated(d, bench, n).collect())) for n in (10_000, 60))
    assert one == many and len(one) >= 24
    assert [x.doc_id for x in decontam.clean(d, bench, 60).collect()] == [99]


def test_oddities(odd, spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, prose(2, 60)), (4, prose(2, 60)), (None, prose(3, 60)), (6, prose(1, 20_000)[:5000])], ITEMS)
    got = decontam.contaminated(odd, bench).collect()
    assert sorted((repr(x.doc_id), repr(x.item_id)) for x in got) == sorted([("1", "4")] * 4 + [("2", "None"), ("6", "6")])
    kept = decontam.clean(odd, bench)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count() - 4
    none, empty = spark.createDataFrame([], ITEMS), spark.createDataFrame([], DOCS)
    assert decontam.contaminated(odd, none).count() == 0 and decontam.clean(odd, none).count() == odd.count()
    assert decontam.contaminated(empty, bench).count() == 0
