import hashlib
from collections import defaultdict

from plumbline.llm import mix
from tests.llm.conftest import DOCS, prose


def brute(rows, weights, default, levels):
    place = lambda i: int(hashlib.md5(f"{mix.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16)
    by = defaultdict(lambda: defaultdict(int))
    for i, t, s in rows:
        by[s][place(i)] += len((t or "").split())
    total = {s: sum(v.values()) for s, v in by.items()}
    w = {s: weights.get(s, default) for s in total}
    unit = min((total[s] // w[s] for s in total if w[s] and total[s]), default=0)
    level = {}
    for s, v in by.items():
        run = 0
        for p in sorted(v):
            run += v[p]
            level[s, p] = next((k for k in range(1, levels + 1) if run <= unit * w[s] * k // levels), None)
    return sorted((repr(i), repr(s), len((t or "").split()), level[s, place(i)]) for i, t, s in rows if level[s, place(i)])


def test_brute_force(spark, docs):
    data = [(i, prose(i, 5 + i * 7 % 90), "en", f"src{i % 5}") for i in range(400)] + [(i, prose(i, 9), "en", None) for i in range(400, 440)] + [(None, "a b", "en", "src1"), (3, "again", "en", "src3")]
    got = mix.mixed_in(docs(*data), {"src0": 3, "src4": 0}, 1, 4).collect()
    assert sorted((repr(x.doc_id), repr(x.source), x.tokens, x.level) for x in got) == brute([(i, t, s) for i, t, _, s in data], {"src0": 3, "src4": 0}, 1, 4)


def test_few_bits_refine_the_same(spark, docs):
    """With two bits a bucket, nearly all is decided in refined buckets."""
    narrow = mix.counted(docs(*[(i, prose(i, 20), "en", f"src{i % 3}") for i in range(120)]))
    a, b = (sorted(map(repr, mix.thresholds(narrow, {}, 1, 4, bits).select("source", "level").collect())) for bits in (2, 12))
    assert a == b
    chosen = []
    for bits in (2, 12):
        t = {(x.source, x.level): x.last for x in mix.thresholds(narrow, {}, 1, 4, bits).collect()}
        chosen.append({(x.doc_id, k) for x in narrow.collect() for k in range(1, 5) if x.place <= t[x.source, k]})
    assert chosen[0] == chosen[1]


def test_nested_and_in_proportion(spark, docs):
    got = mix.mixed_in(docs(*[(i, prose(i, 50), "en", f"src{i % 2}") for i in range(600)]), {"src0": 2, "src1": 1}, 1, 4).collect()
    of = lambda s, k: sum(x.tokens for x in got if x.source == s and x.level <= k)
    for k in range(1, 5):
        assert abs(of("src0", k) - 2 * of("src1", k)) <= 100


def test_oddities(odd, spark):
    got = mix.mixed_in(odd).collect()
    assert {x.source for x in got} <= {"s", None}
    kept = mix.mixture(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(got)
    assert mix.mixed_in(spark.createDataFrame([], DOCS)).count() == 0
    assert mix.mixture(spark.createDataFrame([], DOCS)).count() == 0
