import itertools
import random

import numpy as np

from tests.llm.conftest import words
from weftline.llm import graph, simhash


def near_texts(n=400, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if i % 4 == 0 or not out:
            out.append(words(seed * 1000 + i, r.randint(30, 120)))
        else:
            w = r.choice(out[-8:]).split()
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = words(r.randrange(10**6), 1)
            out.append(" ".join(w))
    return out


def brute_groups(ids, a, b, has, tau=simhash.TAU, both=simhash.TAU_BOTH):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(ids)), 2):
        if has[x] and has[y]:
            p, q = bin(int(a[x] ^ a[y])).count("1"), bin(int(b[x] ^ b[y])).count("1")
            if p <= tau and p + q <= both:
                u, v = find(ids[x]), find(ids[y])
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def test_all_pairs_are_found(spark):
    """Every pair that brute force finds is connected, and nothing else: recall and precision of 1."""
    texts = near_texts()
    a, b, has = simhash.signatures(texts)
    want = {(i, r) for i, r in brute_groups(list(range(len(texts))), a, b, has).items() if i != r}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert len(want) > 100
    assert set(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.one_of_each(docs).count() == len(texts) - len(want)


def test_partition_thresholds_find_every_near_value():
    """Whatever thresholds are allocated, signatures within tau share a key."""
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    flips = np.array([sum(1 << int(k) for k in r.choice(64, r.integers(0, 12), replace=False)) for _ in a], dtype=np.uint64)
    c = a ^ flips
    for m in (3, 4, 5, 8):
        parts = simhash.group_bits(np.corrcoef(r.random((64, 100))), m)
        assert sorted(itertools.chain(*parts)) == list(range(64))
        costs = [[0.0, *r.random(5).cumsum().tolist()] for _ in range(m)]
        t = simhash.allocate(costs, 11)
        assert sum(x + 1 for x in t) >= 12
        how = simhash.Plan(parts, t)
        met = np.zeros(len(a), bool)
        mine, theirs = ([k | np.int64(i << 56) for i in how.used for k in how.keys(x, i)] for x in (a, c))
        for x in mine:
            for y in theirs:
                met |= x == y
        assert met.all()


def test_allocation_is_the_cheapest():
    r = random.Random(4)
    for _ in range(30):
        costs = [[0.0] + sorted(r.random() for _ in range(4)) for _ in range(4)]
        t = simhash.allocate(costs, 7)
        cost = lambda t: sum(c[x + 1] for c, x in zip(costs, t, strict=True))
        best = min(cost(x) for x in itertools.product(range(-1, 4), repeat=4) if sum(k + 1 for k in x) >= 8)
        assert abs(cost(t) - best) < 1e-12


def test_counted_pairs():
    r = np.random.default_rng(3)
    values = r.integers(0, 64, 200)
    got = simhash.pairs_within(np.bincount(values, minlength=64), 6, 6)
    for t in range(7):
        assert got[t] == sum(bin(int(x ^ y)).count("1") <= t for x, y in itertools.combinations(values, 2))


def test_signature_against_a_slow_one():
    texts = ["one two two three", "", None, words(1, 900), "x"]
    h, row = simhash.word_sets(texts)
    a, _, has = simhash.signatures(texts)
    assert has.tolist() == [True, False, False, True, True]
    for i in np.flatnonzero(has):
        own = [int(x) for x in h[row == i]]
        assert len(own) == len(set(texts[i].split()))
        # numpy holds the bytes from the lowest, and each byte's bits from the highest.
        slow = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in own) > len(own))
        assert slow == int(a[i])


def test_components(spark):
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in edges:
        if u is not None and v is not None:
            p, q = find(u), find(v)
            root[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in root if find(x) != x}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_odd_cases(odd, none):
    got = sorted(map(tuple, simhash.near_duplicates(odd).collect()))
    assert got == [(3, 1), (9, 8), (10, 10)]
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == odd.count() - 3 and {r["wl_place"] for r in rows} == {5} and {r["a"] for r in rows} == {1}
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_sharing_a_long_passage_is_no_duplicate(spark):
    shared = words(77, 60)
    docs = spark.createDataFrame([(i, words(i, 200) + " " + shared) for i in range(50)], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
