import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words
from weftline.llm import brown


def slow_likelihood(pairs, classes):
    n, left, right = Counter(), Counter(), Counter()
    for (a, b), k in pairs.items():
        n[classes[a], classes[b]] += k
        left[classes[a]] += k
        right[classes[b]] += k
    f = lambda c: sum(x * math.log(x) for x in c.values())
    return f(n) - f(left) - f(right)


def test_gain_of_a_move_is_the_difference_of_likelihoods():
    r = random.Random(1)
    size, movable, codes = 6, 4, 12
    for _ in range(20):
        classes = np.array([r.randrange(movable) for _ in range(codes - 2)] + [4, 5])
        pairs = Counter((r.randrange(codes), r.randrange(codes)) for _ in range(150))
        n = np.zeros((size, size))
        for (a, b), k in pairs.items():
            n[classes[a], classes[b]] += k
        w = r.randrange(codes - 2)
        after = np.bincount(classes, [pairs[w, o] for o in range(codes)], minlength=size)
        before = np.bincount(classes, [pairs[o, w] for o in range(codes)], minlength=size)
        k, gain = brown.best_class(n, int(classes[w]), after, before, float(pairs[w, w]), movable)
        base = slow_likelihood(pairs, classes)
        gains = []
        for c in range(movable):
            tried = classes.copy()
            tried[w] = c
            gains.append(slow_likelihood(pairs, tried) - base)
        assert gain == pytest.approx(max(gains), abs=1e-8) and gains[k] == pytest.approx(max(gains), abs=1e-8)


def texts():
    r = random.Random(9)
    noun, verb, end = [f"n{k}x" for k in range(12)], [f"v{k}y" for k in range(12)], [f"e{k}z" for k in range(12)]
    return [" ".join(w for _ in range(40) for w in (r.choice(noun), r.choice(verb), r.choice(end))) for _ in range(60)]


def test_counts_and_probabilities_against_brute_force(spark):
    own = texts() + [None, "", "Odd, WORDS once."]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string").repartition(4)
    model = brown.train(docs, classes=6, common=1e-3, rounds=3)
    assert model.trace == sorted(model.trace) and len(model.trace) > 1
    code = model.lexicon
    every = [[code[w] for w in (t or "").split()] for t in own]
    pairs = Counter(p for c in every for p in itertools.pairwise([code.start, *c]))
    assert model.trace[-1] == pytest.approx(slow_likelihood(pairs, model.classes))
    sums = np.exp(model.log_transition).sum(1)
    assert sums == pytest.approx(np.ones(len(sums)))
    for c in range(6):
        assert np.exp(model.log_emission[: len(code.words)][model.classes[: len(code.words)] == c]).sum() == pytest.approx(1)
    got = {r["doc_id"]: r for r in brown.score(docs, model).collect()}
    for i, c in enumerate(every):
        p = sum(model.log_transition[model.classes[a], model.classes[b]] + model.log_emission[b] for a, b in itertools.pairwise([code.start, *c]))
        assert got[i]["n_words"] == len(c) and got[i]["log_prob"] == pytest.approx(p)
        assert got[i]["perplexity"] == (pytest.approx(math.exp(-p / len(c))) if c else None)


def test_classes_are_the_kinds_of_word(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string")
    model = brown.train(docs, classes=3, common=1e-4, rounds=8)
    kinds = {}
    for w, i in model.lexicon.words.items():
        kinds.setdefault(w[0], Counter())[int(model.classes[i])] += 1
    assert len({c.most_common(1)[0][0] for c in kinds.values()}) == 3
    assert all(c.most_common(1)[0][1] >= 10 for c in kinds.values())
    # A text in the order of the corpus is likelier than the same words shuffled.
    a, b = texts()[0].split(), texts()[0].split()
    random.Random(1).shuffle(b)
    (p, q), _ = model.log_probs([" ".join(a), " ".join(b)])
    assert p > q


def test_odd_cases(spark, odd, none):
    model = brown.train(odd, classes=4, common=1e-3, rounds=1)
    got = brown.score(odd, model)
    assert got.count() == odd.count()
    blank = got.where("doc_id in (4, 5, 6, 7)").collect()
    assert len(blank) == 4 and all(r["n_words"] == 0 and r["perplexity"] is None and r["log_prob"] == 0 for r in blank)
    assert got.where("n_words > 0 and (perplexity is null or isnan(perplexity) or perplexity > 1e300)").count() == 0
    empty = brown.train(none, rounds=1)
    assert brown.score(none, empty).count() == 0
    (p,), (n,) = empty.log_probs([words(1, 3)])
    assert n == 3 and np.isfinite(p)


def test_words_seen_twice_have_their_own_probability_in_any_corpus(spark):
    docs = spark.createDataFrame([(i, "one two three four five " * 4000) for i in range(20)] + [(20, "twice once twice thrice thrice thrice")], "doc_id bigint, text string")
    model = brown.train(docs, classes=4, rounds=1)
    assert set(model.lexicon.words) == {"one", "two", "three", "four", "five", "twice", "thrice"}
    two, three = (model.lexicon[w] for w in ("twice", "thrice"))
    if model.classes[two] == model.classes[three]:
        assert model.log_emission[three] - model.log_emission[two] == pytest.approx(math.log(1.5))


def test_exchange_goes_on_until_no_word_gains(spark):
    """With all words in one group, moves that lose together are halved, and the search ends where no single move gains."""
    own = texts()
    model = brown.train(spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string"), classes=6, groups=1, tolerance=0.0)
    code = model.lexicon
    pairs = Counter(p for t in own for p in itertools.pairwise([code.start, *(code[w] for w in t.split())]))
    base = slow_likelihood(pairs, model.classes)
    assert model.trace == sorted(model.trace) and model.trace[-1] == pytest.approx(base)
    for w in range(len(code.words)):
        for c in range(6):
            tried = model.classes.copy()
            tried[w] = c
            assert slow_likelihood(pairs, tried) <= base + 1e-5


def test_contexts_are_blocks_that_hold_every_bigram(spark):
    """A row is a block of words, so that a step of the exchange passes few rows to Python; no bigram is lost in them."""
    own = [*texts(), None, "", "Odd, WORDS once.", "x " * 900]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string").repartition(4)
    code = brown.train(docs, classes=6, rounds=0).lexicon
    every = [[code[w] for w in (t or "").split()] for t in own]
    pairs = Counter(p for c in every for p in itertools.pairwise([code.start, *c]))
    groups = 3
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = brown.contexts(docs.select("text").where("text is not null"), code, groups, 10_000).collect()
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
    assert len(rows) <= groups + 1 < len(code.words)
    found = {True: Counter(), False: Counter()}
    seen = []
    for r in rows:
        w = np.frombuffer(r["w"], np.int32)
        seen += w.tolist()
        assert all((r["turn"] < groups) == (c < len(code.words)) for c in w)
        for after in (True, False):
            sizes, o, n = brown._unside(pa.py_buffer(r["after" if after else "before"]))
            for a, b, k in zip(np.repeat(w, sizes).tolist(), o.tolist(), n.tolist(), strict=True):
                found[after][(a, b) if after else (b, a)] += k
    assert len(seen) == len(set(seen)) and set(range(len(code.words))) <= set(seen)
    assert found[True] == pairs
    assert found[False] == Counter({p: k for p, k in pairs.items() if p[1] < len(code.words)})


def test_changes_at_every_level_against_brute_force(spark, monkeypatch):
    """Neighbours that move at different levels or at the same, repeated words, and more bigrams than a task holds at once."""
    monkeypatch.setattr(brown, "_HELD", 40)
    r, size = random.Random(3), 9
    codes = 32
    pairs = Counter((r.randrange(codes), r.randrange(codes)) for _ in range(900))
    pairs[3, 3] = 70_000
    blocks = []
    for start in range(0, codes, 5):
        own = range(start, min(start + 5, codes))
        packed = []
        for after in (True, False):
            lists = [sorted((o, k) for (a, b), k in pairs.items() for mine, o in [(a, b) if after else (b, a)] if mine == w) for w in own]
            flat = [x for x in itertools.chain(*lists)]
            packed.append(bytearray(brown._side(np.array([len(x) for x in lists]), np.array([o for o, _ in flat]), np.array([k for _, k in flat]))))
        blocks.append((bytearray(np.array(own, np.int32).tobytes()), *packed, 0))
    table = spark.createDataFrame(blocks, brown._CONTEXTS)
    classes = np.array([r.randrange(size) for _ in range(codes)], np.uint8)
    moved = r.sample(range(codes), 13)
    then, level, levels = classes.copy(), np.full(codes, -1, np.int8), 4
    then[moved] = [r.randrange(size) for _ in moved]
    for q in range(levels):
        level[moved[: 13 >> q]] = q

    def table_of(c):
        n = np.zeros((size, size))
        for (a, b), k in pairs.items():
            n[c[a], c[b]] += k
        return n

    assert np.array_equal(brown.class_bigrams(table, classes, size), table_of(classes))
    got = brown.changes(table, classes, then, level, levels, size)
    for q in range(levels):
        assert np.array_equal(got[q], table_of(np.where(level >= q, then, classes)) - table_of(classes))


def test_moves_of_many_words_against_brute_force():
    """Counts over and under those that are looked up, loops, words without a neighbour on one side."""
    r = random.Random(8)
    size, movable, codes = 7, 5, 24
    classes = np.array([r.randrange(movable) for _ in range(codes - 2)] + [5, 6])
    pairs = Counter({(r.randrange(codes), r.randrange(1, codes)): r.choice((1, 3, 31, 32, 400)) for _ in range(200)})
    pairs[4, 4] = 50
    n = np.zeros((size, size))
    for (a, b), k in pairs.items():
        n[classes[a], classes[b]] += k
    words = range(codes - 2)
    after, before = (np.array([np.bincount(classes, [pairs[(w, o) if side else (o, w)] for o in range(codes)], minlength=size) for w in words]) for side in (True, False))
    loop = np.array([float(pairs[w, w]) for w in words])
    to, gain = brown.best_classes(n, classes[: codes - 2], after, before, loop, movable, (brown.Cells(n[:movable].T), brown.Cells(n[:, :movable])))
    base = slow_likelihood(pairs, classes)
    for w in words:
        gains = []
        for c in range(movable):
            tried = classes.copy()
            tried[w] = c
            gains.append(slow_likelihood(pairs, tried) - base)
        assert gain[w] == pytest.approx(max(gains), abs=1e-7) and gains[to[w]] == pytest.approx(max(gains), abs=1e-7)
