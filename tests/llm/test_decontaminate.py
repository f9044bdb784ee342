import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import words
from weftline.llm import decontaminate as d


def brute(docs, tests, ngram=8, least=5):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = defaultdict(set)
    for item, t in tests:
        w = split(t)
        if len(w) < least and len("".join(w)) < 24 or not w:
            continue
        k = min(ngram, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i, own in docs:
            v = split(own)
            hits = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} & grams
            if hits:
                found[i, item] |= hits
    return sorted((i, item, len(h)) for (i, item), h in found.items())


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=400), st.lists(st.text("ab", min_size=1, max_size=9), min_size=1, max_size=12, unique=True))
def test_finds_every_occurrence(text, patterns):
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    machine = d.WuManber([code(p).tobytes() for p in patterns], block=3)
    got = sorted((at, bytes(machine.patterns[p])) for at, p in machine.find(code(text)))
    want = sorted((i, code(p).tobytes()) for p in patterns for i in range(len(text)) if text.startswith(p, i))
    assert got == want


def test_against_brute_force(spark):
    r = random.Random(5)
    tests = [(k, words(1000 + k, r.randint(2, 40))) for k in range(30)] + [(30, words(1000, 20)), (31, None), (32, "")]
    docs = []
    for i in range(150):
        own = words(i, r.randint(0, 200)).split()
        if i % 3 == 0:
            w = r.choice(tests[:30])[1].upper().split()
            cut = r.randint(0, max(0, len(w) - 9))
            own[len(own) // 2 : len(own) // 2] = [x + "," for x in w[cut : cut + r.randint(4, 30)]]
        docs.append((i, " ".join(own)))
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(tests, "item_id bigint, text string")
    want = brute(docs, tests)
    assert len(want) > 20
    assert sorted(map(tuple, d.leaks(a, b).collect())) == want
    assert sorted(r[0] for r in d.clean(a, b).select("doc_id").collect()) == sorted({i for i, _ in docs} - {i for i, _, _ in want})


def test_passes_over_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(d, "PASS_CHARS", 200)
    tests = [(k, words(50 + k, 12)) for k in range(20)]
    docs = [(i, words(i, 30) + " " + tests[i % 20][1]) for i in range(40)]
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(tests, "item_id bigint, text string")
    assert sorted(map(tuple, d.leaks(a, b).collect())) == brute(docs, tests)
    assert d.clean(a, b).count() == 0


def test_nothing_spans_two_documents(spark):
    a = spark.createDataFrame([(1, "one two three four"), (2, "five six seven eight")], "doc_id bigint, text string").coalesce(1)
    b = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id bigint, text string")
    assert d.leaks(a, b).count() == 0


def test_odd_cases(spark, odd, none):
    b = spark.createDataFrame([(1, words(1, 60), 3), (None, words(3, 50), 3), (2, None, 3), (3, "x", 3)], "item_id bigint, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(odd, b).collect()}
    assert got == {(1, 1), (3, 1), (None, 1), (10, None)}
    kept = d.clean(odd, b)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5
    assert d.leaks(none, b).count() == 0 and d.leaks(odd, b.limit(0)).count() == 0
    assert d.clean(odd, b.limit(0)).count() == odd.count() and d.clean(none, b).count() == 0


def test_short_strings_and_scripts_without_blanks(spark):
    han = "".join(chr(0x4E00 + (k * 37) % 3000) for k in range(40))
    tests = [(1, "antidisestablishmentarianism floccinaucinihilipilification"), (2, "yes it is"), (3, han), (4, f"abc {han[:4]} def {han[20:24]} tail words here now"), (5, None)]
    docs = [
        (1, "so Antidisestablishmentarianism, floccinaucinihilipilification!"),
        (2, "yes it is"),
        (3, "前" + han[3:22] + "后"),
        (4, han[:12]),
        (5, f"x abc {han[:4]} def {han[20:24]} tail words here now y"),
        (6, han[::-1]),
    ]
    docs, tests = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(tests, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, tests).collect()}
    assert got == {(1, 1), (3, 3), (5, 4)}
    assert {r["doc_id"] for r in d.clean(docs, tests).collect()} == {2, 4, 6}


def test_several_passes_find_the_same(spark, monkeypatch):
    r = random.Random(2)
    tests = [(k, words(50 + k, r.randint(6, 30))) for k in range(40)] + [(None, words(51, 12)), (7, words(51, 12))]
    docs = [(i, " ".join([words(i, 20), tests[i % 40][1], words(i + 7, 5)])) for i in range(60)] + [(None, tests[3][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(tests, "item_id bigint, text string")
    one = sorted(map(str, d.leaks(frame, bench).collect()))
    monkeypatch.setattr(d, "PASS_CHARS", 500)
    assert sorted(map(str, d.leaks(frame, bench).collect())) == one and len(one) > 60
    assert d.clean(frame, bench).count() == 0
