import math
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.conftest import words
from weftline.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """On rated documents that were not trained on: good ones stay, poor ones go, most toxic ones go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    model = quality.train(docs, train)
    got = quality.score(docs, model).join(test.select("doc_id", quality.grade().alias("grade")), "doc_id").toPandas()
    kept = got.groupby("grade").keep.mean()
    assert kept[2] > 0.97 and kept[0] < 0.1 and kept[1] < 0.8
    assert got.expected_grade.corr(got.grade) > 0.8


def slow_features(text):
    """slot -> value, token by token."""
    tokens, out = (text or "").split(), {}
    for k, t in enumerate(tokens):
        word = t.strip(".,;:!?\"'()[]{}#$%&*|-_/").lower()
        if word:
            out[xxhash.xxh3_64_intdigest(word) % quality.WORDS] = 1.0
        if len(word) > 4:
            out[quality.WORDS + xxhash.xxh3_64_intdigest(word[:4]) % quality.STEMS] = 1.0
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", lambda m: "X" if len(m[0]) > 1 and m[0].isupper() else "x", t)))
        at = quality.WORDS + quality.STEMS + xxhash.xxh3_64_intdigest(shape) % quality.SHAPES
        out[at] = out.get(at, 0) + 10 / len(tokens)
        if k and tokens[k - 1] == t:
            out[quality.SLOTS - 1] = out.get(quality.SLOTS - 1, 0) + 10 / len(tokens)
    return out


def test_features_and_scores_against_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [None, "", " \n", "no no NO !! 12 aa12 --", "é ß ßßßßß"]
    row, slot, value, n = quality.features(pa.array(texts, pa.string()))
    r = np.random.default_rng(3)
    model = quality.OrdinalModel(np.where(r.random(quality.SLOTS) < 0.5, r.normal(size=quality.SLOTS), 0), np.array([-0.5, 0.75]))
    tails = model.tails(texts)
    for i, t in enumerate(texts):
        want = slow_features(t)
        own = row == i
        assert n[i] == len((t or "").split()) and dict(zip(slot[own].tolist(), value[own].tolist(), strict=True)) == pytest.approx(want)
        score = sum(model.weights[k] * v for k, v in want.items())
        assert tails[i].tolist() == (pytest.approx([1 / (1 + math.exp(x - score)) for x in (-0.5, 0.75)]) if n[i] else [0, 0])


def test_gradients_are_the_differences_of_the_likelihood():
    r = np.random.default_rng(5)
    for top in (1, 2, 4):
        y = r.integers(0, top + 1, 40)
        s, theta = r.normal(size=40), np.sort(r.normal(size=top)) + 0.3 * np.arange(top)

        def plain(s, theta, y=y, top=top):
            cdf = lambda i, k: 0.0 if k < 0 else 1.0 if k >= top else 1 / (1 + math.exp(s[i] - theta[k]))
            return -sum(math.log(cdf(i, y[i]) - cdf(i, y[i] - 1)) for i in range(len(y))) / len(y)

        loss, by_score, by_theta = quality.likelihood(s, theta, y)
        assert loss == pytest.approx(plain(s, theta))
        step = 1e-5
        for k in range(40):
            d = np.eye(40)[k] * step
            assert by_score[k] == pytest.approx((plain(s + d, theta) - plain(s - d, theta)) / (2 * step), abs=1e-8)
        for k in range(top):
            d = np.eye(top)[k] * step
            assert by_theta[k] == pytest.approx((plain(s, theta + d) - plain(s, theta - d)) / (2 * step), abs=1e-7)


def test_fit_ends_at_the_optimum():
    """No weight or threshold can be changed so that the penalised likelihood gets clearly better."""
    texts = [words(k % 23, 8) + (" bad" if k % 3 == 0 else " meh" if k % 3 == 1 else " fine") * (k % 5 > 0) for k in range(120)]
    y = np.array([k % 3 for k in range(120)])
    row, slot, value, _ = quality.features(pa.array(texts))
    m = quality.fit_features(row, slot, value, y, prior=2.0, rounds=6000, rate=0.1)

    def total(w, theta):
        return 120 * quality.likelihood(np.bincount(row, w[slot] * value, 120), theta, y)[0] + 2.0 * np.abs(w).sum()

    base = total(m.weights, m.thresholds)
    for k in np.unique(slot):
        for d in (-0.02, 0.02):
            w = m.weights.copy()
            w[k] += d
            assert total(w, m.thresholds) > base - 1e-2
    for k in range(2):
        for d in (-0.02, 0.02):
            assert total(m.weights, m.thresholds + d * np.eye(2)[k]) > base - 1e-2


def test_fit_reaches_a_good_likelihood():
    """Fitting without penalty reaches a point where no small step of weights or thresholds raises the likelihood much."""
    texts = [words(k, 12) + (" bad bad" if k % 3 == 0 else " meh" if k % 3 == 1 else " fine") for k in range(90)]
    y = np.array([k % 3 for k in range(90)])

    def loss(m):
        p = np.concatenate([np.ones((90, 1)), m.tails(texts), np.zeros((90, 1))], 1)
        return -np.log(np.maximum(p[np.arange(90), y] - p[np.arange(90), y + 1], 1e-12)).mean()

    m = quality.fit(texts, y.tolist(), prior=0.0, rounds=800)
    assert loss(m) < 0.05 and (np.diff(m.thresholds) > 0).all()
    assert loss(m) < loss(quality.fit(texts, y.tolist(), prior=0.0, rounds=10))


def test_sample_is_bounded_and_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = quality.train(docs.repartition(5), labels.repartition(3), max_labelled=60, rounds=20)
    b = quality.train(docs, labels, max_labelled=60, rounds=20)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_odd_cases(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (10, 1, 1), (None, 1, 0), (3, None, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(odd, labels, rounds=50)
    got = quality.score(odd, model)
    assert got.count() == odd.count() and quality.score(none, model).count() == 0
    blank = got.join(odd.where("text is null or trim(text) in ('', '\n\t', '\n \t')").select("doc_id"), "doc_id").where("doc_id in (4, 5, 6, 7)").collect()
    assert len(blank) == 4 and all(r["expected_grade"] == 0 and r["p_top"] == 0 and not r["keep"] for r in blank)
    assert quality.select(odd, model, cut=0.0).columns == odd.columns
    for d, lab in ((none, labels), (odd, labels.limit(0)), (none, labels.limit(0))):
        free = quality.train(d, lab)
        assert quality.select(odd, free).count() == odd.count() - 5 and quality.score(none, free).count() == 0
    for g in range(3):
        one = quality.fit(["a b", "c d"] * 5, [g] * 10)
        assert one.tails(["a b"])[0].round().tolist() == [float(g >= 1), float(g >= 2)]
    low = quality.fit(["a b", "c d"] * 5, [0, 1] * 5)
    assert len(low.thresholds) == 2 and (low.tails(["c d"])[:, 1] < 0.2).all()
    assert {r["p_top"] for r in quality.score(odd, low, at_least=7).collect()} == {0.0}


def test_repeated_ids_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(3)], "doc_id bigint, quality int, toxic int")
    a = quality.train(docs.repartition(4), labels, max_labelled=10, rounds=5)
    b = quality.train(docs, labels, max_labelled=10, rounds=5)
    assert (a.weights == b.weights).all() and np.count_nonzero(a.weights) <= 10 * 5


def test_score_is_the_tail_sum(spark):
    docs = spark.createDataFrame([(1, words(1, 30))], "doc_id bigint, text string")
    m = quality.OrdinalModel(np.zeros(quality.SLOTS), np.array([-1.0, 1.0]))
    r = quality.score(docs, m).first()
    low, high = 1 / (1 + np.exp(-1.0)), 1 / (1 + np.exp(1.0))
    assert r["expected_grade"] == pytest.approx(low + high) and r["p_top"] == pytest.approx(high)
