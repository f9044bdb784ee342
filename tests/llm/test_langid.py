import re

import numpy as np

from tests.llm.conftest import words
from weftline.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    filters = langid.train(docs.where("doc_id % 2 = 0"))
    got = langid.identify(docs.where("doc_id % 2 = 1"), filters).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.language == got.lang).mean() > 0.98


def test_filters_hold_all_their_ngrams_and_few_others():
    """No stored n-gram is missed; foreign ones are claimed about as often as the filter says."""
    texts = {"x": words(1, 4000), "y": "abcd efgh ijkl mnop qrst " * 50 + words(2, 50)}
    grams = {k: np.unique(langid.ngrams([t])[0]) for k, t in texts.items()}
    f = langid.build(grams)
    for bit, name in enumerate(f.languages):
        assert ((f.masks(grams[name]) >> bit) & 1).all()
    foreign = np.random.default_rng(1).integers(0, 2**63, 200_000, dtype=np.int64).view(np.uint64)
    for bit in range(2):
        claimed = ((f.masks(foreign) >> bit) & 1).mean()
        assert abs(claimed - f.wrong[bit]) < 0.1 * f.wrong[bit] + 5e-4


def test_counts_against_sets():
    """Masks and counts against a plain set of n-grams in each language."""
    text = "Hello, wide WORLD hello"
    folded = [f" {w} " for w in text.lower().replace(",", "").split()]
    want = [w[i : i + 4] for w in folded for i in range(len(w) - 3)]
    grams, row = langid.ngrams([None, text, "", "a b"])
    assert len(grams) == len(want) and set(row) == {1}
    assert len(set(grams.tolist())) == len(set(want))


def plain_grams(text):
    out = []
    for w in re.findall(r"[^\W\d_]+", text or ""):
        w = f" {w.lower()} "
        out += [w[i : i + 4] for i in range(len(w) - 3)]
    return out


def test_masks_counts_and_decision_against_plain_sets(spark):
    """Every language that contains an n-gram is in its mask; corrected counts are near those of sets; the language that sets give most n-grams is chosen."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and length(text) > 40")
    rows = docs.select("doc_id", "text", "lang").collect()
    train, test = ([r for r in rows if r["doc_id"] % 3 > 0], [r for r in rows if r["doc_id"] % 3 == 0])
    sets = {}
    for r in train:
        sets.setdefault(r["lang"], set()).update(plain_grams(r["text"]))
    filters = langid.train(docs.where("doc_id % 3 > 0"), per_language=10**6)
    assert filters.languages == sorted(sets)
    counts, n = filters.counts([r["text"] for r in test])
    slow = np.array([[sum(g in sets[k] for g in plain_grams(r["text"])) for k in filters.languages] for r in test])
    assert n.tolist() == [len(plain_grams(r["text"])) for r in test]
    assert np.abs(counts - slow).max() <= 0.02 * n.max() + 3 and (np.abs(counts - slow) <= 0.03 * n[:, None] + 4).all()
    chosen = {r["doc_id"]: r for r in langid.identify(docs.where("doc_id % 3 = 0"), filters).collect()}
    for r, own, size in zip(test, slow, n, strict=True):
        order = np.sort(own)[::-1]
        if order[0] - order[1] > 0.05 * size and order[0] > 0.8 * size:
            assert chosen[r["doc_id"]]["language"] == filters.languages[int(own.argmax())]
    # All languages that contain an n-gram come back, whatever others contain it.
    some = [g for g in sorted(set().union(*sets.values())) if sum(g in x for x in sets.values()) > 1][:2000]
    for g in some:
        grams, _ = langid.ngrams([f"zzzz{g.strip()}" if not g.startswith(" ") else g])
        if g.startswith(" ") and g.endswith(" "):
            mask = int(filters.masks(grams[:1])[0])
            assert all(mask >> k & 1 for k, name in enumerate(filters.languages) if g in sets[name])


def test_more_than_eight_languages():
    grams = {f"l{k:02}": np.unique(langid.ngrams([words(k, 30)])[0]) for k in range(20)}
    f = langid.build(grams)
    counts, n = f.counts([words(13, 30)])
    assert f.table.dtype == np.uint32 and f.languages[int(counts[0].argmax())] == "l13" and counts[0, 13] == n[0]


def test_odd_cases(spark, odd, none):
    filters = langid.train(odd)
    got = {r["doc_id"]: r for r in langid.identify(odd, filters).where("doc_id is not null").collect()}
    assert got[4]["language"] == "und" and got[5]["language"] == "und" and got[7]["confidence"] == 0
    assert langid.identify(odd, filters).count() == odd.count()
    assert langid.identify(none, filters).count() == 0
    empty = langid.train(none)
    assert {r["language"] for r in langid.identify(odd, empty).collect()} == {"und"}
