import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from weftline.llm import packing


def check(rows, docs, window):
    """Every token of every document is in exactly one place; all windows but the last are full."""
    cover = {}
    for r in rows:
        for k in range(r["length"]):
            at = (r["window_id"], r["place"] + k)
            assert at not in cover
            cover[at] = (r["doc_id"], r["start"] + k)
    want = sorted((i, k) for i, n in docs for k in range(n))
    assert sorted(cover.values()) == want
    assert sorted(cover) == [(k // window, k % window) for k in range(len(want))]


def test_covers_and_keeps_proportions(spark):
    r = random.Random(3)
    rows = [(i, words(i, r.randint(1, 90)), r.choice(["a", "a", "a", "a", "b", "c"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = packing.pack(docs, window=64, targets=targets).collect()
    check(got, [(i, len(t.split())) for i, t, _ in rows], 64)
    total = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in targets}
    # Until the first queue runs dry, what a source got differs from its target by less than two tokens at any window.
    dry = min(total[s] / targets[s] for s in targets) // 64 - 1
    for w in range(int(dry)):
        for s in targets:
            assert abs(sum(x["length"] for x in got if x["source"] == s and x["window_id"] <= w) - targets[s] * 64 * (w + 1)) < 2
    again = packing.pack(docs.repartition(3), window=64, targets=targets).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def sequential(totals, targets, window):
    """Tokens of each source in each window, window by window with carried deficits."""
    names = sorted(s for s, n in totals.items() if n)
    left, deficit, out = dict(totals), dict.fromkeys(names, 0.0), []
    while sum(left[s] for s in names):
        active = [s for s in names if left[s] and targets.get(s)] or [s for s in names if left[s]]
        w = {s: targets.get(s) or 1.0 for s in active}
        for s in active:
            deficit[s] += window * w[s] / sum(w.values())
        pay = {s: min(left[s], max(0, int(deficit[s]))) for s in active}
        while sum(pay.values()) < min(window, sum(left[s] for s in names)):
            s = max((s for s in names if left[s] > pay.get(s, 0)), key=lambda s: (deficit[s] - pay.get(s, 0), -names.index(s)))
            pay[s] = pay.get(s, 0) + 1
        for s, n in pay.items():
            left[s] -= n
            deficit[s] -= n
        out.append(pay)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_schedule_is_near_a_sequential_round_robin(seed):
    r = random.Random(seed)
    totals = {f"s{k}": r.randint(1, 9000) for k in range(r.randint(1, 6))}
    targets = {s: r.random() + 0.05 for s in totals}
    schedule = packing.Schedule(totals, targets, 100)
    own = np.zeros((schedule.windows, len(schedule.sources)), dtype=int)
    w, k, _, _, n = schedule.slots(0, schedule.windows)
    own[w, k] = n
    want = sequential(totals, targets, 100)
    assert len(want) == schedule.windows
    assert (own.sum(1)[:-1] == 100).all() and own.sum(0).tolist() == [totals[s] for s in schedule.sources]
    slow = np.array([[p.get(s, 0) for s in schedule.sources] for p in want])
    assert np.abs(np.cumsum(own, 0) - np.cumsum(slow, 0)).max() <= 4 + len(totals)


def test_ranges_of_windows_continue_each_other():
    """However the windows are cut into ranges, the slots are the same; every window is full and no queue is served backwards."""
    for seed in range(30):
        r = random.Random(seed)
        totals = {f"s{k}": int(10 ** r.uniform(0, 4)) for k in range(r.randint(1, 40))}
        targets = {s: r.choice([0, 1e-7, r.random(), 10 * r.random()]) for s in totals}
        window = r.choice([1, 7, 50, 512])
        schedule = packing.Schedule(totals, targets, window)
        whole = np.stack(schedule.slots(0, schedule.windows), 1)
        cuts = sorted({0, schedule.windows, *(r.randrange(schedule.windows + 1) for _ in range(4))})
        assert (np.concatenate([np.stack(schedule.slots(a, b), 1) for a, b in itertools.pairwise(cuts)]) == whole).all()
        full = np.bincount(whole[:, 0], whole[:, 4])
        assert (full[:-1] == window).all() and (whole[:, 4] > 0).all()
        for k in range(len(schedule.sources)):
            own = whole[whole[:, 1] == k]
            assert (own[:, 3] == np.cumsum(own[:, 4]) - own[:, 4]).all() and own[:, 4].sum() == totals[schedule.sources[k]]


def test_small_targets_are_paid_all_along():
    """A source whose share of a window is far below a token still gets its part by any window."""
    totals = {"big": 4_000_000, "small": 400}
    share = 1e-4
    schedule = packing.Schedule(totals, {"big": 1 - share, "small": share}, 100)
    w, k, _, _, n = schedule.slots(0, schedule.windows)
    small = np.cumsum(np.bincount(w[k == 1], n[k == 1], minlength=schedule.windows))
    due = np.minimum(400, share * 100 * np.arange(1, schedule.windows + 1))
    assert np.abs(small - due).max() < 2


def test_thousands_of_sources(spark):
    """5,000 sources of different sizes, one of them with a third of all tokens."""
    totals = {f"s{k:04d}": 20 + k % 37 for k in range(5000)} | {"hot": 90_000}
    schedule = packing.Schedule(totals, packing.tempered(totals, 0.7), 2048)
    edges = schedule.served(np.arange(schedule.windows + 1))
    n = np.diff(edges, axis=0)
    assert (n >= 0).all() and (n.sum(1)[:-1] == 2048).all() and edges[-1].tolist() == [totals[s] for s in schedule.sources]
    rows = [(i, words(i, 20 + i % 9), f"d{i % 1000}" if i % 3 else "hot") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check(packing.pack(docs, window=512).collect(), [(i, len(t.split())) for i, t, _ in rows], 512)


def test_long_documents_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 16)
    rows = [(i, words(i, 3000 if i == 5 else i % 40 + 1), "ab"[i % 2]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check(packing.pack(docs, window=32).collect(), [(i, len(t.split())) for i, t, _ in rows], 32)


def test_many_buckets_continue_each_other(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    rows = [(i, words(i, i % 17 + 1), "ab"[i % 2]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check(packing.pack(docs, window=32).collect(), [(i, len(t.split())) for i, t, _ in rows], 32)


def test_odd_cases(odd, none):
    got = packing.pack(odd, window=512).collect()
    n = [r[0] for r in odd.select(F.size(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda x: x != ""))).where("text is not null").collect()]
    assert sum(r["length"] for r in got) == sum(n)
    assert {r["source"] for r in got} == {"s1", "s2", "s3", None}
    assert packing.pack(none).count() == 0
    assert packing.pack(odd, window=512, targets={"s1": 1.0, "gone": 2.0}).agg(F.sum("length")).first()[0] == sum(n)
