import random

import numpy as np
import pytest

from weftline.llm import urls


def brute(url, listed):
    import re

    m = re.match(r"\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)(?::\d+)?([^#\s]*)", url or "", re.I)
    if not m:
        return None, False
    host = m[1].lower()
    parts = host.split(".")
    keys = {".".join(parts[i:]) for i in range(len(parts))} | {re.sub(r"^www\.", "", host) + re.sub(r"/$", "", m[2])}
    return host, bool(keys & listed)


def universe(spark, n, listed):
    rows = [(f"k{i}", i < listed) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, listed boolean")
    h1, h2 = urls._hashes(df["key"])
    return df.select("key", h1.alias("h1"), h2.alias("h2"), "listed")


@pytest.mark.parametrize(("n", "listed", "local"), [(3000, 100, 10**9), (3000, 100, 0), (3000, 2900, 0), (500, 500, 0), (500, 0, 0), (2, 1, 0)])
def test_exact_over_the_universe(spark, monkeypatch, n, listed, local):
    """Built on the driver or on the executors, the cascade has no wrong answer over the whole universe."""
    monkeypatch.setattr(urls, "LOCAL", local)
    own = universe(spark, n, listed)
    cascade = urls.build(own)
    t = own.toPandas()
    assert (cascade.listed(t.h1.to_numpy(), t.h2.to_numpy()) == t.listed.to_numpy()).all()
    monkeypatch.setattr(urls, "SHARD_BYTES", max(40, listed))
    shards = urls.build(own)
    assert (len(shards.files) > 1) == (listed >= 100)
    assert (shards.listed(t.h1.to_numpy(), t.h2.to_numpy()) == t.listed.to_numpy()).all()


def test_levels_alternate_and_shrink(spark):
    cascade = urls.cascade(universe(spark, 20_000, 1000))
    sizes = [x.bits for x in cascade.levels]
    assert len(sizes) > 3 and sizes[0] == max(sizes) and sum(sizes) < 32_000


def test_equal_hashes_are_refused(spark):
    with pytest.raises(RuntimeError):
        urls.build(spark.createDataFrame([(1, 2, True), (1, 2, False)], "h1 bigint, h2 bigint, listed boolean"))


def test_pages_against_brute_force(spark, monkeypatch):
    r = random.Random(1)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "m.", "x.y.") for b in ("good", "bad", "ugly", "notbad") for c in ("com", "example.org")]
    rows = [(i, f"{r.choice(['http', 'HTTPS'])}://{r.choice(['', 'me:pw@'])}{r.choice(hosts).upper() if i % 3 else r.choice(hosts)}{r.choice(['', ':8080'])}/p{r.randint(0, 5)}{r.choice(['', '/', '?q=1', '#top'])}") for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "no url"), (None, "http://bad.com"), (1, rows[1][1]), (1, rows[1][1]), (1003, "http://a b/"), (1004, "http://")]
    listed = {"bad.com", "ugly.example.org", "good.com/p3", "never.seen"}
    pages = spark.createDataFrame([(*x, 1, "z") for x in rows], "page_id bigint, url string, keys int, host string")
    entries = spark.createDataFrame([(k.upper(), 1) for k in listed] + [(None, 1), ("bad.com", 2)], "key string, page_id int")
    want = sorted(((i, u, *brute(u, listed)) for i, u in rows), key=str)
    got = urls.blocked(pages, entries)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert urls.blocked(pages.limit(0), entries).count() == 0
    assert not any(x["blocked"] for x in urls.blocked(pages, entries.limit(0)).collect())
    monkeypatch.setattr(urls, "SHARD_BYTES", 1)
    assert sorted(map(tuple, urls.blocked(pages, entries).collect()), key=str) == want


def test_false_positive_rate():
    r = np.random.default_rng(2)
    a, b = r.integers(-(2**62), 2**62, (2, 60_000))
    level = urls.Level.sized(20_000, 0.05, 3)
    level.add(a[:20_000], b[:20_000])
    assert level.claims(a[:20_000], b[:20_000]).all()
    assert abs(level.claims(a[20_000:], b[20_000:]).mean() - 0.06) < 0.025


def test_entries_are_brought_into_the_pages_form(spark):
    pages = spark.createDataFrame(list(enumerate(["http://example.com/Page?ID=7", "https://www.example.com:8080/Dir/#x", "http://a.host.org/x", "http://other.org/deep/er", "http://other.org/", "http://www.w.net/1", "http://w.net/1", "http://fine.org/Page?ID=7"])), "page_id bigint, url string")
    listed = spark.createDataFrame([(k,) for k in ("example.com/Page?ID=7", "HTTPS://me@www.Example.com:443/dir/", "http://host.org:80/", "other.org/Deep", "www.w.net", " ", "://")], "key string")
    assert {r["page_id"] for r in urls.blocked(pages, listed).where("blocked").collect()} == {0, 1, 2, 5}
