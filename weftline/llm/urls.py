"""URL filters by a cascade of Bloom filters.

The keys of a page are its host, each parent domain of that, and its canonical URL; the corpus's key universe is every
key of every page. Level 1 encodes the listed keys of the universe, level 2 the other keys that level 1 claims wrongly,
level 3 the listed ones that level 2 claims, and so on until a level claims nothing wrongly. A key of the universe is
then listed exactly if the first level that denies it is an even one (or, where none denies it, the number of levels is odd). Looking pages
up is map only: hashes are made in the JVM, and no key is joined or sent to Python.

The levels take about 1.44 * (log2(others / listed) + 3) bits for each listed key that occurs in the corpus. They lie in files of the shared folder that the
executors map into memory. Keys are cut into shards by their hashes, each with a cascade of ``SHARD_BYTES`` at most, which are built one after the other,
so that the driver holds one of them whatever the list's size is.

Cases: a null URL, or one without a host, has no keys and isn't blocked; letters' case, user, port and fragment don't count;
listed keys that don't occur cost nothing; an empty list blocks nothing; repeated rows are judged alike; page ids that aren't integers raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Shared, cut

#: Bytes of a shard's cascade, about.
SHARD_BYTES = 128 << 20
#: Keys from which on, on either side, a level is built on the executors; fewer are a few MB and are handled on the driver.
LOCAL = 200_000
_LEVELS = 200


def host(url: Column) -> Column:
    """The host in lower case, or null."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path and query, in lower case: no scheme, user, port, fragment or final slash."""
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), _rest(url))


def _rest(url: Column) -> Column:
    rest = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://[^/?#\s]+([^#\s]*)", 1)
    return F.regexp_replace(rest, "/$", "")


def entry_key(entry: Column) -> Column:
    """The key that an entry of a list stands for: its host where it has no path or query, else its canonical URL."""
    entry = F.trim(entry)
    url = F.when(entry.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), entry).otherwise(F.concat(F.lit("http://"), entry))
    return F.when(_rest(url) == "", host(url)).otherwise(canonical(url))


def keys(url: Column) -> Column:
    """The distinct keys of a URL as an array; empty without a host."""
    parts = F.split(host(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host(url).isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, F.array(canonical(url)))))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


@dataclass
class Level:
    """A Bloom filter of ``bits`` bits with ``probes`` probes by double hashing, salted with its place in the cascade."""

    bits: int
    probes: int
    salt: int
    words: np.ndarray

    @classmethod
    def sized(cls, n: int, wrong: float, salt: int) -> Level:
        probes = max(1, round(-np.log2(wrong)))
        bits = max(64, int(np.ceil(-n * probes / np.log1p(-(wrong ** (1 / probes))) / 64)) * 64)
        return cls(bits, probes, salt, np.zeros(bits // 64, dtype=np.uint64))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        salt = np.uint64(self.salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        a, b = h1.view(np.uint64) ^ salt, h2.view(np.uint64) + salt
        a = (a ^ (a >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        b = ((b ^ (b >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        for k in range(self.probes):
            x = a + np.uint64(k) * b
            yield (x ^ (x >> np.uint64(32))) % np.uint64(self.bits)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for p in self.places(h1, h2):
            np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))

    def claims(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), dtype=bool)
        for p in self.places(h1, h2):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0
        return out


@dataclass
class Cascade:
    """Levels that tell listed keys from all others of the universe that they were built over."""

    levels: list[Level]

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), dtype=bool)
        open_ = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            claims = level.claims(h1[open_], h2[open_])
            out[open_[~claims]] = i % 2 == 1
            open_ = open_[claims]
        out[open_] = len(self.levels) % 2 == 1
        return out


class Shards:
    """The cascades of all shards, in files. A key's shard is told by its second hash."""

    def __init__(self, files: list[tuple[Shared, list[tuple[int, int, int]]]]):
        """files: of each shard the file, and bits, probes and salt of its levels."""
        self.files, self.cascades = files, []
        for file, levels in files:
            at, own = 0, []
            for bits, probes, salt in levels:
                own.append(Level(bits, probes, salt, file.array(np.uint64, bits // 64, at)))
                at += bits // 8
            self.cascades.append(Cascade(own))

    def __reduce__(self):
        return Shards, (self.files,)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        if len(self.cascades) == 1:
            return self.cascades[0].listed(h1, h2)
        out = np.zeros(len(h1), dtype=bool)
        shard = h2 % len(self.cascades)
        for k, cascade in enumerate(self.cascades):
            own = np.flatnonzero(shard == k)
            out[own] = cascade.listed(h1[own], h2[own])
        return out


def _fill(level: Level, members: DataFrame) -> None:
    """Set the members' bits: words of the filter are or-ed on the executors, so that each comes to the driver once."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.unique(np.concatenate(list(level.places(batch.column(0).to_numpy(), batch.column(1).to_numpy()))))
            word = (p >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first).view(np.int64))], ["w", "x"])

    own = members.select("h1", "h2").mapInArrow(words, "w bigint, x bigint").groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    level.words[own.column("w").to_numpy()] = own.column("x").to_numpy().view(np.uint64)


def _claimed(level: Level, rows: DataFrame) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(level)
    return cut(rows.where(F.arrow_udf(lambda a, b: pa.array(sent.value.claims(a.to_numpy(), b.to_numpy())), "boolean")("h1", "h2")))


def _pairs(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.select("h1", "h2").toArrow()
    return t.column("h1").to_numpy(), t.column("h2").to_numpy()


def build(universe: DataFrame) -> Shards:
    """The cascades for a universe (h1, h2, listed) of distinct keys."""
    spark = universe.sparkSession
    n, rest = _sizes(universe)
    wrong = _first_rate(n, rest)
    shards = max(1, -(-int(Level.sized(1000, wrong, 0).bits / 8000 * n + n) // SHARD_BYTES))
    files = []
    for k in range(shards):
        own = universe if shards == 1 else universe.where(F.pmod("h2", F.lit(shards)) == k)
        levels = cascade(own).levels
        files.append((Shared.write(spark, "cascade", (x.words.tobytes() for x in levels)), [(x.bits, x.probes, x.salt) for x in levels]))
    return Shards(files)


def _sizes(universe: DataFrame) -> tuple[int, int]:
    count = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    return count.get(True, 0), count.get(False, 0)


def _first_rate(n: int, rest: int) -> float:
    """The share of other keys that level 1 may claim."""
    return min(0.5, max(1e-9, 0.7 * n / max(rest, 1)))


def cascade(universe: DataFrame) -> Cascade:
    """The cascade for a universe (h1, h2, listed) of distinct keys, whose levels the driver can hold."""
    members, other = universe.where("listed"), universe.where("not listed")
    n_members, n_other = _sizes(universe)
    wrong = _first_rate(n_members, n_other)
    levels: list[Level] = []
    while n_members:
        if len(levels) >= _LEVELS:
            raise RuntimeError("two keys of the universe have the same hashes")
        if max(n_members, n_other) <= LOCAL:
            (m1, m2), (o1, o2) = _pairs(members), _pairs(other)
            while len(m1) and len(levels) < _LEVELS:
                level = Level.sized(len(m1), 0.5 if levels else wrong, len(levels))
                level.add(m1, m2)
                levels.append(level)
                c = level.claims(o1, o2)
                (m1, m2), (o1, o2) = (o1[c], o2[c]), (m1, m2)
            if len(m1):
                raise RuntimeError("two keys of the universe have the same hashes")
            break
        level = Level.sized(n_members, 0.5 if levels else wrong, len(levels))
        _fill(level, members)
        levels.append(level)
        claimed = _claimed(level, other)
        members, n_members, other, n_other = claimed, claimed.count(), members, n_members
    return Cascade(levels)


def blocked(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", key_col: str = "key") -> DataFrame:
    """(page_id, url, host, blocked) of every page: whether one of its keys is in the list.

    listed: hosts, domains (which cover their subdomains) or URLs, in any case, with or without scheme, port and final slash.
    A URL without path and query stands for its host. The list may be of any size.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("keys", keys(F.col("url")))
    every = rows.select(F.explode("keys").alias("key")).distinct()
    entries = listed.select(entry_key(F.col(key_col).cast("string")).alias("key")).where("key is not null").distinct().withColumn("listed", F.lit(True))
    h1, h2 = _hashes(F.col("key"))
    universe = cut(every.join(entries, "key", "left").select("key", h1.alias("h1"), h2.alias("h2"), F.coalesce("listed", F.lit(False)).alias("listed")))
    sent = pages.sparkSession.sparkContext.broadcast(build(universe))

    def any_listed(first: pa.Array, second: pa.Array) -> pa.Array:
        offsets = first.offsets.to_numpy()
        a, b = (x.flatten().to_numpy(zero_copy_only=False) for x in (first, second))
        hits = np.concatenate([[0], np.cumsum(sent.value.listed(a, b))])
        offsets = offsets - offsets[0]
        return pa.array(hits[offsets[1:]] > hits[offsets[:-1]])

    judged = rows.select("page_id", "url", F.transform("keys", lambda k: _hashes(k)[0]).alias("a"), F.transform("keys", lambda k: _hashes(k)[1]).alias("b"))
    return judged.select("page_id", "url", host(F.col("url")).alias("host"), F.arrow_udf(any_listed, "boolean")("a", "b").alias("blocked"))
