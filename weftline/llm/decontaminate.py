"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every run of ``ngram`` words of a test string is a pattern (the whole string where it is shorter), both sides folded
to lower-case letters and digits with single separators, so that a pattern begins and ends at a word. A table of
shifts, indexed by a hash of the last ``block`` characters of the search window, says how far the window can move
without missing a pattern; where it can't move, the bucket of that hash holds the patterns whose window ends so, and
each is compared directly. Cursors at the starts of many segments of text move in step, one numpy operation for all.

In scripts without blanks between words two characters count as a word, and patterns begin and end anywhere.

Cases: a null or empty text holds nothing; a null or empty test string isn't searched for, nor is one of under ``min_words`` words that has under
``min_chars`` letters and digits too, as it would be found in clean texts; equal test strings are all reported; an empty table on either side gives no rows. A document row with
a null id is reported with a null id, and rows with one id count as one document.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import EDGE, chunks, fold_table, joined, utf8

#: Characters of test strings searched for in one pass over the documents (about 50 bytes of patterns each); a larger benchmark takes more passes.
PASS_CHARS = 8_000_000
_BITS = 21
_SEGMENT = 512


def _mix(windows: list[np.ndarray]) -> np.ndarray:
    """A hash of _BITS bits of the characters in each block, given as one array for each place in it."""
    h = np.zeros(len(windows[0]), dtype=np.uint64)
    for w in windows:
        h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


class WuManber:
    """Finds all occurrences of a set of patterns (arrays of folded code points) in an array."""

    def __init__(self, patterns: list[bytes], block: int = 6):
        """patterns: distinct, as the bytes of their uint32 codes."""
        arrays = [np.frombuffer(p, np.uint32) for p in patterns]
        self.m = m = min(map(len, arrays))
        self.block = b = min(block, m)
        heads = np.stack([a[:m] for a in arrays])
        self.shift = np.full(1 << _BITS, m - b + 1, dtype=np.int16 if m < 30_000 else np.int32)
        for end in range(b, m + 1):
            np.minimum.at(self.shift, _mix([heads[:, end - b + k] for k in range(b)]), m - end)
        tails = _mix([heads[:, m - b + k] for k in range(b)])
        self.order = np.argsort(tails, kind="stable")
        self.tails = tails[self.order]
        self.patterns = [patterns[k] for k in self.order]
        #: A second hash, of the first block, passes over most patterns of a bucket before the comparison.
        self.fronts = _mix([heads[:, k] for k in range(b)])[self.order]

    def _at(self, text: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _mix([text[last - self.block + 1 + k] for k in range(self.block)])

    def find(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(place of the first character, index in ``order``'s numbering of the pattern) of all occurrences."""
        m, found = self.m, []
        if len(text) < m:
            return found
        cursor = np.arange(m - 1, len(text), _SEGMENT, dtype=np.int64)
        stop = np.minimum(cursor + _SEGMENT, len(text))
        while len(cursor):
            h = self._at(text, cursor)
            step = self.shift[h].astype(np.int64)
            hit = np.flatnonzero(step == 0)
            if len(hit):
                self._compare(text, cursor[hit] - m + 1, h[hit], found)
            cursor = cursor + np.maximum(step, 1)
            alive = cursor < stop
            cursor, stop = cursor[alive], stop[alive]
        return found

    def _compare(self, text: np.ndarray, first: np.ndarray, h: np.ndarray, found: list[tuple[int, int]]) -> None:
        low, high = np.searchsorted(self.tails, h, "left"), np.searchsorted(self.tails, h, "right")
        n = high - low
        row = np.repeat(np.arange(len(first)), n)
        pattern = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        front = _mix([text[first + k] for k in range(self.block)])
        same = self.fronts[pattern] == front[row]
        for at, p in zip(first[row[same]].tolist(), pattern[same].tolist(), strict=True):
            own = self.patterns[p]
            if text[at : at + len(own) // 4].tobytes() == own:
                found.append((at, p))


#: Scripts without blanks between words: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def passages(text: str | None, ngram: int, min_words: int, min_chars: int) -> list[bytes]:
    """The distinct patterns of a test string."""
    folded, _ = joined([text], fold_table(True))
    folded = folded[: int(np.flatnonzero(folded == EDGE)[0])]
    letter = folded != 0
    free = np.zeros(len(folded), dtype=bool)
    for low, high in _UNSPACED:
        free |= (folded >= low) & (folded <= high)
    # A word begins after a separator, and where a run without blanks begins, ends, and after every two of its characters.
    begin = letter & np.append(True, ~letter[:-1] | (free[1:] != free[:-1]))
    run = np.maximum.accumulate(np.where(begin, np.arange(len(folded)), 0))
    begin |= letter & free & ((np.arange(len(folded)) - run) % 2 == 0)
    first = np.flatnonzero(begin)
    words = len(first)
    if not words or (words < min_words and int(letter.sum()) < min_chars):
        return []
    k = min(ngram, words)
    ends = np.append(first[1:], np.flatnonzero(letter)[-1] + 1) - 1
    ends -= ~letter[ends]
    # A word's separators belong to the pattern that begins or ends with it.
    low = first - (~free[first] & ~letter[first - 1])
    high = ends + 1 + (~free[ends] & ~letter[ends + 1])
    return list(dict.fromkeys(folded[low[i] : high[i + k - 1]].tobytes() for i in range(words - k + 1)))


@dataclass(frozen=True)
class _Patterns:
    """The patterns of some test strings and the items that have each, as arrays; sent to the executors once."""

    key: str
    blob: bytes
    ends: np.ndarray
    items: np.ndarray
    item_ends: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]], ngram: int, min_words: int, min_chars: int) -> _Patterns | None:
        owners: dict[bytes, list[int | None]] = {}
        for item, text in rows:
            for p in passages(text, ngram, min_words, min_chars):
                owners.setdefault(p, []).append(item)
        if not owners:
            return None
        items = [i for own in owners.values() for i in own]
        return cls(uuid.uuid4().hex, b"".join(owners), np.cumsum([0, *map(len, owners)]), np.ma.array([i or 0 for i in items], mask=[i is None for i in items], dtype=np.int64), np.cumsum([0, *map(len, owners.values())]))


#: The machine that a worker built last, so that its tasks share it.
_BUILT: dict[str, WuManber] = {}


def _machine(own: _Patterns) -> WuManber:
    if own.key not in _BUILT:
        _BUILT.clear()
        _BUILT[own.key] = WuManber([own.blob[a:b] for a, b in itertools.pairwise(own.ends.tolist())])
    return _BUILT[own.key]


def _hits(own: _Patterns, texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(row, pattern) of all texts, each once."""
    machine = _machine(own)
    for start, part in chunks(texts):
        array, starts = joined(part, fold_table(True))
        seen = set()
        for at, p in machine.find(array):
            row = int(np.searchsorted(starts, at, "right")) - 1
            if (row, p) not in seen:
                seen.add((row, p))
                yield start + row, int(machine.order[p])


def _passes(spark: SparkSession, benchmark: DataFrame, item_col: str, item_text_col: str, *how: int) -> list[Broadcast]:
    """The test strings' patterns, PASS_CHARS characters of them at a time."""
    tests = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), utf8(item_text_col).alias("text")).where("text is not null").distinct()
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // PASS_CHARS)
    found = []
    for k in range(parts):
        own = tests.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else tests
        if (patterns := _Patterns.of([tuple(r) for r in own.collect()], *how)) is not None:
            found.append(spark.sparkContext.broadcast(patterns))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = 8, min_words: int = 5, min_chars: int = 24) -> DataFrame:
    """(doc_id, item_id, passages): for each document that holds part of a test string, how many different runs of
    ``ngram`` words of it. Only the test strings travel, in passes of PASS_CHARS characters at most; the documents
    are read in place, and nothing but the hits is shuffled.
    """
    spark = docs.sparkSession
    pairs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text"))
    found = []
    for k, sent in enumerate(_passes(spark, benchmark, item_col, item_text_col, ngram, min_words, min_chars)):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                hits = list(_hits(own, batch.column(1)))
                row, p = (np.array(x, np.int64) for x in (zip(*hits, strict=True) if hits else ((), ())))
                n = own.item_ends[p + 1] - own.item_ends[p]
                item = np.repeat(own.item_ends[p] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(row, n))), pa.array(own.items.data[item], mask=np.ma.getmaskarray(own.items)[item]), pa.array(np.repeat(p, n))], ["doc_id", "item_id", "passage"])

        found.append(pairs.mapInArrow(search, "doc_id bigint, item_id bigint, passage bigint").withColumn("part", F.lit(k)))
    if not found:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, passages bigint")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.countDistinct("part", "passage").alias("passages"))


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", ngram: int = 8, min_words: int = 5, min_chars: int = 24, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no run of ``ngram`` words of a test string. Each row is judged
    by its own text, so ids needn't be unique or present; documents with a null or empty text stay."""
    for sent in _passes(docs.sparkSession, benchmark, item_col, item_text_col, ngram, min_words, min_chars):
        docs = docs.where(~F.arrow_udf(_dirty(sent), "boolean")(utf8(text_col)))
    return docs


def _dirty(sent: Broadcast) -> Callable[[pa.Array], pa.Array]:
    """A function that says of each text whether it holds a pattern."""

    def dirty(texts: pa.Array) -> pa.Array:
        flags = np.zeros(len(texts), dtype=bool)
        for row, _ in _hits(sent.value, texts):
            flags[row] = True
        return pa.array(flags)

    return dirty
