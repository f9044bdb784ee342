"""Language-model scoring with Brown class n-grams.

Words are assigned to classes by exchange clustering: each word moves to the class that raises the likelihood of the
corpus under P(word | previous) = P(class | previous class) * P(word | class) most. Words move in groups: those of one
group are tried in parallel against the counts that the classes had before. Of a group's moves all, the better half, the better quarter
and so on are tried, in one pass, and those that raise the likelihood most together are made; then the next group's turn comes. The search ends when a round
over all groups moves nothing or gains less than ``TOLERANCE`` a token. Transitions are smoothed towards the class's own frequency, and emissions leave one
count for unseen words, so every text has a finite perplexity.

All words and bigrams of all documents are counted. Every word that occurs ``least`` = 2 times moves and has a probability of
its own. Words that occur once don't move: their class is a hash of their last two letters, and they share its probability
evenly, as their counts are equal. The words, their classes and probabilities lie in files of the shared folder that the executors map into memory;
the driver holds some 30 bytes a word, and a step of the exchange sends one byte a word.

A word is a run of characters without white space, outer punctuation off, lower case; pure punctuation is a word.

Cases: a null or empty text has no tokens, log-probability 0 and null perplexity; repeated rows count and are scored
each; an empty table gives no rows; ids that aren't integers raise.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Shared, cut, remove, scratch, slices, utf8

RARE = 32
_OUTER = ".,;:!?\"'()[]{}#$%&*|-_/"
#: Characters of text that a worker takes at a time.
_CHUNK = 4_000_000
#: Bigrams that a task holds before it passes its counts on, and those that one gathers, about.
_BIGRAMS = 4_000_000
#: Words that the driver holds on their way to the lexicon's file.
_PART = 500_000
#: Words in a block of contexts.
_BLOCK = 500
#: Bigrams of words that move which a task holds before it adds them up.
_HELD = 1_000_000
#: Counts up to which a move's gains are looked up.
_SMALL = 31
#: The exchange ends when a round over all groups gains less than this, in nats a token.
TOLERANCE = 1e-3


def _tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all the texts' tokens, and how many each text has."""
    split = pa.compute.utf8_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    flat = split.flatten()
    some = pa.compute.not_equal(flat, "")
    row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))[some.to_numpy(zero_copy_only=False)]
    tokens = flat.filter(some).dictionary_encode()
    words = pa.compute.utf8_lower(pa.compute.utf8_trim(tokens.dictionary, _OUTER))
    words = pa.compute.if_else(pa.compute.equal(words, ""), tokens.dictionary, words).dictionary_encode()
    return pa.DictionaryArray.from_arrays(words.indices.take(tokens.indices), words.dictionary), np.bincount(row, minlength=len(texts))


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, where each begins, and its length."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)


def _flat(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. for size[0] places, then begin[1], and so on."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, none of which is empty."""
    data, begin, size = _bytes(words)
    if not len(words):
        return np.zeros(0, np.int64)
    flat = _flat(begin, size)
    inside = (flat - np.repeat(begin, size)).astype(np.uint64)
    sums = np.add.reduceat(_mix(data[flat].astype(np.uint64) + (inside << np.uint64(32)) + np.uint64(0x9E3779B97F4A7C15)), np.cumsum(size) - size)
    return _mix(sums + size.astype(np.uint64)).view(np.int64)


def rare_classes(words: pa.Array) -> np.ndarray:
    """A class of each word by a hash of its last two letters."""
    ends = pa.compute.utf8_slice_codeunits(words, -2, 1 << 30).dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(x) % RARE for x in ends.dictionary.to_pylist()], dtype=np.int64)
    return own[ends.indices.to_numpy()]


class Words(Mapping):
    """Word -> place among the movable words, which lie in a file in the order of their hashes. Equal hashes are told apart by the words."""

    def __init__(self, hashes: Shared, ends: Shared, blob: Shared, n: int, size: int):
        self.files, self.n, self.size = (hashes, ends, blob), n, size
        self.hashes, self.ends, self.blob = hashes.array(np.int64, n), ends.array(np.int64, n + 1), blob.array(np.uint8, size)

    def __reduce__(self):
        return Words, (*self.files, self.n, self.size)

    @classmethod
    def of(cls, known: DataFrame) -> tuple[Words, np.ndarray]:
        """The words of (word, n) and their counts. They pass the driver ``_PART`` at a time on their way to the files."""
        spark, n = known.sparkSession, known.count()
        parts = max(1, -(-n // _PART))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes(batch.column(0)))], ["word", "n", "h"])

        placed = known.select("word", "n").mapInArrow(hashed, "word string, n bigint, h bigint").withColumn("part", F.expr(f"((shiftright(h, 40) + {1 << 23}) * {parts}) div {1 << 24}"))
        placed = cut(placed) if parts > 1 else placed
        found, sizes, counts = [], [], []

        def blobs() -> Iterator[bytes]:
            for part in range(parts):
                t = placed.where(F.col("part") == part).select("word", "h", "n").toArrow().sort_by([("h", "ascending"), ("word", "ascending")])
                words = t.column("word").cast(pa.large_string()).combine_chunks()
                found.append(t.column("h").to_numpy())
                counts.append(t.column("n").to_numpy())
                sizes.append(pa.compute.binary_length(words).to_numpy(zero_copy_only=False))
                yield "".join(words.to_pylist()).encode()

        blob = Shared.write(spark, "words", blobs())
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        files = [Shared.write(spark, name, [x.astype(np.int64).tobytes()]) for name, x in (("word-hashes", np.concatenate(found)), ("word-ends", ends))]
        return cls(*files, blob, n, int(ends[-1])), np.concatenate(counts).astype(np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 for others. Hashes find it, all bytes are compared."""
        out = np.full(len(words), -1, np.int64)
        if not self.n:
            return out
        data, begin, size = _bytes(words)
        h = hashes(words)
        at = np.searchsorted(self.hashes, h)
        rows = np.flatnonzero(self.hashes[np.minimum(at, self.n - 1)] == h)
        while len(rows):
            p = at[rows]
            alike = self.ends[p + 1] - self.ends[p] == size[rows]
            own, q = rows[alike], p[alike]
            if len(own):
                n = size[own]
                wrong = data[_flat(begin[own], n)] != self.blob[_flat(self.ends[q], n)]
                alike[alike] = np.add.reduceat(wrong.astype(np.int64), np.cumsum(n) - n) == 0
            out[rows[alike]] = at[rows[alike]]
            # Another word may have the same hash.
            rows = rows[~alike]
            at[rows] += 1
            rows = rows[at[rows] < self.n]
            rows = rows[self.hashes[at[rows]] == h[rows]]
        return out

    def __getitem__(self, word: str) -> int:
        p = int(self.places(pa.array([word]))[0])
        if p < 0:
            raise KeyError(word)
        return p

    def __iter__(self) -> Iterator[str]:
        return (self.blob[self.ends[p] : self.ends[p + 1]].tobytes().decode() for p in range(self.n))

    def __len__(self) -> int:
        return self.n


@dataclass(frozen=True)
class Lexicon:
    """Token -> code: the place of a movable word, or their number plus the rare class."""

    words: Words

    def __getitem__(self, token: str) -> int:
        return int(self.codes(pa.array([token]))[0][1])

    @property
    def start(self) -> int:
        """The code before each text."""
        return len(self.words) + RARE

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' codes, each text after ``start``; and where those stand. Each different word is looked up once."""
        tokens, n = _tokens(texts)
        every = tokens.dictionary
        code = self.words.places(every)
        rare = np.flatnonzero(code < 0)
        code[rare] = len(self.words) + rare_classes(every.take(pa.array(rare)))
        at = np.cumsum(n + 1) - n - 1
        out = np.full(len(tokens) + len(n), self.start, dtype=np.int64)
        inside = np.ones(len(out), dtype=bool)
        inside[at] = False
        out[inside] = code[tokens.indices.to_numpy()]
        return out, at


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all documents of a frame with one column of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch.column(0), _CHUNK):
                tokens, _ = _tokens(own)
                n = np.bincount(tokens.indices.to_numpy(), minlength=len(tokens.dictionary))
                yield pa.RecordBatch.from_arrays([tokens.dictionary.cast(pa.string()), pa.array(n)], ["word", "n"])

    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(w: np.ndarray, o: np.ndarray, n: np.ndarray) -> bytes:
    """Rows in the order of w, compressed."""
    wide = np.uint32 if not len(n) or n.max() < 1 << 32 else np.int64
    raw = np.array([len(w), np.dtype(wide).itemsize], np.int64).tobytes() + np.diff(w, prepend=0).astype(np.uint32).tobytes() + o.astype(np.uint32).tobytes() + n.astype(wide).tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(memoryview(data)[8:], int(np.frombuffer(data, np.int64, 1)[0]), "zstd", asbytes=True)
    k, size = np.frombuffer(raw, np.int64, 2)
    return np.cumsum(np.frombuffer(raw, np.uint32, k, 16).astype(np.int64)), np.frombuffer(raw, np.uint32, k, 16 + 4 * k).astype(np.int64), np.frombuffer(raw, np.uint32 if size == 4 else np.int64, k, 16 + 8 * k).astype(np.int64)


def _place(codes: np.ndarray, n: int) -> np.ndarray:
    """A multiplicative hash that spreads codes over n places."""
    return (codes.astype(np.int64) * 2654435761 >> 7) % n


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, rising, and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def contexts(texts: DataFrame, lexicon: Lexicon, groups: int, tokens: int) -> DataFrame:
    """(w, after, before, turn) over all documents, a row for about ``_BLOCK`` codes of one group, all codes of a block whole: the codes, and the codes
    after and before each, with counts, as ``_side`` packs them. Others than words are in a group of their own. tokens: of all documents; a task has
    those of about ``_BIGRAMS``.

    Each task adds up its bigrams and sends them in blocks, sorted and compressed, so that a block is a row and a bigram a few bytes.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(lexicon)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // _BIGRAMS))
    buckets, words, size = 8 * parts, len(lexicon.words), lexicon.start + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        room = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            first = key // size
            second = key - first * size
            for after in (True, False):
                w, o, m = (first, second, n) if after else (second, first, n)
                if not after:
                    some = np.flatnonzero(w < words)
                    some = some[np.argsort(w[some] * size + o[some])]
                    w, o, m = w[some], o[some], m[some]
                # Each block in the order of w: a stable sort of what is so already.
                bucket = _place(w, buckets).astype(np.min_scalar_type(buckets))
                order = np.argsort(bucket, kind="stable")
                w, o, m, bucket = w[order], o[order], m[order], bucket[order]
                ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1 if len(w) else np.zeros(0, np.int64)
                begin = np.append(0, ends)[:-1].astype(np.int64)
                for k in range(0, len(ends), 64):
                    own = [slice(i, j) for i, j in zip(begin[k : k + 64], ends[k : k + 64], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[begin[k : k + 64]].astype(np.int64)), pa.array([after] * len(own)), pa.array([_packed(w[x], o[x], m[x]) for x in own], pa.binary())], ["bucket", "after", "block"])

        for batch in batches:
            for own in slices(batch.column(0), _CHUNK):
                codes, _ = sent.value.codes(own)
                held.append((codes[:-1] * size + codes[1:])[codes[1:] != size - 1])
                room += len(held[-1])
                if room >= _BIGRAMS:
                    yield from flush()
                    room = 0
        yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
        for batch in batches:
            for after, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w, o, n = _unpacked(block)
                had[after].append((w * size + o, n))
                if sum(len(k) for k, _ in had[after]) > 4 * _BIGRAMS and len(had[after]) > 8:
                    had[after] = [_added(*map(np.concatenate, zip(*had[after], strict=True)))]
        none = np.zeros(0, np.int64)
        sides = {}
        for after, own in had.items():
            key, n = _added(*map(np.concatenate, zip(*own, strict=True))) if own else (none, none)
            sides[after] = (key // size, key % size, n)
            own.clear()
        codes = np.union1d(sides[True][0], sides[False][0])
        turn = np.where(codes < words, _place(codes, 1 << 20) % groups, groups).astype(np.int32)
        for group in range(groups + 1):
            mine = codes[turn == group]
            for start in range(0, len(mine), _BLOCK):
                some = mine[start : start + _BLOCK]
                packed = []
                for after in (True, False):
                    w, o, n = sides[after]
                    begin = np.searchsorted(w, some, "left")
                    size_of = np.searchsorted(w, some, "right") - begin
                    at = _flat(begin, size_of)
                    packed.append(pa.array([_side(size_of, o[at], n[at])], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([some.astype(np.int32).tobytes()], pa.binary()), *packed, pa.array([group], pa.int32())], ["w", "after", "before", "turn"])

    blocks = texts.mapInArrow(count, "bucket bigint, after boolean, block binary")
    return blocks.repartition(parts, "bucket").mapInArrow(gather, _CONTEXTS)


_CONTEXTS = "w binary, after binary, before binary, turn int"


def _side(sizes: np.ndarray, o: np.ndarray, n: np.ndarray) -> bytes:
    """How many neighbours each code has, all neighbours, and their counts in as few bytes as the largest needs."""
    wide = np.min_scalar_type(int(n.max())) if len(n) else np.dtype(np.uint8)
    raw = np.array([len(sizes), len(o), wide.itemsize], np.int64).tobytes() + sizes.astype(np.uint32).tobytes() + o.astype(np.uint32).tobytes() + n.astype(wide).tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "lz4", asbytes=True)


def _unside(data: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(data.slice(8), int(np.frombuffer(data, np.int64, 1)[0]), "lz4")
    k, m, size = np.frombuffer(raw, np.int64, 3)
    return np.frombuffer(raw, np.uint32, k, 24), np.frombuffer(raw, np.uint32, m, 24 + 4 * k), np.frombuffer(raw, f"u{size}", m, 24 + 4 * (k + m))


def _codes(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The number and the codes of each block of a batch."""
    for k, x in enumerate(batch.column(0)):
        yield k, np.frombuffer(x.as_buffer(), np.int32)


def _flog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _summed(parts: DataFrame, levels: int, cells: int) -> np.ndarray:
    """[i]: the sums of the arrays x by i, taken on the executors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(pa.decompress(x.as_buffer(), 8 * cells, "zstd"))
        yield _cells(sums)

    t = parts.repartition("i").mapInArrow(add, _CELLS).toArrow()
    out = np.zeros((levels, cells))
    for i, x in zip(t.column("i").to_pylist(), t.column("x"), strict=True):
        out[i] = np.frombuffer(pa.decompress(x.as_buffer(), 8 * cells, "zstd"))
    return out


_CELLS = "i bigint, x binary"


def _cells(sums: Mapping[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in sums.values()], pa.binary())], ["i", "x"])


def class_bigrams(contexts: DataFrame, classes: np.ndarray, size: int) -> np.ndarray:
    """How often each class follows each class."""
    sent = contexts.sparkSession.sparkContext.broadcast(classes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, np.zeros(size * size)
        for batch in batches:
            for k, w in _codes(batch):
                sizes, o, n = _unside(batch.column(1)[k].as_buffer())
                total += np.bincount(np.repeat(own[w].astype(np.int64) * size, sizes) + own[o], weights=n, minlength=size * size)
        yield _cells({0: total})

    out = _summed(contexts.select("w", "after").mapInArrow(add, _CELLS), 1, size * size)
    sent.destroy()
    return out.reshape(size, size)


def changes(contexts: DataFrame, classes: np.ndarray, then: np.ndarray, level: np.ndarray, levels: int, size: int) -> np.ndarray:
    """[q]: how the class bigrams change if the codes of level q and more have the classes ``then``; level: -1 for codes that stay."""
    sent = contexts.sparkSession.sparkContext.broadcast((classes, then, level))
    cells = size * size

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, new, up = sent.value
        total = np.zeros(levels * cells)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def put(q: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
            nonlocal total
            total += np.bincount((q.astype(np.int64) * size + a) * size + b, weights=n, minlength=levels * cells)

        def flush() -> None:
            # From the highest level down a bigram's cell changes where one of its codes moves, and where the other does.
            a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            left, right = up[a], up[b]
            q = np.maximum(left, right)
            x, y = np.where(left == q, new[a], own[a]), np.where(right == q, new[b], own[b])
            put(q, own[a], own[b], -n)
            put(q, x, y, n)
            both = np.flatnonzero((left >= 0) & (right >= 0) & (left != right))
            a, b, n, q = a[both], b[both], n[both], np.minimum(left, right)[both]
            put(q, x[both], y[both], -n)
            put(q, new[a], new[b], n)

        for batch in batches:
            for k, w in _codes(batch):
                moved = np.flatnonzero(up[w] >= 0)
                if not len(moved):
                    continue
                for j in (1, 2):
                    sizes, o, n = _unside(batch.column(j)[k].as_buffer())
                    at = _flat((np.cumsum(sizes, dtype=np.int64) - sizes)[moved], sizes[moved].astype(np.int64))
                    mine, o, n = np.repeat(w[moved], sizes[moved]), o[at], n[at].astype(float)
                    if j == 2:
                        # A pair of two that move counts once, with its first word.
                        once = np.flatnonzero(up[o] < 0)
                        mine, o, n = o[once], mine[once], n[once]
                    held.append((mine, o, n))
                if sum(len(n) for *_, n in held) >= _HELD:
                    flush()
        if held:
            flush()
        yield _cells({q: x for q, x in enumerate(total.reshape(levels, cells)) if x.any()})

    out = _summed(contexts.select("w", "after", "before").mapInArrow(add, _CELLS), levels, cells)
    sent.destroy()
    return np.cumsum(out[::-1], axis=0)[::-1].reshape(levels, size, size)


def likelihood(n: np.ndarray) -> float:
    """The log-likelihood of the classes' sequence and the words in it, without the words' own constant."""
    return float(_flog(n).sum() - _flog(n.sum(1)).sum() - _flog(n.sum(0)).sum())


class Cells:
    """The class bigrams m[a, c] of one side as the moves need them: c is the class of the word, a its neighbour's."""

    def __init__(self, m: np.ndarray):
        self.m = np.ascontiguousarray(m)
        self.log = _flog(self.m)
        #: [l * len(m) + a, c]: what adding l <= _SMALL to the cell gains.
        self.small = (_flog(self.m + np.arange(_SMALL + 1)[:, None, None]) - self.log).reshape(-1, m.shape[1])


def best_classes(n: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, loop: np.ndarray, movable: int, sides: tuple[Cells, Cells]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of classes ``own`` the class among the first ``movable`` to which it moves best, and what that gains.

    n: class bigrams; after, before: the words' counts with each class, those with themselves (loop) included;
    sides: the ``Cells`` after and before.
    """
    every = np.arange(len(own))
    left, right = after.copy(), before.copy()
    left[every, own] -= loop
    right[every, own] -= loop
    gain = np.zeros((len(own), movable))
    # The word's counts are taken out of its class's row and column; then those that it adds elsewhere are put in.
    for cells, x, other in ((sides[0], left, right), (sides[1], right, left)):
        i, a = np.divmod(np.flatnonzero(x.ravel() != 0), x.shape[1])
        # Words with equally many items follow each other, so that theirs are summed as one array.
        many = np.bincount(i, minlength=len(own))
        order = np.argsort(many.astype(np.uint16)[i], kind="stable")
        i, a = i[order], a[order]
        by, mine = x[i, a], own[i]
        same = a == mine
        part = cells.small.take(np.minimum(by, _SMALL).astype(np.int64) * len(cells.m) + a, axis=0)
        some = np.flatnonzero(by > _SMALL)
        part[some] = _flog(cells.m[a[some]] + by[some, None]) - cells.log[a[some]]
        some = np.flatnonzero(same)
        less = other[i[some], :movable]
        row, c = np.divmod(np.flatnonzero(less.ravel() != 0), movable)
        base, row = cells.m[mine[some[row]], c] - less[row, c], some[row]
        part[row, c] = _flog(base + by[row]) - _flog(base)
        base = cells.m[a, mine] - by - same * (other[i, mine] + loop[i])
        part[np.arange(len(i)), mine] = _flog(base + by) - _flog(base)
        start = 0
        for m, words in enumerate(np.bincount(many)):
            if m and words:
                rows = slice(start, start := start + m * words)
                gain[i[rows][::m]] += part[rows].reshape(words, m, movable).sum(1)
    # The cell (c, c) changes by both and by the loop at once.
    i, c = np.divmod(np.flatnonzero((((left[:, :movable] > 0) & (right[:, :movable] > 0)) | (loop[:, None] > 0)).ravel()), movable)
    by, into, twice = left[i, c], right[i, c], loop[i]
    cell = n[c, c] - (c == own[i]) * (by + into + twice)
    gain[i, c] += _flog(cell + by + into + twice) - _flog(cell + by) - _flog(cell + into) + _flog(cell)
    for sums, x in ((n.sum(1)[:movable], left), (n.sum(0)[:movable], right)):
        more = x.sum(1) + loop
        # Most words share their number with others of the block; their own classes differ.
        different, which = np.unique(more, return_inverse=True)
        part = (_flog(sums + different[:, None]) - _flog(sums))[which]
        base = sums[own] - more
        part[every, own] = _flog(base + more) - _flog(base)
        gain -= part
    to = gain.argmax(1)
    return to, gain[every, to] - gain[every, own]


def best_class(n: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, loop: float, movable: int) -> tuple[int, float]:
    """``best_classes`` of one word."""
    to, gain = best_classes(n, np.array([own]), after[None].astype(float), before[None].astype(float), np.array([loop]), movable, (Cells(n[:movable].T), Cells(n[:, :movable])))
    return int(to[0]), float(gain[0])


def exchange(table: DataFrame, counts: np.ndarray, k: int, rounds: int | None, groups: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all codes, the class bigrams, and the likelihood after each step. counts: of the words."""
    spark, words = table.sparkSession, len(counts)
    size = k + RARE + 1
    classes = np.concatenate([np.zeros(words), k + np.arange(RARE + 1)]).astype(np.min_scalar_type(size))
    classes[np.argsort(-counts, kind="stable")] = np.arange(words) % k
    n = class_bigrams(table, classes, size)
    trace, least = [likelihood(n)], tolerance * n.sum()
    for done in itertools.count():
        if done == rounds:
            break
        before = trace[-1]
        for turn in range(groups):
            own = table.where(F.col("turn") == turn).drop("turn")
            sent = spark.sparkContext.broadcast((classes, n))

            def move(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                own, counts = sent.value
                sides = Cells(counts[:k].T), Cells(counts[:, :k])
                for batch in batches:
                    found = []
                    for j, w in _codes(batch):
                        sums = []
                        for side in (1, 2):
                            sizes, o, m = _unside(batch.column(side)[j].as_buffer())
                            sums.append(np.bincount(np.repeat(np.arange(len(w)) * size, sizes) + own[o], weights=m, minlength=len(w) * size).reshape(-1, size))
                        looped = np.flatnonzero(o == np.repeat(w, sizes))
                        loop = np.zeros(len(w))
                        loop[np.searchsorted(w, o[looped])] = m[looped]
                        now = own[w].astype(np.int64)
                        to, gain = best_classes(counts, now, *sums, loop, k, sides)
                        moved = np.flatnonzero((gain > 1e-6) & (to != now))
                        found.append((w[moved], to[moved].astype(np.int32), gain[moved]))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["w", "c", "gain"])

            moves = own.mapInArrow(move, "w int, c int, gain double").toArrow().sort_by([("gain", "descending"), ("w", "ascending")])
            sent.destroy()
            w, c = moves.column("w").to_numpy(), moves.column("c").to_numpy()
            if not len(w):
                continue
            # The moves of a group don't know of each other: all of them are tried together, the better half, the better quarter, and so on
            # to the best one, which gains alone; those that gain most stay.
            then = classes.copy()
            then[w] = c
            levels = len(w).bit_length()
            level = np.full(len(classes), -1, np.int8)
            for q in range(levels):
                level[w[: len(w) >> q]] = q
            tried = n + changes(own, classes, then, level, levels, size)
            q = int(np.argmax([likelihood(x) for x in tried]))
            if likelihood(tried[q]) > trace[-1]:
                w, c = w[: len(w) >> q], c[: len(w) >> q]
                classes[w], n = c, tried[q]
                trace.append(likelihood(n))
        if trace[-1] - before <= least:
            break
    return classes, n, trace


@dataclass
class BrownModel:
    """log_transition[previous class, class], log_emission[code], class of each code; what there is by code lies in a file."""

    lexicon: Lexicon
    file: Shared
    log_transition: np.ndarray
    trace: list[float]

    def __post_init__(self):
        n = self.lexicon.start + 1
        self.log_emission, self.classes = self.file.array(np.float64, n), self.file.array(np.uint8, n, 8 * n)

    def __reduce__(self):
        return BrownModel, (self.lexicon, self.file, self.log_transition, self.trace)

    def log_probs(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The log-probability and number of words of each text."""
        codes, at = self.lexicon.codes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        own = self.classes[codes]
        p = np.zeros(len(codes))
        p[1:] = self.log_transition[own[:-1], own[1:]] + self.log_emission[codes[1:]]
        p[at] = 0
        return np.add.reduceat(p, at), np.diff(np.append(at, len(codes))) - 1


def smoothed(spark: SparkSession, lexicon: Lexicon, counts: np.ndarray, rare_types: np.ndarray, classes: np.ndarray, n: np.ndarray, prior: float) -> BrownModel:
    """Probabilities from the counts of codes, the different words of each rare class, and the class bigrams."""
    size = len(n)
    base = (n.sum(0) + 1) / (n.sum() + size)
    transition = (n + prior * base) / (n.sum(1, keepdims=True) + prior)
    totals = np.bincount(classes, weights=counts, minlength=size)
    words = len(lexicon.words)
    emission = np.ones(len(classes))
    emission[:words] = counts[:words] / np.maximum(totals[classes[:words]], 1)
    emission[words : words + RARE] = 1 / (rare_types + 1)
    file = Shared.write(spark, "emissions", [np.log(np.maximum(emission, 1e-300)).tobytes(), classes.astype(np.uint8).tobytes()])
    return BrownModel(lexicon, file, np.log(transition), [])


def train(docs: DataFrame, *, text_col: str = "text", classes: int = 64, least: int = 2, common: float = 0.0, rounds: int | None = None, groups: int = 4, tolerance: float = TOLERANCE, prior: float = 50.0) -> BrownModel:
    """Count all documents, cluster the movable words, and smooth. classes: 223 at most. common: words below this share of the
    tokens don't move either; rounds: stop after so many, even if the classes haven't settled. Neither is set by default."""
    if classes + RARE + 1 > 256:
        raise ValueError("a class is held in a byte")
    spark = docs.sparkSession
    texts = docs.select(utf8(text_col).alias("text")).where("text is not null")
    words = cut(word_counts(texts))
    total = words.agg(F.sum("n")).first()[0] or 0
    bound = max(float(least), common * total)
    own, counts = Words.of(words.where(F.col("n") >= bound))
    lexicon, known = Lexicon(own), len(own)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, count = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
        for batch in batches:
            c = rare_classes(batch.column(0))
            types += np.bincount(c, minlength=RARE)
            count += np.bincount(c, weights=batch.column(1).to_numpy(), minlength=RARE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE)), pa.array(types), pa.array(count)], ["c", "types", "n"])

    others = words.where(F.col("n") < bound).mapInArrow(rare, "c bigint, types bigint, n bigint").groupBy("c").agg(F.sum("types").alias("types"), F.sum("n").alias("n")).toArrow()
    types, every = np.zeros(RARE), np.zeros(known + RARE + 1)
    every[:known] = counts
    types[others.column("c").to_numpy()] = others.column("types").to_numpy()
    every[known + others.column("c").to_numpy()] = others.column("n").to_numpy()
    at = scratch(spark, "contexts")
    try:
        contexts(texts, lexicon, groups, total).write.partitionBy("turn").option("compression", "none").option("parquet.enable.dictionary", "false").parquet(at)
        own, n, trace = exchange(spark.read.schema(_CONTEXTS).parquet(at), counts, classes, rounds, groups, tolerance)
    finally:
        remove(spark, at)
    model = smoothed(spark, lexicon, every, types, own, n, prior)
    model.trace = trace
    return model


def score(docs: DataFrame, model: BrownModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every document. Map only: no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(texts: pa.Array) -> pa.Array:
        parts = [sent.value.log_probs(own) for own in slices(texts, _CHUNK)]
        p = np.concatenate([np.zeros(0), *(x for x, _ in parts)])
        n = np.concatenate([np.zeros(0, np.int64), *(x for _, x in parts)])
        return pa.StructArray.from_arrays([pa.array(n), pa.array(p), pa.array(np.exp(-p / np.maximum(n, 1)), mask=n == 0)], ["n_words", "log_prob", "perplexity"])

    udf = F.arrow_udf(each, "struct<n_words: bigint, log_prob: double, perplexity: double>")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), udf(utf8(text_col)).alias("s")).select("doc_id", "s.*")
