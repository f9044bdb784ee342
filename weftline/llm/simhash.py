"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's signature is two 64-bit SimHashes, a and b, of its set of words (letters and digits, lower case). Two texts
are near duplicates if their a differ in ``tau`` bits at most and a and b together in ``tau_both``.

Candidates: the 64 bits of a are grouped into partitions, correlated bits together, by the correlations over all
signatures. Partition i gets a threshold t_i, -1 or more, such that the sum of (t_i + 1) is tau + 1: two values within
tau bits are then within t_i bits in at least one partition. The thresholds come from a dynamic programme over the
numbers of candidates and of probes that each threshold would cost, counted on all signatures' values in that partition. To find
what lies within t bits of a partition's value, each signature is sent to all values within ceil(t / 2) bits of its own,
so that two near ones meet; those that meet are verified on all bits. Signatures that are equal are one from the start.

Cases: null texts and texts without a word have no signature and no near duplicates; rows that repeat are near
duplicates at distance 0; documents with a null id aren't paired; an empty table gives no rows; ids that aren't integers raise.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import chunks, cut, fold_table, joined, utf8
from weftline.llm.graph import components
from weftline.llm.members import boxed, field, only, without

BITS = 64
TAU, TAU_BOTH = 11, 22
#: Nanoseconds that a probe and a candidate cost, for the dynamic programme.
PROBE_NS, CANDIDATE_NS = 2000.0, 8.0

_SPREAD = np.array([sum(((v >> (7 - k)) & 1) << (8 * k) for k in range(8)) for v in range(256)], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct words, and for each the number of its text, in order."""
    array, starts = joined(texts, fold_table(True))
    letter = array > 1
    begin = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(letter)
    length = np.diff(np.append(np.searchsorted(at, begin), len(at)))
    inside = at - np.repeat(begin, length)
    sums = np.add.reduceat(_mix(array[at].astype(np.uint64) + (inside.astype(np.uint64) << np.uint64(32)) + np.uint64(0x9E3779B97F4A7C15)), np.cumsum(length) - length)
    row = np.searchsorted(starts, begin, "right") - 1
    h = _mix(sums + length.astype(np.uint64))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _majority(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of each run of n hashes from ``first``; sums are of at most 255 at a time, eight bits side by side."""
    pieces = -(-n // 255)
    run = np.repeat(first, pieces)
    run = run + 255 * (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    owner = np.cumsum(pieces) - pieces
    columns = h.view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(n), dtype=np.uint64)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[columns[:, k]], run).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(lanes, owner, axis=0)
        packed = np.packbits(2 * ones > n[:, None], axis=1)[:, 0]
        out |= packed.astype(np.uint64) << np.uint64(8 * k)
    return out


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and whether there is a signature, for each text."""
    h, row = word_sets(texts)
    has = np.zeros(len(texts), dtype=bool)
    a, b = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    if len(h):
        rows, first, n = np.unique(row, return_index=True, return_counts=True)
        has[rows] = True
        a[rows] = _majority(h, first, n)
        b[rows] = _majority(_mix(h + np.uint64(0x632BE59BD9B4E019)), first, n)
    return a, b, has


def _sign(texts: pa.Array) -> pa.Array:
    parts = [signatures(own) for _, own in chunks(texts)]
    a, b, has = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in range(3))
    has = has.astype(bool)
    return pa.StructArray.from_arrays([pa.array(x.view(np.int64), mask=~has) for x in (a, b)], ["a", "b"])


_SIG = "struct<a: bigint, b: bigint>"


@dataclass(frozen=True)
class Plan:
    """Partitions as lists of bits, and their thresholds."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    @property
    def used(self) -> list[int]:
        """The partitions that are probed."""
        return [i for i, t in enumerate(self.thresholds) if t >= 0]

    def keys(self, a: np.ndarray, i: int) -> Iterator[np.ndarray]:
        """The keys under which the signatures meet others in partition i: an array for each flip of its bits."""
        bits, t = self.parts[i], self.thresholds[i]
        own = values(a, bits)
        for r in range(-(-t // 2) + 1):
            for c in itertools.combinations(range(len(bits)), r):
                yield own ^ np.int64(sum(1 << k for k in c))


def values(a: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The value of some bits of each signature."""
    out = np.zeros(len(a), dtype=np.int64)
    for k, bit in enumerate(bits):
        out |= ((a >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def group_bits(correlation: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """m partitions of nearly equal width; each takes the free bit that correlates most with what it holds."""
    free, parts = list(range(BITS)), []
    strength = np.abs(correlation) - np.eye(BITS)
    for i in range(m):
        width = (BITS * (i + 1)) // m - (BITS * i) // m
        own = [max(free, key=lambda k: (strength[k, free].max(), -k))]
        free.remove(own[0])
        while len(own) < width:
            best = max(free, key=lambda k: (strength[k, own].sum(), -k))
            own.append(best)
            free.remove(best)
        parts.append(tuple(sorted(own)))
    return tuple(parts)


def pairs_within(histogram: np.ndarray, width: int, most: int) -> list[float]:
    """For t = 0.. most, how many pairs of signatures have values within t bits, from the counts of the values."""
    layers, out, ball = [histogram.astype(float)], [], np.zeros(len(histogram))
    place = np.arange(len(histogram))
    for t in range(most + 1):
        if t:
            # The sums over the values at distance t, from those at t - 1 and t - 2.
            spread = sum(layers[t - 1][place ^ (1 << k)] for k in range(width))
            layers.append((spread - ((width - t + 2) * layers[t - 2] if t > 1 else 0)) / t)
        ball = ball + layers[t]
        out.append(float((histogram * ball).sum() - histogram.sum()) / 2)
    return out


def allocate(costs: list[list[float]], tau: int) -> tuple[int, ...]:
    """Thresholds, one for each partition, whose (t + 1) add up to tau + 1 at least cost; costs[i][t + 1] for t = -1.."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for own in costs:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for had, (cost, chosen) in best.items():
            for k, c in enumerate(own):
                total = min(tau + 1, had + k)
                if total not in after or cost + c < after[total][0]:
                    after[total] = (cost + c, (*chosen, k - 1))
        best = after
    return best[tau + 1][1]


def width_of(n: int, tau: int) -> int:
    """The number of partitions that costs least for n signatures if bits were independent."""

    def cost(m: int) -> float:
        w = BITS // m
        own = [[0.0]] * m
        ball = [sum(math.comb(w, r) for r in range(t + 1)) for t in range(w)]
        own = [[0.0, *(n * ball[-(-t // 2)] * PROBE_NS + n * n / 2 * ball[t] / 2.0**w * CANDIDATE_NS for t in range(min(w, 7)))] for _ in range(m)]
        if m * len(own[0]) - m < tau + 1:
            return math.inf
        return sum(o[t + 1] for o, t in zip(own, allocate(own, tau), strict=True))

    return min(range(3, 9), key=cost)


def plan(sigs: DataFrame, tau: int = TAU) -> Plan:
    """Partitions and thresholds, from all signatures ``a``: their bits' correlations, then each partition's counts."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((BITS, BITS))
        for batch in batches:
            a = batch.column(0).to_numpy().view(np.uint64)
            x = ((a[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            n += len(a)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], ["n", "x"])

    rows = sigs.select("a").mapInArrow(moments, "n bigint, x array<double>").collect()
    n = sum(r["n"] for r in rows)
    both = sum((np.array(r["x"]) for r in rows), np.zeros(BITS * BITS)).reshape(BITS, BITS) / max(n, 1)
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    parts = group_bits((both - np.outer(p, p)) / np.outer(spread, spread), width_of(n, tau))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(0).to_numpy().view(np.uint64)
            for i, bits in enumerate(parts):
                v, c = np.unique(values(a, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i)), pa.array(v), pa.array(c)], ["i", "v", "c"])

    counts = sigs.select("a").mapInArrow(count, "i bigint, v bigint, c bigint").groupBy("i", "v").agg(F.sum("c").alias("c")).toArrow()
    i, v, c = (counts.column(k).to_numpy() for k in ("i", "v", "c"))
    costs = []
    for k, bits in enumerate(parts):
        histogram = np.zeros(1 << len(bits))
        histogram[v[i == k]] = c[i == k]
        most = min(len(bits), 6)
        ball = [sum(math.comb(len(bits), r) for r in range(t + 1)) for t in range(most + 1)]
        costs.append([0.0, *(n * ball[-(-t // 2)] * PROBE_NS + pairs * CANDIDATE_NS for t, pairs in enumerate(pairs_within(histogram, len(bits), most)))])
    return Plan(parts, allocate(costs, tau))


def near_pairs(key: np.ndarray, a: np.ndarray, b: np.ndarray, tau: int, both: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs with the same key that verify. The keys are sorted; each step compares rows d apart."""
    left, right = [], []
    at, d = np.arange(len(key) - 1), 1
    while len(at):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        for block in np.array_split(at, max(1, len(at) // 2_000_000)):
            x = np.bitwise_count(a[block] ^ a[block + d]).astype(np.int64)
            own = block[x <= tau]
            own = own[np.bitwise_count(a[own] ^ a[own + d]).astype(np.int64) + np.bitwise_count(b[own] ^ b[own + d]) <= both]
            left.append(own)
            right.append(own + d)
        d += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one of its component."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        rest = root[left] != root[right]
        left, right = left[rest], right[rest]
    return root


def links(sigs: DataFrame, how: Plan, tau: int = TAU, both: int = TAU_BOTH) -> DataFrame:
    """(a1, b1, a2, b2): edges that connect all near signatures; of each task's a spanning forest, not all pairs.

    Partitions are probed one after the other, and the probes of one go before those of the next are made, so that the
    disks hold one partition's at a time.
    """

    def probe(batches: Iterator[pa.RecordBatch], i: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                own = batch.slice(start, 4096)
                a, b = own.column(0), own.column(1)
                for key in how.keys(a.to_numpy().view(np.uint64), i):
                    yield pa.RecordBatch.from_arrays([pa.array(key), a, b], ["k", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had = [tuple(batch.column(k).to_numpy() for k in range(3)) for batch in batches]
        if not had:
            return
        key, a, b = (np.concatenate([h[k] for h in had]) for k in range(3))
        del had
        order = np.lexsort((b, a, key))
        key, a, b = key[order], a[order].view(np.uint64), b[order].view(np.uint64)
        left, right = near_pairs(key, a, b, tau, both)
        if not len(left):
            return
        used = np.unique(np.concatenate([left, right]))
        pair, node = np.unique(np.stack([a[used], b[used]], 1), axis=0, return_inverse=True)
        node = node.ravel()
        ends = np.unique(np.stack([node[np.searchsorted(used, left)], node[np.searchsorted(used, right)]], 1), axis=0)
        root = _forest(len(pair), ends[:, 0], ends[:, 1])
        child = np.flatnonzero(root != np.arange(len(pair)))
        pair = pair.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[k, c])) for k in (child, root[child]) for c in (0, 1)], ["a1", "b1", "a2", "b2"])

    found = []
    for i in how.used:
        probes = sigs.select("a", "b").mapInArrow(partial(probe, i=i), "k bigint, a bigint, b bigint")
        found.append(cut(probes.repartition("k").mapInArrow(meet, "a1 bigint, b1 bigint, a2 bigint, b2 bigint").distinct()))
    return reduce(DataFrame.union, found).distinct()


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, tau_both: int = TAU_BOTH) -> DataFrame:
    """(doc_id, a, b, root) of the documents that have a near duplicate; root is the least id of those connected.

    The texts are read once; only signatures travel. Equal signatures meet first, then distinct ones by their probes.
    """
    own = cut(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.arrow_udf(_sign, _SIG)(utf8(text_col)).alias("s")).select("doc_id", "s.a", "s.b").where("doc_id is not null and a is not null"))
    # The checkpoint fixes the numbers of the signatures, so that two never share one as hashes could.
    sigs = cut(own.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    found = links(sigs, plan(sigs, tau), tau, tau_both)
    for end, name in (("1", "u"), ("2", "v")):
        found = found.join(sigs.select(F.col("a").alias(f"a{end}"), F.col("b").alias(f"b{end}"), F.col("node").alias(name)), [f"a{end}", f"b{end}"])
    placed = sigs.join(components(found.select("u", "v")), "node", "left").withColumn("one", F.coalesce("root", "node")).select("a", "b", "rep", "n", "one")
    heads = placed.groupBy("one").agg(F.min("rep").alias("root"), F.sum("n").alias("docs")).where("docs > 1")
    return own.join(placed.join(heads, "one").select("a", "b", heads["root"]), ["a", "b"]).select("doc_id", "a", "b", "root")


def near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, duplicate_of): each document that isn't the least of its group, with the least. A row that repeats an
    id is the duplicate of that id."""
    order = Window.partitionBy("root").orderBy("doc_id", "a", "b")
    return groups(docs, **kw).withColumn("place", F.row_number().over(order)).where("place > 1").select("doc_id", F.col("root").alias("duplicate_of"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents, with all their columns, less all but one of each group: the least id stays, of equal ids the least
    text. Documents with a null id or without a signature stay."""
    found = cut(groups(docs, id_col=id_col, text_col=text_col, **kw))
    ids = found.select(F.col("doc_id").alias("wl_key")).distinct()
    rows, key, text = boxed(docs), field(id_col).cast("bigint"), utf8(field(text_col))
    roots = found.select(F.col("a").alias("wl_a"), F.col("b").alias("wl_b"), F.col("root").alias("wl_root")).distinct()
    inside = only(rows, key, ids).withColumn("wl_sig", F.arrow_udf(_sign, _SIG)(text)).select("wl_row", F.col("wl_sig.a").alias("wl_a"), F.col("wl_sig.b").alias("wl_b")).join(roots, ["wl_a", "wl_b"], "left")
    # An id can come again with a text that has no near duplicate: that row stays.
    alone = F.col("wl_root").isNull()
    ranked = inside.where(~alone).withColumn("wl_place", F.row_number().over(Window.partitionBy("wl_root").orderBy(key, text))).where("wl_place = 1")
    return without(rows, key, ids).unionByName(inside.where(alone).select("wl_row")).unionByName(ranked.select("wl_row")).select("wl_row.*")
