"""Mixture-controlled packing by deficit round-robin over source queues.

Every window of ``window`` tokens is filled from the queues of all sources in target proportions. A source earns its
share of each window as credit; whole tokens of it are paid, and what is left is its deficit, carried from window to window for as
long as the queue lasts. Documents follow each other within their queue, cut where a window ends. In the window in which
a queue runs dry, what it can't pay is paid by the others, all alike in tokens, which they owe from then on; later windows have the shares of the
sources that remain.

No pass over windows is needed. As long as the same queues last, a source's credit grows evenly, so the driver only works
out the windows in which queues run dry (``Schedule``: a few numbers for each source). From those, the tokens served of every queue up to any window
follow directly: the round's credit is raised until the window is full, and its whole tokens are served. Ranges of windows are laid out by
many tasks, and each continues the deficits of the one before exactly. A window's slots meet the documents by the block of
``BLOCK`` tokens of the queue in which they lie, so that a large source is worked on by many tasks and no group is larger than a block.

Tokens are the text's runs of characters that aren't white space (blank, tab, line ends). The order within a queue is
by a hash of the id, then id, then a hash of the text.

Cases: null texts and those without tokens occupy nothing and don't appear; a null source is a queue of its own; rows
that repeat are packed each; targets of sources that aren't there are left out, and sources without a positive target are
packed evenly after all others are dry; the last window may be short; ids that aren't integers raise. The driver holds about 100 bytes a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, utf8

#: Documents in a bucket of a queue's order, about.
BUCKET = 50_000
#: Tokens of a queue in which documents and slots meet.
BLOCK = 4096
#: Windows laid out at a time by a task, times sources, about.
_CELLS = 1_000_000


def tokens(text: Column) -> Column:
    """The number of tokens of a text."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+"))


class _Round:
    """The round-robin over some queues until all are dry. ``ahead``: tokens of the sequence before its own."""

    def __init__(self, left: np.ndarray, want: np.ndarray, window: int, ahead: int):
        self.left, self.want = left.astype(np.int64), want / want.sum()
        self.window, self.ahead, self.total = window, ahead, int(left.sum())
        k = len(left)
        #: The phase in which each queue runs dry.
        self.dry = np.full(k, k + 1, dtype=np.int64)
        #: Of each phase: from which token on, tokens of the dry queues, weight and number of the others, and what those were paid ahead.
        self.begin, self.spent, self.weight, self.open, self.extra = [0], [0], [1.0], [k], [0.0]
        while self.open[-1]:
            self._next()

    def _next(self) -> None:
        """The next window in which a queue runs dry."""
        e = len(self.begin) - 1
        on = np.flatnonzero(self.dry > e)
        w, n, extra = self.want[on], self.left[on], self.extra[e]
        # The round at which the first queue is dry, in tokens, and the end of that window.
        at = self.spent[e] + self.open[e] * extra + self.weight[e] * max(0.0, float(((n - extra) / w).min()))
        end = max(-(-int(min(self.total, math.ceil(at)) + self.ahead) // self.window) * self.window - self.ahead, self.begin[e])
        level = (end - self.spent[e] - self.open[e] * extra) / self.weight[e]
        lasts = np.ones(len(on), dtype=bool)
        more = extra
        while lasts.any():
            credit = w * level + more
            gone = lasts & ((credit >= n) | (end >= self.total))
            if not gone.any():
                break
            owed = (credit - n)[gone].sum()
            lasts &= ~gone
            more += owed / max(1, int(lasts.sum()))
        if lasts.all():  # by rounding none was dry yet: the fullest one is
            lasts[np.argmax(w * level + extra - n)] = False
        self.dry[on[~lasts]] = e + 1
        on, own = on[lasts], self.left[on[lasts]]
        spent = self.total - int(own.sum())
        weight = float(self.want[on].sum())
        before = max(self.begin[e], end - self.window)
        grown = weight * (level - (before - self.spent[e] - self.open[e] * extra) / self.weight[e])
        if len(on) and grown < 2 * len(on):
            more = self._bounded(e, end, before, on, spent, more)
        self.begin.append(min(end, self.total))
        self.spent.append(spent)
        self.weight.append(weight)
        self.open.append(len(on))
        self.extra.append(more)

    def _bounded(self, e: int, end: int, before: int, on: np.ndarray, spent: int, high: float) -> float:
        """The most that the others can be paid ahead, ``high`` or less, without taking back what the window before gave them."""
        low = self.extra[e]
        _, level = self._solve(e, np.array([before]))
        fits = lambda x: np.minimum(self.left[on], np.floor(self.want[on] * level[0] + x)).sum() <= end - spent
        if fits(high):
            return high
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        return low

    def _solve(self, e: int, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens served of each queue when ``upto`` tokens are in all, in phase e; and the level of the round's credit."""
        on = np.flatnonzero(self.dry > e)
        w, n, extra = self.want[on], self.left[on], self.extra[e]
        need = upto - self.spent[e]
        served = lambda level: np.minimum(n, np.maximum(0, np.floor(w * level[:, None] + extra)).astype(np.int64))
        out = np.repeat(np.where(self.dry > e, 0, self.left)[None], len(upto), 0)
        if not len(on):
            return out, np.zeros(len(upto))
        nominal = (need - len(on) * extra) / self.weight[e]
        low, step = nominal - 2 / self.weight[e], (len(on) + 2) / self.weight[e]
        while (over := served(low).sum(1) >= np.maximum(need, 1)).any():
            low = np.where(over, low - step, low)
        high = nominal + step
        while (short := served(high).sum(1) < need).any():
            high, step = np.where(short, high + step, high), step * 2
        rows = np.arange(len(upto))
        while len(rows):
            mid = (low[rows] + high[rows]) / 2
            enough = served(mid).sum(1) >= need[rows]
            stuck = (mid <= low[rows]) | (mid >= high[rows])
            high[rows] = np.where(enough & ~stuck, mid, high[rows])
            low[rows] = np.where(~enough & ~stuck, mid, low[rows])
            rows = rows[~stuck & (served(high[rows]).sum(1) > need[rows])]
        below, most = served(low), served(high)
        # Credits that pass a whole token at the same moment are paid in the sources' order.
        rest = (need - below.sum(1))[:, None]
        before = np.cumsum(most - below, axis=1) - (most - below)
        own = np.where((most.sum(1) == need)[:, None], most, below + np.clip(rest - before, 0, most - below))
        out[:, on] = np.where((need <= 0)[:, None], 0, own)
        return out, high

    def served(self, upto: np.ndarray) -> np.ndarray:
        """Row by row the tokens served of each queue when ``upto`` tokens (rising) of this round-robin are in all."""
        out = np.repeat(self.left[None], len(upto), 0)
        phase = np.searchsorted(np.array(self.begin), upto, "right") - 1
        for e in np.unique(phase).tolist():
            at = np.flatnonzero(phase == e)
            out[at] = self._solve(e, upto[at])[0]
        return out


class Schedule:
    """How far each queue is served after each window."""

    def __init__(self, totals: Mapping[str | None, int], targets: Mapping[str | None, float], window: int):
        """totals: tokens of each source."""
        self.sources = sorted((s for s, n in totals.items() if n), key=lambda s: (s is None, s or ""))
        left = np.array([totals[s] for s in self.sources], dtype=np.int64)
        want = np.array([max(0.0, float(targets.get(s) or 0)) for s in self.sources])
        self.window, self.total = window, int(left.sum())
        self.windows = -(-self.total // window)
        self.rounds: list[tuple[np.ndarray, _Round]] = []
        ahead = 0
        for own, w in ((np.flatnonzero(want > 0), want), (np.flatnonzero(want <= 0), np.ones(len(want)))):
            if len(own):
                self.rounds.append((own, _Round(left[own], w[own], window, ahead)))
                ahead += int(left[own].sum())

    def served(self, upto: np.ndarray) -> np.ndarray:
        """Tokens served of each source (columns) when the windows before ``upto`` (rising) are full."""
        out = np.zeros((len(upto), len(self.sources)), dtype=np.int64)
        tokens_ = np.minimum(np.asarray(upto, dtype=np.int64) * self.window, self.total)
        for own, r in self.rounds:
            out[:, own] = r.served(np.clip(tokens_ - r.ahead, 0, r.total))
        return out

    def slots(self, first: int, last: int) -> tuple[np.ndarray, ...]:
        """The slots of windows first .. last - 1: window, source, place within the window, start within the queue, length."""
        edge = self.served(np.arange(first, last + 1))
        n = np.diff(edge, axis=0)
        place = np.cumsum(n, axis=1) - n
        w, k = np.nonzero(n)
        return first + w, k, place[w, k], edge[w, k], n[w, k]


def tempered(totals: Mapping[str | None, int], power: float) -> dict[str | None, float]:
    """Targets in proportion to a power of each source's tokens: 1 as they come, 0 all alike."""
    return {s: float(n) ** power for s, n in totals.items() if n}


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = 2048, targets: Mapping[str | None, float] | None = None, power: float = 0.7) -> DataFrame:
    """(window_id, place, source, doc_id, start, length): the pieces that fill the windows. place: the piece's first token
    within its window; start and length: its tokens within the document. Without targets they are ``tempered``.

    Only (id, source, number of tokens) travel, three times: to sum the buckets, to order within them, and to meet the slots.
    """
    if window < 1:
        raise ValueError("a window needs a token at least")
    text = utf8(text_col)
    rows = cut(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens(text).cast("bigint").alias("n"), F.xxhash64(F.col(id_col).cast("bigint")).alias("h"), F.xxhash64(text).alias("t")).where("n > 0"))
    sums = rows.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()
    totals = {r["source"]: r["n"] for r in sums}
    schedule = Schedule(totals, tempered(totals, power) if targets is None else targets, window)
    bits = max(0, min(40, math.ceil(math.log2(max([1, *(r["docs"] for r in sums)]) / BUCKET))))
    rows = rows.withColumn("bucket", F.shiftright(F.col("h"), 63 - bits) if bits else F.lit(0).cast("bigint"))
    queue = Window.partitionBy("source").orderBy("bucket")
    before = rows.groupBy("source", "bucket").agg(F.sum("n").alias("own")).withColumn("before", F.sum("own").over(queue) - F.col("own")).select("source", "bucket", "before")
    inner = Window.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "t", "n")
    placed = rows.withColumn("upto", F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, 0))).alias("r").join(before.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket"))).select("doc_id", F.col("r.source").alias("source"), (F.col("before") + F.col("upto") - F.col("n")).alias("lo"), (F.col("before") + F.col("upto")).alias("hi"))
    slots = _slots(docs.sparkSession, schedule)
    blocks = lambda lo, hi: F.explode(F.sequence(F.expr(f"{lo} div {BLOCK}"), F.expr(f"({hi} - 1) div {BLOCK}")))
    d = placed.withColumn("block", blocks("lo", "hi")).alias("d")
    # Both sides grow with the input: neither is sent whole.
    s = slots.withColumn("block", blocks("begin", "stop")).hint("merge").alias("s")
    met = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.block") == F.col("s.block")) & (F.col("lo") < F.col("stop")) & (F.col("begin") < F.col("hi")))
    # What lies in several blocks on both sides meets in each, and counts where it begins.
    start, stop = F.greatest("lo", "begin"), F.least("hi", "stop")
    return met.where(F.floor(start / BLOCK) == F.col("d.block")).select("window_id", (F.col("place") + start - F.col("begin")).alias("place"), F.col("d.source").alias("source"), "doc_id", (start - F.col("lo")).alias("start"), (stop - start).alias("length"))


def _slots(spark: SparkSession, schedule: Schedule) -> DataFrame:
    """(window_id, source, place, begin, stop): what each window takes from each queue, laid out by ranges of windows."""
    step = max(1, min(4096, _CELLS // max(1, len(schedule.sources))))
    sent = spark.sparkContext.broadcast(schedule)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = pa.array(own.sources, pa.string())
        for batch in batches:
            for first in batch.column(0).to_pylist():
                w, k, place, begin, n = own.slots(first * step, min(own.windows, (first + 1) * step))
                for i in range(0, len(w), 100_000):
                    j = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(w[j]), names.take(pa.array(k[j])), pa.array(place[j]), pa.array(begin[j]), pa.array(begin[j] + n[j])], ["window_id", "source", "place", "begin", "stop"])

    ranges = -(-schedule.windows // step)
    parts = max(1, min(ranges, spark.sparkContext.defaultParallelism * 4))
    return spark.range(0, ranges, 1, parts).mapInArrow(lay, "window_id bigint, source string, place bigint, begin bigint, stop bigint")
