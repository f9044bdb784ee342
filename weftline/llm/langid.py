"""Language identification with bit-sliced Bloom filters over character n-grams.

One table holds all the languages' filters: slot j has one bit for each language, so that the AND of an n-gram's
``PROBES`` slots is the bitmask of all languages that contain it. A text's n-grams are looked up all at once; the
set bits are counted for each language, corrected for that filter's rate of false positives, and the counts decide.

An n-gram is four folded letters, with word edges as separators. A language contains it if it occurs in its training text, however
many other languages contain it too. Training
takes at most ``per_language`` rows with that language in ``lang``, those with the lowest hash of the id: a documented
bound. Identification covers every document and its whole text.

Cases: a null text, or one without n-grams, or in which no language reaches ``least`` of the n-grams, is ``und`` with
confidence 0 where nothing was counted; of equal counts the first language by name wins; rows with a null language or a null id
don't train; with no training rows every text is ``und``. There can be 64 languages at most. Ids that aren't integers raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import EDGE, chunks, fold_table, joined, utf8

N, PROBES = 4, 3
#: Bits of table per stored n-gram and language.
_ROOM = 12


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of all texts (21 bits a letter would not fit, so they are mixed to 64 bits), and for each the
    number of its text. N-grams lie within a word with its edges: a separator stands only at either end."""
    array, starts = joined(texts, fold_table(False))
    wide = array.astype(np.uint64)
    if len(array) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inner = (array[1 : 2 - N] > EDGE) & (array[2 : 3 - N] > EDGE)
    first, last = array[: 1 - N], array[N - 1 :]
    at = np.flatnonzero(inner & (first != EDGE) & (last != EDGE))
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(N):
        h = (h ^ wide[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h, np.searchsorted(starts, at, "right") - 1


@dataclass
class LanguageFilters:
    """table[slot] is the bitmask of languages; wrong[l] the chance that language l's filter claims a foreign n-gram."""

    languages: list[str]
    table: np.ndarray
    wrong: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of all languages that contain it."""
        m = np.uint64(len(self.table) - 1)
        step = (grams >> np.uint64(32)) | np.uint64(1)
        mask = self.table[(grams & m).astype(np.int64)]
        for k in range(1, PROBES):
            mask = mask & self.table[((grams + np.uint64(k) * step) & m).astype(np.int64)]
        return mask

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the n-grams of each language, corrected for false positives; and how many n-grams it has."""
        grams, row = ngrams(texts)
        n = np.bincount(row, minlength=len(texts)).astype(float)
        out = np.zeros((len(texts), len(self.languages)))
        mask = self.masks(grams)
        for k in range(len(self.languages)):
            hits = np.bincount(row[(mask >> np.array(k, mask.dtype)) & np.array(1, mask.dtype) != 0], minlength=len(texts))
            out[:, k] = np.maximum(0, (hits - n * self.wrong[k]) / (1 - self.wrong[k]))
        return out, n


def build(grams: dict[str, np.ndarray]) -> LanguageFilters:
    """Filters of each language's distinct n-grams."""
    names = sorted(grams)
    if len(names) > 64:
        raise ValueError("more than 64 languages")
    if not names:
        return LanguageFilters([], np.zeros(2, np.uint8), np.zeros(0))
    slots = 1 << max(10, int(np.ceil(np.log2(_ROOM * max(1, max(map(len, grams.values())))))))
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(names) <= 8 * np.dtype(t).itemsize)
    table = np.zeros(slots, dtype=kind)
    m = np.uint64(slots - 1)
    for bit, name in enumerate(names):
        g = grams[name]
        step = (g >> np.uint64(32)) | np.uint64(1)
        for k in range(PROBES):
            np.bitwise_or.at(table, ((g + np.uint64(k) * step) & m).astype(np.int64), kind(1 << bit))
    fill = np.array([np.mean((table >> kind(bit)) & kind(1) != 0) for bit in range(len(names))])
    return LanguageFilters(names, table, fill**PROBES)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400) -> LanguageFilters:
    """Build filters from ``per_language`` documents of each language; their n-grams are gathered on the executors."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("wl_id"), F.col(lang_col).cast("string").alias("lang"), utf8(text_col).alias("text")).where("lang is not null and text is not null")
    keys = rows.select("wl_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("wl_id"), "wl_id")
    # row_number <= n is planned as a group limit before the shuffle, so that no language's rows gather in one task.
    some = keys.withColumn("wl_n", F.row_number().over(first)).where(F.col("wl_n") <= per_language).drop("wl_n")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column(1)):
                names = np.array(batch.column(0).slice(start, len(texts)).to_pylist(), dtype=object)
                grams, row = ngrams(texts)
                for name in sorted(set(names)):
                    g = np.unique(grams[names[row] == name])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g.view(np.int64))], ["lang", "gram"])

    # The sample has per_language ids a language at most, whatever the input: it is the side that is sent. Ids may come again, so its rows are bounded too.
    own = rows.join(F.broadcast(some), ["wl_id", "lang"]).withColumn("wl_h", F.xxhash64("text"))
    own = own.withColumn("wl_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("wl_id"), "wl_id", "wl_h"))).where(F.col("wl_n") <= per_language)
    found = own.select("lang", "text").mapInArrow(count, "lang string, gram bigint").distinct().toArrow()
    names = np.array(found.column("lang").to_pylist(), dtype=object)
    grams = found.column("gram").to_numpy().view(np.uint64)
    return build({name: np.sort(grams[names == name]) for name in sorted(set(names))})


def identify(docs: DataFrame, filters: LanguageFilters, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75) -> DataFrame:
    """(doc_id, language, confidence, languages) of every document. languages: all that reach ``least`` of its n-grams,
    the likeliest first. confidence: the share of n-grams of the first. Map only: no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def decide(texts: pa.Array) -> pa.Array:
        own, names = sent.value, sent.value.languages
        lang, sure, some = [], [], []
        for _, part in chunks(texts):
            counts, n = own.counts(part)
            p = counts / np.maximum(n, 1)[:, None]
            order = np.argsort(-p, axis=1, kind="stable")
            for i in range(len(part)):
                ranked = [int(k) for k in order[i] if p[i, k] >= least]
                lang.append(names[ranked[0]] if ranked else "und")
                sure.append(float(p[i, ranked[0]]) if ranked else 0.0)
                some.append([names[k] for k in ranked])
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(some, pa.list_(pa.string()))], ["language", "confidence", "languages"])

    udf: Callable = F.arrow_udf(decide, "struct<language: string, confidence: double, languages: array<string>>")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), udf(utf8(text_col)).alias("found")).select("doc_id", "found.*")
