"""Token ids as Parquet list columns for selective reads.

Texts are encoded with a public byte-level BPE vocabulary, whose file is a parameter, and written as one Parquet table
of metadata and a list column of ids. The ids are dictionary encoded (a vocabulary's ids fit one dictionary page for each row group),
the document's id and its length in tokens delta encoded; row groups have a set size, and each column chunk has page indexes, so
that a reader of some documents, or of the metadata only, reads the pages it needs.

Cases: a null text has null ids and length; an empty text has an empty list and length 0; strings that look like special tokens are
ordinary text; rows that repeat are written each, those with a null id too; an empty table gives an empty table; columns to keep can't have the names of
the table's own (ValueError), and other columns are left out; ids that aren't integers raise.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import chunks, scratch, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's tokens were bounded: contractions, words and numbers with the blank before, signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """A byte-level BPE encoder, built from its vocabulary file where it is used."""

    def __init__(self, vocabulary: str, pattern: str = PATTERN):
        self.vocabulary, self.pattern, self._encoding = vocabulary, pattern, None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "pattern": self.pattern, "_encoding": None}

    @property
    def encoding(self):
        if self._encoding is None:
            import tiktoken

            lines = Path(self.vocabulary).read_bytes().splitlines()
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._encoding

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())


def encoded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("source", "lang"), vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, the columns to keep, n_tokens, tokens) of every document."""
    if clash := {"doc_id", "n_tokens", "tokens"} & {c.lower() for c in keep}:
        raise ValueError(f"the token table has its own columns {sorted(clash)}")
    encoder = Encoder(vocabulary)

    def each(texts: pa.Array) -> pa.Array:
        parts = []
        for _, own in chunks(texts):
            ids = [None if t is None else encoder.encode(t) for t in own]
            n = np.fromiter((0 if x is None else len(x) for x in ids), dtype=np.int64, count=len(ids))
            flat = np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)]).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append([x is None for x in ids], False))
            parts.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    columns = [F.col(id_col).cast("bigint").alias("doc_id"), *(F.col(c) for c in keep)]
    with_ids = docs.select(*columns, F.arrow_udf(each, "array<int>")(utf8(text_col)).alias("tokens"))
    return with_ids.select("doc_id", *keep, F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens"), "tokens")


def write(table: DataFrame, path: str, *, row_group_mb: int = 32, page_kb: int = 256, delta: tuple[str, ...] = ("doc_id", "n_tokens")) -> None:
    """Write a token table with dictionary-encoded ids, delta-encoded ``delta`` columns, set row groups and page indexes."""
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_mb << 20, "parquet.page.size": page_kb << 10, "parquet.dictionary.page.size": 1 << 20, "parquet.enable.dictionary": "true", "parquet.page.write-checksum.enabled": "true", "parquet.column.index.access": "true", "compression": "zstd"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in delta}
    table.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read(spark: SparkSession, path: str, *, ids: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Some columns of some documents of a token table; filters and columns reach the Parquet scan."""
    table = spark.read.parquet(path)
    if ids is not None:
        table = table.where(F.col("doc_id").isin(ids))
    return table if columns is None else table.select(*columns)


def tokenized(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Encode all documents, write the token table to ``path`` (a new one in the shared folder by default), and read it."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write(encoded(docs, **kw), path)
    return read(spark, path)
