import base64
from glob import glob
from pathlib import Path

import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.conftest import words
from weftline.llm import tokens

pytest.importorskip("tiktoken")


def test_round_trip(spark, odd, none, tmp_path):
    """Every text comes back from its ids, byte for byte."""
    special = spark.createDataFrame([(50, "a  b\n\n c <|endoftext|> 12345 naïve 🙂 don't", "en", "s", 1, 1, "x", 1, 1)], odd.schema)
    docs = odd.union(special)
    table = tokens.tokenized(docs, str(tmp_path / "t"))
    encoding = tokens.Encoder(tokens.VOCABULARY).encoding
    got = sorted((str(r["doc_id"]), None if r["tokens"] is None else encoding.decode(r["tokens"])) for r in table.collect() if r["doc_id"] is not None)
    assert got == sorted((str(r["doc_id"]), r["text"]) for r in docs.collect() if r["doc_id"] is not None)
    assert table.where("n_tokens != size(tokens) or (tokens is null) != (n_tokens is null)").count() == 0
    assert table.count() == docs.count() and table.where("doc_id = 5").first()["n_tokens"] == 0
    assert tokens.tokenized(none, str(tmp_path / "e")).count() == 0


def test_layout_and_selective_reads(spark, tmp_path):
    docs = spark.createDataFrame([(i, words(i, 400), "s", "en") for i in range(3000)], "doc_id bigint, text string, source string, lang string").coalesce(1)
    tokens.write(tokens.encoded(docs), str(tmp_path / "t"), row_group_mb=1, page_kb=16)
    (file,) = glob(str(tmp_path / "t/*.parquet"))
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 2
    for g in range(meta.num_row_groups):
        own = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
        ids = own["tokens.list.element"]
        assert "RLE_DICTIONARY" in ids.encodings and ids.compression == "ZSTD"
        assert "DELTA_BINARY_PACKED" in own["doc_id"].encodings and "DELTA_BINARY_PACKED" in own["n_tokens"].encodings
        assert all(c.has_column_index and c.has_offset_index for c in own.values())
    some = tokens.read(spark, str(tmp_path / "t"), ids=[7, 2900], columns=["doc_id", "n_tokens"])
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in plan
    assert sorted(r["doc_id"] for r in some.collect()) == [7, 2900]
    assert tokens.read(spark, str(tmp_path / "t")).agg(F.count("tokens")).first()[0] == 3000


def slow_bpe(text, ranks):
    """Of each piece the neighbours of the lowest rank join, until none has a rank."""
    out = []
    for piece in regex.findall(tokens.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while True:
            best = min(((ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_ids_against_a_second_encoder(spark, tmp_path):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(tokens.VOCABULARY).read_bytes().splitlines() if x)}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(-1, "a  b\n\n c <|endoftext|> 12345 naïve 🙂 don't ŻÓŁĆ 漢字\t ", "s", "en")], "doc_id bigint, text string, source string, lang string"), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in tokens.tokenized(docs, str(tmp_path / "t")).collect()}
    for r in docs.collect():
        text = r["text"]
        assert got[r["doc_id"]]["tokens"] == (None if text is None else slow_bpe(text, ranks))


def test_own_vocabulary_and_names_that_clash(spark, tmp_path):
    """A small vocabulary of one's own, and null ids; a column to keep can't have a name of the table's own."""
    own = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b" ab"]
    ranks = {t: k for k, t in enumerate(own)}
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for t, k in ranks.items()))
    docs = spark.createDataFrame([(None, "abc ab abab", 1), (1, None, 2), (None, "abc ab abab", 1)], "doc_id bigint, text string, n_tokens int")
    table = tokens.encoded(docs, keep=(), vocabulary=str(tmp_path / "v"))
    assert sorted((str(r["doc_id"]), r["tokens"]) for r in table.where("tokens is not null").collect()) == [("None", slow_bpe("abc ab abab", ranks))] * 2
    with pytest.raises(ValueError):
        tokens.encoded(docs, keep=("n_tokens",))
