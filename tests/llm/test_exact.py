from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.conftest import words
from weftline.llm import exact


def brute(rows):
    """Pairs (doc, owner) and kept rows by comparing whole texts."""
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            groups[r[1]].append(r)
    pairs, lost = [], 0
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is None, r[0] or 0))
        pairs += [(r[0], own[0][0]) for r in own[1:]]
        lost += len(own) - 1
    return sorted(pairs, key=str), len(rows) - lost


def test_odd_cases(odd, odd_rows):
    pairs, left = brute(odd_rows)
    assert sorted(map(tuple, exact.duplicates(odd).collect()), key=str) == pairs
    kept = exact.first_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == left and {r["wl_place"] for r in rows} == {5} and {r["doc"] for r in rows} == {"x"}


def test_empty(none):
    assert exact.duplicates(none).count() == 0
    assert exact.first_of_each(none).count() == 0


def test_full_bytes_decide_when_digests_collide(spark):
    rows = [(i, words(i % 40, 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    short = lambda text: F.substring(exact.digest(text), 1, 1)
    assert sorted(map(tuple, exact.duplicates(docs, digest_of=short).collect()), key=str) == brute(rows)[0]


def test_state_goes_on_over_micro_batches_and_runs(spark, tmp_path):
    """State from many micro-batches and a second run holds the least id, its place and the count."""
    schema = "doc_id bigint, digest string, locator string"
    for part in range(6):
        spark.createDataFrame([(10 * part + k, f"d{k}", f"f{part}#{k}") for k in range(3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    exact.update_state(stream, str(tmp_path / "state"))
    spark.createDataFrame([(-1, "d1", "new#0"), (99, "d9", "new#1")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    exact.update_state(stream, str(tmp_path / "state"))
    got = {r["digest"]: (r["doc_id"], r["locator"], r["times"]) for r in exact.read_state(spark, str(tmp_path / "state")).collect()}
    assert got == {"d0": (0, "f0#0", 6), "d1": (-1, "new#0", 7), "d2": (2, "f0#2", 6), "d9": (99, "new#1", 1)}


def test_locators_of_files(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "x")], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = spark.read.parquet(str(tmp_path / "t"))
    where = [r[0] for r in got.select(exact._locator(got)).collect()]
    assert where[0].endswith("#0") and where[1].endswith("#1") and ".parquet" in where[0]


def test_one_text_a_hundred_thousand_times(spark):
    """No task sees all copies: those of a task are combined before they are sent."""
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, F.repeat(F.lit("boilerplate "), 50)).otherwise(F.col("id").cast("string")).alias("text"), F.lit(1).alias("wl_key"))
    got = exact.duplicates(docs)
    assert got.count() == 89_999 and {r["duplicate_of"] for r in got.select("duplicate_of").distinct().collect()} == {1}
    kept = exact.first_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 10_001


def test_one_row_many_times(spark):
    docs = spark.range(25_003).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("same").alias("text"))
    assert exact.duplicates(docs).groupBy("doc_id", "duplicate_of").count().collect() == [(7, 7, 25_002)]
    assert exact.first_of_each(docs).count() == 1
