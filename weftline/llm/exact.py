"""Exact duplicates by a stateful stream.

Documents stream through keyed state that lies on disk (RocksDB) and never expires. The key is the digest of a text's
bytes; the state of a digest holds the least id seen (the stable identifier), where that content lies (the file and row,
where the source is files; ``read_state`` gives it) and how often the digest came. A digest that came more than once is a hit: the full
texts of its documents are compared, so that two texts with one digest stay apart. Copies are combined before they are sent, so that a text that comes
very often doesn't gather in one task.

Batch input goes through the same stream: its digests are written to the shared folder and read from there, some files
in each micro-batch. State and progress lie in the shared folder, so a stream that lost executors or was ended goes on.

Cases: null texts are never duplicates; empty texts are equal to each other; of equal texts the least id stays, a null
id after all others; rows that repeat in every column are duplicates of one another; an empty table gives no rows; ids that aren't integers raise.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, remove, scratch, utf8
from weftline.llm.members import boxed, field, only, side, without

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_REPEAT = 10_000


def digest(text: Column) -> Column:
    """SHA-256 of the text's bytes."""
    return F.sha2(text.cast("binary"), 256)


def update_state(stream: DataFrame, checkpoint: str) -> None:
    """Run a stream of (digest, doc_id, locator) into the state at ``checkpoint`` until its source has no more."""
    spark = stream.sparkSession
    had = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        owner = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator"))
        seen = stream.groupBy("digest").agg(owner.alias("owner"), F.count("*").alias("times"))
        query = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", had)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, doc_id, locator, times): the state as a table."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", "value.min.doc_id", "value.min.locator", F.col("value.count").alias("times"))


def _repeated(docs: DataFrame, text: Column, id_key: Column, *, digest_of=digest, files_per_batch: int) -> DataFrame:
    """Digests that came more than once, as the 64-bit keys of ``_key``."""
    spark = docs.sparkSession
    at, held = scratch(spark, "digests"), scratch(spark, "dedup-state")
    try:
        docs.select(digest_of(text).alias("digest"), id_key.alias("doc_id"), _locator(docs).alias("locator")).where("digest is not null").write.parquet(at)
        written = spark.read.parquet(at)
        stream = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", files_per_batch).parquet(at)
        update_state(stream, held)
        return cut(read_state(spark, held).where("times > 1").select(F.xxhash64("digest").alias("wl_key")).distinct())
    finally:
        remove(spark, at)
        remove(spark, held)


def _key(digest: Column) -> Column:
    """Eight bytes of a digest, null for null. Only rows whose keys repeat are compared, by their full texts, so that two digests with one key
    cost a comparison and change no result."""
    return F.when(digest.isNotNull(), F.xxhash64(digest))


def _locator(docs: DataFrame) -> Column:
    """File and row of each document where the frame reads files, else null."""
    where = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    try:
        docs.select(where)
    except AnalysisException:
        return F.lit(None).cast("string")
    return where


def _owners(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (wl_h, wl_id, wl_text) whose digests repeat: (wl_h, wl_owner) of the keys that one text has, and the keys (wl_key) of several.

    Texts are compared in full: they are what is grouped by. Copies are combined before they travel, so that a text which comes any number of times is sent once
    by each task.
    """
    texts = cut(rows.groupBy("wl_h", "wl_text").agg(F.min(F.struct(F.col("wl_id").isNull().alias("no_id"), "wl_id")).alias("wl_first")).select("wl_h", F.col("wl_first.wl_id").alias("wl_owner")))
    sizes = texts.groupBy("wl_h").agg(F.count("*").alias("wl_n"), F.first("wl_owner").alias("wl_owner"))
    return sizes.where("wl_n = 1").drop("wl_n"), sizes.where("wl_n > 1").select(F.col("wl_h").alias("wl_key"))


def _ranked(rows: DataFrame) -> DataFrame:
    """The rows of keys that several texts have, with their place among equal texts and the least id of those."""
    same = Window.partitionBy("wl_text").orderBy(F.col("wl_id").asc_nulls_last())
    return rows.withColumn("wl_place", F.row_number().over(same)).withColumn("wl_owner", F.first("wl_id").over(same))


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_of=digest, files_per_batch: int = 10_000) -> DataFrame:
    """(doc_id, duplicate_of): each document whose whole text is that of one with a smaller id, with the least such id."""
    hits = _repeated(docs, utf8(text_col), F.col(id_col).cast("bigint"), digest_of=digest_of, files_per_batch=files_per_batch)
    own = docs.select(F.col(id_col).cast("bigint").alias("wl_id"), utf8(text_col).alias("wl_text"))
    inside = only(own, _key(digest_of(F.col("wl_text"))), hits).withColumn("wl_h", _key(digest_of(F.col("wl_text"))))
    owners, mixed = _owners(inside)
    # Ids and keys travel, not texts.
    met = inside.select("wl_h", "wl_id").join(side(owners), "wl_h")
    others = met.where(~F.col("wl_id").eqNullSafe(F.col("wl_owner"))).select(F.col("wl_id").alias("doc_id"), F.col("wl_owner").alias("duplicate_of"))
    # Rows that repeat their text's least id: all but one of them.
    again = met.where(F.col("wl_id").eqNullSafe(F.col("wl_owner"))).groupBy("wl_h", "wl_id").count().where("count > 1")
    # Written out in parts, so that no array follows the number of repeats.
    again = again.withColumn("part", F.explode(F.expr(f"sequence(0, (count - 2) div {_REPEAT})"))).select(F.col("wl_id").alias("doc_id"), F.explode(F.expr(f"array_repeat(wl_id, cast(least({_REPEAT}, count - 1 - part * {_REPEAT}) as int))")).alias("duplicate_of"))
    rest = _ranked(only(inside, F.col("wl_h"), mixed)).where("wl_place > 1").select(F.col("wl_id").alias("doc_id"), F.col("wl_owner").alias("duplicate_of"))
    return others.unionByName(again).unionByName(rest)


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_of=digest, files_per_batch: int = 10_000) -> DataFrame:
    """The documents, with all their columns, without those whose whole text came with a smaller id. Of rows with both alike any one stays."""
    hits = _repeated(docs, utf8(text_col), F.col(id_col).cast("bigint"), digest_of=digest_of, files_per_batch=files_per_batch)
    rows = boxed(docs)
    text, key = utf8(field(text_col)), _key(digest_of(utf8(field(text_col))))
    inside = only(rows, key, hits).select("wl_row", field(id_col).cast("bigint").alias("wl_id"), text.alias("wl_text"), key.alias("wl_h"))
    owners, mixed = _owners(inside.drop("wl_row"))
    # Both the key and the id spread the rows, so that copies of one text don't gather.
    met = inside.alias("i").join(side(owners).alias("o"), (F.col("i.wl_h") == F.col("o.wl_h")) & F.col("i.wl_id").eqNullSafe(F.col("o.wl_owner"))).select("i.wl_h", "wl_row")
    kept = met.groupBy("wl_h").agg(F.first("wl_row").alias("wl_row")).select("wl_row")
    rest = _ranked(only(inside, F.col("wl_h"), mixed)).where("wl_place = 1").select("wl_row")
    return without(rows, key, hits).unionByName(kept).unionByName(rest).select("wl_row.*")
