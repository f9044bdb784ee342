"""Rows whose key is, or isn't, among some others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit keys up to which they are sent to the executors (about 32 bytes each there); more are joined by a shuffle.
SEND = 4_000_000


def boxed(docs: DataFrame) -> DataFrame:
    """The rows as one struct column ``wl_row``, so that no name of theirs meets one of ours."""
    return docs.select(F.struct("*").alias("wl_row"))


def field(name: str) -> Column:
    """A column of boxed rows."""
    return F.col("wl_row").getField(name)


def side(keys: DataFrame) -> DataFrame:
    """The frame, sent to the executors if it has ``SEND`` rows at most."""
    return F.broadcast(keys) if keys.count() <= SEND else keys


def only(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key is in the one column ``wl_key`` of keys."""
    keys = side(keys)
    return df.join(keys, key == keys["wl_key"], "left_semi")


def without(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key isn't among them; a null key isn't."""
    keys = side(keys)
    return df.join(keys, key == keys["wl_key"], "left_anti")
