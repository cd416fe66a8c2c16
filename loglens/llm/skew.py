"""A left join whose hot keys do not meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least one in so many of the left rows; so there are at most that many hot keys.
SHARE = 1000
_SALTS = 4096


def left_join(left: DataFrame, right: DataFrame, key: str, copies: str, total: int, spread: str) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a key), nulls where it has none.

    ``copies`` is a column of ``right``: how many left rows hold the key; ``total`` the number of
    left rows. The keys that hold ``1 / SHARE`` of the rows or more, ``SHARE`` at most, are
    broadcast; rows that found theirs are dealt by the hash of ``spread`` in the shuffle of the
    rest, where no key then holds more than ``total / SHARE`` rows.
    """
    values = [c for c in right.columns if c not in (key, copies)]
    is_hot = F.col(copies) * SHARE >= total
    hot = F.broadcast(right.filter(is_hot).select(F.col(key).alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in values)))
    rest = right.filter(~is_hot).select(F.col(key).alias("__key"), F.lit(0).alias("__of"), *(F.col(c).alias(f"__rest_{c}") for c in values))
    got = left.join(hot, F.col(key) == F.col("__hot"), "left")
    salt = F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int"))
    got = got.withColumn("__salt", salt)
    got = got.join(rest, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__of")), "left")
    return got.select(*left.columns, *(F.coalesce(f"__hot_{c}", f"__rest_{c}").alias(c) for c in values))
