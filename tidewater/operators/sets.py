"""Unions to a common schema, set differences and intersections, deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.windows import first_n


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def to_activity(df: DataFrame, author: str, handle: Column, kind: str, ts: str, data: list[str]) -> DataFrame:
    """author_did, author_handle, data_type, data (JSON of the rest) and activity_timestamp."""
    packed = F.to_json(F.struct(*data), {"ignoreNullFields": "false"})
    return df.select(F.col(author).cast("string").alias("author_did"), handle.cast("string").alias("author_handle"), F.lit(kind).alias("data_type"), packed.alias("data"), F.col(ts).alias("activity_timestamp"))


def last_wins(df: DataFrame, key: str, order: str, value: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*value), order).alias("v")).select(key, "v.*")


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The new rows that existing lacks, the first of each key."""
    return first_n(new, key, order).join(existing.select(*key), key, "left_anti")


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


#: Rows of one task where keys are told apart.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys to as many tasks as hold about ``rows`` rows each, so that an aggregate by these keys, which
    then needs no further shuffle, takes the same memory whatever the size of df (equal keys still meet)."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)
