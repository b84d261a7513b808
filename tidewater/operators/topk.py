"""Sorted, cut and sampled rows; every random choice takes a seed and depends on a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.windows import numbered


def _uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) from a key, alike on every run, every partitioning and every engine with md5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 10)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 40)


def top_n(df: DataFrame, count: str, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(count), key).limit(n)


def positions(df: DataFrame, by: list[str], order: list[Column], alias: str = "position") -> DataFrame:
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def jitter(df: DataFrame, by: list[str], position: str, key: str, amount: int, seed: int) -> DataFrame:
    """Positions moved by up to amount either way, clamped and renumbered stably."""
    shift = F.floor(_uniform(key, seed) * (2 * amount + 1)) - amount
    last = F.max(position).over(Window.partitionBy(*by))
    moved = F.least(F.greatest(F.col(position) + shift, F.lit(0)), last)
    df = df.withColumn("__moved", moved)
    return df.withColumn(position, F.row_number().over(Window.partitionBy(*by).orderBy("__moved", position)) - 1).drop("__moved")


def too_short(df: DataFrame, by: list[str], length: int) -> DataFrame:
    """Groups with fewer rows than they must have; an empty result means all is well."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") < length)


def checked_length(df: DataFrame, by: list[str], length: int) -> DataFrame:
    """df, of which the job fails if a group has fewer rows than it must have."""
    short = too_short(df, by, length).limit(1)
    wrong = short.agg(F.count("*").alias("__short"))
    checked = F.when(F.col("__short") > 0, F.raise_error(F.lit(f"a group has fewer than {length} rows"))).otherwise(F.lit(True))
    return df.crossJoin(F.broadcast(wrong)).where(checked).drop("__short")


def page_after(items: DataFrame, position: str, item: str, cursor: str | None, limit: int = 30) -> DataFrame:
    """The page after the item whose sha256 is the cursor (the first page for none; empty for eof)."""
    if cursor == "eof":
        return items.limit(0)
    if cursor is not None:
        at = items.where(F.sha2(item, 256) == cursor).agg(F.min(position).alias("__at"))
        items = items.crossJoin(F.broadcast(at)).where(F.col(position) > F.col("__at")).drop("__at")
    return items.orderBy(position).limit(limit)


def last_rows(df: DataFrame, flag: Column, *order: Column) -> DataFrame:
    """Sorted, with the flagged rows at the end."""
    return df.orderBy(flag, *order)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """n rows (of each group), the same whenever it is asked for."""
    if not by:
        return df.orderBy(_uniform(key, seed), key).limit(n)
    w = Window.partitionBy(*by).orderBy(_uniform(key, seed), key)
    return df.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= n).drop("__place")


def sample_share(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """About a share of the rows; none for 0 and less, all for 1 and more."""
    return df.limit(0) if share <= 0 else df if share >= 1 else df.where(_uniform(key, seed) < share)


def resample(df: DataFrame, key: str, size: int, n: int, seed: int = 42, replacement: bool = True) -> DataFrame:
    """size rows from df's n rows: a sample without repeats, or if n is too small, draws with replacement.

    Draws are numbered; each takes the row whose place (by hash of key) its own hash points at, so the
    draws are shuffled, never gathered. Without replacement, each row comes as often as it takes.
    """
    if n <= 0 or size <= 0:
        return df.limit(0)
    if size <= n:
        return sample_n(df, key, size, seed)
    if not replacement:
        whole = -(-size // n)
        many = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(whole))))
        return many.orderBy("__copy", _uniform(key, seed), key).limit(size).drop("__copy")
    return drawn(df, key, size, n, seed)


def drawn(df: DataFrame, key: str, size: int, n: int, seed: int = 42) -> DataFrame:
    """size draws with replacement from df's n rows, also where these are enough for a sample without repeats."""
    placed = numbered(df, [_uniform(key, seed), F.col(key)], "__at")
    draws = df.sparkSession.range(size).select(F.floor(_uniform("id", seed + 1) * n).alias("__at"))
    return placed.join(draws, "__at").drop("__at")


