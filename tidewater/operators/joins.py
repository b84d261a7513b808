"""Joins beyond plain equality, and the usual chains of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_by(df: DataFrame, other: DataFrame, key: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in other, and rows whose key is not."""
    keys = other.select(key).distinct()
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def without_participants(df: DataFrame, did: str, handle: str, excluded: DataFrame) -> DataFrame:
    """Rows whose did and whose handle are both not among the excluded (did, handle); a null matches nothing."""
    dids = excluded.select(F.col("did").alias(did)).where(F.col(did).isNotNull()).distinct()
    handles = excluded.select(F.col("handle").alias(handle)).where(F.col(handle).isNotNull()).distinct()
    return df.join(dids, did, "left_anti").join(handles, handle, "left_anti").select(df.columns)


def enrich(df: DataFrame, parts: list[tuple[DataFrame, dict[str, object]]], key: str, done: DataFrame | None = None) -> DataFrame:
    """Left joins on key with a fill value for every column taken; rows in done are left out.

    Each part must have one row a key (see windows.latest).
    """
    if done is not None:
        df = df.join(done.select(key), key, "left_anti")
    for part, fills in parts:
        df = df.join(part.select(key, *fills), key, "left").fillna({k: v for k, v in fills.items() if v is not None})
    return df


def hydrate(df: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Chain of left joins; columns that df has already are not taken again."""
    return reduce(lambda a, b: a.join(b.drop(*[c for c in b.columns if c != key and c in a.columns]), key, "left"), parts, df)


def without_missing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Inner join that fails the job on a key that other lacks."""
    joined = df.join(other.withColumn("__there", F.lit(True)), key, "left")
    checked = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return joined.where(checked).drop("__there")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, value: str, default: Column | None = None, span: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the value of the newest right row of the same group that is not later.

    Both sides are united, and a window carries the last value forward, so a group's sides never
    multiply. Of right rows at one time the largest value counts; null values are passed over.

    A group's history is cut by ``span``, a monotonic function of the time (the day, if times are
    dates or timestamps; else there is one span), and each span starts with the last value of
    those before it: so a busy group is dealt over tasks by its spans. Those last values come from
    an aggregate with a row a group and span, and the rows themselves are shuffled once.
    """
    if span is None:
        timed = isinstance(left.schema[left_ts].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        span = F.to_date if timed else lambda _: F.lit(0)
    r = right.select(*by, F.col(right_ts).alias("__ts"), F.lit(1).alias("__side"), F.col(value).alias("__value"))
    l = left.withColumn("__row", F.struct(*left.columns)).select(*by, F.col(left_ts).alias("__ts"), F.lit(2).alias("__side"), "__row")  # noqa: E741
    r, l = (d.withColumn("__span", span(F.col("__ts"))) for d in (r, l))  # noqa: E741

    newest = F.max(F.when(F.col("__value").isNotNull(), F.struct("__ts", "__value")))["__value"]
    ends = r.groupBy(*by, "__span").agg(newest.alias("__end"))
    spans = l.select(*by, "__span").distinct().withColumn("__side", F.lit(0))
    earlier = Window.partitionBy(*by).orderBy("__span", F.col("__side").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a span's end comes after its rows
    carried = spans.unionByName(ends, allowMissingColumns=True).withColumn("__value", F.last("__end", ignorenulls=True).over(earlier))
    carried = carried.where("__side = 0").select(*by, "__span", "__side", "__value")

    w = Window.partitionBy(*by, "__span").orderBy("__side_first", "__ts", "__side", F.col("__value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    both = both.withColumn("__side_first", F.col("__side") > 0).withColumn("__last", F.last("__value", ignorenulls=True).over(w))
    out = both.where("__side = 2").select("__row.*", F.col("__last").alias(value))
    return out.withColumn(value, F.coalesce(value, default)) if default is not None else out


def interval_join(df: DataFrame, events: DataFrame, key: str, day: str, event_day: str, after: int, how: str = "left_semi") -> DataFrame:
    """Rows with (left_semi) or without (left_anti) an event of the key on one of the days day .. day + after.

    Days are discrete: every event stands for the rows it can match (after + 1 of them), so the
    join is an equi-join on key and day.
    """
    reach = events.select(F.col(key), F.explode(F.sequence(F.date_sub(event_day, after), F.col(event_day))).alias("__day")).distinct()
    cond = (df[key] == reach[key]) & (df[day] == reach["__day"])
    return df.join(reach, cond, how)


def flag_interval(df: DataFrame, events: DataFrame, key: str, day: str, event_day: str, after: int, alias: str) -> DataFrame:
    """df with a flag: whether the key has an event on one of the days day .. day + after."""
    reach = events.select(F.col(key), F.explode(F.sequence(F.date_sub(event_day, after), F.col(event_day))).alias(day)).distinct().withColumn(alias, F.lit(True))
    return df.join(reach, [key, day], "left").withColumn(alias, F.coalesce(alias, F.lit(False)))


def containing(left: DataFrame, items: str, right: DataFrame, key: str, keep: list[str], collected: str) -> DataFrame:
    """For every left row, the keys of right that stand in its array, sorted."""
    hits = left.select(*keep, F.explode(items).alias(key)).distinct().join(right.select(key).distinct(), key)
    return hits.groupBy(*keep).agg(F.sort_array(F.collect_list(key)).alias(collected))


def grid(rows: DataFrame, days: DataFrame) -> DataFrame:
    """All pairs of rows (users) and days; days is a calendar, bounded by the study's length."""
    return rows.crossJoin(F.broadcast(days))


def calendar(spark, start: str, end: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Days from start to end, both included, without those excluded."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.where(~F.col("day").isin([F.lit(x).cast("date") for x in exclude])) if exclude else days


def unique_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """df, of which the job fails if two rows agree on the keys; one shuffle by them."""
    w = Window.partitionBy(*on)
    wrong = F.raise_error(F.concat(F.lit("more than one row of "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on])))
    return df.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.when(F.col("__n") > 1, wrong).otherwise(F.lit(True))).drop("__n")


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", fills: dict[str, object] | None = None) -> DataFrame:
    """A join that fails the job unless the keys are unique on both sides; so rows never multiply."""
    out = unique_keys(left, on).join(unique_keys(right, on), on, how)
    return out.fillna(fills) if fills else out


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows for which SQL's NOT IN is true: none if other holds a null, all if it is empty.

    Nulls are counted first, and the rest is a plain anti join, which may shuffle; the join for
    NOT IN that an engine would choose sends all of other to every task.
    """
    seen = other.agg(F.count("*").alias("__all"), F.count_if(F.col(other_key).isNull()).alias("__nulls"))
    may = df.crossJoin(F.broadcast(seen)).where("__nulls = 0").where(F.col(key).isNotNull() | (F.col("__all") == 0)).drop("__all", "__nulls")
    keys = other.select(F.col(other_key).alias("__key")).where("__key is not null").distinct()
    return may.join(keys, F.col(key) == F.col("__key"), "left_anti")


def fill_grid(cells: DataFrame, values: DataFrame, on: list[str], fills: dict[str, object]) -> DataFrame:
    """Left join of values onto the grid, gaps filled; values must have one row a cell."""
    return cells.join(values, on, "left").fillna(fills)
