"""Rows chosen or marked by their place within a group. Every order is explicit and total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.scratch import materialize


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int = 1, ties: bool = False) -> DataFrame:
    """The first n rows of each group; with ties, all rows that rank so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    place = F.rank() if ties else F.row_number()
    return df.withColumn("__place", place.over(w)).where(F.col("__place") <= n).drop("__place")


def latest(df: DataFrame, key: str | list[str], ts: str, *tie_break: str, since: str | None = None, since_first: bool = False) -> DataFrame:
    """The newest row of each key, nulls last. ``since`` filters after ranking, or before it."""
    keys = [key] if isinstance(key, str) else key
    if since is not None and since_first:
        df = df.where(F.col(ts) >= since)
    out = first_n(df, keys, [F.col(ts).desc_nulls_last(), *[F.col(c) for c in tie_break]])
    return out.where(F.col(ts) >= since) if since is not None and not since_first else out


def numbered(df: DataFrame, order: list[Column], alias: str) -> DataFrame:
    """df numbered from 0 in a total order, sorted over as many ranges as the session shuffles to."""
    placed = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ordered")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = placed.groupBy("__range").agg(F.count("*").alias("__c")).select("__range", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return placed.withColumn("__in", within).join(ranges, "__range").withColumn(alias, F.col("__first") + F.col("__in")).drop("__range", "__first", "__in")


def top_share(df: DataFrame, key: str, share: float) -> DataFrame:
    """The most frequent keys, as many as share of all: key, n, place and total."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    ranked = numbered(counts, [F.desc("n"), F.col(key)], "__place")
    total = counts.agg(F.count("*").alias("total"))
    out = ranked.crossJoin(F.broadcast(total)).where(F.col("__place") < F.floor(F.col("total") * share))
    return out.select(key, "n", (F.col("__place") + 1).cast("int").alias("place"), "total")


def running_cap(df: DataFrame, by: list[str], order: list[Column], flag: Column, cap: int | Column) -> DataFrame:
    """Rows of a walk through each group, without flagged ones past the cap."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__flag", flag.cast("int")).withColumn("__met", F.sum("__flag").over(w)).where((F.col("__flag") == 0) | (F.col("__met") <= cap)).drop("__flag", "__met")


def whole_batches(df: DataFrame, batch: str, cap: int, by: list[str] | None = None) -> DataFrame:
    """Rows of the batches, in order, that fit whole within the cap; a batch that does not fit ends it."""
    by = by or []
    sizes = df.groupBy(*by, batch).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = sizes.withColumn("__sum", F.sum("__n").over(w)).where(F.col("__sum") <= cap).select(*by, batch)
    return df.join(fits, [*by, batch], "left_semi")


def share_in(df: DataFrame, slices: list[str], value: str, alias: str = "share") -> DataFrame:
    return df.withColumn(alias, F.col(value) / F.sum(value).over(Window.partitionBy(*slices)))


def ranked(df: DataFrame, by: list[str], count: str, key: str, alias: str = "place") -> DataFrame:
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(count), F.col(key))))


def rank_changes(before: DataFrame, after: DataFrame, key: str, count: str, top: int, outer: bool = False) -> DataFrame:
    """key, place_before, place_after and change of the keys in both top lists (or in either)."""

    def best(df: DataFrame, name: str) -> DataFrame:
        return df.orderBy(F.desc(count), key).limit(top).withColumn(name, F.row_number().over(Window.orderBy(F.desc(count), key))).select(key, name)

    out = best(before, "place_before").join(best(after, "place_after"), key, "full" if outer else "inner")
    return out.withColumn("change", F.col("place_before") - F.col("place_after"))


def rank_movement(changes: DataFrame, top: int, threshold: int = 2) -> DataFrame:
    """Outer rank changes with absent ranks set to top + 1, and their category."""
    a, b = F.coalesce("place_before", F.lit(top + 1)), F.coalesce("place_after", F.lit(top + 1))
    kind = (
        F.when(F.col("place_before").isNull(), "New")
        .when(F.col("place_after").isNull(), "Dropped")
        .when(F.abs(a - b) < threshold, "No Change")
        .when(a > b, "Improved")
        .otherwise("Declined")
    )
    return changes.withColumn("movement", (a - b).cast("int")).withColumn("category", kind)
