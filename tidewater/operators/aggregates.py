"""Aggregations: conditional, weighted, in two stages, over slices, pivoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_means(df: DataFrame, by: list[str], values: dict[str, str], order: str, first: str) -> DataFrame:
    """Means and counts by group, and the value of ``first`` in the earliest row."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(a) for a, c in values.items()], F.count("*").alias("n"), F.min_by(first, order).alias(f"first_{first}"))


def weighted_mean(df: DataFrame, by: list[str], values: list[str], weight: str) -> DataFrame:
    """Means weighted by the weight, over rows with a value, and the total weight."""
    means = [F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))).alias(c) for c in values]
    return df.groupBy(*by).agg(*means, F.sum(weight).alias(weight))


def at_least(df: DataFrame, key: str, threshold: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def mean_of_means(df: DataFrame, inner: list[str], outer: list[str], values: list[str], digits: int = 3, outer_digits: int | None = None) -> DataFrame:
    """Unweighted means, by outer, of rounded means by inner."""
    daily = df.groupBy(*inner).agg(*[F.round(F.avg(c), digits).alias(c) for c in values])
    return daily.groupBy(*outer).agg(*[F.round(F.avg(c), digits if outer_digits is None else outer_digits).alias(c) for c in values])


def matrix(df: DataFrame, by: list[str], value: Column, conditions: dict[str, Column]) -> DataFrame:
    """Mean of value under each condition, one column each, in one pass."""
    return df.groupBy(*by).agg(*[F.avg(F.when(c, value)).alias(a) for a, c in conditions.items()])


def typed(df: DataFrame, by: list[str], numeric: list[str], categorical: list[str]) -> DataFrame:
    """Means of numbers, and the smallest mode of categories."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numeric], *[F.mode(c, True).alias(c) for c in categorical])


def over_slices(df: DataFrame, slices: list[list[str]], key: str, count: Column | None = None) -> DataFrame:
    """Counts of key in every slice at once; columns outside a slice are null."""
    columns = list(dict.fromkeys(c for s in slices for c in s))
    sets = [[F.col(c) for c in [*s, key]] for s in slices]
    return df.groupingSets(sets, *columns, key).agg((count if count is not None else F.count("*")).alias("n"), F.grouping_id().alias("slice"))


def by_type(df: DataFrame, by: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Counts by kind, one column each, 0 where there is none."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def overlap(df: DataFrame, key: str, group: str, a: str, b: str) -> DataFrame:
    """Distinct keys of groups a and b, of both, and the shares of the overlap."""
    flags = df.groupBy(key).agg(F.max((F.col(group) == a).cast("int")).alias("in_a"), F.max((F.col(group) == b).cast("int")).alias("in_b"))
    out = flags.agg(F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"), F.sum(F.col("in_a") * F.col("in_b")).alias("n_both"))
    return out.select("*", F.round(F.try_divide("n_both", "n_a"), 3).alias("share_of_a"), F.round(F.try_divide("n_both", "n_b"), 3).alias("share_of_b"))


def prevalence(df: DataFrame, columns: list[str], bounds: tuple[float, ...] = (1.0, 5.0, 20.0), names: tuple[str, ...] = ("rare", "low", "medium", "high")) -> DataFrame:
    """Per column of a one-row table of shares: percent (null as 0, one digit) and its category."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    out = df.selectExpr(f"stack({len(columns)}, {pairs}) as (label, share)")
    pct = F.round(F.coalesce("share", F.lit(0.0)) * 100, 1)
    kind = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names, strict=False))):
        kind = F.when(F.col("percent") < bound, name).otherwise(kind)
    return out.select("label", pct.alias("percent")).withColumn("category", kind)


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """One row: the component-wise mean, as an array; partial sums combine before the shuffle."""
    parts = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    return parts.agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select(F.transform("v", lambda s: s["x"]).alias("mean"))
