"""Study users: repair of handles, waves, weeks, feeds by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lookup(values: dict[str, str], key: Column) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def repair(df: DataFrame, handle: str, fixes: dict[str, str], excluded: tuple[str, ...] = (), wave: str | None = None, duplicate_waves: dict[str, str] | None = None) -> DataFrame:
    """Handles corrected, excluded users gone, and of users in two waves the wave that does not count."""
    df = df.withColumn(handle, F.coalesce(_lookup(fixes, F.col(handle)), F.col(handle)))
    if excluded:
        df = df.where(~F.col(handle).isin(*excluded))
    if wave is not None and duplicate_waves:
        df = df.where(~F.coalesce(_lookup(duplicate_waves, F.col(handle)) == F.col(wave).cast("string"), F.lit(False)))
    return df


def static_week(df: DataFrame, day: str, wave: str, ends: dict[str, list[str]]) -> DataFrame:
    """Number of the first week end of the user's wave that is not before the day; null past the last."""
    from tidewater.functions.time import first_threshold

    week = F.lit(None).cast("int")
    for name, days in ends.items():
        week = F.when(F.col(wave) == name, first_threshold(F.col(day), F.array(*[F.lit(d).cast("date") for d in days]))).otherwise(week)
    return df.withColumn("week", week)


def impute_feeds(sessions: DataFrame, feeds: DataFrame, marker: str = "backfill") -> DataFrame:
    """The default feed of the session's feed_id, for sessions whose cursor is the marker."""
    default = feeds.where("user = 'default'").groupBy("feed_id").agg(F.max("feed").alias("__feed"))
    needs = F.col("cursor") == marker
    return sessions.join(default, "feed_id", "left").withColumn("feed", F.when(needs, F.col("__feed")).otherwise(F.col("feed"))).drop("__feed")


def topics(df: DataFrame, vector: str, k: int, seed: int = 1, iterations: int = 20) -> DataFrame:
    """df with a topic: k-means on the vectors, as a built-in stand-in for topic models."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="__v", predictionCol="topic").fit(v)
    return model.transform(v).drop("__v")
