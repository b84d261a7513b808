"""Partitioned storage of datasets: write, read with pruning, compact, repartition, delete, back up.

Layout: {root}/{dataset}/tier={cache|active}/partition_date={day}/*.parquet. Everything goes
through Spark's readers and writers, so any file system that Spark knows will do.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import time as TM
from tidewater.operators.sets import same_rows
from tidewater.operators.windows import first_n, latest
from tidewater.sources.catalog import Dataset, coerce, without_artefacts

TIERS = ("cache", "active")
DEFAULT_LOOKBACK_DAYS = 2
#: Spellings of null in CSV results (fixed values).
NULL_TOKENS = ("", "NULL", "null", "None", "NaN", "nan", "N/A", "NA")


def tier(day: Column, today: str, lookback_days: int = DEFAULT_LOOKBACK_DAYS) -> Column:
    """Days within the lookback are active, older ones are cache."""
    return F.when(day >= F.date_format(F.date_sub(F.lit(today).cast("date"), lookback_days), "yyyy-MM-dd"), "active").otherwise("cache")


def with_partition_date(df: DataFrame, ts: str | None) -> DataFrame:
    """partition_date from the time column; the default date where it is missing or implausible."""
    if ts is None or ts not in df.columns:
        return df.withColumn("partition_date", F.lit(TM.DEFAULT_PARTITION_DATE))
    return df.withColumn("partition_date", TM.partition_date(F.col(ts).cast("string")))


def write(df: DataFrame, root: str, dataset: Dataset, today: str, mode: str = "append", fmt: str = "parquet", extra: tuple[str, ...] = ()) -> None:
    """Typed and partitioned; rows are brought together by day, a large day in as many tasks as its bytes ask for."""
    out = coerce(with_partition_date(df, dataset.ts), dataset.with_partition)
    out = out.withColumn("tier", tier(F.col("partition_date"), today))
    keys = ["tier", *extra, "partition_date"]
    out.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).format(fmt).save(f"{root}/{dataset.name}")


def one_day(df: DataFrame, day: str = "partition_date") -> DataFrame:
    """df, of which the job fails if its partition date is null somewhere or not the same everywhere."""
    seen = df.agg(F.count_if(F.col(day).isNull()).alias("__nulls"), F.min(day).alias("__a"), F.max(day).alias("__e"))
    fine = F.when((F.col("__nulls") > 0) | (F.col("__a") != F.col("__e")), F.raise_error(F.lit("a batch must have one partition date"))).otherwise(F.lit(True))
    return df.crossJoin(F.broadcast(seen)).where(fine).drop("__nulls", "__a", "__e")


def read_files(spark: SparkSession, files: list[str], columns: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The files' rows with the declared columns; an empty table for no files."""
    return spark.read.schema(columns).format(fmt).load(files) if files else spark.createDataFrame([], columns)


def days_between(start: str, end: str, max_days: int = 366) -> list[str]:
    """The days of a range, no more than max_days of them."""
    a, e = date.fromisoformat(start), date.fromisoformat(end)
    if e < a or (e - a).days >= max_days:
        raise ValueError(f"a range must have from one to {max_days} days")
    return [(a + timedelta(days=k)).isoformat() for k in range((e - a).days + 1)]


def read(spark: SparkSession, root: str, dataset: Dataset, tiers: tuple[str, ...] = TIERS, day: str | None = None, start: str | None = None, end: str | None = None, since: str | None = None, fmt: str = "parquet", tolerant: bool = False) -> DataFrame:
    """One day or a range of days of some tiers; partition filters prune, ``since`` compares strings."""
    if day is not None and (start is not None or end is not None):
        raise ValueError("give a day or a range of days")
    if (start is None) != (end is None):
        raise ValueError("a range needs both ends")
    declared = T.StructType([*dataset.with_partition, T.StructField("tier", T.StringType())])
    reader = spark.read.schema(declared).format(fmt)
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true")
    df = reader.load(f"{root}/{dataset.name}").where(F.col("tier").isin(*tiers))
    if day is not None:
        df = df.where(F.col("partition_date") == day)
    if start is not None:
        df = df.where(F.col("partition_date").between(start, end))
    if since is not None and dataset.ts:
        df = df.where(F.col(dataset.ts) >= since)
    return without_artefacts(df)


def latest_per_source(df: DataFrame, ts: str, source: str = "source", n: int | None = None, newest_first: bool = True) -> DataFrame:
    if n is None:
        return df
    return first_n(df, [source], [F.desc(ts) if newest_first else F.asc(ts), F.col("uri")], n)


def compact(spark: SparkSession, root: str, dataset: Dataset, target: str, today: str, since: str | None = None) -> None:
    """All tiers, the newest row of each key only, rewritten below target with tiers set anew."""
    df = read(spark, root, dataset)
    if dataset.key and dataset.deduplicate:
        df = latest(df, dataset.key, dataset.ts, "partition_date", since=since)
    write(df, target, dataset, today, "overwrite")


def repartition_by(spark: SparkSession, root: str, dataset: Dataset, ts: str, target: str, today: str) -> bool:
    """A copy partitioned by another time column; whether it holds the same rows."""
    old = read(spark, root, dataset)
    moved = Dataset(dataset.name, dataset.ddl, dataset.key, ts, dataset.deduplicate)
    write(old.drop("partition_date", "tier"), target, moved, today, "overwrite")
    return same_rows(old.drop("partition_date", "tier"), read(spark, target, moved).drop("partition_date", "tier"))


def delete(spark: SparkSession, root: str, dataset: Dataset, target: str, day: str) -> None:
    """A copy without one day; callers swap folders, so readers never see half a delete."""
    read(spark, root, dataset).where(F.col("partition_date") != day).write.mode("overwrite").partitionBy("tier", "partition_date").parquet(f"{target}/{dataset.name}")


def backup(spark: SparkSession, source: str, target: str, overwrite: bool = False, fmt: str = "parquet", partitions: tuple[str, ...] = ("tier", "partition_date")) -> None:
    """A copy with the same folders; partition columns that source lacks are passed over."""
    df = spark.read.format(fmt).load(source)
    keys = [c for c in partitions if c in df.columns]
    df = df.withColumns({c: F.col(c).cast("string") for c in keys}) if keys else df
    out = df.write.mode("overwrite" if overwrite else "errorifexists").format(fmt)
    (out.partitionBy(*keys) if keys else out).save(target)


def newest_files(df: DataFrame, keep: int) -> DataFrame:
    """path, modified and tier of a table's files: the newest ``keep`` of a folder are active, others cache."""
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")).distinct()
    files = files.withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))
    newest = first_n(files, ["folder"], [F.desc("modified"), F.desc("path")], keep).select("path").withColumn("tier", F.lit("active"))
    return files.join(newest, "path", "left").select("path", "modified", F.coalesce("tier", F.lit("cache")).alias("tier"))


def after(df: DataFrame, year: int, month: int, day: int, hour: int, minute: int) -> DataFrame:
    """Rows of partitions strictly after a time, for tables partitioned by year/month/day/hour/minute."""
    parts = ("year", "month", "day", "hour", "minute")
    return df.where(F.struct(*[F.col(c).cast("int") for c in parts]) > F.struct(*[F.lit(x) for x in (year, month, day, hour, minute)]))


def read_results(spark: SparkSession, path: str, columns: T.StructType, tolerant: bool = True) -> DataFrame:
    """CSV results with the spellings of null made null."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in columns])
    df = spark.read.schema(raw).option("header", "true").option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").csv(path)
    return df.select(*[F.when(~F.coalesce(F.trim(f.name), F.lit("")).isin(*NULL_TOKENS), F.col(f.name)).cast(f.dataType).alias(f.name) for f in columns])


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
