"""What a query costs: its plan, its observed rows, its time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """df with a row count (and more aggregates) gathered while it runs; no second pass."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *metrics), o


def plan_of(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def profile(df: DataFrame, action: Callable[[DataFrame], object] | None = None) -> dict[str, object]:
    """Runs the query once: seconds, rows and the physical plan."""
    watched, o = observed(df, "profile")
    began = time.perf_counter()
    if action is None:
        watched.write.format("noop").mode("overwrite").save()
    else:
        action(watched)
    return {"seconds": time.perf_counter() - began, "rows": o.get["rows"], "plan": plan_of(df)}
