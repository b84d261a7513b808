"""Statistics: moments and ranks in Spark, distribution functions of a few numbers apart."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.scratch import materialize


def counted_values(df: DataFrame, column: str, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """by, column, __n and __before: every value that is not null, how often it comes, and the rows before it.

    Equal values are combined first, so they never meet in one task; values are then sorted over
    as many ranges as the session shuffles to (or buckets), and sums by range place each range after the others.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    placed = materialize(counts.repartitionByRange(*([buckets] if buckets else []), *by, column).withColumn("__range", F.spark_partition_id()), "values")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = placed.groupBy(*by, "__range").agg(F.sum("__n").alias("__sum"))
    ranges = ranges.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__first"))
    w = Window.partitionBy(*by, "__range").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = [F.col("__range") == F.col("__of"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]]
    out = placed.withColumn("__upto", F.sum("__n").over(w)).join(ranges, on)
    return out.select(*by, column, "__n", (F.col("__first") + F.col("__upto") - F.col("__n")).alias("__before"))


def average_ranks(df: DataFrame, column: str, alias: str, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """df with the rank of a numeric column, ties sharing their mean rank."""
    by = by or []
    ranks = counted_values(df, column, by, buckets).select(*by, column, (F.col("__before") + (F.col("__n") + 1) / 2).alias(alias))
    return df.join(ranks, [*by, column])


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pearson, spearman, n and the means, over rows with both; zeros if there are none."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    ranked = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return ranked.agg(zero(F.corr("x", "y")).alias("pearson"), zero(F.corr("rx", "ry")).alias("spearman"), F.count("*").alias("n"), zero(F.avg("x")).alias("mean_x"), zero(F.avg("y")).alias("mean_y"))


def percentiles(df: DataFrame, column: str, at: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation; the values of a group never meet in one task."""
    by = by or []
    values = counted_values(df.select(*by, F.col(column).cast("double").alias(column)), column, by)
    total = df.groupBy(*by).agg(F.count(column).alias("__all"))
    if by:
        total = total.withColumnsRenamed({c: f"__{c}" for c in by})
        joined = values.join(total, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    else:
        joined = values.crossJoin(F.broadcast(total))

    def value_at(place: Column) -> Column:
        return F.max(F.when((F.col("__before") <= place) & (place < F.col("__before") + F.col("__n")), F.col(column)))

    ends = []
    for k, p in enumerate(at.values()):
        place = (F.col("__all") - 1) * F.lit(float(p))
        ends += [value_at(F.floor(place)).alias(f"__low{k}"), value_at(F.ceil(place)).alias(f"__high{k}"), F.first(place - F.floor(place)).alias(f"__part{k}")]
    found = joined.groupBy(*by).agg(*ends)
    return found.select(*by, *[(F.col(f"__low{k}") + F.col(f"__part{k}") * (F.col(f"__high{k}") - F.col(f"__low{k}"))).alias(a) for k, a in enumerate(at)])


def five_numbers(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return percentiles(df, column, {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}, by)


def without_outliers(df: DataFrame, column: str, times: float = 1.5) -> DataFrame:
    """Rows within times the interquartile range of the quartiles."""
    q = percentiles(df, column, {"__q1": 0.25, "__q3": 0.75})
    spread = times * (F.col("__q3") - F.col("__q1"))
    return df.crossJoin(F.broadcast(q)).where(F.col(column).between(F.col("__q1") - spread, F.col("__q3") + spread)).drop("__q1", "__q3")


def over_percentile(df: DataFrame, column: str, p: float) -> DataFrame:
    q = percentiles(df, column, {"__q": p})
    return df.crossJoin(F.broadcast(q)).where(F.col(column) >= F.col("__q")).drop("__q")


def mean_intervals(df: DataFrame, value: str, by: list[str], share: float = 0.95) -> DataFrame:
    """n, mean, sd, and low and high of the t interval of the mean, by group (null for single rows).

    The t quantiles are looked up by the distinct group sizes, of which there are few.
    """
    m = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        known = {k: t_quantile(share, k - 1) if k > 1 else float("nan") for k in n.unique()}
        return n.map(known)

    half = F.nullif(quantile("n"), F.lit(float("nan"))) * F.col("sd") / F.sqrt("n")
    return m.withColumn("__half", half).select(*by, "n", "mean", "sd", (F.col("mean") - F.col("__half")).alias("low"), (F.col("mean") + F.col("__half")).alias("high"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, median and sample deviation, as printed beside a histogram."""
    middle = percentiles(df, column, {"median": 0.5})
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd")).crossJoin(F.broadcast(middle))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, low, high and n of equal bins from least to greatest; the last bin is closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    placed = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col(column) - F.col("lo")) / width), F.lit(0))).cast("int"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(ends)).select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("low"), (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("high"), "n")


def summary(df: DataFrame, columns: list[str], by: list[str], digits: int = 4) -> DataFrame:
    """Mean, sample deviation (0 for one row) and count."""
    out = []
    for c in columns:
        out += [F.round(F.avg(c), digits).alias(f"{c}_mean"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), digits).alias(f"{c}_std"), F.count(c).alias(f"{c}_count")]
    return df.groupBy(*by).agg(*out)


# ---- distribution functions ----------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    return beta_cdf(dof / (dof + t * t), dof / 2, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def t_quantile(p: float, dof: float) -> float:
    """Two-sided: the t with probability p between -t and t."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, dof) < p else (lo, mid)
    return lo


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


def chi_square_upper(x: float, dof: float) -> float:
    """The chance that a chi-square variable exceeds x."""
    return gamma_upper(dof / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def two_samples(df: DataFrame, value: str, group: Column) -> dict[str, float]:
    """Welch and pooled t, their p, 95% interval of the difference, Cohen's d, Levene, Mann-Whitney.

    group is true for the second sample. All moments and rank sums are aggregates over df.
    """
    d = df.select(F.col(value).cast("double").alias("x"), group.alias("g")).where("x is not null and g is not null")
    centre = percentiles(d, "x", {"m": 0.5}, ["g"])
    ranked = average_ranks(d, "x", "r").join(F.broadcast(centre), "g").withColumn("z", F.abs(F.col("x") - F.col("m")))
    rows = {r["g"]: r for r in ranked.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.sum("r").alias("ranks"), F.avg("z").alias("zmean"), F.var_pop("z").alias("zvar")).collect()}
    if len(rows) < 2:
        return {}
    a, b = rows[False], rows[True]
    n1, n2 = a["n"], b["n"]
    diff, v1, v2 = a["mean"] - b["mean"], (a["var"] or 0.0) / n1, (b["var"] or 0.0) / n2
    pooled = ((n1 - 1) * (a["var"] or 0.0) + (n2 - 1) * (b["var"] or 0.0)) / max(1, n1 + n2 - 2)
    out = {"n_a": n1, "n_b": n2, "mean_a": a["mean"], "mean_b": b["mean"], "cohens_d": diff / math.sqrt(pooled) if pooled else 0.0}
    if v1 + v2:
        dof = (v1 + v2) ** 2 / ((v1**2 / (n1 - 1) if n1 > 1 else 0) + (v2**2 / (n2 - 1) if n2 > 1 else 0))
        half = t_quantile(0.95, dof) * math.sqrt(v1 + v2)
        t = diff / math.sqrt(pooled * (1 / n1 + 1 / n2))
        w = diff / math.sqrt(v1 + v2)
        out |= {"t": t, "t_p": t_two_sided(t, n1 + n2 - 2), "welch_t": w, "welch_p": t_two_sided(w, dof), "low": diff - half, "high": diff + half}
    zbar = (n1 * a["zmean"] + n2 * b["zmean"]) / (n1 + n2)
    within = n1 * a["zvar"] + n2 * b["zvar"]
    if within:
        f = (n1 + n2 - 2) * (n1 * (a["zmean"] - zbar) ** 2 + n2 * (b["zmean"] - zbar) ** 2) / within
        out |= {"levene": f, "levene_p": f_upper(f, 1, n1 + n2 - 2)}
    u = a["ranks"] - n1 * (n1 + 1) / 2
    ties = d.groupBy("x").agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.pow("c", 3) - F.col("c"))).first()[0] or 0.0
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) if n > 1 else 0.0
    out |= {"mann_whitney_u": u, "mann_whitney_p": min(1.0, normal_two_sided(max(0.0, abs(u - n1 * n2 / 2) - 0.5) / sigma)) if sigma else 1.0}
    return out


#: Rational approximation of the normal quantile (algorithm AS 241): near the middle, in the tails, far out.
_MIDDLE = ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727), (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610))
_TAIL = ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640), (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9))
_FAR = ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7), (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))
#: The weights' and the p-value's polynomials of the Shapiro-Wilk test (algorithm AS R94).
_LAST, _LAST_BUT_ONE = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL = ((-2.273, 0.459), (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322))
_LARGE = ((-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302))


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The z below which a standard normal variable falls with probability p; null outside (0, 1)."""
    q = p - 0.5
    ratio = lambda x, parts: polynomial(x, parts[0]) / polynomial(x, parts[1])
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(r <= 5, ratio(r - 1.6, _TAIL)).otherwise(ratio(r - 5, _FAR)) * F.signum(q)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio(0.180625 - q * q, _MIDDLE)).otherwise(outer))


def shapiro_wilk(df: DataFrame, value: str, by: list[str] | None = None, chunk: int = 10_000) -> DataFrame:
    """by, n, w and z of the test for a normal distribution; ``normal_upper(z)`` is its p.

    Weights belong to places in the order, which come from counted values: equal values are one row with
    its first place, and its places are taken apart ``chunk`` at a time where their weights are summed.
    Groups of fewer than three values, or of one value only, have null w and z; for three values z is null.
    """
    by = by or []
    values = counted_values(df.select(*by, F.col(value).cast("double").alias("x")).where("not isnan(x)"), "x", by)
    values = materialize(values, "order")
    moments = values.groupBy(*by).agg(F.sum("__n").alias("n"), (F.sum(F.col("x") * F.col("__n")) / F.sum("__n")).alias("mean"))
    moments = moments.select(*[F.col(c).alias(f"__{c}") for c in by], "n", "mean")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    rows = (values.join(moments, on) if by else values.crossJoin(F.broadcast(moments))).withColumn("d", F.col("x") - F.col("mean"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / chunk)))
    rows = rows.withColumn("c", chunks).withColumn("take", F.least(F.lit(chunk).cast("long"), F.col("__n") - F.col("c") * chunk))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("take")))).withColumn("place", F.col("k") + F.col("__before") + F.col("c") * chunk)
    rows = rows.withColumn("m", normal_quantile((F.col("place") - 0.375) / (F.col("n") + 0.25)))
    end = lambda c, k: F.max(F.when(F.col("place") == (k if k > 0 else F.col("n") + 1 + k), F.col(c)))
    g = rows.groupBy(*by, "n").agg(F.sum(F.col("d") * F.col("d")).alias("ss"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("d")).alias("md"), end("m", -1).alias("m1"), end("m", -2).alias("m2"), (end("d", -1) - end("d", 1)).alias("d1"), (end("d", -2) - end("d", 2)).alias("d2"))
    n, u, root = F.col("n"), 1 / F.sqrt("n"), F.sqrt("mm")
    a1 = F.when(n == 3, math.sqrt(0.5)).otherwise(F.col("m1") / root + polynomial(u, _LAST))
    a2 = F.col("m2") / root + polynomial(u, _LAST_BUT_ONE)
    g = g.withColumns({"a1": a1, "a2": F.when(n > 5, a2)})
    phi = F.when(n > 5, (F.col("mm") - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2) / (1 - 2 * F.col("a1") ** 2 - 2 * F.col("a2") ** 2)).otherwise((F.col("mm") - 2 * F.col("m1") ** 2) / (1 - 2 * F.col("a1") ** 2))
    inner = F.when(n > 5, F.col("md") - F.col("m1") * F.col("d1") - F.col("m2") * F.col("d2")).otherwise(F.col("md") - F.col("m1") * F.col("d1"))
    total = F.when(n == 3, F.col("a1") * F.col("d1")).when(n > 5, inner / F.sqrt(phi) + F.col("a1") * F.col("d1") + F.col("a2") * F.col("d2")).otherwise(inner / F.sqrt(phi) + F.col("a1") * F.col("d1"))
    g = g.withColumn("w", F.when((n >= 3) & (F.col("ss") > 0), F.least(F.lit(1.0), total * total / F.col("ss"))))
    few = (-F.log(polynomial(n.cast("double"), _SMALL[0]) - F.log(1 - F.col("w"))) - polynomial(n.cast("double"), _SMALL[1])) / F.exp(polynomial(n.cast("double"), _SMALL[2]))
    many = (F.log(1 - F.col("w")) - polynomial(F.log("n"), _LARGE[0])) / F.exp(polynomial(F.log("n"), _LARGE[1]))
    return g.select(*by, "n", "w", F.when(n >= 12, many).when(n >= 4, few).alias("z"))


def normal_upper(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2
