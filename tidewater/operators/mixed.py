"""Linear mixed models with one random intercept, from sums that Spark takes in one pass.

For rows of group g the inverse covariance is I - c(n) 11', with c(n) = theta / (1 + n theta), n the group's
rows and theta the ratio of the two variances. So a fit needs the cross products of all rows, and by size of
group those of the groups' sums; both are aggregates that combine before their shuffle, for all outcomes
together. What reaches the driver has a row for each outcome and size, at most the square root of twice
the rows, of (terms + 1) squared numbers. The profiled likelihood is then a function of theta alone.

Rows without outcome, group or a term take no part in that outcome's fit. Terms that others determine are
dropped, with null estimates. Groups of any size may hold any share of the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.stats import chi_square_upper, normal_two_sided

Z95 = 1.959963984540054


def treatment(column: Column, levels: list, name: str) -> dict[str, Column]:
    """0/1 terms for every level but the first."""
    return {f"{name}[{level}]": (column == F.lit(level)).cast("double") for level in levels[1:]}


def interact(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {f"{x}:{y}": a[x] * b[y] for x in a for y in b}


@dataclass
class Fit:
    outcome: str
    terms: list[str]
    beta: dict[str, float | None]
    covariance: np.ndarray  # of the kept terms
    kept: list[str]
    sigma2: float
    tau2: float
    n: int
    groups: int
    reml: float
    ml: float
    parameters: int = field(init=False)

    def __post_init__(self) -> None:
        self.parameters = len(self.kept) + 2

    def se(self, term: str) -> float | None:
        return math.sqrt(self.covariance[self.kept.index(term), self.kept.index(term)]) if term in self.kept else None

    @property
    def aic(self) -> float:
        return -2 * self.reml + 2 * self.parameters

    @property
    def bic(self) -> float:
        return -2 * self.reml + math.log(self.n) * self.parameters

    def contrast(self, weights: dict[str, float]) -> dict[str, float]:
        """Estimate of the weighted sum of coefficients, standard error, 95% interval and p by the normal distribution."""
        w = np.array([weights.get(t, 0.0) for t in self.kept])
        estimate = float(w @ np.array([self.beta[t] for t in self.kept]))
        se = math.sqrt(max(0.0, float(w @ self.covariance @ w)))
        return {"estimate": estimate, "se": se, "low": estimate - Z95 * se, "high": estimate + Z95 * se, "p": normal_two_sided(estimate / se) if se else float("nan")}


def cross_products(df: DataFrame, outcomes: list[str], terms: dict[str, Column], group: Column) -> DataFrame:
    """By outcome and size of group: groups, sums of products of all rows, and of the groups' sums, in order of pairs i <= j."""
    names = [f"z{i}" for i in range(len(terms) + 1)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    ys = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes])).alias("o")
    rows = df.select(group.alias("g"), *[t.cast("double").alias(n) for n, t in zip(names, terms.values(), strict=False)], ys).select("g", "o.outcome", *names[:-1], F.col("o.y").alias(names[-1]))
    rows = rows.where(" and ".join(f"{c} is not null" for c in ("g", *names)) + f" and not isnan({names[-1]})")
    by_group = rows.groupBy("outcome", "g").agg(F.count("*").alias("n"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs])
    return by_group.groupBy("outcome", "n").agg(
        F.count("*").alias("groups"),
        F.array(*[F.sum(f"p{i}_{j}") for i, j in pairs]).alias("rows"),
        F.array(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs]).alias("sums"),
    )


def _square(flat: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = flat
    return out + np.triu(out, 1).T


def _independent(xx: np.ndarray) -> list[int]:
    """Columns that those before them do not determine."""
    left, kept = xx.copy(), []
    for i in range(len(xx)):
        if left[i, i] > 1e-9 * max(xx[i, i], 1e-300):
            kept.append(i)
            left = left - np.outer(left[:, i], left[i]) / left[i, i]
    return kept


class Profile:
    """The likelihood of one outcome as a function of theta."""

    def __init__(self, sizes: np.ndarray, groups: np.ndarray, total: np.ndarray, sums: np.ndarray) -> None:
        self.sizes, self.groups, self.total, self.sums = sizes.astype(float), groups.astype(float), total, sums
        self.n, self.p = int((sizes * groups).sum()), len(total) - 1

    def at(self, theta: float, reml: bool) -> tuple[float, float, np.ndarray, np.ndarray, float]:
        """-2 log likelihood, its slope, coefficients, inverse of X'V^-1 X (over sigma2), and sigma2."""
        one = 1 + self.sizes * theta
        z = self.total - np.tensordot(theta / one, self.sums, 1)
        dz = -np.tensordot(1 / one**2, self.sums, 1)
        a, b, c = z[:-1, :-1], z[:-1, -1], z[-1, -1]
        inverse = np.linalg.inv(a)
        beta = inverse @ b
        rss = max(float(c - b @ beta), 1e-300)
        slope = float(dz[-1, -1] - 2 * beta @ dz[:-1, -1] + beta @ dz[:-1, :-1] @ beta)
        dof = self.n - self.p if reml else self.n
        value = dof * (math.log(2 * math.pi * rss / dof) + 1) + float(self.groups @ np.log(one))
        change = dof * slope / rss + float(self.groups @ (self.sizes / one))
        if reml:
            value += np.linalg.slogdet(a)[1]
            change += float((inverse * dz[:-1, :-1].T).sum())
        return float(value), float(change), beta, inverse, rss / dof

    def best(self, reml: bool) -> float:
        """The theta of the largest likelihood: the best of a grid, then the root of the slope around it."""
        grid = [0.0, *np.exp(np.linspace(-25, 15, 161))]
        values = [self.at(t, reml)[0] for t in grid]
        k = int(np.argmin(values))
        low, high = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
        if k <= 1 and self.at(0.0, reml)[1] >= 0:
            return 0.0
        for _ in range(200):
            mid = (low + high) / 2 if low == 0 or high / low < 1.001 else math.sqrt(low * high)
            low, high = (mid, high) if self.at(mid, reml)[1] < 0 else (low, mid)
        return (low + high) / 2


def fit(df: DataFrame, outcomes: list[str], terms: dict[str, Column], group: Column) -> dict[str, Fit]:
    """outcome ~ terms + (1 | group) for every outcome, by restricted maximum likelihood; an outcome without enough rows is left out."""
    names, k = list(terms), len(terms) + 1
    rows = cross_products(df, outcomes, terms, group).collect()  # a row for each outcome and size of group
    out = {}
    for outcome in outcomes:
        mine = sorted((r for r in rows if r["outcome"] == outcome), key=lambda r: r["n"])
        if not mine:
            continue
        total = _square(np.sum([r["rows"] for r in mine], axis=0), k)
        keep = _independent(total[:-1, :-1])
        at = np.ix_([*keep, k - 1], [*keep, k - 1])
        p = Profile(np.array([r["n"] for r in mine]), np.array([r["groups"] for r in mine]), total[at], np.array([_square(np.array(r["sums"]), k)[at] for r in mine]))
        if p.n <= p.p + 1:
            continue
        theta = p.best(True)
        value, _, beta, inverse, sigma2 = p.at(theta, True)
        kept = [names[i] for i in keep]
        found = dict(zip(kept, map(float, beta), strict=True))
        ml = -0.5 * p.at(p.best(False), False)[0]
        out[outcome] = Fit(outcome, names, {t: found.get(t) for t in names}, sigma2 * inverse, kept, sigma2, theta * sigma2, p.n, int(p.groups.sum()), -0.5 * value, ml)
    return out


def likelihood_ratio(small: Fit, large: Fit) -> dict[str, float]:
    """Twice the difference of log likelihoods (not restricted), terms added, and the chi-square tail."""
    chisq, df = max(0.0, 2 * (large.ml - small.ml)), large.parameters - small.parameters
    return {"chisq": chisq, "df": df, "p": chi_square_upper(chisq, df) if df > 0 else float("nan")}
