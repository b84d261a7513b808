"""Distribution tests and mixed models: published values, and mixed models against the dense likelihood on unbalanced rows, and distribution tails against tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import mixed as M
from tidewater.operators import stats as ST


def test_chi_square_tail():
    # upper 5 %, 1 % and 0.1 % points by degrees of freedom, as printed in tables
    for dof, points in {1: (3.841, 6.635, 10.828), 2: (5.991, 9.210, 13.816), 3: (7.815, 11.345, 16.266), 10: (18.307, 23.209, 29.588), 50: (67.505, 76.154, 86.661)}.items():
        for x, p in zip(points, (0.05, 0.01, 0.001), strict=True):
            assert ST.chi_square_upper(x, dof) == pytest.approx(p, rel=2e-3)
    for x in (1e-9, 0.3, 2.0, 40.0, 700.0):
        assert ST.chi_square_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert ST.chi_square_upper(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)
    assert ST.chi_square_upper(0, 3) == 1


def dense(x, y, groups, theta, reml):
    n, p = x.shape
    v = np.eye(n) + theta * (groups[:, None] == groups[None, :])
    w = np.linalg.inv(v)
    a = x.T @ w @ x
    beta = np.linalg.solve(a, x.T @ w @ y)
    rss = float((y - x @ beta) @ w @ (y - x @ beta))
    dof = n - p if reml else n
    value = dof * (math.log(2 * math.pi * rss / dof) + 1) + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(a)[1] if reml else 0)
    return value, beta, np.linalg.inv(a) * rss / dof, rss / dof


def table(spark, seed, effect):
    rng = np.random.default_rng(seed)
    sizes = [1, 1, 2, 3, 5, 5, 8, 13, 40]
    groups = np.repeat(np.arange(len(sizes)), sizes)
    x = np.column_stack([np.ones(len(groups)), rng.normal(size=len(groups)), groups % 2])
    y = x @ [1.0, 2.0, -1.0] + effect * rng.normal(size=len(sizes))[groups] + rng.normal(size=len(groups))
    z = rng.normal(size=len(groups))
    rows = [(f"g{g}", float(a), float(b), float(v), float(w)) for g, (_, a, b), v, w in zip(groups, x, y, z, strict=True)]
    rows += [(None, 1.0, 1.0, 1.0, 1.0), ("g1", None, 1.0, 1.0, 1.0), ("g1", 1.0, 1.0, None, None), ("g1", 1.0, 1.0, float("nan"), None)]
    return x, y, groups, spark.createDataFrame(rows, "g string, a double, b double, y double, z double")


@pytest.fixture
def terms(spark):
    return {"(Intercept)": F.lit(1.0), "a": F.col("a"), "b": F.col("b")}


@pytest.mark.parametrize("effect", [0.0, 1.5])
def test_fit_is_the_dense_optimum(spark, terms, effect):
    x, y, groups, df = table(spark, 3, effect)
    f = M.fit(df, ["y", "z"], terms | {"twice": F.col("a") * 2 + F.col("b")}, F.col("g"))["y"]
    theta = f.tau2 / f.sigma2
    value, beta, cov, sigma2 = dense(x, y, groups, theta, True)
    assert (f.n, f.groups, f.beta["twice"], f.parameters) == (len(y), 9, None, 5)
    assert -2 * f.reml == pytest.approx(value) and f.sigma2 == pytest.approx(sigma2)
    assert [f.beta[t] for t in terms] == pytest.approx(beta) and [f.se(t) for t in terms] == pytest.approx(np.sqrt(np.diag(cov)))
    for t in [0.0, *np.exp(np.linspace(-8, 4, 200))]:
        assert dense(x, y, groups, t, True)[0] >= value - 1e-8
        assert dense(x, y, groups, t, False)[0] >= -2 * f.ml - 1e-8
    c = f.contrast({"a": 1.0, "b": -1.0})
    assert c["estimate"] == pytest.approx(beta[1] - beta[2]) and c["se"] == pytest.approx(math.sqrt(cov[1, 1] + cov[2, 2] - 2 * cov[1, 2]))
    assert c["p"] == pytest.approx(math.erfc(abs(c["estimate"] / c["se"]) / math.sqrt(2)))


def test_comparison(spark, terms):
    _, _, _, df = table(spark, 4, 1.0)
    small, large = (M.fit(df, ["y"], {k: terms[k] for k in names}, F.col("g"))["y"] for names in (["(Intercept)"], ["(Intercept)", "a"]))
    test = M.likelihood_ratio(small, large)
    assert test["df"] == 1 and test["chisq"] > 20 and test["p"] < 1e-5
    assert large.aic == pytest.approx(-2 * large.reml + 8) and large.bic == pytest.approx(-2 * large.reml + 4 * math.log(large.n))
    assert M.fit(df.where("false"), ["y"], terms, F.col("g")) == {}


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-300, 1e-20, 1e-9, 0.01, 0.074, 0.076, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select(ST.normal_quantile(F.col("p"))).collect()
    assert [r[0] for r in got[:-2]] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-15)
    assert [r[0] for r in got[-2:]] == [None, None]


def test_shapiro_wilk(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # published: W 0.7888, p 0.0067
    miles = [21.0, 21.0, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26.0, 30.4, 15.8, 19.7, 15.0, 21.4]  # W 0.94756, p 0.1229
    rows = [(g, float(v)) for g, vs in {"w": weights, "m": miles, "two": [1, 2], "same": [3] * 9, "three": [1, 2, 4], "four": [1, 2, 3, 10], None: [1, 2, 3, 4, 5.5]}.items() for v in vs] + [("w", None), ("w", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    for chunk in (10_000, 2):
        got = {r["g"]: r for r in ST.shapiro_wilk(df, "v", ["g"], chunk).collect()}
        assert got["w"]["w"] == pytest.approx(0.788815, abs=2e-5) and ST.normal_upper(got["w"]["z"]) == pytest.approx(0.0067038, rel=1e-3)
        assert got["m"]["w"] == pytest.approx(0.94756, abs=1e-5) and ST.normal_upper(got["m"]["z"]) == pytest.approx(0.1229, abs=5e-5)
        assert got["two"]["w"] is None and got["same"]["w"] is None and got["three"]["w"] == pytest.approx(0.5 * 9 / (14 / 3), rel=1e-9)
        assert 0.6 < got["four"]["w"] < 0.85 and got[None]["n"] == 5 and got[None]["w"] > 0.95
