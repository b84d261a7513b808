"""Registered queries of models: density clusters, and mixed effects over a complete grid of users and days.

The grid is balanced, so that restricted maximum likelihood has a closed form, which the SQL computes from
mean squares between and within users; the Spark side knows nothing of the balance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import valence as V
from tidewater.operators import density as DE
from tidewater.operators import graph as G
from tidewater.operators import joins as J
from tidewater.operators import language as L
from tidewater.operators import mixed as M
from tidewater.operators import stats as ST
from tidewater.operators import text_stats as TS
from tidewater.plans.registry import register, table

POST = "2024-01-16"
_KINDS = ("view", "click", "purchase", "signup", "error")
OUTCOMES = ("n_events", "total", "largest", *(f"n_{k}" for k in _KINDS))
MODELS = ("base", "prepost")


def _user_days(spark: SparkSession, sf: str) -> DataFrame:
    """Eight measures of every user and day of the events, zero where nothing happened."""
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    measures = [F.count("*").alias("n_events"), F.sum("value").alias("total"), F.max("value").alias("largest"), *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in _KINDS]]
    cells = J.grid(e.select("user_id").distinct(), e.select("day").distinct())
    out = J.fill_grid(cells, e.groupBy("user_id", "day").agg(*measures), ["user_id", "day"], dict.fromkeys(OUTCOMES, 0))
    return out.withColumn("post", (F.col("day") >= F.lit(POST).cast("date")).cast("double"))


def _fits(spark: SparkSession, sf: str, outcomes: tuple[str, ...], conditions: int) -> dict[str, dict[str, M.Fit]]:
    df = _user_days(spark, sf)
    one, post = {"(Intercept)": F.lit(1.0)}, {"post": F.col("post")}
    condition = M.treatment(F.col("user_id") % conditions, list(range(conditions)), "condition")
    terms = {"base": one | condition, "prepost": one | condition | post | M.interact(condition, post)}
    return {model: M.fit(df, list(outcomes), terms[model], F.col("user_id")) for model in MODELS}


def _closed(outcomes: tuple[str, ...], conditions: int) -> str:
    """CTEs up to v: by outcome and model, N, U, variances lam and s, and log likelihoods; and c, by outcome and condition."""
    value = {"n_events": "count(e.user_id)", "total": "coalesce(sum(value), 0)", "largest": "coalesce(max(value), 0)"} | {f"n_{k}": f"count(e.user_id) FILTER (event_type = '{k}')" for k in _KINDS}
    return f"""
WITH g AS (SELECT u.user_id, d.day, {", ".join(f"({value[o]})::DOUBLE AS {o}" for o in outcomes)} FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT ts::DATE AS day FROM events) d LEFT JOIN events e ON e.user_id = u.user_id AND e.ts::DATE = d.day GROUP BY 1, 2),
l AS (UNPIVOT (SELECT user_id, user_id % {conditions} AS cond, day >= DATE '{POST}' AS post, {", ".join(outcomes)} FROM g) ON {", ".join(outcomes)} INTO NAME outcome VALUE y),
u AS (SELECT outcome, cond, user_id, avg(y) AS m, avg(y) FILTER (post) AS mp, avg(y) FILTER (NOT post) AS mq, count(*) AS n, count(*) FILTER (post) AS n1, var_pop(y) * count(*) AS w FROM l GROUP BY ALL),
c AS (SELECT outcome, cond, avg(m) AS m, avg(mp) AS p, avg(mq) AS q, count(*) AS uc, any_value(n) AS n, any_value(n1) AS n1, any_value(n) - any_value(n1) AS n0, var_pop(m) * count(*) * any_value(n) AS ssb, sum(w) AS ssw FROM u GROUP BY ALL),
t AS (SELECT outcome, unnest(['base', 'prepost']) AS model, unnest([sum(ssw), sum(ssw) - sum(uc * n0 * n1 / n * (p - q) * (p - q))]) AS ssw, unnest([sum(ln(uc * n)), sum(ln(uc * n0) + ln(uc * n1))]) AS xx, unnest([1, 2]) * count(*) AS k, sum(ssb) AS ssb, sum(uc) AS u, count(*) AS c, any_value(n) AS n, sum(uc) * any_value(n) AS total FROM c GROUP BY 1),
r AS (SELECT *, total - u - (k - c) AS dw, ssb / (u - c) AS lr, ssw / (total - u - (k - c)) AS sr, ssb / u AS lm, ssw / (total - u) AS sm FROM t),
s AS (SELECT *, CASE WHEN lr < sr THEN (ssb + ssw) / (u - c + dw) ELSE lr END AS lam, CASE WHEN lr < sr THEN (ssb + ssw) / (u - c + dw) ELSE sr END AS s, CASE WHEN lm < sm THEN (ssb + ssw) / total ELSE lm END AS lml, CASE WHEN lm < sm THEN (ssb + ssw) / total ELSE sm END AS sml FROM r),
v AS (SELECT *, (lam - s) / n AS tau2, -0.5 * ((total - k) * ln(2 * pi()) + (u - c) * ln(lam) + dw * ln(s) + ssb / lam + ssw / s + xx) AS reml, -0.5 * (total * ln(2 * pi()) + u * ln(lml) + (total - u) * ln(sml) + ssb / lml + ssw / sml) AS ml FROM s)"""


@register("stat_mixed_model", _closed(("total",), 3) + """,
a AS (SELECT v.model, v.lam, v.s, v.tau2, c.*, z.m AS zm, z.p AS zp, z.q AS zq, z.uc AS zu FROM v JOIN c USING (outcome) JOIN c z ON z.outcome = c.outcome AND z.cond = 0),
e AS (SELECT model, CASE cond WHEN 0 THEN '(Intercept)' ELSE 'condition[' || cond || ']' END AS term, CASE WHEN cond = 0 THEN m ELSE m - zm END AS estimate, CASE WHEN cond = 0 THEN lam / (uc * n) ELSE lam / n * (1 / uc + 1 / zu) END AS var FROM a WHERE model = 'base'
UNION ALL SELECT model, CASE cond WHEN 0 THEN '(Intercept)' ELSE 'condition[' || cond || ']' END, CASE WHEN cond = 0 THEN q ELSE q - zq END, CASE WHEN cond = 0 THEN (tau2 + s / n0) / uc ELSE (tau2 + s / n0) * (1 / uc + 1 / zu) END FROM a WHERE model = 'prepost'
UNION ALL SELECT model, CASE cond WHEN 0 THEN 'post' ELSE 'condition[' || cond || ']:post' END, CASE WHEN cond = 0 THEN p - q ELSE p - q - zp + zq END, CASE WHEN cond = 0 THEN s * (1 / n0 + 1 / n1) / uc ELSE s * (1 / n0 + 1 / n1) * (1 / uc + 1 / zu) END FROM a WHERE model = 'prepost')
SELECT e.model, term, round(estimate, 6) AS estimate, round(sqrt(var), 6) AS se, round(v.s, 4) AS sigma2, round(v.tau2, 4) AS tau2 FROM e JOIN v ON v.model = e.model""")
def stat_mixed_model(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed effects of three conditions, before and after a date, with a random intercept a user."""
    fits = _fits(spark, sf, ("total",), 3)
    rows = [(model, t, f.beta[t], f.se(t), f.sigma2, f.tau2) for model, found in fits.items() for f in found.values() for t in f.terms]
    out = spark.createDataFrame(rows, "model string, term string, estimate double, se double, sigma2 double, tau2 double")
    return out.withColumns({"estimate": F.round("estimate", 6), "se": F.round("se", 6), "sigma2": F.round("sigma2", 4), "tau2": F.round("tau2", 4)})


@register("stat_mixed_contrasts", _closed(("total",), 3) + """,
w AS (SELECT * FROM (VALUES ('1 vs 0', 1, 0), ('2 vs 0', 2, 0), ('1 vs 2', 1, 2)) x(contrast, i, j)),
e AS (SELECT w.contrast, t.period, CASE t.period WHEN 'pre' THEN x.q - y.q ELSE x.p - y.p END AS estimate, sqrt((v.tau2 + v.s / CASE t.period WHEN 'pre' THEN x.n0 ELSE x.n1 END) * (1 / x.uc + 1 / y.uc)) AS se FROM w JOIN c x ON x.cond = w.i JOIN c y ON y.cond = w.j CROSS JOIN (VALUES ('pre'), ('post')) t(period) JOIN v ON v.model = 'prepost')
SELECT contrast, period, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate - 1.959963984540054 * se, 5) AS low, round(estimate + 1.959963984540054 * se, 5) AS high FROM e""")
def stat_mixed_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of conditions in each period, with their intervals."""
    f = _fits(spark, sf, ("total",), 3)["prepost"]["total"]
    mean = lambda c, post: {"(Intercept)": 1.0, "post": post} | ({f"condition[{c}]": 1.0, f"condition[{c}]:post": post} if c else {})
    rows = []
    for i, j in ((1, 0), (2, 0), (1, 2)):
        for period, post in (("pre", 0.0), ("post", 1.0)):
            a, b = mean(i, post), mean(j, post)
            x = f.contrast({t: a.get(t, 0.0) - b.get(t, 0.0) for t in {*a, *b}})
            rows.append((f"{i} vs {j}", period, x["estimate"], x["se"], x["low"], x["high"]))
    out = spark.createDataFrame(rows, "contrast string, period string, estimate double, se double, low double, high double")
    return out.withColumns({"estimate": F.round("estimate", 6), "se": F.round("se", 6), "low": F.round("low", 5), "high": F.round("high", 5)})


@register("stat_model_comparison", _closed(OUTCOMES, 2) + """,
i AS (SELECT *, -2 * reml + 2 * (k + 2) AS aic, -2 * reml + ln(total) * (k + 2) AS bic, CASE WHEN model = 'prepost' THEN greatest(0, 2 * (ml - min(ml) OVER (PARTITION BY outcome))) END AS chisq FROM v)
SELECT outcome, model, (k + 2)::INT AS df, round(reml, 3) AS loglik, round(aic, 3) AS aic, round(bic, 3) AS bic, round(aic - min(aic) OVER (PARTITION BY outcome), 3) AS delta_aic, round(bic - min(bic) OVER (PARTITION BY outcome), 3) AS delta_bic, round(chisq, 4) AS chisq, round(exp(-chisq / 2), 5) AS p FROM i""")
def stat_model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """With and without the period, for eight outcomes at once: log likelihood, AIC, BIC and the likelihood-ratio test."""
    fits = _fits(spark, sf, OUTCOMES, 2)
    rows = []
    for o in OUTCOMES:
        small, large = (fits[m][o] for m in MODELS)
        test = M.likelihood_ratio(small, large)
        for model, f in zip(MODELS, (small, large), strict=True):
            rows.append((o, model, f.parameters, f.reml, f.aic, f.bic, f.aic - min(small.aic, large.aic), f.bic - min(small.bic, large.bic), test["chisq"] if f is large else None, test["p"] if f is large else None))
    out = spark.createDataFrame(rows, "outcome string, model string, df int, loglik double, aic double, bic double, delta_aic double, delta_bic double, chisq double, p double")
    return out.withColumns({c: F.round(c, 3) for c in ("loglik", "aic", "bic", "delta_aic", "delta_bic")} | {"chisq": F.round("chisq", 4), "p": F.round("p", 5)})


@register("ml_density_clusters")
def ml_density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The density cluster of every vector, -1 for outliers; tests/test_density.py compares with the full matrix."""
    return DE.density_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", 5, 15).select("vec_id", "cluster", F.round("w", 6).alias("w"))


_GRAMS = r"""
WITH w AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, lang, substr(' ' || w || ' ', i, 3) AS gram FROM (SELECT *, unnest(range(1, length(w) + 1)) AS i FROM w)),
p AS (SELECT lang, gram, rank FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS rank FROM g WHERE lang IS NOT NULL GROUP BY 1, 2) WHERE rank <= 300)"""


@register("filter_language_predicted", _GRAMS + """,
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), k AS (SELECT g.doc_id, p.lang, sum(301 - rank) AS s FROM g JOIN p USING (gram) GROUP BY 1, 2),
d AS (SELECT n.doc_id, l.lang, 301 - coalesce(s, 0) / n AS d FROM n CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN k ON k.doc_id = n.doc_id AND k.lang = l.lang)
SELECT doc_id, lang, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(d, 9), lang) AS r FROM d) WHERE r = 1 AND lang IN ('en', 'fr')""")
def filter_language_predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that read as English or French, by trigram profiles of all labelled documents, with the distance."""
    docs = table(spark, sf, "documents")
    found = L.predict(docs, "doc_id", "text", L.profiles(docs, "lang", "text"))
    return found.where(F.col("lang").isin("en", "fr")).select("doc_id", "lang", F.round("distance", 5).alias("distance"))


@register("text_vector_coherence", r"""
WITH d AS (SELECT lang, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+'), lambda x: x <> '')) AS ws, embedding AS v FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang IS NOT NULL),
w AS (SELECT lang, unnest(ws) AS w, v FROM d), t AS (SELECT lang AS topic, w FROM (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS r FROM w GROUP BY 1, 2) WHERE r <= 10),
x AS (SELECT w, i, avg(x) AS x FROM (SELECT w, unnest(range(len(v))) AS i, unnest(v)::DOUBLE AS x FROM w WHERE w IN (SELECT w FROM t)) GROUP BY 1, 2), u AS (SELECT w, i, x / sqrt(sum(x * x) OVER (PARTITION BY w)) AS u FROM x),
c AS (SELECT a.topic, a.w, b.w AS w2, sum(y.u * z.u) AS c FROM t a JOIN t b ON a.topic = b.topic AND a.w < b.w JOIN u y ON y.w = a.w JOIN u z ON z.w = b.w AND z.i = y.i GROUP BY 1, 2, 3)
SELECT t.topic, count(DISTINCT t.w)::BIGINT AS n_words, round(coalesce(any_value(m.c), 0), 6) AS coherence FROM t LEFT JOIN (SELECT topic, avg(c) AS c FROM c GROUP BY 1) m ON m.topic = t.topic GROUP BY 1""")
def text_vector_coherence(spark: SparkSession, sf: str) -> DataFrame:
    """Coherence of the ten words of each language that most documents hold, by the documents' vectors."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    docs = table(spark, sf, "documents").where("text is not null and lang is not null").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select("lang", words.alias("ws"), "embedding")
    counts = docs.select(F.col("lang").alias("topic"), F.explode("ws").alias("word")).groupBy("topic", "word").agg(F.count("*").alias("n"))
    topics = counts.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "word"))).where("r <= 10").select("topic", "word")
    return TS.vector_coherence(docs, topics, "ws", "embedding").withColumn("coherence", F.round("coherence", 6))


def _poly(x: str, c: tuple[float, ...]) -> str:
    return "(" + " + ".join(f"{v!r}::DOUBLE * ({x}) ** {i}" if i else f"{v!r}::DOUBLE" for i, v in enumerate(c)) + ")"


def _ratio(x: str, parts: tuple) -> str:
    return f"{_poly(x, parts[0])} / {_poly(x, parts[1])}"


@register("stat_shapiro_wilk", f"""
WITH o AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS a FROM events WHERE value IS NOT NULL),
p AS (SELECT *, (i - 0.375) / (n + 0.25) AS p, sqrt(-ln(least((i - 0.375) / (n + 0.25), 1 - (i - 0.375) / (n + 0.25)))) AS r FROM o),
m AS (SELECT event_type, n, i, x - a AS d, CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_ratio("0.180625 - (p - 0.5) ** 2", ST._MIDDLE)} WHEN r <= 5 THEN sign(p - 0.5) * {_ratio("r - 1.6", ST._TAIL)} ELSE sign(p - 0.5) * {_ratio("r - 5", ST._FAR)} END AS m FROM p),
g AS (SELECT event_type, n, sum(d * d) AS ss, sum(m * m) AS mm, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2 FROM m GROUP BY 1, 2),
w AS (SELECT *, m1 / sqrt(mm) + {_poly("1 / sqrt(n)", ST._LAST)} AS a1, m2 / sqrt(mm) + {_poly("1 / sqrt(n)", ST._LAST_BUT_ONE)} AS a2 FROM g),
f AS (SELECT *, sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS f FROM w),
t AS (SELECT f.event_type, f.n, sum(CASE WHEN i = f.n THEN a1 WHEN i = 1 THEN -a1 WHEN i = f.n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE m / f END * d) ** 2 / any_value(ss) AS w FROM m JOIN f USING (event_type) GROUP BY 1, 2)
SELECT event_type, n, round(w, 6) AS w, round((ln(1 - w) - {_poly("ln(n)", ST._LARGE[0])}) / exp({_poly("ln(n)", ST._LARGE[1])}), 3) AS z FROM t""")
def stat_shapiro_wilk(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the values of each kind of event are normal."""
    return ST.shapiro_wilk(table(spark, sf, "events"), "value", ["event_type"]).withColumns({"w": F.round("w", 6), "z": F.round("z", 3)})


@register("ml_valence_rules")
def ml_valence_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Compound, positive, negative and neutral shares of every document; tests/test_valence.py has the rules as plain loops."""
    lexicon = spark.createDataFrame(list({"the": 1.5, "der": -2.0, "la": 0.7, "that": -1.1, "in": 0.4}.items()), "word string, valence double")
    boosters = {"and": V.BOOST, "y": V.BOOST, "und": -V.BOOST, "et": -V.BOOST}
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = V.scored(docs, "doc_id", "text", lexicon, boosters, ["of", "die", "le", "no"])
    return out.select("doc_id", *[F.round(c, 4).alias(c) for c in ("compound", "pos", "neg", "neu")])


# ---- restrictions and averages by day ---------------------------------------------------------


@register("filter_participants", """
WITH p AS (SELECT event_id, user_id AS did, 'h' || (event_id % 300) AS handle FROM events), x AS (SELECT c_custkey AS did, CASE WHEN c_nationkey < 4 THEN 'h' || (c_custkey % 300) END AS handle FROM customer WHERE c_nationkey < 6)
SELECT event_id, did, handle FROM p WHERE did NOT IN (SELECT did FROM x) AND handle NOT IN (SELECT handle FROM x WHERE handle IS NOT NULL)""")
def filter_participants(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of which neither author nor handle is an excluded participant's."""
    handle = lambda c: F.concat(F.lit("h"), (c % 300).cast("string"))
    posts = table(spark, sf, "events").select("event_id", F.col("user_id").alias("did"), handle(F.col("event_id")).alias("handle"))
    c = table(spark, sf, "customer").where("c_nationkey < 6")
    return J.without_participants(posts, "did", "handle", c.select(F.col("c_custkey").alias("did"), F.when(F.col("c_nationkey") < 4, handle(F.col("c_custkey"))).alias("handle")))


@register("graph_restricted", """
SELECT DISTINCT l_suppkey AS a, l_partkey AS b, l_shipdate::DATE AS day FROM lineitem WHERE l_shipdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO')) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO'))""")
def graph_restricted(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of one year between nodes of two types."""
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.to_date("l_shipdate").alias("day")).distinct()
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("kind"))
    return G.restricted(edges, nodes, ("ECONOMY", "PROMO"), "1995-01-01", "1995-12-31")


@register("agg_baseline_source_day", """
SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS partition_date, round(avg(value), 6) AS average, round(avg((value >= 50)::INT), 6) AS share, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2""")
def agg_baseline_source_day(spark: SparkSession, sf: str) -> DataFrame:
    """Averages of two sources by day, in one pass."""
    e = table(spark, sf, "events").where("event_type in ('view', 'click')")
    return e.groupBy(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("partition_date")).agg(F.round(F.avg("value"), 6).alias("average"), F.round(F.avg((F.col("value") >= 50).cast("int")), 6).alias("share"), F.count("*").alias("n"))
