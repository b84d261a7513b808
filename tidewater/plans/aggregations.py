"""Registered aggregation and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import labels as L
from tidewater.operators import aggregates as A
from tidewater.operators import joins as J
from tidewater.operators import stats as ST
from tidewater.plans.registry import register, table



def _day():
    return F.to_date("ts")


@register("agg_author_daily_mean", """
SELECT user_id, strftime(ts::DATE, '%Y-%m-%d') AS day, round(avg(value), 6) AS mean_value, count(*) AS n,
       min_by(event_type, (ts, event_id)) AS first_event_type
FROM events GROUP BY 1, 2""")
def agg_author_daily_mean(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("day", _day().cast("string")).withColumn("at", F.struct("ts", "event_id"))
    return A.daily_means(e, ["user_id", "day"], {"mean_value": "value"}, "at", "event_type").withColumn("mean_value", F.round("mean_value", 6))


@register("agg_weighted_mean_days", """
WITH d AS (SELECT user_id, ts::DATE AS day, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, round(sum(v * n) / sum(n), 9) AS v, sum(n)::BIGINT AS n FROM d GROUP BY 1""")
def agg_weighted_mean_days(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id", _day().alias("day")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return A.weighted_mean(d, ["user_id"], ["v"], "n").withColumn("v", F.round("v", 9))


@register("agg_threshold_having", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 65")
def agg_threshold_having(spark, sf):
    return A.at_least(table(spark, sf, "events"), "user_id", 65)


@register("agg_superposters_packed", """
WITH c AS (SELECT ts::DATE AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT strftime(day, '%Y-%m-%d') AS day, '[' || string_agg('{"author_did":"' || user_id || '","count":' || n || '}', ',' ORDER BY n DESC, user_id) || ']' AS superposters
FROM c GROUP BY 1""")
def agg_superposters_packed(spark, sf):
    c = table(spark, sf, "events").groupBy(_day().alias("day"), "user_id").agg(F.count("*").alias("n")).where("n >= 4")
    row = F.struct(F.negative("n").alias("o"), "user_id", F.struct(F.col("user_id").cast("string").alias("author_did"), F.col("n").alias("count")).alias("r"))
    return c.groupBy(F.col("day").cast("string").alias("day")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"])).alias("superposters"))


@register("agg_label_avg_prop", """
SELECT source, round(avg(toxic), 3) AS avg_toxic, round(avg(CASE WHEN quality IS NOT NULL THEN (quality >= 0.5)::INT::DOUBLE END), 3) AS prop_quality,
       count(*) AS n_posts, count(quality) AS n_labelled
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def agg_label_avg_prop(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(L.average(F.col("toxic")).alias("avg_toxic"), L.proportion(F.col("quality")).alias("prop_quality"), F.count("*").alias("n_posts"), F.count("quality").alias("n_labelled"))


def _event_labels(spark, sf):
    """Events as posts with all labels: every label is a fixed function of value, null for errors."""
    e = table(spark, sf, "events").withColumn("day", _day().cast("string"))
    ok = F.col("event_type") != "error"
    cols = {}
    for i, (name, kind) in enumerate(L.LABELS.items()):
        x = F.pmod(F.col("event_id") * (2 * i + 3) + i, F.lit(997)) / 997.0
        cols[name] = F.when(ok, x >= 0.5) if kind == "boolean" else F.when(ok, x)
    return e.select("user_id", "day", "event_type", *[c.alias(n) for n, c in cols.items()])


def _label_sql(prefix: str) -> str:
    out = []
    for i, (name, kind) in enumerate(L.LABELS.items()):
        short = name.removeprefix("prob_")
        x = f"(((event_id * {2 * i + 3} + {i}) % 997) / 997.0)"
        value = f"CASE WHEN event_type <> 'error' THEN {'(' + x + ' >= 0.5)::INT::DOUBLE' if kind == 'boolean' else x} END"
        hit = f"CASE WHEN event_type <> 'error' THEN ({x} >= 0.5)::INT::DOUBLE END"
        out.append(f"round(avg({value}), 3) AS {prefix}_average_{short}")
        out.append("NULL::DOUBLE" f" AS {prefix}_proportion_{short}" if kind == "score" else f"round(avg({hit}), 3) AS {prefix}_proportion_{short}")
    return ", ".join(out)


@register("agg_label_metrics_user_day", f"SELECT user_id, strftime(ts::DATE, '%Y-%m-%d') AS day, {_label_sql('feed')} FROM events GROUP BY 1, 2")
def agg_label_metrics_user_day(spark, sf):
    """All 36 labels, average and proportion, by user and day in one pass."""
    return _event_labels(spark, sf).groupBy("user_id", "day").agg(*L.all_metrics("feed"))


@register("agg_label_metrics_baseline", f"SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, {_label_sql('baseline')} FROM events GROUP BY 1")
def agg_label_metrics_baseline(spark, sf):
    return _event_labels(spark, sf).groupBy("day").agg(*L.all_metrics("baseline"))


@register("agg_engaged_pivot", """
SELECT user_id, strftime(ts::DATE, '%Y-%m-%d') AS day, round(avg(value) FILTER (event_type = 'click'), 3) AS click_average,
       round(avg(value) FILTER (event_type = 'view'), 3) AS view_average, round(avg(value) FILTER (event_type = 'purchase'), 3) AS purchase_average
FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2""")
def agg_engaged_pivot(spark, sf):
    e = table(spark, sf, "events").withColumn("day", _day().cast("string"))
    out = e.groupBy("user_id", "day").pivot("event_type", ["click", "view", "purchase"]).agg(F.round(F.avg("value"), 3))
    names = {k: f"{k}_average" for k in ("click", "view", "purchase")}
    return out.withColumnsRenamed(names).where("click_average is not null or view_average is not null or purchase_average is not null")


@register("agg_weekly_of_daily", """
WITH d AS (SELECT user_id, ts::DATE AS day, round(avg(value), 5) AS v FROM events GROUP BY 1, 2)
SELECT user_id, (floor(date_diff('day', DATE '2024-01-01', day) / 7) + 1)::INT AS week, round(avg(v), 9) AS v FROM d GROUP BY 1, 2""")
def agg_weekly_of_daily(spark, sf):
    e = table(spark, sf, "events").select("user_id", _day().alias("day"), F.col("value").alias("v"))
    e = e.withColumn("week", (F.floor(F.datediff("day", F.lit("2024-01-01")) / 7) + 1).cast("int"))
    return A.mean_of_means(e, ["user_id", "day", "week"], ["user_id", "week"], ["v"], 5, 9)


@register("agg_study_total_average", """
WITH d AS (SELECT ts::DATE AS day, avg(value) AS v FROM events GROUP BY 1) SELECT round(avg(v), 6) AS mean_of_days, count(*) AS n_days FROM d""")
def agg_study_total_average(spark, sf):
    d = table(spark, sf, "events").groupBy(_day().alias("day")).agg(F.avg("value").alias("v"))
    return d.agg(F.round(F.avg("v"), 6).alias("mean_of_days"), F.count("*").alias("n_days"))


@register("agg_prevalence", """
WITH s AS (SELECT avg((event_type = 'click')::INT) AS click, avg((value > 30)::INT) AS large, avg((value < 0)::INT) AS negative FROM events),
u AS (UNPIVOT s ON click, large, negative INTO NAME label VALUE share), p AS (SELECT label, round(coalesce(share, 0) * 100, 1) AS percent FROM u)
SELECT label, percent, CASE WHEN percent < 1 THEN 'rare' WHEN percent < 5 THEN 'low' WHEN percent < 20 THEN 'medium' ELSE 'high' END AS category FROM p""")
def agg_prevalence(spark, sf):
    s = table(spark, sf, "events").agg(*[F.avg(c.cast("int")).alias(n) for n, c in (("click", F.col("event_type") == "click"), ("large", F.col("value") > 30), ("negative", F.col("value") < 0))])
    return A.prevalence(s, ["click", "large", "negative"])


@register("agg_cond_matrix", """
SELECT c_mktsegment, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS avg_f, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS avg_o,
       round(avg(o_totalprice), 4) AS avg_all FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def agg_cond_matrix(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = A.matrix(o, ["c_mktsegment"], F.col("o_totalprice"), {"avg_f": F.col("o_orderstatus") == "F", "avg_o": F.col("o_orderstatus") == "O", "avg_all": F.lit(True)})
    return m.select("c_mktsegment", *[F.round(c, 4).alias(c) for c in ("avg_f", "avg_o", "avg_all")])


@register("agg_pivot_case", """
WITH g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, max(CASE WHEN o_orderstatus = 'F' THEN n END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN n END) AS o, max(CASE WHEN o_orderstatus = 'P' THEN n END) AS p FROM g GROUP BY 1""")
def agg_pivot_case(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@register("agg_max_by", """
SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY 1""")
def agg_max_by(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"))


@register("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY 1")
def agg_distinct(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderdate").alias("days"))


@register("agg_list", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS order_list, count(*) AS n FROM orders GROUP BY 1")
def agg_list(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("order_list"), F.count("*").alias("n"))


@register("agg_pivot_week_condition", """
WITH e AS (SELECT c_mktsegment AS segment, (floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7) + 1)::INT AS week, value FROM events JOIN customer ON user_id = c_custkey)
SELECT week, round(avg(value) FILTER (segment = 'BUILDING'), 4) AS building, round(avg(value) FILTER (segment = 'MACHINERY'), 4) AS machinery FROM e GROUP BY 1""")
def agg_pivot_week_condition(spark, sf):
    e = table(spark, sf, "events").join(table(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey"))
    e = e.withColumn("week", (F.floor(F.datediff(_day(), F.lit("2024-01-01")) / 7) + 1).cast("int"))
    return e.groupBy("week").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.round(F.avg("value"), 4)).withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})


@register("agg_grid_zero_fill", """
WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day),
c AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1, 2)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, coalesce(clicks, 0) AS clicks, coalesce(views, 0) AS views FROM u CROSS JOIN d LEFT JOIN c USING (user_id, day)""")
def agg_grid_zero_fill(spark, sf):
    e = table(spark, sf, "events").withColumn("day", _day())
    cells = J.grid(e.select("user_id").distinct(), J.calendar(spark, "2024-01-01", "2024-01-30"))
    counts = A.by_type(e, ["user_id", "day"], "event_type", ["click", "view"]).withColumnsRenamed({"click": "clicks", "view": "views"})
    return J.fill_grid(cells, counts, ["user_id", "day"], {"clicks": 0, "views": 0}).withColumn("day", F.col("day").cast("string"))


@register("agg_weekly_sums", """
SELECT user_id, (floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7) + 1)::INT AS week, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1, 2""")
def agg_weekly_sums(spark, sf):
    e = table(spark, sf, "events").withColumn("week", (F.floor(F.datediff(_day(), F.lit("2024-01-01")) / 7) + 1).cast("int"))
    return A.by_type(e, ["user_id", "week"], "event_type", ["click", "purchase"])


@register("agg_mode_typed", """
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM c)
SELECT o.o_custkey, round(avg(o_totalprice), 6) AS o_totalprice, any_value(m.o_orderpriority) AS o_orderpriority FROM orders o JOIN m ON o.o_custkey = m.o_custkey AND r = 1 GROUP BY 1""")
def agg_mode_typed(spark, sf):
    return A.typed(table(spark, sf, "orders"), ["o_custkey"], ["o_totalprice"], ["o_orderpriority"]).withColumn("o_totalprice", F.round("o_totalprice", 6))


@register("agg_source_share", """
WITH f AS (SELECT l_orderkey, avg((p_type = 'ECONOMY')::INT) AS share, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT round(avg(share), 6) AS mean_share, round(1 - avg(share), 6) AS complement, sum(n)::BIGINT AS n_items FROM f""")
def agg_source_share(spark, sf):
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    f = l.groupBy("l_orderkey").agg(F.avg((F.col("p_type") == "ECONOMY").cast("int")).alias("share"), F.count("*").alias("n"))
    return f.agg(F.round(F.avg("share"), 6).alias("mean_share"), F.round(1 - F.avg("share"), 6).alias("complement"), F.sum("n").alias("n_items"))


@register("agg_unique_share", "SELECT count(*) AS total, count(DISTINCT l_partkey) AS n_unique, round(count(DISTINCT l_partkey) * 100.0 / count(*), 2) AS pct_unique FROM lineitem")
def agg_unique_share(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("total"), F.countDistinct("l_partkey").alias("n_unique")).withColumn("pct_unique", F.round(F.col("n_unique") * 100.0 / F.col("total"), 2))


@register("agg_overlap_ratio", """
WITH p AS (SELECT l_partkey, max((c_mktsegment = 'BUILDING')::INT) AS a, max((c_mktsegment = 'MACHINERY')::INT) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * b)::BIGINT AS n_both, round(sum(a * b) / sum(a)::DOUBLE, 3) AS share_of_a, round(sum(a * b) / sum(b)::DOUBLE, 3) AS share_of_b FROM p""")
def agg_overlap_ratio(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.overlap(rows, "l_partkey", "c_mktsegment", "BUILDING", "MACHINERY")


@register("agg_grouping_sets_topn", """
WITH w AS (SELECT lang, source, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM documents),
c AS (SELECT lang, source, word, count(*) AS n, grouping(lang) * 2 + grouping(source) AS slice FROM w GROUP BY GROUPING SETS ((lang, word), (source, word), (lang, source, word), (word))),
r AS (SELECT *, row_number() OVER (PARTITION BY slice, lang, source ORDER BY n DESC, word) AS place FROM c)
SELECT slice::BIGINT AS slice, lang, source, word, n, place::INT AS place FROM r WHERE place <= 5""")
def agg_grouping_sets_topn(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("word"))
    # counts combine by the finest slice first, so the sets expand groups and not words
    fine = d.groupBy("lang", "source", "word").agg(F.count("*").alias("c"))
    c = A.over_slices(fine, [["lang"], ["source"], ["lang", "source"], []], "word", F.sum("c"))
    w = Window.partitionBy("slice", "lang", "source").orderBy(F.desc("n"), "word")
    slice_ = F.shiftright("slice", 1)  # the word's bit is last and always 0
    return c.withColumn("place", F.row_number().over(w)).where("place <= 5").select(slice_.alias("slice"), "lang", "source", "word", "n", "place")


@register("agg_topic_slices", """
WITH a AS (SELECT vec_id, label AS topic, vec_id % 4 AS condition FROM embeddings), c AS (SELECT condition, topic, count(*) AS n FROM a GROUP BY 1, 2)
SELECT condition, topic, n, round(n / sum(n) OVER (PARTITION BY condition), 6) AS share FROM c""")
def agg_topic_slices(spark, sf):
    from tidewater.operators.text_stats import slice_shares

    a = table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("condition"), F.col("label").alias("topic"))
    return slice_shares(a, ["condition"], "topic").withColumn("share", F.round("share", 6))


@register("agg_slice_summary", """
WITH c AS (SELECT vec_id % 4 AS condition, label AS topic, count(*) AS n FROM embeddings GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY condition) AS share FROM c)
SELECT condition, sum(n)::BIGINT AS n_documents, count(*) AS n_topics, max_by(topic, (n, -topic)) AS top_topic, round(max(share), 6) AS top_share FROM s GROUP BY 1""")
def agg_slice_summary(spark, sf):
    from tidewater.operators.text_stats import slice_shares, slice_summary

    a = table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("condition"), F.col("label").alias("topic"))
    return slice_summary(slice_shares(a, ["condition"], "topic"), ["condition"], "topic").withColumn("top_share", F.round("top_share", 6))


@register("agg_monthly_stats", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 4) AS o_totalprice_mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS o_totalprice_std, count(o_totalprice) AS o_totalprice_count FROM orders GROUP BY 1""")
def agg_monthly_stats(spark, sf):
    return ST.summary(table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), ["o_totalprice"], ["month"])


@register("agg_network_comparison", """
SELECT (user_id % 2 = 0) AS in_network, strftime(ts::DATE, '%Y-%m-%d') AS day, round(avg(value), 4) AS value_mean, round(coalesce(stddev_samp(value), 0), 4) AS value_std, count(value) AS value_count FROM events GROUP BY 1, 2""")
def agg_network_comparison(spark, sf):
    return ST.summary(table(spark, sf, "events").select((F.col("user_id") % 2 == 0).alias("in_network"), _day().cast("string").alias("day"), "value"), ["value"], ["in_network", "day"])


@register("agg_mean_vector", "WITH e AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT i::INT AS i, round(avg(x), 5) AS x FROM e GROUP BY 1")
def agg_mean_vector(spark, sf):
    m = A.mean_vector(table(spark, sf, "embeddings"), "embedding")
    return m.select(F.posexplode("mean").alias("i", "x")).select("i", F.round("x", 5).alias("x"))


@register("agg_percentile_iqr", """
SELECT o_orderpriority, round(min(o_totalprice), 4) AS minimum, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(max(o_totalprice), 4) AS maximum FROM orders GROUP BY 1""")
def agg_percentile_iqr(spark, sf):
    f = ST.five_numbers(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])
    return f.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("minimum", "q1", "median", "q3", "maximum")])


@register("agg_percentiles_high", """
WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT round(quantile_cont(n, 0.9), 4) AS p90, round(quantile_cont(n, 0.95), 4) AS p95, round(quantile_cont(n, 0.99), 4) AS p99, round(quantile_cont(n, 0.999), 4) AS p999 FROM c""")
def agg_percentiles_high(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return ST.percentiles(c, "n", {"p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}).select(*[F.round(x, 4).alias(x) for x in ("p90", "p95", "p99", "p999")])


@register("agg_hist", """
WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT least(29, floor((value - lo) / ((hi - lo) / 30)))::INT AS bin, lo, hi FROM events, e)
SELECT bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 30, 6) AS low, round(any_value(lo) + (bin + 1) * (any_value(hi) - any_value(lo)) / 30, 6) AS high, count(*) AS n FROM b GROUP BY 1""")
def agg_hist(spark, sf):
    return ST.histogram(table(spark, sf, "events"), "value").select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@register("filter_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, q WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def filter_outliers(spark, sf):
    return ST.without_outliers(table(spark, sf, "events"), "value").select("event_id", "value")


@register("filter_over_percentile", "SELECT event_id, value FROM events WHERE value >= (SELECT quantile_cont(value, 0.95) FROM events)")
def filter_over_percentile(spark, sf):
    return ST.over_percentile(table(spark, sf, "events"), "value", 0.95).select("event_id", "value")


@register("stat_corr_spearman", """
WITH d AS (SELECT o_totalprice AS x, n AS y FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d)
SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y FROM r""")
def stat_corr_spearman(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("n"))  # noqa: E741
    d = table(spark, sf, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return ST.correlations(d, "o_totalprice", "n").select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "n", F.round("mean_x", 4).alias("mean_x"), F.round("mean_y", 4).alias("mean_y"))


@register("stat_two_samples", """
WITH d AS (SELECT value AS x, ts >= TIMESTAMP '2024-01-16' AS g FROM events), r AS (SELECT x, g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM d),
m AS (SELECT count(*) FILTER (NOT g) AS n1, count(*) FILTER (g) AS n2, avg(x) FILTER (NOT g) AS m1, avg(x) FILTER (g) AS m2, var_samp(x) FILTER (NOT g) AS v1, var_samp(x) FILTER (g) AS v2, sum(r) FILTER (NOT g) AS r1 FROM r)
SELECT n1 AS n_a, n2 AS n_b, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS welch_t, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohens_d, round(r1 - n1 * (n1 + 1) / 2, 3) AS mann_whitney_u FROM m""")
def stat_two_samples(spark, sf):
    e = table(spark, sf, "events")
    got = ST.two_samples(e, "value", F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))
    row = (int(got["n_a"]), int(got["n_b"]), round(got["welch_t"], 6), round(got["cohens_d"], 6), round(got["mann_whitney_u"], 3))
    return spark.createDataFrame([row], "n_a long, n_b long, welch_t double, cohens_d double, mann_whitney_u double")
