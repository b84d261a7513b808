"""Registered queries of scalar functions, filters, feeds, texts, vectors and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import nested as N
from tidewater.functions import score as S
from tidewater.functions import text as T
from tidewater.functions import time as TM
from tidewater.functions import vector as V
from tidewater.operators import feeds as FD
from tidewater.operators import filters as FL
from tidewater.operators import graph as G
from tidewater.operators import text_stats as TS
from tidewater.plans.registry import register, table


@register("fn_time_parse_many", """
WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d-%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE 'not a time' END AS t FROM events)
SELECT event_id, strftime(coalesce(try_strptime(t, '%Y-%m-%dT%H:%M:%S'), try_strptime(t, '%Y-%m-%d-%H:%M:%S'), try_strptime(t, '%Y-%m-%dT%H:%M:%SZ')), '%Y-%m-%d-%H:%M:%S') AS pipeline_time,
       coalesce(strftime(coalesce(try_strptime(t, '%Y-%m-%dT%H:%M:%S'), try_strptime(t, '%Y-%m-%d-%H:%M:%S'), try_strptime(t, '%Y-%m-%dT%H:%M:%SZ')), '%Y-%m-%d'), '2016-01-01') AS partition_date FROM s""")
def fn_time_parse_many(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.date_format("ts", TM.ISO_FORMAT)).when(k == 1, F.date_format("ts", TM.PIPELINE_FORMAT)).when(k == 2, F.date_format("ts", TM.ISO_FORMAT + "'Z'")).otherwise("not a time")
    return table(spark, sf, "events").withColumn("t", t).select("event_id", TM.to_pipeline(F.col("t")).alias("pipeline_time"), TM.partition_date(F.col("t")).alias("partition_date"))


@register("fn_partition_default", """
SELECT o_orderkey, CASE WHEN year(o_orderdate + INTERVAL 25 YEAR) >= 2024 THEN strftime(o_orderdate + INTERVAL 25 YEAR, '%Y-%m-%d') ELSE '2016-01-01' END AS partition_date FROM orders""")
def fn_partition_default(spark, sf):
    shifted = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 25 YEARS"), TM.PIPELINE_FORMAT)
    return table(spark, sf, "orders").select("o_orderkey", TM.partition_date(shifted).alias("partition_date"))


@register("fn_time_truncate", """
SELECT event_id, regexp_extract(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '^[^.+Z]*') AS truncated, 'year=' || strftime(ts, '%Y') || '/month=' || strftime(ts, '%m') || '/day=' || strftime(ts, '%d') || '/hour=' || strftime(ts, '%H') || '/minute=' || strftime(ts, '%M') AS partition_key FROM events""")
def fn_time_truncate(spark, sf):
    return table(spark, sf, "events").select("event_id", TM.truncate(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("truncated"), TM.partition_key(F.date_format("ts", TM.PIPELINE_FORMAT)).alias("partition_key"))


@register("fn_week_no", """
SELECT event_id, CASE WHEN ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' THEN (floor(date_diff('day', DATE '2024-01-03', ts::DATE) / 7) + 1)::INT END AS week, strftime(date_trunc('week', ts), '%Y-%m-%d') AS calendar_week, CASE WHEN ts::DATE <= DATE '2024-01-15' THEN 'pre' ELSE 'post' END AS period FROM events""")
def fn_week_no(spark, sf):
    day = F.to_date("ts")
    return table(spark, sf, "events").select("event_id", TM.week_number(day, F.lit("2024-01-03").cast("date"), F.lit("2024-01-25").cast("date")).alias("week"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("calendar_week"), TM.before_after(day, "2024-01-15").alias("period"))


@register("fn_dynamic_week", """
WITH p AS (SELECT unnest([DATE '2024-01-01', DATE '2024-01-08', DATE '2024-01-15', DATE '2024-01-22']) AS a, unnest([DATE '2024-01-07', DATE '2024-01-14', DATE '2024-01-21', DATE '2024-01-28']) AS b),
s AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'signup'), u AS (SELECT DISTINCT user_id FROM events),
th AS (SELECT u.user_id, p.a, coalesce(max(s.d), p.b) AS t FROM u CROSS JOIN p LEFT JOIN s ON s.user_id = u.user_id AND s.d BETWEEN p.a AND p.b GROUP BY u.user_id, p.a, p.b),
e AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), c AS (SELECT e.user_id, e.day, count(*) FILTER (th.t < e.day) AS k FROM e JOIN th USING (user_id) GROUP BY 1, 2)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN k < 4 THEN (k + 1)::INT END AS week FROM c""")
def fn_dynamic_week(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    surveys = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") == "signup", F.col("day"))).alias("surveys"))  # at most one a study day
    dates = lambda *d: F.array(*[F.lit(x).cast("date") for x in d])
    starts, ends = dates("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"), dates("2024-01-07", "2024-01-14", "2024-01-21", "2024-01-28")
    marks = surveys.select("user_id", TM.dynamic_thresholds(F.col("surveys"), ends, starts).alias("marks"))
    return e.select("user_id", "day").distinct().join(marks, "user_id").select("user_id", F.col("day").cast("string").alias("day"), TM.first_threshold(F.col("day"), F.col("marks")).alias("week"))


@register("fn_tz_utc", """
SELECT event_id, strftime((ts AT TIME ZONE 'America/Denver') AT TIME ZONE 'UTC', '%Y-%m-%d') AS utc_day FROM events""")
def fn_tz_utc(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "America/Denver"), "yyyy-MM-dd").alias("utc_day"))


@register("fn_join_month", "SELECT o_orderkey, CASE WHEN year(o_orderdate + INTERVAL 25 YEAR) < 2024 THEN '2023-12' ELSE strftime(o_orderdate + INTERVAL 25 YEAR, '%Y-%m') END AS month FROM orders")
def fn_join_month(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", TM.month_bucket(F.col("o_orderdate") + F.expr("INTERVAL 25 YEARS")).alias("month"))


_POSTS = """p AS (SELECT event_id AS uri, user_id AS author, value, CASE WHEN event_id % 3 = 0 THEN floor(value * 10)::BIGINT END AS likes, CASE WHEN event_id % 3 = 1 THEN value / 100 END AS sim, ts,
 CASE WHEN event_id % 5 <> 0 THEN (event_id % 97) / 97.0 END AS tox, CASE WHEN event_id % 7 <> 0 THEN (event_id % 89) / 89.0 END AS con, (event_id % 83) / 83.0 AS rea, event_id % 4 <> 0 AS soc FROM events),
q AS (SELECT *, least(floor(((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', ts))) * 100 + 1800) / 3600) / 100, 720.0) AS age, user_id IS NOT NULL AS is_super
 FROM p LEFT JOIN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 70) ON author = user_id),
r AS (SELECT *, ln(1 + coalesce(likes::DOUBLE, sim * 100, 80)) AS likeability, greatest(0.0, 3.0 - age * (3.0 / 720)) AS fresh,
 (CASE WHEN soc AND tox + coalesce(con, rea) > 0 THEN (tox * 0.965 + coalesce(con, rea) * 1.02) / (tox + coalesce(con, rea)) ELSE 1 END) * (CASE WHEN is_super THEN 0.95 ELSE 1 END) AS mult FROM q)"""


def _scored(spark, sf, config=S.FeedConfig(lookback_days=30)):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    posts = e.select(
        i.alias("uri"), F.col("user_id").alias("author_did"), F.col("ts").cast("timestamp").alias("posted_at"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("posted_unix"),
        F.when(i % 2 == 0, "firehose").otherwise("most_liked").alias("source"),
        F.when(i % 3 == 0, F.floor(F.col("value") * 10).cast("long")).alias("like_count"), F.when(i % 3 == 1, F.col("value") / 100).alias("similarity"),
        F.when(i % 5 != 0, (i % 97) / 97.0).alias("prob_toxic"), F.when(i % 7 != 0, (i % 89) / 89.0).alias("prob_constructive"), ((i % 83) / 83.0).alias("prob_reasoning"), (i % 4 != 0).alias("is_sociopolitical"),
    )
    supers = e.groupBy(F.col("user_id").alias("author_did")).agg(F.count("*").alias("n")).where("n >= 70")
    return FD.score_posts(posts, supers, F.lit("2024-01-31 00:00:00").cast("timestamp"), config)


@register("fn_post_scores", f"WITH {_POSTS} SELECT uri, round(likeability + fresh, 6) AS engagement_score, round((likeability + fresh) * mult, 6) AS treatment_score FROM r")
def fn_post_scores(spark, sf):
    return _scored(spark, sf).select("uri", F.round("engagement_score", 6).alias("engagement_score"), F.round("treatment_score", 6).alias("treatment_score"))


@register("fn_freshness_exponential", """
SELECT event_id, round(3.0 * pow(1.0 * (1 - 3.0 / 24) * 0.95, least(floor(((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', ts))) * 100 + 1800) / 3600) / 100, 24.0)), 9) AS fresh FROM events""")
def fn_freshness_exponential(spark, sf):
    age = S.age_hours(F.lit("2024-01-31 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.round(S.exponential_freshness(age), 9).alias("fresh"))


@register("feed_end_to_end", f"""
WITH {_POSTS}, s AS (SELECT uri, author, CASE WHEN uri % 2 = 0 THEN 'firehose' ELSE 'most_liked' END AS source, round((likeability + fresh), 6) AS score FROM r),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY author ORDER BY score DESC, uri) <= 5),
u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT DISTINCT o_custkey AS user_id, l_suppkey AS other FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
n AS (SELECT DISTINCT u.user_id, c.uri, c.score FROM u JOIN e USING (user_id) JOIN c ON c.author = e.other AND c.source = 'firehose'),
o AS (SELECT user_id, uri, score, true AS own FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, uri) <= 50),
x AS (SELECT u.user_id, c.uri, c.score, false AS own FROM u CROSS JOIN c WHERE c.source = 'most_liked' AND NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = u.user_id AND n.uri = c.uri)),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY own DESC, score DESC, uri) - 1 AS position FROM (SELECT * FROM o UNION ALL SELECT * FROM x))
SELECT user_id, position::INT AS position, uri, own AS is_in_network FROM f WHERE position < 100""")
def feed_end_to_end(spark, sf):
    config = S.FeedConfig(lookback_days=30)
    posts = _scored(spark, sf, config).withColumn("engagement_score", F.round("engagement_score", 6))
    posts = FD.capped_per_author(posts, [F.desc("engagement_score"), F.col("uri")], config)
    edges = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("other")).distinct()
    users = table(spark, sf, "events").select(F.col("user_id").alias("user")).distinct().withColumn("condition", F.lit("engagement"))
    feed = FD.rank_feeds(users, FD.pools(posts).where("condition = 'engagement'").drop("author_did"), FD.in_network(users, edges, posts), config=config)
    return feed.select(F.col("user").alias("user_id"), "position", "uri", "is_in_network")


@register("feed_statistics", """
WITH f AS (SELECT o_custkey, l_partkey, l_quantity > 25 AS own FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT o_custkey, '{"prop_in_network":' || round(count(*) FILTER (own) / count(*), 3)::DOUBLE || ',"total_in_network":' || count(*) FILTER (own) || ',"feed_length":' || count(*) || '}' AS stats FROM f GROUP BY 1""")
def feed_statistics(spark, sf):
    f = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    items = f.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("item"), (F.col("l_quantity") > 25).alias("is_in_network"))).alias("items"))
    return items.select("o_custkey", N.feed_statistics(F.col("items")).alias("stats"))


@register("feed_in_network_daily", """
WITH f AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m') AS day, avg((l_quantity > 25)::INT) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3) SELECT o_custkey AS user_id, day, round(avg(p), 6) AS p FROM f GROUP BY 1, 2""")
def feed_in_network_daily(spark, sf):
    f = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    per_feed = f.groupBy(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("day"), "o_orderkey").agg(F.avg((F.col("l_quantity") > 25).cast("int")).alias("p"))
    return per_feed.groupBy("user_id", "day").agg(F.round(F.avg("p"), 6).alias("p"))


@register("fn_json_defensive", """
SELECT o_custkey, count(*) AS n_items, sum(l_partkey)::BIGINT AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def fn_json_defensive(spark, sf):
    """Feeds written as JSON in four states of repair, read back and unnested."""
    f = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    j = f.groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("item"), F.lit(True).alias("is_in_network")))).alias("j"))
    twice = F.concat(F.lit('"'), F.replace("j", F.lit('"'), F.lit('\\"')), F.lit('"'))
    broken = F.when(F.col("o_custkey") % 4 == 0, F.col("j")).when(F.col("o_custkey") % 4 == 1, F.concat("j", F.lit(" trailing"))).when(F.col("o_custkey") % 4 == 2, twice).otherwise(F.concat(F.lit("garbage "), "j"))
    items = j.select("o_custkey", F.explode(F.coalesce(N.feed_items(broken), N.defensive(broken))).alias("i"))
    return items.groupBy("o_custkey").agg(F.count("*").alias("n_items"), F.sum(F.col("i.item").cast("long")).alias("total"))


@register("fn_json_pack", """SELECT event_id, '{"user_id":' || user_id || ',"value":' || CASE WHEN event_type = 'error' THEN 'null' ELSE '1' END || '}' AS packed, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def fn_json_pack(spark, sf):
    v = F.when(F.col("event_type") != "error", 1).alias("value")
    return table(spark, sf, "events").select("event_id", N.packed(F.col("user_id"), v).alias("packed"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("fn_map_string", """SELECT user_id, count(*) AS n FROM events GROUP BY 1""")
def fn_map_string(spark, sf):
    """Map strings {author_did=.., count=..} repaired to JSON and read."""
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    s = c.select(F.concat(F.lit("[{author_did="), F.col("user_id").cast("string"), F.lit(", count="), F.col("n").cast("string"), F.lit("}]")).alias("s"))
    return s.select(F.explode(F.from_json(N.map_string_to_json(F.col("s")), "array<struct<author_did:string,count:string>>")).alias("x")).select(F.col("x.author_did").cast("long").alias("user_id"), F.col("x.count").cast("long").alias("n"))


@register("fn_hashtags", """
WITH h AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(regexp_replace(text, '(\\w)[%&*$]+', '#\\1', 'g')), '#([\\p{L}\\p{N}_]+)', 1)) AS tag FROM documents)
SELECT lang, tag, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM h GROUP BY 1, 2 HAVING count(*) >= 5""")
def fn_hashtags(spark, sf):
    """Noise marks turned to hashtags."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", r"(\w)[%&*$]+", "#$1").alias("t"))
    h = d.select("doc_id", "lang", F.explode(T.hashtags(F.col("t"))).alias("tag"))
    return h.groupBy("lang", "tag").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n >= 5")


@register("fn_canonical_docid", "SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS sha FROM documents")
def fn_canonical_docid(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.document_id(F.col("text")).alias("sha"))


@register("fn_uri_parts", """
SELECT page_id, split_part(url, '/', -1) AS last_part, regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g') AS safe, split_part('did:' || page_id || '::' || (page_id * 7), '::', 2) AS feed_part FROM pages""")
def fn_uri_parts(spark, sf):
    feed = F.concat_ws("::", F.concat(F.lit("did:"), F.col("page_id").cast("string")), (F.col("page_id") * 7).cast("string"))
    return table(spark, sf, "pages").select("page_id", T.last_part(F.col("url")).alias("last_part"), T.safe_name(F.col("url")).alias("safe"), F.split_part(feed, F.lit("::"), F.lit(2)).alias("feed_part"))


@register("fn_multi_label", """
WITH p AS (SELECT event_id, (event_id % 101) / 101.0 AS e, (event_id % 103) / 103.0 AS i, (event_id % 107) / 107.0 AS m, (event_id % 109) / 109.0 AS o FROM events)
SELECT event_id, (e > 0.5)::INT AS label_emotion, (i > 0.5)::INT AS label_intergroup, (m > 0.5)::INT AS label_moral, CASE WHEN o > 0.5 OR NOT (e > 0.5 OR i > 0.5 OR m > 0.5) THEN 1 ELSE 0 END AS label_other FROM p""")
def fn_multi_label(spark, sf):
    from tidewater.functions.labels import multi_label

    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", *multi_label({"emotion": (i % 101) / 101.0, "intergroup": (i % 103) / 103.0, "moral": (i % 107) / 107.0, "other": (i % 109) / 109.0}))


@register("fn_valence_label", "SELECT event_id, CASE WHEN value / 100 - 0.2 >= 0.05 THEN 'positive' WHEN value / 100 - 0.2 <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM events")
def fn_valence_label(spark, sf):
    return table(spark, sf, "events").select("event_id", T.valence_label(F.col("value") / 100 - 0.2).alias("label"))


@register("filter_chain_flags", """
WITH d AS (SELECT doc_id, source, lang, CASE doc_id % 11 WHEN 0 THEN 'bit.ly' WHEN 1 THEN 'porn' WHEN 2 THEN 'a # b # c #' WHEN 3 THEN 'null' ELSE text END AS text FROM documents),
v AS (SELECT *, source = 'src3' AS bot, source = 'src5' AS nsfw_author, text = 'porn' AS nsfw, (text = 'bit.ly' OR len(regexp_extract_all(text, '#')) >= 3) AS spam FROM d WHERE lang = 'en' AND length(trim(text)) >= 5 AND lower(trim(text)) <> 'null' OR lang = 'en' AND text = 'bit.ly')
SELECT source, count(*) AS n, count(*) FILTER (bot) AS n_bot, count(*) FILTER (spam) AS n_spam, count(*) FILTER (NOT (nsfw OR nsfw_author OR spam)) AS n_passed,
       count(*) FILTER (spam) AS n_by_spam, count(*) FILTER (nsfw_author AND NOT spam) AS n_by_author, count(*) FILTER (bot AND NOT spam AND NOT nsfw_author AND NOT nsfw) AS n_by_bot FROM v GROUP BY 1""")
def filter_chain_flags(spark, sf):
    k = F.col("doc_id") % 11
    text = F.when(k == 0, "bit.ly").when(k == 1, "porn").when(k == 2, "a # b # c #").when(k == 3, "null").otherwise(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("author_did"), F.col("lang").alias("langs"), text.alias("text"), F.lit(None).cast("string").alias("labels"))
    authors = lambda *a: spark.createDataFrame([(x,) for x in a], "author_did string")
    f = FL.preprocess(d, authors("src3"), authors("src5"))
    by = lambda x: F.count_if(F.col("filtered_by_func") == x)
    return f.groupBy(F.col("author_did").alias("source")).agg(F.count("*").alias("n"), F.count_if("author_is_bot").alias("n_bot"), F.count_if("is_spam").alias("n_spam"), F.count_if("passed_filters").alias("n_passed"), by("has_spam").alias("n_by_spam"), by("author_is_nsfw").alias("n_by_author"), by("author_is_bot").alias("n_by_bot"))


@register("filter_dynamic", """
SELECT event_id, user_id, value FROM events WHERE event_type IN ('click', 'purchase') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND value >= 20 AND (props LIKE '%7%' OR props LIKE '%3%') ORDER BY value DESC, event_id LIMIT 100""")
def filter_dynamic(spark, sf):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    preds = [F.col("event_type").isin("click", "purchase"), F.col("ts").between(at("2024-01-05"), at("2024-01-25")), FL.tri_state(F.col("value"), True, 20.0), FL.any_keyword(F.col("props"), ["7", "3"])]
    return FL.dynamic(table(spark, sf, "events").select("event_id", "user_id", "value", "event_type", "ts", "props"), preds, 100, [F.desc("value"), F.col("event_id")]).select("event_id", "user_id", "value")


@register("filter_study_window", """
SELECT event_id, user_id FROM events WHERE ts::DATE BETWEEN DATE '2024-01-04' AND DATE '2024-01-20' AND ts::DATE NOT IN (DATE '2024-01-08', DATE '2024-01-09')""")
def filter_study_window(spark, sf):
    return table(spark, sf, "events").where(FL.in_study(F.to_date("ts"), "2024-01-04", "2024-01-20", ("2024-01-08", "2024-01-09"))).select("event_id", "user_id")


@register("vec_cosine_to_mean", """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM x GROUP BY 1)
SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) AS cosine FROM x JOIN m USING (i) GROUP BY 1""")
def vec_cosine_to_mean(spark, sf):
    from tidewater.operators.aggregates import mean_vector

    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.crossJoin(F.broadcast(mean_vector(e, "embedding"))).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("mean")), 5).alias("cosine"))


@register("text_tfidf_top_terms", """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents), v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1), k AS (SELECT term, df FROM v, n WHERE df >= 5 AND df <= 0.95 * n ORDER BY total DESC, term LIMIT 2000),
r AS (SELECT doc_id, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN k ON tf.term = k.term, n), l AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM r GROUP BY 1)
SELECT term, round(sum(w / len) / any_value(n), 6) AS score FROM r JOIN l USING (doc_id), n GROUP BY 1 ORDER BY score DESC, term LIMIT 50""")
def text_tfidf_top_terms(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return TS.top_terms(TS.tf_idf(d, "doc_id", "text", 5, 0.95, 2000), d, 50)


@register("text_npmi", """
WITH w AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (SELECT * FROM (VALUES ('the', 'and'), ('der', 'die'), ('que', 'los'), ('the', 'die')) AS p(a, b)),
d AS (SELECT doc_id, list_distinct(regexp_extract_all(t, '[a-z]+')) AS ws FROM w), n AS (SELECT count(*) AS n FROM d),
c AS (SELECT a, b, count(*) FILTER (list_contains(ws, a)) AS na, count(*) FILTER (list_contains(ws, b)) AS nb, count(*) FILTER (list_contains(ws, a) AND list_contains(ws, b)) AS nab FROM p CROSS JOIN d GROUP BY 1, 2)
SELECT a, b, round(CASE WHEN nab = 0 THEN -1 WHEN nab = n THEN 1 ELSE ln(nab * n::DOUBLE / (na * nb)) / -ln(nab / n) END, 6) AS npmi FROM c, n WHERE na > 0 AND nb > 0""")
def text_npmi(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("words"))
    pairs = spark.createDataFrame([("the", "and"), ("der", "die"), ("que", "los"), ("the", "die")], "a string, b string")
    return TS.npmi(d, "doc_id", "words", pairs).withColumn("npmi", F.round("npmi", 6))


@register("graph_degree", """
WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey), b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
d AS (SELECT a AS node, count(*) AS degree FROM b GROUP BY 1) SELECT node, degree, round(degree / ((SELECT count(*) FROM d) - 1), 9) AS centrality FROM d""")
def graph_degree(spark, sf):
    e = G.undirected(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")
    return G.degrees(e).withColumn("centrality", F.round("centrality", 9))


@register("graph_assortativity", """
WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey), b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
d AS (SELECT a AS node, count(*) AS degree FROM b GROUP BY 1) SELECT round(corr(x.degree, y.degree), 6) AS assortativity FROM b JOIN d x ON x.node = b.a JOIN d y ON y.node = b.b""")
def graph_assortativity(spark, sf):
    e = G.undirected(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")
    return G.assortativity(e).select(F.round("assortativity", 6).alias("assortativity"))


@register("graph_components", """
WITH RECURSIVE e AS (SELECT c_custkey AS a, 1000000000 + c_nationkey * 100000 + floor(c_acctbal / 50)::BIGINT + 5000 AS b FROM customer UNION SELECT c_custkey, 2000000000 + length(c_mktsegment) * 100000 + floor(c_acctbal / 20)::BIGINT + 5000 FROM customer), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, label) AS (SELECT a, a FROM g UNION SELECT g.b, r.label FROM r JOIN g ON g.a = r.node WHERE r.label < g.b)
SELECT node, min(label) AS component FROM r GROUP BY 1""")
def graph_components(spark, sf):
    """Customers linked by what they share: nation and about the same balance, or segment and nearer balances."""
    c = table(spark, sf, "customer")
    near = lambda width: F.floor(F.col("c_acctbal") / width).cast("long") + 5000
    by_nation = c.select(F.col("c_custkey").alias("x"), (F.col("c_nationkey").cast("long") * 100000 + 1000000000 + near(50)).alias("y"))
    by_segment = c.select(F.col("c_custkey").alias("x"), (F.length("c_mktsegment").cast("long") * 100000 + 2000000000 + near(20)).alias("y"))
    return G.components(G.undirected(by_nation.union(by_segment), "x", "y"))
