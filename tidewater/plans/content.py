"""Registered queries on users, engagement, topics and further storage forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import labels as L
from tidewater.functions import nested as N
from tidewater.functions import text as T
from tidewater.functions import time as TM
from tidewater.operators import aggregates as A
from tidewater.operators import feeds as FD
from tidewater.operators import filters as FL
from tidewater.operators import graph as G
from tidewater.operators import text_stats as TS
from tidewater.operators import users as US
from tidewater.plans.registry import register, table
from tidewater.sources import catalog as CT
from tidewater.sources import storage as ST
from tidewater.sources.scratch import scratch_path

_KINDS = {"click": "liked_posts", "purchase": "replied_posts"}
_THREE = {"prob_toxic": "probability", "valence_clf_score": "score", "is_sociopolitical": "boolean"}


def _engagement_sql() -> str:
    out = []
    for value, name in _KINDS.items():
        f = f"FILTER (event_type = '{value}')"
        out += [f"round(avg((event_id % 991) / 991.0) {f}, 3) AS engagement_average_{name}_toxic", f"round(avg(((event_id % 991) / 991.0 >= 0.5)::INT) {f}, 3) AS engagement_proportion_{name}_toxic"]
        out += [f"round(avg((event_id % 983) / 983.0) {f}, 3) AS engagement_average_{name}_valence_clf_score", f"NULL::DOUBLE AS engagement_proportion_{name}_valence_clf_score"]
        out += [f"round(avg((event_id % 3 = 0)::INT) {f}, 3) AS engagement_average_{name}_is_sociopolitical", f"round(avg((event_id % 3 = 0)::INT) {f}, 3) AS engagement_proportion_{name}_is_sociopolitical"]
    return ", ".join(out)


@register("agg_engagement_metrics", f"SELECT user_id, {_engagement_sql()} FROM events GROUP BY 1")
def agg_engagement_metrics(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf, "events").select("user_id", "event_type", ((i % 991) / 991.0).alias("prob_toxic"), ((i % 983) / 983.0).alias("valence_clf_score"), (i % 3 == 0).alias("is_sociopolitical"))
    return e.groupBy("user_id").agg(*L.engagement_metrics("event_type", _THREE, _KINDS))


@register("agg_user_feed_averages", """
SELECT o_custkey AS user_id, round(avg(l_discount), 9) AS avg_discount, round(avg((l_returnflag = 'R')::INT), 6) AS share_r, round(avg((l_returnflag = 'A')::INT), 6) AS share_a, round(avg((l_quantity >= 25)::INT), 6) AS prop_large, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def agg_user_feed_averages(spark, sf):
    """Averages and one-hot shares over all rows of a user's feeds."""
    f = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    hot = f.select(F.col("o_custkey").alias("user_id"), "l_discount", "l_quantity", *L.one_hot(F.col("l_returnflag"), {"r": "R", "a": "A"}))
    return hot.groupBy("user_id").agg(F.round(F.avg("l_discount"), 9).alias("avg_discount"), F.round(F.avg(F.col("r").cast("int")), 6).alias("share_r"), F.round(F.avg(F.col("a").cast("int")), 6).alias("share_a"), L.proportion(F.col("l_quantity"), threshold=25, digits=6).alias("prop_large"), F.count("*").alias("n"))


@register("agg_baseline_by_source", """
SELECT source, lang, round(avg(toxic), 6) AS average_toxic, round(avg(quality), 6) AS average_quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def agg_baseline_by_source(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source", "lang").agg(F.round(F.avg("toxic"), 6).alias("average_toxic"), F.round(F.avg("quality"), 6).alias("average_quality"), F.count("*").alias("n"))


@register("agg_network_filtered_sets", """
SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS day, count(DISTINCT l_partkey) AS n_uris FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 25 GROUP BY 1, 2""")
def agg_network_filtered_sets(spark, sf):
    """In-network items of parsed feeds by user and month, as sets."""
    f = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    feeds = f.groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(F.to_json(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("item"), (F.col("l_quantity") > 25).alias("is_in_network")))).alias("feed"))
    items = feeds.select(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("day"), F.explode(N.feed_items(F.col("feed"))).alias("i")).where("i.is_in_network")
    return items.groupBy("user_id", "day").agg(F.countDistinct("i.item").alias("n_uris"))


@register("agg_session_analytics", """
SELECT c_mktsegment AS condition, count(DISTINCT o_custkey) AS n_feeds, count(*) AS n_posts, count(DISTINCT l_partkey) AS n_unique, round(avg((l_quantity > 25)::INT), 3) AS prop_in_network FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def agg_session_analytics(spark, sf):
    f = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return FD.session_analytics(f.select(F.col("c_mktsegment").alias("condition"), F.col("o_custkey").alias("user"), F.col("l_partkey").alias("uri"), (F.col("l_quantity") > 25).alias("is_in_network")))


@register("agg_topic_evolution", """
WITH t AS (SELECT event_id, event_type AS topic, 'week_' || ((floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7) + 1)::INT) AS week, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'pre' ELSE 'post' END AS period FROM events),
s AS (SELECT week AS slice, topic FROM t UNION ALL SELECT period, topic FROM t), c AS (SELECT slice, topic, count(*) AS n FROM s GROUP BY 1, 2)
SELECT slice, topic, n, round(n / sum(n) OVER (PARTITION BY slice), 6) AS share, 'topic ' || topic AS topic_name FROM c""")
def agg_topic_evolution(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("topic"), F.to_date("ts").alias("day"))
    week = F.concat(F.lit("week_"), (F.floor(F.datediff("day", F.lit("2024-01-01")) / 7) + 1).cast("string"))
    slices = e.select("topic", F.explode(F.array(week, TM.before_after(F.col("day"), "2024-01-16", inclusive=False))).alias("slice"))
    names = e.select("topic").distinct().withColumn("topic_name", F.concat(F.lit("topic "), "topic"))
    return TS.slice_shares(slices, ["slice"], "topic").withColumn("share", F.round("share", 6)).join(names, "topic")


@register("agg_filter_outcomes", """
WITH d AS (SELECT CASE doc_id % 11 WHEN 0 THEN 'sale # # #' ELSE text END AS text, lang FROM documents), v AS (SELECT *, len(regexp_extract_all(text, '#')) >= 3 AS spam FROM d WHERE lang = 'en' AND length(trim(text)) >= 5)
SELECT count(*) AS n, 0::BIGINT AS n_author_is_bot, 0::BIGINT AS n_is_nsfw, 0::BIGINT AS n_author_is_nsfw, count(*) FILTER (spam) AS n_is_spam, 0::BIGINT AS n_is_hate, count(*) FILTER (NOT spam) AS n_passed_filters FROM v""")
def agg_filter_outcomes(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("author_did"), F.col("lang").alias("langs"), F.when(F.col("doc_id") % 11 == 0, "sale # # #").otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("labels"))
    return FL.outcome_counts(FL.preprocess(d))


@register("agg_before_after", """
WITH m AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'before' ELSE 'after' END AS period, count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY 1)
SELECT period, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(sd / sqrt(n), 6) AS standard_error FROM m""")
def agg_before_after(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "before").otherwise("after").alias("period")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"))
    return m.select("period", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round(F.col("sd") / F.sqrt("n"), 6).alias("standard_error"))


@register("join_impute_lookup", """
WITH f AS (SELECT o_orderkey % 50 AS feed_id, max('feed ' || o_custkey) AS feed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT event_id, CASE WHEN event_type = 'error' THEN f.feed ELSE props END AS feed FROM events LEFT JOIN f ON f.feed_id = event_id % 60""")
def join_impute_lookup(spark, sf):
    feeds = table(spark, sf, "orders").select((F.col("o_orderkey") % 50).alias("feed_id"), F.when(F.col("o_orderstatus") == "F", "default").otherwise("u").alias("user"), F.concat(F.lit("feed "), F.col("o_custkey").cast("string")).alias("feed"))
    sessions = table(spark, sf, "events").select("event_id", (F.col("event_id") % 60).alias("feed_id"), F.when(F.col("event_type") == "error", "backfill").otherwise("x").alias("cursor"), F.col("props").alias("feed"))
    return US.impute_feeds(sessions, feeds).select("event_id", "feed")


@register("filter_users_repair", """
WITH u AS (SELECT c_custkey, CASE c_name WHEN 'Customer#000000003' THEN 'Customer#000000004' ELSE c_name END AS handle, (c_custkey % 2 + 1)::VARCHAR AS wave FROM customer)
SELECT c_custkey, handle, wave FROM u WHERE handle NOT IN ('Customer#000000007', 'Customer#000000008') AND NOT (handle = 'Customer#000000010' AND wave = '1') AND NOT (handle = 'Customer#000000011' AND wave = '1')""")
def filter_users_repair(spark, sf):
    u = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("handle"), (F.col("c_custkey") % 2 + 1).cast("string").alias("wave"))
    name = "Customer#0000000{:02d}".format
    return US.repair(u, "handle", {name(3): name(4)}, (name(7), name(8)), "wave", {name(10): "1", name(11): "1"})


@register("fn_static_week", """
WITH e AS (SELECT event_id, ts::DATE AS day, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS wave FROM events)
SELECT event_id, CASE WHEN wave = 'a' THEN CASE WHEN day <= DATE '2024-01-07' THEN 1 WHEN day <= DATE '2024-01-14' THEN 2 END ELSE CASE WHEN day <= DATE '2024-01-10' THEN 1 WHEN day <= DATE '2024-01-20' THEN 2 WHEN day <= DATE '2024-01-28' THEN 3 END END AS week FROM e""")
def fn_static_week(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("wave"))
    return US.static_week(e, "day", "wave", {"a": ["2024-01-07", "2024-01-14"], "b": ["2024-01-10", "2024-01-20", "2024-01-28"]}).select("event_id", "week")


@register("fn_lookback", """
SELECT event_id, strftime(greatest((ts::DATE - INTERVAL 5 DAY)::DATE, DATE '2024-01-10'), '%Y-%m-%d') AS first_day, strftime(ts::DATE, '%Y-%m-%d') AS last_day, strftime(date_trunc('second', ts) - INTERVAL 3 DAY, '%Y-%m-%d-%H:%M:%S') AS since FROM events""")
def fn_lookback(spark, sf):
    first, last = TM.lookback_range(F.to_date("ts"), 5, F.lit("2024-01-10").cast("date"))
    return table(spark, sf, "events").select("event_id", first.cast("string").alias("first_day"), last.cast("string").alias("last_day"), TM.lookback(F.col("ts"), 3).alias("since"))


@register("fn_entities", """
WITH w AS (SELECT unnest(regexp_split_to_array(trim(text), '\\s+')) AS w FROM documents), n AS (SELECT regexp_replace(lower(w), '^[!-/:-@\\[-`{-~]+|[!-/:-@\\[-`{-~]+$', '', 'g') AS e FROM w)
SELECT CASE e WHEN 'thee' THEN 'the' ELSE e END AS entity, count(*) AS n FROM n GROUP BY 1 HAVING count(*) >= 20""")
def fn_entities(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.split(F.trim("text"), r"\s+")).alias("w"))
    return w.groupBy(T.normal_entity(F.col("w"), {"thee": "the"}).alias("entity")).agg(F.count("*").alias("n")).where("n >= 20")


@register("fn_topic_words", """
WITH t AS (SELECT doc_id, (list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(text), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')), '\\s+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and'))) AS ws FROM documents)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(list_distinct(ws))::BIGINT AS n_distinct FROM t""")
def fn_topic_words(spark, sf):
    """Topic words of every text, all and distinct."""
    w = table(spark, sf, "documents").select("doc_id", T.topic_words(F.col("text"), ("the", "and")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@register("fn_facets", "SELECT user_id, string_agg(DISTINCT 'tag:' || event_type, ',' ORDER BY 'tag:' || event_type) AS facets FROM events GROUP BY 1")
def fn_facets(spark, sf):
    f = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("t"))  # five types at most
    return f.select("user_id", N.facets(F.transform("t", lambda x: F.struct(F.lit("tag").alias("kind"), x.alias("value")))).alias("facets"))


@register("fn_engaged_uri", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'p' || (event_id - 1) WHEN 'view' THEN 'u' || event_id ELSE 's' || user_id END AS engaged FROM events""")
def fn_engaged_uri(spark, sf):
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "reply").when(F.col("event_type") == "view", "post").otherwise("like")
    subject = F.to_json(F.struct(F.lit("c").alias("cid"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("uri")))
    reply = F.to_json(F.struct(F.struct(F.concat(F.lit("p"), (i - 1).cast("string")).alias("uri")).alias("parent")))
    return table(spark, sf, "events").select("event_id", N.engaged_uri(kind, F.concat(F.lit("u"), i.cast("string")), subject, reply).alias("engaged"))


@register("graph_follow_edges", """
SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey ELSE l_partkey END AS "user", CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS other FROM lineitem""")
def graph_follow_edges(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("follow_did"), F.col("l_partkey").alias("follower_did"), F.when(F.col("l_linenumber") % 2 == 0, "follower").otherwise("follow").alias("relationship_to_study_user"))
    return G.follow_edges(rows)


@register("set_consolidated_schema", """
SELECT uri, author_did, text, source, like_count, passed_filters FROM (SELECT doc_id::VARCHAR AS uri, source AS author_did, lang AS text, 'firehose' AS source, n_chars AS like_count, NULL::BOOLEAN AS passed_filters FROM documents
UNION ALL SELECT conv_id || '/' || turn, role, 'x', 'most_liked', NULL, NULL FROM conversations)""")
def set_consolidated_schema(spark, sf):
    """Two kinds of records in the one schema of preprocessed posts, typed nulls where a kind lacks a column."""
    from tidewater.operators.sets import union_all

    want = CT.DATASETS["preprocessed_posts"].columns
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uri"), F.col("source").alias("author_did"), F.col("lang").alias("text"), F.lit("firehose").alias("source"), F.col("n_chars").alias("like_count"))
    c = table(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uri"), F.col("role").alias("author_did"), F.lit("x").alias("text"), F.lit("most_liked").alias("source"))
    return union_all([CT.coerce(d, want), CT.coerce(c, want)]).select("uri", "author_did", "text", "source", "like_count", "passed_filters")


@register("ml_classify_pluggable", "SELECT doc_id, (length(text) >= 200)::INT AS label, length(text)::BIGINT AS score FROM documents")
def ml_classify_pluggable(spark, sf):
    """A scorer in batches of pandas frames; a model would stand where the length rule stands."""
    d = table(spark, sf, "documents").select("doc_id", "text")

    def scorer(frame):
        n = frame["text"].str.len().astype("Int64")  # null for null texts
        return frame[["doc_id"]].assign(label=(n >= 200).astype("Int32"), score=n)

    return TS.classify(d, scorer, "doc_id long, label int, score long")


@register("ml_topics")
def ml_topics(spark, sf):
    """Ten topics of embeddings by k-means: sizes and the main label of each, tested for purity."""
    t = US.topics(table(spark, sf, "embeddings"), "embedding", 10)
    return A.typed(t.withColumn("one", F.lit(1)), ["topic"], ["one"], ["label"]).select("topic", "label")


@register("io_csv_report", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def io_csv_report(spark, sf):
    path = scratch_path(spark, "report")
    r = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    ST.write_report(r, path)
    return ST.read_results(spark, path, r.schema)


@register("io_jsonl_round_trip", "SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events")
def io_jsonl_round_trip(spark, sf):
    path = scratch_path(spark, "jsonl")
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    e.write.json(path)
    return spark.read.schema(e.schema).json(path)


@register("io_route_by_type", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS partition_date FROM events WHERE event_type = 'purchase' AND ts::DATE = DATE '2024-01-12'")
def io_route_by_type(spark, sf):
    """Written by record type and day; one type and day read back, the rest pruned."""
    root = scratch_path(spark, "routed")
    d = CT.Dataset("records", "event_id bigint, event_type string, ts string", "event_id", "ts")
    ST.write(table(spark, sf, "events").withColumn("ts", F.date_format("ts", TM.PIPELINE_FORMAT)), root, d, "2024-02-01", extra=("event_type",))
    return spark.read.parquet(f"{root}/records").where("event_type = 'purchase' and partition_date = '2024-01-12'").select("event_id", F.col("partition_date").cast("string").alias("partition_date"))
