"""Registered window, top-k and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import topk as K
from tidewater.operators import windows as W
from tidewater.plans.registry import register, table


@register("win_latest_by_pk", """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1 AND o_orderdate >= TIMESTAMP '2001-01-01'""")
def win_latest_by_pk(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return W.latest(o, "o_custkey", "day", "o_orderkey", since="2001-01-01").select("o_custkey", "o_orderkey", "day")


@register("win_latest_since_first", """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') WHERE r = 1""")
def win_latest_since_first(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return W.latest(o, "o_custkey", "day", "o_orderkey", since="2001-01-01", since_first=True).select("o_custkey", "o_orderkey", "day")


@register("win_latest_label_nulls_last", """
WITH l AS (SELECT user_id, event_id, event_type, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d-%H:%M:%S') ELSE 'bad' END AS label_timestamp FROM events)
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY try_strptime(label_timestamp, '%Y-%m-%d-%H:%M:%S') DESC NULLS LAST, event_id) AS r FROM l) WHERE r = 1""")
def win_latest_label_nulls_last(spark, sf):
    from tidewater.functions.time import PIPELINE_FORMAT

    e = table(spark, sf, "events").withColumn("label_timestamp", F.when(F.col("event_type") != "error", F.date_format("ts", PIPELINE_FORMAT)).otherwise("bad"))
    e = e.withColumn("at", F.try_to_timestamp("label_timestamp", F.lit(PIPELINE_FORMAT)))
    return W.latest(e, "user_id", "at", "event_id").select("user_id", "event_id", "event_type")


@register("win_top_pct", """
WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS place, count(*) OVER () AS total FROM c)
SELECT user_id, n, place::INT AS place, total FROM r WHERE place <= floor(total * 0.1)""")
def win_top_pct(spark, sf):
    return W.top_share(table(spark, sf, "events"), "user_id", 0.1)


@register("win_head_n_per_group", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5""")
def win_head_n_per_group(spark, sf):
    return W.first_n(table(spark, sf, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 5).select("user_id", "event_id", "value")


@register("win_latest_with_ties", """
SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1""")
def win_latest_with_ties(spark, sf):
    return W.first_n(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate")], 1, ties=True).select("o_custkey", "o_orderkey")


@register("win_running_cap", """
WITH w AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS met FROM events)
SELECT user_id, event_id FROM w WHERE event_type <> 'error' OR met <= 3""")
def win_running_cap(spark, sf):
    return W.running_cap(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", 3).select("user_id", "event_id")


@register("win_batch_prefix", """
WITH s AS (SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM s)
SELECT l.l_suppkey, l.l_orderkey, l_linenumber, l_partkey FROM lineitem l JOIN c ON l.l_suppkey = c.l_suppkey AND l.l_orderkey = c.l_orderkey WHERE s <= 50""")
def win_batch_prefix(spark, sf):
    return W.whole_batches(table(spark, sf, "lineitem"), "l_orderkey", 50, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@register("win_share_in_slice", """
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share FROM c""")
def win_share_in_slice(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return W.share_in(c, ["o_orderstatus"], "n").withColumn("share", F.round("share", 6))


_HALVES = """WITH b AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), a AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
rb AS (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id)::INT AS place_before FROM b QUALIFY place_before <= 20), ra AS (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id)::INT AS place_after FROM a QUALIFY place_after <= 20)"""


def _halves(spark, sf):
    e = table(spark, sf, "events")
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    return (e.where(c).groupBy("user_id").agg(F.count("*").alias("n")) for c in (cut, ~cut))


@register("win_rank_change", _HALVES + " SELECT user_id, place_before, place_after, place_before - place_after AS change FROM rb JOIN ra USING (user_id)")
def win_rank_change(spark, sf):
    return W.rank_changes(*_halves(spark, sf), "user_id", "n", 20)


@register("win_rank_movement", _HALVES + """
SELECT user_id, place_before, place_after, place_before - place_after AS change, (coalesce(place_before, 21) - coalesce(place_after, 21))::INT AS movement,
       CASE WHEN place_before IS NULL THEN 'New' WHEN place_after IS NULL THEN 'Dropped' WHEN abs(place_before - place_after) < 2 THEN 'No Change' WHEN place_before > place_after THEN 'Improved' ELSE 'Declined' END AS category
FROM rb FULL JOIN ra USING (user_id)""")
def win_rank_movement(spark, sf):
    return W.rank_movement(W.rank_changes(*_halves(spark, sf), "user_id", "n", 20, outer=True), 20)


@register("topk_per_pool", """
SELECT 'by_time' AS pool, event_id, (row_number() OVER (ORDER BY ts DESC, event_id))::INT AS position FROM events QUALIFY position <= 50
UNION ALL SELECT 'by_value', event_id, (row_number() OVER (ORDER BY value DESC, event_id))::INT AS position FROM events QUALIFY position <= 50""")
def topk_per_pool(spark, sf):
    e = table(spark, sf, "events")
    pools = e.select(F.lit("by_time").alias("pool"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("o")).union(e.select(F.lit("by_value"), "event_id", "value"))
    # the first 50 of each pool, then their places
    best = W.first_n(pools, ["pool"], [F.desc("o"), F.col("event_id")], 50)
    return K.positions(best, ["pool"], [F.desc("o"), F.col("event_id")]).select("pool", "event_id", (F.col("position") + 1).alias("position"))


@register("topk_latest_one", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 1")
def topk_latest_one(spark, sf):
    return table(spark, sf, "events").where("user_id = 7").orderBy(F.desc("ts"), "event_id").limit(1).select("event_id", "user_id", "event_type")


@register("topk_most_common", "SELECT p_type, count(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1 ORDER BY n DESC, p_type LIMIT 3")
def topk_most_common(spark, sf):
    c = table(spark, sf, "part").join(table(spark, sf, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_type").agg(F.count("*").alias("n"))
    return K.top_n(c, "n", "p_type", 3)


@register("topk_clip_truncate", """
SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1)::INT AS position FROM events QUALIFY position < 20""")
def topk_clip_truncate(spark, sf):
    return K.positions(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")]).where("position < 20").select("user_id", "event_id", "position")


@register("topk_too_short", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) < 60")
def topk_too_short(spark, sf):
    return K.too_short(table(spark, sf, "events"), ["user_id"], 60)


@register("topk_page_after_cursor", """
WITH f AS (SELECT o_orderkey::VARCHAR AS item, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders)
SELECT item, position FROM f WHERE position > (SELECT min(position) FROM f WHERE sha256(item) = (SELECT sha256(item) FROM f WHERE position = 41)) ORDER BY position LIMIT 30""")
def topk_page_after_cursor(spark, sf):
    o = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)  # a feed: a top list of bounded length
    f = K.positions(o.select(F.col("o_orderkey").cast("string").alias("item"), "o_totalprice", "o_orderkey", F.lit(0).alias("feed")), ["feed"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    cursor = f.where("position = 41").select(F.sha2("item", 256)).first()[0]
    return K.page_after(f.select("item", F.col("position").cast("long").alias("position")), "position", "item", cursor)


_PLACE = "('0x' || substr(md5('42:' || {}), 1, 10))::BIGINT / 1099511627776.0"


@register("topk_sample_n", f"SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_PLACE.format('c_custkey')}, c_custkey) <= 100")
def topk_sample_n(spark, sf):
    """Seeded sample of 100 users a segment; the same on every run, tested for size and repetition."""
    return K.sample_n(table(spark, sf, "customer"), "c_custkey", 100, by=["c_mktsegment"])


@register("topk_jitter", f"""
WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS position, count(*) OVER (PARTITION BY user_id) - 1 AS last FROM events),
m AS (SELECT *, least(greatest(position + floor({_PLACE.format('event_id')} * 5) - 2, 0), last) AS moved FROM p)
SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY moved, position) - 1)::INT AS position FROM m""")
def topk_jitter(spark, sf):
    """Jittered positions of every user's events, a permutation of the original ones."""
    p = K.positions(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")])
    return K.jitter(p, ["user_id"], "position", "event_id", 2, 42).select("user_id", "event_id", "position")
