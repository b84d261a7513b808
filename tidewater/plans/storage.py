"""Registered queries that write, compact and stream."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.time import PIPELINE_FORMAT
from tidewater.plans.registry import register, table
from tidewater.sources import queue as Q
from tidewater.sources import storage as ST
from tidewater.sources.catalog import Dataset
from tidewater.sources.scratch import scratch_path
from tidewater.streaming import ingest as I  # noqa: E741

_EVENTS = Dataset("event_log", "event_id bigint, user_id bigint, event_type string, value double, ts string", "user_id", "ts")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.date_format("ts", PIPELINE_FORMAT))


@register("io_partition_write_read", """
SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS partition_date, CASE WHEN ts::DATE >= DATE '2024-01-29' THEN 'active' ELSE 'cache' END AS tier FROM events WHERE ts::DATE BETWEEN DATE '2024-01-20' AND DATE '2024-01-30'""")
def io_partition_write_read(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "event-log")
    ST.write(_log(spark, sf), root, _EVENTS, "2024-01-31")
    return ST.read(spark, root, _EVENTS, start="2024-01-20", end="2024-01-30").select("event_id", "event_type", "partition_date", "tier")


@register("io_compact_dedupe", """
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS partition_date FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d-%H:%M:%S') DESC, strftime(ts, '%Y-%m-%d')) AS r FROM events) WHERE r = 1""")
def io_compact_dedupe(spark, sf):
    root = scratch_path(spark, "event-log")
    ST.write(_log(spark, sf), root, _EVENTS, "2024-01-31")
    ST.compact(spark, root, _EVENTS, f"{root}-compact", "2024-01-31")
    return ST.read(spark, f"{root}-compact", _EVENTS).select("user_id", "event_id", "partition_date")


@register("io_latest_per_source", """
SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 25""")
def io_latest_per_source(spark, sf):
    e = table(spark, sf, "events").withColumn("uri", F.col("event_id"))
    return ST.latest_per_source(e, "ts", "event_type", 25).select("event_type", "event_id")


@register("io_queue_round_trip", """
SELECT floor(o_orderkey / 1000)::BIGINT AS batch_id, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders WHERE floor(o_orderkey / 1000) > 0 GROUP BY 1""")
def io_queue_round_trip(spark, sf):
    """Orders queued in batches of 1000; the first batch is taken, the rest is pending."""
    path = scratch_path(spark, "queue")
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), "o_orderkey", "o_custkey", "o_orderstatus")
    Q.enqueue(Q.chunks(items, "i", created_at="2024-01-01-00:00:00"), path)
    Q.mark(spark, Q.load(spark, path, limit=1), "processing", "2024-01-01-00:00:01", path)
    got = Q.items(Q.load(spark, path, status="pending"), "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    return got.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@register("io_queue_claims", """
SELECT floor(o_orderkey / 1000)::BIGINT AS batch_id, 1::BIGINT AS n_takers, count(*) AS n FROM orders GROUP BY 1""")
def io_queue_claims(spark, sf):
    """Two takers at once empty a queue; each batch is in one taker's hands only, and finished by it."""
    path = scratch_path(spark, "queue")
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), "o_orderkey")
    Q.enqueue(Q.chunks(items, "i", created_at="2024-01-01-00:00:00"), path)

    def work(taker: str) -> list[tuple[int, str]]:
        done = []
        for ids in Q.lots(spark, path, taker, limit=100):
            done += [(i, taker) for i in Q.finish(spark, path, taker, ids, "2024-01-01-00:00:02")]
        return done

    with ThreadPoolExecutor(2) as pool:
        taken = [x for found in pool.map(work, ("a", "b")) for x in found]
    takers = spark.createDataFrame(taken, "batch_id long, taker string").groupBy("batch_id").agg(F.count("*").alias("n_takers"))
    got = Q.items(Q.load(spark, path, status="completed"), "o_orderkey bigint").groupBy("batch_id").agg(F.count("*").alias("n"))
    return takers.join(got, "batch_id", "left")


def _as_messages(spark: SparkSession, sf: str, tasks: int | None = None) -> DataFrame:
    """Events as messages (event_id, value): views are posts, clicks are likes of the post before, signups follow."""
    e = table(spark, sf, "events")
    e = e.repartition(tasks) if tasks else e
    did = lambda c: F.concat(F.lit("did:"), c.cast("string"))
    uri = lambda c: F.concat(F.lit("at://post/"), c.cast("string"))
    kind = F.element_at(F.create_map(*[F.lit(x) for p in {"view": "post", "click": "like", "signup": "follow", "purchase": "reply", "error": "post"}.items() for x in p]), F.col("event_type"))
    record = F.struct(
        uri(F.col("event_id")).alias("uri"), F.lit("text").alias("text"), F.lit(None).cast("string").alias("created_at"),
        F.when(F.col("event_type") == "click", uri(F.col("event_id") - 1)).alias("subject_uri"), F.when(F.col("event_type") == "signup", did((F.col("user_id") * 7) % 150)).alias("subject_did"),
        F.when(F.col("event_type") == "purchase", uri(F.col("event_id") - 1)).alias("parent_uri"), F.lit(None).cast("string").alias("root_uri"),
    )
    op = F.when(F.col("event_type") == "error", "delete").otherwise("create")
    commit = F.struct(op.alias("operation"), F.concat(F.lit("app.feed."), kind).alias("collection"), F.col("event_id").cast("string").alias("rkey"), record.alias("record"))
    return e.select("event_id", "event_type", F.to_json(F.struct(did(F.col("user_id")).alias("did"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), F.lit("commit").alias("kind"), commit.alias("commit"))).alias("value"))


def _messages(spark: SparkSession, sf: str, path: str) -> None:
    m = _as_messages(spark, sf).select("value")
    m.union(spark.createDataFrame([("not json",), ('{"kind":"commit"}',)], "value string")).write.text(path)


def _people(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("did:"), F.col("c_custkey").cast("string")).alias("did"), F.col("c_custkey").alias("id"))


def _routed(spark: SparkSession, sf: str, root: str, per_trigger: int | None = None) -> None:
    """One run of the routing stream over what lies in root/in."""
    people = _people(spark, sf)
    q = I.route_stream(I.read_lines(spark, f"{root}/in", per_trigger), people.where("id % 5 = 0").select("did"), people.where("id % 3 = 0").select("did"), f"{root}/posts", f"{root}/out", f"{root}/checkpoint", rejected_path=f"{root}/rejected")
    q.awaitTermination()


_ROUTES_SQL = """
WITH e AS (SELECT *, user_id % 5 = 0 AS is_study, user_id % 3 = 0 AS is_near, (user_id * 7) % 150 % 5 = 0 AS on_study FROM events), s AS (SELECT event_id FROM e WHERE is_study AND event_type IN ('view', 'purchase')),
x AS (SELECT e.*, s.event_id IS NOT NULL AS on_post FROM e LEFT JOIN s ON e.event_id - 1 = s.event_id),
r AS (SELECT 'study_user_' || CASE event_type WHEN 'view' THEN 'post' WHEN 'click' THEN 'like' ELSE 'reply' END AS route FROM x WHERE is_study AND event_type IN ('view', 'click', 'purchase')
UNION ALL SELECT 'like_on_study_user_post' FROM x WHERE on_post AND event_type = 'click' UNION ALL SELECT 'reply_to_study_user_post' FROM x WHERE on_post AND event_type = 'purchase'
UNION ALL SELECT 'in_network_post' FROM x WHERE is_near AND NOT is_study AND event_type IN ('view', 'purchase') UNION ALL SELECT 'study_user_follows' FROM x WHERE is_study AND event_type = 'signup' UNION ALL SELECT 'study_user_followed' FROM x WHERE on_study AND event_type = 'signup')
SELECT route, count(*) AS n FROM r GROUP BY 1"""


@register("stream_route_batch", _ROUTES_SQL)
def stream_route_batch(spark, sf):
    root = scratch_path(spark, "stream")
    _messages(spark, sf, f"{root}/in")
    _routed(spark, sf, root)
    return spark.read.parquet(f"{root}/out").groupBy("route").agg(F.count("*").alias("n"))


@register("stream_late_and_early", _ROUTES_SQL)
def stream_late_and_early(spark, sf):
    """The same routes, whatever the order: messages come in micro-batches dealt by id, so that of likes
    and replies many come before their post, others hours after it, and half of them after a restart."""
    root, files = scratch_path(spark, "stream"), spark.sparkContext.defaultParallelism
    m = _as_messages(spark, sf, files).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    for run in range(2):
        for part in (2 * run, 2 * run + 1):
            m.where(F.col("part") == part).select("value").write.mode("append").text(f"{root}/in")
        _routed(spark, sf, root, per_trigger=files)
    return spark.read.parquet(f"{root}/out").groupBy("route").agg(F.count("*").alias("n"))


@register("stream_rejected", """
WITH r AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'malformed' WHEN event_id % 7 = 1 THEN 'no_author' WHEN event_id % 7 = 2 THEN 'no_time' WHEN event_id % 7 = 3 THEN 'unknown_kind' WHEN event_id % 7 = 4 THEN 'no_operation' WHEN event_id % 7 = 5 AND event_type <> 'error' THEN 'no_address' END AS reason, event_id FROM events)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def stream_rejected(spark, sf):
    """Six of seven messages are broken in one way each; every one is kept with its reason, in two runs."""
    root = scratch_path(spark, "stream")
    m, k = _as_messages(spark, sf), F.col("event_id") % 7
    without = lambda pattern: F.regexp_replace("value", pattern, "")
    broken = F.when(k == 0, F.expr("left(value, length(value) - 3)")).when(k == 1, without('"did":"[^"]*",')).when(k == 2, without('"time_us":[0-9]*,')).when(k == 3, F.regexp_replace("value", '"kind":"commit"', '"kind":"odd"'))
    broken = broken.when(k == 4, without('"operation":"[^"]*",')).when(k == 5, without('"uri":"[^"]*",')).otherwise(F.col("value"))
    m = m.select(broken.alias("value"), (F.col("event_id") % 2).alias("run"))
    for run in range(2):
        m.where(F.col("run") == run).select("value").write.mode("append").text(f"{root}/in")
        _routed(spark, sf, root)
    return spark.read.parquet(f"{root}/rejected").groupBy("reason").agg(F.count("*").alias("n"))


@register("stream_windowed", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_windowed(spark, sf):
    """Daily tumbling windows over an event stream: a batch writes the windows that it changed, of each the last counts."""
    e = table(spark, sf, "events").schema
    source = spark.readStream.schema(e).parquet(f"{sf}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))
    root = scratch_path(spark, "windowed")
    w = I.windowed(source, "at", ["event_type"], "value", "10 minutes", "1 day")
    land = lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    w.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "x.n", F.round("x.total", 4).alias("total"))


@register("stream_incremental", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_incremental(spark, sf):
    """Two runs over a growing folder: the second processes only what is new."""
    root = scratch_path(spark, "incremental")
    e = table(spark, sf, "events").select("event_id", "event_type")

    def run() -> None:
        source = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        land = lambda b, n: b.groupBy("event_type").count().write.mode("overwrite").parquet(f"{root}/out/batch={n}")
        I.incremental(source, land, f"{root}/checkpoint").awaitTermination()

    e.where("event_id % 2 = 0").write.parquet(f"{root}/in")
    run()
    e.where("event_id % 2 = 1").write.mode("append").parquet(f"{root}/in")
    run()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.sum("count").alias("n"))
