"""Registered queries of single rules: sources, checks, filters, forms of records, samples, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import labels as L
from tidewater.functions import nested as N
from tidewater.functions import text as T
from tidewater.functions import time as TM
from tidewater.operators import feeds as FD
from tidewater.operators import filters as FL
from tidewater.operators import graph as G
from tidewater.operators import joins as J
from tidewater.operators import sets as U
from tidewater.operators import stats as ST
from tidewater.operators import telemetry as TE
from tidewater.operators import text_stats as TS
from tidewater.operators import topk as K
from tidewater.plans.registry import register, table
from tidewater.plans.storage import _EVENTS, _log, _messages
from tidewater.plans.windows import _PLACE
from tidewater.sources import catalog as CT
from tidewater.sources import queue as Q
from tidewater.sources import storage as S
from tidewater.sources.scratch import scratch_path
from tidewater.streaming import ingest as I  # noqa: E741

# ---- sources and sinks ----------------------------------------------------------------------


@register("io_sql_over_views", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value >= 50 AND event_type <> 'error' GROUP BY 1")
def io_sql_over_views(spark: SparkSession, sf: str) -> DataFrame:
    """Views with declared columns only, and a query with named parameters."""
    CT.register_views(spark, {"event_view": (table(spark, sf, "events"), ["event_type", "value"])})
    got = CT.query(spark, f"SELECT {CT.quoted('event_type')}, count(*) AS n, round(sum(value), 4) AS total FROM event_view WHERE value >= :least AND event_type <> :not GROUP BY 1", least=50, **{"not": "error"})
    return got


@register("io_no_files", "SELECT count(*) AS n, NULL::BIGINT AS last_id, 11 AS n_days FROM events WHERE false")
def io_no_files(spark, sf):
    """No files give an empty table of the declared columns; a guarded range of days."""
    none = S.read_files(spark, [], table(spark, sf, "events").schema)
    return none.agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.lit(len(S.days_between("2024-01-20", "2024-01-30", 31))).alias("n_days"))


@register("io_one_day_batches", "SELECT count(*) AS n, strftime(ts, '%Y-%m-%d') AS partition_date FROM events WHERE ts::DATE = DATE '2024-01-07' GROUP BY 2")
def io_one_day_batches(spark, sf):
    """A day's batch, checked to be of one day, written and read by its day."""
    root = scratch_path(spark, "one-day")
    day = S.with_partition_date(_log(spark, sf), "ts").where("partition_date = '2024-01-07'")
    S.write(S.one_day(day).drop("partition_date"), root, _EVENTS, "2024-01-31")
    return S.read(spark, root, _EVENTS, day="2024-01-07").groupBy("partition_date").agg(F.count("*").alias("n"))


@register("io_tolerant_read", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def io_tolerant_read(spark, sf):
    """A file that is no Parquet lies among the others; it is passed over."""
    root = scratch_path(spark, "corrupt")
    S.write(_log(spark, sf), root, _EVENTS, "2024-01-31")
    spark.range(1).select(F.lit("no parquet").alias("value")).coalesce(1).write.mode("append").text(f"{root}/{_EVENTS.name}/tier=cache/partition_date=2024-01-05")
    return S.read(spark, root, _EVENTS, tolerant=True).groupBy("event_type").agg(F.count("*").alias("n"))


@register("io_after_time", "SELECT event_id FROM events WHERE (year(ts), month(ts), day(ts), hour(ts), minute(ts)) > (2024, 1, 15, 12, 30)")
def io_after_time(spark, sf):
    root = scratch_path(spark, "by-minute")
    e = table(spark, sf, "events").select("event_id", *[getattr(F, k)("ts").alias(k) for k in ("year", "month", "day", "hour", "minute")])
    e.repartition("year", "month", "day").write.partitionBy("year", "month", "day").parquet(root)
    return S.after(spark.read.parquet(root), 2024, 1, 15, 12, 30).select("event_id")


@register("io_delete_and_backup", """
SELECT 'left' AS what, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts::DATE <> DATE '2024-01-10' GROUP BY 2 UNION ALL SELECT 'kept', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2""")
def io_delete_and_backup(spark, sf):
    """All days kept in a copy, one day gone from another."""
    root = scratch_path(spark, "delete")
    S.write(_log(spark, sf), root, _EVENTS, "2024-01-31")
    S.backup(spark, f"{root}/{_EVENTS.name}", f"{root}-kept/{_EVENTS.name}")
    S.delete(spark, root, _EVENTS, f"{root}-left", "2024-01-10")
    one = lambda where, what: S.read(spark, where, _EVENTS).groupBy(F.col("partition_date").alias("day")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "day", "n")
    return one(f"{root}-left", "left").union(one(f"{root}-kept", "kept"))


@register("io_newest_files", "SELECT count(DISTINCT ts::DATE) AS n_active FROM events")
def io_newest_files(spark, sf):
    """The newest file of every day's folder stays active."""
    root = scratch_path(spark, "newest")
    for part in (0, 1):
        S.write(_log(spark, sf).where(F.col("event_id") % 2 == part), root, _EVENTS, "2024-01-31")
    return S.newest_files(S.read(spark, root, _EVENTS), 1).agg(F.count_if(F.col("tier") == "active").alias("n_active"))


@register("io_json_and_tiers", """
SELECT event_id, event_type FROM events WHERE strftime(ts, '%Y-%m-%d-%H:%M:%S') >= '2024-01-12-06:00:00' AND event_type = 'click' AND ts::DATE BETWEEN DATE '2024-01-12' AND DATE '2024-01-13'""")
def io_json_and_tiers(spark, sf):
    """JSON files by tier and day, of both tiers, rows told apart by id, read by source, day and recency."""
    root = scratch_path(spark, "json")
    S.write(_log(spark, sf), root, _EVENTS, "2024-01-15", fmt="json")
    both = [S.read(spark, root, _EVENTS, tiers=(t,), start="2024-01-12", end="2024-01-13", since="2024-01-12-06:00:00", fmt="json") for t in ("cache", "active", "cache")]
    return U.union_all(both).dropDuplicates(["event_id"]).where("event_type = 'click'").select("event_id", "event_type")


@register("io_repartition_checked", "SELECT strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS partition_date, count(*) AS n, true AS same FROM events GROUP BY 1")
def io_repartition_checked(spark, sf):
    """The same rows under another time column's days, checked against the old ones."""
    root = scratch_path(spark, "moved")
    two = CT.Dataset("event_log", "event_id bigint, ts string, later string", "event_id", "ts")
    rows = table(spark, sf, "events").select("event_id", F.date_format("ts", TM.PIPELINE_FORMAT).alias("ts"), F.date_format(F.col("ts") + F.expr("INTERVAL 1 DAY"), TM.PIPELINE_FORMAT).alias("later"))
    S.write(rows, root, two, "2024-01-31")
    same = S.repartition_by(spark, root, two, "later", f"{root}-later", "2024-01-31")
    return S.read(spark, f"{root}-later", two).groupBy("partition_date").agg(F.count("*").alias("n")).withColumn("same", F.lit(same))


@register("io_queue_edges", """
WITH b AS (SELECT floor(o_orderkey / 1000)::BIGINT AS id, count(*) AS n FROM orders GROUP BY 1) SELECT id, n, CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM b WHERE id <> 1""")
def io_queue_edges(spark, sf):
    """Labels split by success; failed batches marked so, one deleted by id."""
    path = scratch_path(spark, "queue")
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), "o_orderkey")
    Q.enqueue(Q.chunks(items, "i"), path)
    ok, bad = Q.split_labels(Q.load(spark, path).withColumn("was_successfully_labeled", F.when(F.col("id") % 3 != 0, True)))
    Q.mark(spark, ok, "completed", "1", path)
    Q.mark(spark, bad, "failed", "1", path)
    left = Q.without(Q.load(spark, path), spark.createDataFrame([(1,)], "id long"))
    n = Q.items(left, "o_orderkey bigint").groupBy(F.col("batch_id").alias("id")).agg(F.count("*").alias("n"))
    return left.select("id", "status").join(n, "id")


@register("set_without_artefacts", "SELECT event_id, event_type FROM events")
def set_without_artefacts(spark, sf):
    """Columns that compaction leaves behind are not read."""
    return CT.without_artefacts(table(spark, sf, "events").select("event_id", "event_type", F.lit(1).alias("row_num"), F.lit("x").alias("startTimestamp")))


@register("set_tiers_then_distinct", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind FROM events")
def set_tiers_then_distinct(spark, sf):
    """Days of files with unlike columns, some rows in two tiers, one row an id."""
    e = table(spark, sf, "events")
    even, odd = e.where("event_id % 2 = 0").select("event_id", F.col("event_type").alias("kind")), e.where("event_id % 2 = 1").select("event_id")
    return U.union_all([even, odd, even.where("event_id % 3 = 0")]).dropDuplicates(["event_id"])


@register("set_same_rows", "SELECT true AS alike, false AS unlike FROM events LIMIT 1")
def set_same_rows(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type")
    return spark.createDataFrame([(U.same_rows(e, e.repartition("user_id")), U.same_rows(e, e.union(e.limit(1))))], "alike boolean, unlike boolean")


# ---- predicates and projections ---------------------------------------------------------------


@register("filter_nsfw_words", """
SELECT doc_id FROM documents WHERE source IN ('src1', 'src3') OR contains(text, 'porn') OR contains(text, 'furry') OR contains(text, 'sexual') OR contains(text, 'nudity') OR contains(text, 'gore') OR contains(text, 'graphic-media')""")
def filter_nsfw_words(spark, sf):
    """A hidden label in the list of labels, or such a word anywhere in the text."""
    labels = F.when(F.col("source") == "src1", "cat,nudity").when(F.col("source") == "src3", "gore").otherwise("cat,dog")
    return table(spark, sf, "documents").where(T.holds_nsfw(F.col("text"), labels)).select("doc_id")


@register("filter_valid_labels", "SELECT doc_id, toxic FROM labels WHERE CASE WHEN doc_id % 5 = 0 THEN -1 WHEN doc_id % 7 = 0 THEN NULL ELSE toxic END IN (0, 1)")
def filter_valid_labels(spark, sf):
    label = F.when(F.col("doc_id") % 5 == 0, -1).when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("toxic"))
    return table(spark, sf, "labels").where(L.valid_binary(label)).select("doc_id", "toxic")


@register("filter_metric_columns", """
SELECT * FROM (VALUES ('feed_average_moral'), ('feed_average_moral_outrage')) AS v(name)""")
def filter_metric_columns(spark, sf):
    """A metric's column by its label: moral, and not moral_outrage, which ends otherwise."""
    columns = [f"feed_{m}_{k.removeprefix('prob_')}" for k in L.LABELS for m in ("average", "proportion")]
    return spark.createDataFrame([(c,) for k in ("moral", "moral_outrage") for c in L.metric_columns(columns, "average", k)], "name string")


@register("filter_study_time", """
WITH d AS (SELECT event_id, ts::DATE AS day, CASE event_id % 4 WHEN 0 THEN 'Reverse Chronological' WHEN 1 THEN 'Diversified Extremity' WHEN 2 THEN 'Engagement-Based' ELSE 'other' END AS condition FROM events), m AS (SELECT min(day) AS a, max(day) AS e FROM d)
SELECT event_id, condition, (day - a)::INT AS study_day, (day - a) - (e - a) / 2.0 AS day_centered, (day > DATE '2024-01-15')::INT AS is_post, CASE WHEN day > DATE '2024-01-15' THEN 'Post' ELSE 'Pre' END AS period FROM d, m""")
def filter_study_time(spark, sf):
    """Conditions by their names as shown, days since the start and from the middle, before and after."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "reverse_chronological").when(k == 1, "representative_diversification").when(k == 2, "engagement").otherwise("other")
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), FL.recode_conditions(raw).alias("condition"))
    return FL.with_study_time(e, "day", "2024-01-15").drop("day")


@register("filter_chosen", """
SELECT event_id FROM events WHERE (contains(lower(props), '7') OR contains(lower(props), '3')) AND event_type IN ('click', 'view') AND strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-25' AND user_id::VARCHAR IN ('1', '2', '3', '5', '8', '13', '21', '34')
AND event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 = 0 IS NOT NULL AND CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 7 = 1 END IS NOT DISTINCT FROM false ORDER BY event_id LIMIT 200""")
def filter_chosen(spark, sf):
    """The whole set of filters: words, tags, days, handles, valence, toxicity, politics, slant, and a number of rows."""
    i = F.col("event_id")
    e = table(spark, sf, "events")
    columns = {
        "text": F.col("props"), "hashtags": F.array("event_type"), "date": F.date_format("ts", "yyyy-MM-dd"), "user": F.col("user_id").cast("string"), "valence": F.when(i % 2 == 0, "positive").otherwise("negative"),
        "toxic": F.when(i % 7 != 0, i % 7 == 1), "political": i % 3 != 0, "slant": F.lit("left"),
    }
    filters = {"Content": {"keywords": ["7", "3"], "hashtags": ["click", "view"]}, "Temporal": {"date_range": "2024-01-05 to 2024-01-25"}, "User": {"handles": ["1", "2", "3", "5", "8", "13", "21", "34"]}, "Sentiment": {"valence": "positive", "toxicity": "Not Toxic"}, "Political": {"political": "Yes", "slant": "left"}, "General": {"max_results": 200}}
    preds, n = FL.chosen(filters, columns)
    return FL.dynamic(e, preds, n, [i]).select("event_id")


@register("fn_blank", """
WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN ' ' || chr(8203) || ' ' WHEN 2 THEN 'ｎｕｌｌ' WHEN 3 THEN ' NaN ' WHEN 4 THEN chr(8203) || 'none' ELSE NULL END AS t FROM documents)
SELECT doc_id, doc_id % 6 IN (1, 2, 3, 5) OR coalesce(t IN ('', 'null', 'none', 'nan'), true) AS blank FROM t""")
def fn_blank(spark, sf):
    """Invisible characters, wide letters and spellings of nothing; a hidden mark before a word is text."""
    k = F.col("doc_id") % 6
    t = F.when(k == 0, F.col("text")).when(k == 1, " ​ ").when(k == 2, "ｎｕｌｌ").when(k == 3, " NaN ").when(k == 4, "​none")
    return table(spark, sf, "documents").select("doc_id", T.is_blank(t).alias("blank"))


@register("fn_time_forms", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(date_trunc('day', ts), '%Y-%m-%d-%H:%M:%S') AS midnight, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS short, strftime(ts - INTERVAL 36 HOUR, '%Y-%m-%d-%H:%M:%S') AS cutoff, strftime(ts, '%Y-%m-%d-%H:%M:%S') AS checked FROM events""")
def fn_time_forms(spark, sf):
    t = F.date_format("ts", TM.PIPELINE_FORMAT)
    midnight = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T24:00:00"))
    long = F.concat(F.date_format("ts", TM.ISO_FORMAT), F.lit(".123456789Z"))
    return table(spark, sf, "events").select("event_id", TM.to_iso(t).alias("iso"), TM.to_pipeline(midnight).alias("midnight"), TM.first_19(long).alias("short"), TM.cutoff(F.col("ts"), 36, "hours").alias("cutoff"), TM.to_pipeline_checked(long).alias("checked"))


@register("fn_one_line", "SELECT doc_id, trim(replace(text, chr(10), ' '), ' ') AS line FROM documents")
def fn_one_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"))


@register("fn_hashtag_rules", """
WITH h AS (SELECT doc_id, unnest(regexp_extract_all(replace(replace(lower(regexp_replace(text, '(\\w)[%&*$]+', '#\\1', 'g')), 'er', ''), 'es', 'is'), '#([\\p{L}\\p{N}_]+)', 1)) AS tag FROM documents)
SELECT doc_id, tag, count(*) AS n FROM h GROUP BY 1, 2""")
def fn_hashtag_rules(spark, sf):
    """Excluded strings cut out of the text and variants replaced in it, before tags are taken; counts a document."""
    tags = T.hashtags(F.regexp_replace("text", r"(\w)[%&*$]+", "#$1"), ("er",), {"es": "is"})
    return table(spark, sf, "documents").select("doc_id", F.explode(tags).alias("tag")).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@register("fn_typed_facets", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'tag:' || event_type || ';mention:did:' || user_id WHEN 1 THEN 'link:https://x.y/' || event_id ELSE '' END AS facets FROM events""")
def fn_typed_facets(spark, sf):
    """Features by their types: tags in both spellings, links and mentions."""
    s = lambda kind, **v: F.struct(F.lit(f"app.bsky.richtext.facet{kind}").alias("py_type"), *[v.get(k, F.lit(None).cast("string")).alias(k) for k in ("tag", "uri", "did")])
    e = F.col("event_id")
    features = F.when(e % 3 == 0, F.array(s("#Tag", tag=F.col("event_type")), s(".mention", did=F.concat(F.lit("did:"), F.col("user_id").cast("string"))))).when(e % 3 == 1, F.array(s("#link", uri=F.concat(F.lit("https://x.y/"), e.cast("string"))))).otherwise(F.array().cast(f"array<{N.FEATURE_SCHEMA}>"))
    return table(spark, sf, "events").select("event_id", N.typed_facets(features).alias("facets"))


@register("fn_replies_and_embeds", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'at://p/' || event_id END AS reply_parent, CASE WHEN event_id % 2 = 0 THEN 'at://r/' || user_id END AS reply_root,
event_id % 5 IN (0, 3) AS has_image, CASE WHEN event_id % 5 IN (0, 3) THEN 'one;two ' || event_id END AS image_alt_text, event_id % 5 IN (1, 3) AS has_embedded_record, CASE WHEN event_id % 5 IN (1, 3) THEN 'at://q/' || event_id END AS record_uri,
event_id % 5 = 2 AS has_external, CASE WHEN event_id % 5 = 2 THEN 'https://x.y/' || event_id END AS external_uri FROM events""")
def fn_replies_and_embeds(spark, sf):
    """Replies' parents and roots, and embeds of four kinds, flat."""
    e, u = F.col("event_id"), F.col("user_id")
    reply = F.when(e % 2 == 0, F.format_string('{"parent":{"uri":"at://p/%d"},"root":{"uri":"at://r/%d"}}', e, u))
    images, record = '"images":[{"alt":"one"},{"alt":"two %d"}]', '"record":{"uri":"at://q/%d","cid":"c"}'
    kinds = [f'{{"py_type":"app.bsky.embed.images",{images}}}', f'{{"py_type":"app.bsky.embed.record",{record}}}', '{"py_type":"app.bsky.embed.external","external":{"uri":"https://x.y/%d","title":"t"}}', f'{{"py_type":"app.bsky.embed.recordWithMedia",{record},"media":{{"py_type":"app.bsky.embed.images",{images}}}}}']
    embed = F.lit(None).cast("string")
    for k, text in enumerate(kinds):
        embed = F.when(e % 5 == k, F.format_string(text, *[e] * text.count("%d"))).otherwise(embed)
    out = table(spark, sf, "events").select("event_id", *N.reply_refs(reply), N.flat_embed(embed).alias("e"))
    return out.select("event_id", "reply_parent", "reply_root", "e.has_image", "e.image_alt_text", "e.has_embedded_record", F.get_json_object("e.embedded_record", "$.uri").alias("record_uri"), "e.has_external", F.get_json_object("e.external", "$.uri").alias("external_uri"))


# ---- joins, aggregates, orders ----------------------------------------------------------------


@register("join_checked_weeks", """
WITH u AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), s AS (SELECT user_id, day, (day - DATE '2024-01-01')::INT // 7 + 1 AS static_week FROM u), d AS (SELECT user_id, day, (day - DATE '2024-01-01' + user_id % 3)::INT // 7 + 1 AS dynamic_week FROM u WHERE user_id % 4 <> 0)
SELECT s.user_id, strftime(s.day, '%Y-%m-%d') AS day, static_week, dynamic_week FROM s LEFT JOIN d ON s.user_id = d.user_id AND s.day = d.day""")
def join_checked_weeks(spark, sf):
    """Static and dynamic weeks joined on their keys, which must be unique on both sides."""
    u = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    since = F.datediff("day", F.lit("2024-01-01"))
    week = lambda c: (F.floor(c / 7) + 1).cast("int")
    static = u.withColumn("static_week", week(since))
    dynamic = u.where("user_id % 4 <> 0").withColumn("dynamic_week", week(since + F.col("user_id") % 3))
    return J.one_to_one(static, dynamic, ["user_id", "day"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("join_grid_one_to_one", """
WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day), v AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT u.user_id, strftime(d.day, '%Y-%m-%d') AS day, coalesce(v.n, 0) AS n FROM u CROSS JOIN d LEFT JOIN v ON v.user_id = u.user_id AND v.day = d.day""")
def join_grid_one_to_one(spark, sf):
    e = table(spark, sf, "events")
    cells = J.grid(e.select("user_id").distinct(), J.calendar(spark, "2024-01-01", "2024-01-30"))
    counts = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return J.one_to_one(cells, counts, ["user_id", "day"], fills={"n": 0}).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("win_cap_ratio", """
WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, event_type IN ('view', 'click') AS own FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY position) AS k FROM f WHERE own)
SELECT user_id, event_id FROM n WHERE k <= 12""")
def win_cap_ratio(spark, sf):
    """In-network posts of a feed, up to a share of its length."""
    p = K.positions(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")])
    feeds = p.select(F.col("user_id").alias("user"), "event_id", "position", F.col("event_type").isin("view", "click").alias("is_in_network"))
    return FD.cap_ratio(feeds, 40, 0.3).select(F.col("user").alias("user_id"), "event_id")


@register("topk_central_nodes", """
WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey), b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)
SELECT a AS node, count(*) AS degree FROM b GROUP BY 1 ORDER BY degree DESC, node LIMIT 5""")
def topk_central_nodes(spark, sf):
    return K.top_n(G.degrees(G.undirected(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")), "degree", "node", 5).select("node", "degree")


@register("topk_mixed_order", """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey))::INT AS place FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 100""")
def topk_mixed_order(spark, sf):
    """The first hundred of an order with mixed directions, with their places."""
    first = table(spark, sf, "orders").orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey").limit(100)
    return K.positions(first, [], [F.col("o_orderstatus"), F.desc("o_totalprice"), F.col("o_orderkey")], "place").select("o_orderkey", (F.col("place") + 1).alias("place"))


@register("topk_default_last", """
SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY user_id % 10 = 0, user_id DESC LIMIT 30""")
def topk_default_last(spark, sf):
    """Users in order, those marked as default behind all others."""
    return K.last_rows(table(spark, sf, "events").select("user_id").distinct(), F.col("user_id") % 10 == 0, F.desc("user_id")).limit(30)


@register("topk_checked_length", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1")
def topk_checked_length(spark, sf):
    """Groups checked to be long enough; the job fails on one that is not."""
    e = table(spark, sf, "events")
    long = e.join(e.groupBy("user_id").count().where("count >= 3"), "user_id", "left_semi")
    return K.checked_length(long, ["user_id"], 3).groupBy("user_id").agg(F.count("*").alias("n"))


@register("topk_sample_share", f"""
SELECT 'some' AS what, c_custkey FROM customer WHERE {_PLACE.format('c_custkey')} < 0.3 UNION ALL SELECT 'all', c_custkey FROM customer""")
def topk_sample_share(spark, sf):
    """A share of the rows, with its ends: none for 0, all for 1."""
    c = table(spark, sf, "customer").select("c_custkey")
    return U.union_all([K.sample_share(c, "c_custkey", s).select(F.lit(n).alias("what"), "c_custkey") for n, s in (("none", 0.0), ("some", 0.3), ("all", 1.0))])


@register("topk_resample", """
WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || s_suppkey), 1, 10))::BIGINT, s_suppkey) - 1 AS place, count(*) OVER () AS n FROM supplier), d AS (SELECT unnest(range(5000)) AS i)
SELECT s_suppkey, count(*) AS drawn FROM d JOIN r ON r.place = floor(('0x' || substr(md5('43:' || i), 1, 10))::BIGINT / 1099511627776.0 * r.n) GROUP BY 1""")
def topk_resample(spark, sf):
    """5000 draws with replacement, from fewer rows or more."""
    s = table(spark, sf, "supplier").select("s_suppkey")
    return K.drawn(s, "s_suppkey", 5000, s.count()).groupBy("s_suppkey").agg(F.count("*").alias("drawn"))


@register("agg_mean_intervals", """
WITH m AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1) SELECT event_type, n, round(mean, 4) AS mean, round(sd, 4) AS sd, true AS inside FROM m""")
def agg_mean_intervals(spark, sf):
    """Means with t intervals, whose half width lies between 1.9 and 4.4 standard errors for 4 rows or more."""
    m = ST.mean_intervals(table(spark, sf, "events"), "value", ["event_type"])
    error = F.col("sd") / F.sqrt("n")
    return m.select("event_type", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), ((F.col("high") - F.col("mean")) / error).between(1.9, 4.4).alias("inside"))


@register("agg_distribution", "SELECT count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(stddev_samp(value), 4) AS sd FROM events")
def agg_distribution(spark, sf):
    return ST.distribution(table(spark, sf, "events"), "value").select("n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "sd")])


@register("agg_engagement_lists", """
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, array_to_string(list_sort(list(o_orderstatus || o_orderkey)), ',') AS records, count(*) AS n FROM orders GROUP BY 1, 2""")
def agg_engagement_lists(spark, sf):
    """A user's records of a day as a sorted list; a day of a user bounds the list."""
    o = table(spark, sf, "orders").withColumn("r", F.concat("o_orderstatus", F.col("o_orderkey").cast("string")))
    return o.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.array_join(F.sort_array(F.collect_list("r")), ",").alias("records"), F.count("*").alias("n"))


@register("agg_condition_sets", "SELECT c_mktsegment AS condition, count(DISTINCT l_partkey) AS n_posts, count(DISTINCT l_suppkey) AS n_authors FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def agg_condition_sets(spark, sf):
    """What each condition's users were shown, as a table of distinct pairs that is then counted."""
    shown = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lambda c, n: shown.select(F.col("c_mktsegment").alias("condition"), c).distinct().groupBy("condition").agg(F.count("*").alias(n))
    return pairs("l_partkey", "n_posts").join(pairs("l_suppkey", "n_authors"), "condition")


@register("agg_binary_proportion", "SELECT source, round(avg(toxic), 6) AS prop, count(*) AS n, count(toxic) AS n_labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg_binary_proportion(spark, sf):
    """Share of label 1 among those labelled; documents without a label count as documents alone."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.round(F.avg(F.when(F.col("toxic") == 1, 1.0).when(F.col("toxic") == 0, 0.0)), 6).alias("prop"), F.count("*").alias("n"), F.count("toxic").alias("n_labelled"))


@register("text_coherence", """
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))) AS w FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents), s AS (SELECT w, count(*)::DOUBLE AS c FROM w WHERE w IN ('the', 'and', 'of', 'der', 'die') GROUP BY 1),
p AS (SELECT x.w AS a, y.w AS b FROM s x, s y WHERE x.w < y.w), k AS (SELECT a, b, (SELECT count(*)::DOUBLE FROM w u JOIN w v ON u.doc_id = v.doc_id WHERE u.w = a AND v.w = b) AS nab FROM p),
m AS (SELECT a, b, CASE WHEN nab = 0 THEN -1.0 WHEN nab = n THEN 1.0 ELSE ln(nab * n / (x.c * y.c)) / -ln(nab / n) END AS npmi FROM k, n, s x, s y WHERE x.w = a AND y.w = b),
v AS (SELECT a, b, npmi FROM m UNION ALL SELECT b, a, npmi FROM m UNION ALL SELECT w, w, 1.0 FROM s), t AS (SELECT b, sum(npmi) AS s FROM v GROUP BY 1)
SELECT round(avg(c), 6) AS coherence FROM (SELECT a, sum(npmi * s) / (sqrt(sum(npmi * npmi)) * (SELECT sqrt(sum(s * s)) FROM t)) AS c FROM v JOIN t USING (b) GROUP BY 1)""")
def text_coherence(spark, sf):
    """Coherence of a topic of five words: cosines of their NPMI vectors to the sum."""
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(TS.TOKEN), 0).alias("ws"))
    words = ("and", "der", "die", "of", "the")
    pairs = spark.createDataFrame([(a, b) for k, a in enumerate(words) for b in words[k + 1 :]], "a string, b string")
    scored = TS.npmi(d, "doc_id", "ws", pairs).withColumn("topic", F.lit(0))
    return TS.cosine_coherence(scored, "topic").select(F.round("coherence", 6).alias("coherence"))


@register("ml_valence_lexicon", """
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, ' ')) AS w FROM documents), t AS (SELECT doc_id, sum(CASE lower(w) WHEN 'the' THEN 1.5 WHEN 'der' THEN -2.0 WHEN 'of' THEN 0.5 ELSE 0 END) AS s FROM w GROUP BY 1)
SELECT doc_id, round(s / sqrt(s * s + 15), 6) AS compound, CASE WHEN s / sqrt(s * s + 15) >= 0.05 THEN 'positive' WHEN s / sqrt(s * s + 15) <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM t""")
def ml_valence_lexicon(spark, sf):
    """Compound scores under a lexicon, and their labels."""
    c = TS.valence(F.split("text", " "), {"the": 1.5, "der": -2.0, "of": 0.5})
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.round(c, 6).alias("compound"), T.valence_label(c).alias("label"))


# ---- streams and telemetry --------------------------------------------------------------------


@register("stream_to_queue", "SELECT 'commit' AS kind, count(*) AS n, count(DISTINCT user_id) AS n_authors FROM events")
def stream_to_queue(spark, sf):
    """Valid messages flushed to a table of JSON rows by kind, in two runs of one checkpoint."""
    root = scratch_path(spark, "to-queue")
    _messages(spark, sf, f"{root}/in")
    for _ in range(2):  # the second run finds nothing new
        I.to_queue(I.read_lines(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{root}/out").select("kind", F.get_json_object("payload", "$.did").alias("did"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("did").alias("n_authors"))


@register("stream_max_age", "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d-%H:%M:%S') > '2024-01-28-00:00:00'")
def stream_max_age(spark, sf):
    """Posts no older than two days before a time, by comparing strings."""
    oldest = TM.lookback(F.lit("2024-01-30").cast("timestamp"), 2)
    return I.newer(_log(spark, sf), "ts", oldest).select("event_id")


@register("ml_observed_query", "SELECT count(*) AS n_rows, round(sum(value), 4) AS total, true AS timed, true AS planned FROM events")
def ml_observed_query(spark, sf):
    """Rows, a sum, time and plan of a query, gathered while it runs once."""
    watched, seen = TE.observed(table(spark, sf, "events"), "events", F.sum("value").alias("total"))
    got = TE.profile(watched)
    return spark.createDataFrame([(seen.get["rows"], round(seen.get["total"], 4), got["seconds"] > 0, "Scan parquet" in got["plan"])], "n_rows long, total double, timed boolean, planned boolean")
