"""Small golden frames for operators and functions, with nulls, ties and empty inputs."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.functions import labels as L
from tidewater.functions import nested as N
from tidewater.functions import score as S
from tidewater.functions import text as T
from tidewater.functions import time as TM
from tidewater.operators import aggregates as A
from tidewater.operators import feeds as FD
from tidewater.operators import filters as FL
from tidewater.operators import graph as G
from tidewater.operators import joins as J
from tidewater.operators import sets as U
from tidewater.operators import stats as ST
from tidewater.operators import text_stats as TS
from tidewater.operators import topk as K
from tidewater.operators import windows as W


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()[0]


@pytest.mark.parametrize(("given", "expected"), [("2024-10-20T17:52:03", "2024-10-20-17:52:03"), ("2024-10-20-17:52:03", "2024-10-20-17:52:03"), ("2024-10-20T17:52:03Z", "2024-10-20-17:52:03"), ("2024-10-20T18:36:54.5935595Z", "2024-10-20-18:36:54"), ("2024-10-20T17:52:03+00:00", "2024-10-20-17:52:03"), ("2024-10-20T24:00:00", "2024-10-20-00:00:00"), ("soon", None), (None, None)])
def test_parse_many(spark, given, expected):
    assert one(spark, given, TM.to_pipeline) == expected


@pytest.mark.parametrize(("given", "expected"), [("2024-10-20-01:02:03", "2024-10-20"), ("2021-10-20-01:02:03", "2016-01-01"), ("bad", "2016-01-01"), (None, "2016-01-01")])
def test_partition_date(spark, given, expected):
    assert one(spark, given, TM.partition_date) == expected


@pytest.mark.parametrize(("given", "blank"), [(None, True), ("", True), (" ​ ", True), ("NaN ", True), ("none", True), ("nothing", False)])
def test_blank(spark, given, blank):
    assert one(spark, given, T.is_blank) is blank


@pytest.mark.parametrize(("given", "spam"), [("bit.ly", True), ("see bit.ly", False), ("# # #", True), ("# #", False), ("sale", True)])
def test_spam_is_the_whole_text(spark, given, spam):
    assert one(spark, given, T.is_spam) is spam


def test_hashtags(spark):
    f = lambda c: T.hashtags(c, ("no",), {"usa": "us"})
    assert one(spark, "#USA and #vote #no", f) == ["us", "vote"]


def test_feed_json(spark):
    plain = '[{"item":"a","is_in_network":true}]'
    for given in (plain, '"' + plain.replace('"', '\\"') + '"', plain + " more"):
        assert one(spark, given, N.feed_items)[0]["item"] == "a"
    assert one(spark, "nope", N.defensive) is None


def test_scores(spark):
    c = S.FeedConfig()
    df = spark.createDataFrame([(3, None, 0.5, None, 0.5, True, True), (None, None, 0.0, 0.0, None, True, False), (None, 0.5, 0.2, 0.2, None, False, False)], "likes long, sim double, tox double, con double, rea double, soc boolean, sup boolean")
    r = df.select(S.likeability(F.col("likes"), F.col("sim")).alias("l"), S.treatment_multiplier(F.col("tox"), F.col("con"), F.col("rea"), F.col("soc"), F.col("sup")).alias("m")).collect()
    assert r[0]["l"] == pytest.approx(math.log(4)) and r[0]["m"] == pytest.approx((0.5 * 0.965 + 0.5 * 1.02) * 0.95)
    assert r[1]["l"] == pytest.approx(math.log(81)) and r[1]["m"] == 1.0
    assert r[2]["l"] == pytest.approx(math.log(51)) and r[2]["m"] == 1.0
    assert c.decay == pytest.approx(3 / 24)


def test_proportions(spark):
    df = spark.createDataFrame([(0.5, True), (0.2, False), (None, None)], "p double, b boolean")
    r = df.agg(L.proportion(F.col("p")).alias("p"), L.proportion(F.col("b"), "boolean").alias("b"), L.proportion(F.col("p"), "score").alias("s"), L.average(F.col("p")).alias("a")).first()
    assert tuple(r) == (0.5, 0.5, None, 0.35)
    assert df.where("false").agg(L.average(F.col("p"))).first()[0] is None


def test_asof_ties_nulls_and_default(spark):
    left = spark.createDataFrame([("u", 5), ("u", 0), ("w", 9), ("u", 5)], "k string, t int")
    right = spark.createDataFrame([("u", 1, "a"), ("u", 5, "b"), ("u", 5, None), ("x", 1, "c")], "k string, rt int, v string")
    got = sorted(tuple(r) for r in J.asof(left, right, ["k"], "t", "rt", "v", F.lit("default")).collect())
    assert got == [("u", 0, "default"), ("u", 5, "b"), ("u", 5, "b"), ("w", 9, "default")]


def test_asof_by_spans_equals_brute_force(spark):
    rng = random.Random(4)
    groups = ["hot"] * 6 + ["a", "b", None]
    left = [(i, rng.choice(groups), rng.choice([None, *range(60)])) for i in range(500)]
    right = [(rng.choice(groups), rng.choice([None, *range(60)]), rng.choice([None, *range(9)])) for _ in range(120)]
    early = lambda t: -1 if t is None else t
    want = {}
    for i, g, t in left:
        fits = [(early(rt), v) for rg, rt, v in right if rg == g and v is not None and early(rt) <= early(t)]
        want[i] = max(fits)[1] if fits else None
    l, r = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, rt int, v int")  # noqa: E741
    for span in (None, lambda t: F.floor(t / 7), lambda t: t):
        assert {x["i"]: x["v"] for x in J.asof(l, r, ["k"], "t", "rt", "v", span=span).collect()} == want
    days = lambda d, c: d.withColumn(c, F.timestamp_seconds(F.col(c) * 40_000))
    assert {x["i"]: x["v"] for x in J.asof(days(l, "t"), days(r, "rt"), ["k"], "t", "rt", "v").collect()} == want
    assert J.asof(l.where("false"), r, ["k"], "t", "rt", "v").count() == 0
    assert {x["v"] for x in J.asof(l, r.where("false"), ["k"], "t", "rt", "v").collect()} == {None}


def test_interval_join(spark):
    posts = spark.sql("select 'a' k, date'2024-01-01' d union all select 'a', date'2024-01-08' union all select 'b', date'2024-01-01'")
    sup = spark.sql("select 'a' k, date'2024-01-05' e")
    assert [r["d"].day for r in J.interval_join(posts, sup, "k", "d", "e", 4).collect()] == [1]
    assert J.interval_join(posts, sup, "k", "d", "e", 4, "left_anti").count() == 2


def test_without_missing_raises(spark):
    a, b = spark.range(3).toDF("k"), spark.range(2).toDF("k")
    assert J.without_missing(b, a, "k").count() == 2
    with pytest.raises(Exception, match="no match for 2"):
        J.without_missing(a, b, "k").collect()


def test_latest_and_ties(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3), (2, None, 4)], "k int, t string, i int")
    assert sorted((r["k"], r["i"]) for r in W.latest(df, "k", "t", "i").collect()) == [(1, 2), (2, 4)]
    assert W.first_n(df, ["k"], [F.desc("t")], 1, ties=True).count() == 3


def test_running_cap_and_batches(spark):
    df = spark.createDataFrame([("u", i, i % 2 == 0) for i in range(8)], "k string, i int, old boolean")
    assert sorted(r["i"] for r in W.running_cap(df, ["k"], [F.col("i")], F.col("old"), 2).collect()) == [0, 1, 2, 3, 5, 7]
    b = spark.createDataFrame([(1, x) for x in range(3)] + [(2, x) for x in range(3)] + [(3, 0)], "b int, x int")
    assert {r["b"] for r in W.whole_batches(b, "b", 5).collect()} == {1}


def test_rank_movement(spark):
    a = spark.createDataFrame([("x", 9), ("y", 5), ("z", 4)], "t string, n int")
    b = spark.createDataFrame([("z", 9), ("w", 5), ("x", 1)], "t string, n int")
    got = {r["t"]: r["category"] for r in W.rank_movement(W.rank_changes(a, b, "t", "n", 3, outer=True), 3).collect()}
    assert got == {"x": "Declined", "y": "Dropped", "z": "Improved", "w": "New"}


def test_statistics_match_closed_forms(spark):
    df = spark.createDataFrame([(float(x), False) for x in (1, 2, 3, 4, 5)] + [(float(x), True) for x in (2, 4, 6, 8, 11)], "x double, g boolean")
    r = ST.two_samples(df, "x", F.col("g"))
    assert r["welch_t"] == pytest.approx(-1.8663, abs=1e-3) and r["mann_whitney_u"] == pytest.approx(5.0)
    assert ST.t_two_sided(2.0, 10) == pytest.approx(0.07339, abs=1e-4)
    assert ST.t_quantile(0.95, 10) == pytest.approx(2.2281, abs=1e-3)
    assert ST.f_upper(4.0, 1, 10) == pytest.approx(ST.t_two_sided(2.0, 10), abs=1e-9)
    assert ST.two_samples(df.where("g"), "x", F.col("g")) == {}
    empty = ST.correlations(df.where("false"), "x", "x").first()
    assert (empty["pearson"], empty["n"]) == (0.0, 0)


def test_components_and_empty_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (8, 9)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r["node"]: r["component"] for r in G.components(e).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert {v for k, v in got.items() if k >= 100} == {100}
    assert G.components(e.where("false")).count() == 0


def test_feed_limits(spark):
    cfg = S.FeedConfig(max_feed_length=10, max_per_author=2)
    posts = spark.createDataFrame([(f"p{i:02d}", f"a{i % 7}", "firehose" if i % 2 else "most_liked", float(i), float(i), i) for i in range(40)], "uri string, author_did string, source string, engagement_score double, treatment_score double, posted_unix long")
    assert FD.capped_per_author(posts, [F.desc("engagement_score")], cfg).groupBy("author_did").count().agg(F.max("count")).first()[0] == 2
    users = spark.createDataFrame([("u", "engagement"), ("v", "engagement")], "user string, condition string")
    edges = spark.createDataFrame([("u", "a1"), ("u", "a3"), ("u", "a5"), ("u", "a0")], "user string, other string")
    net = FD.in_network(users, edges, posts)
    previous = spark.createDataFrame([("v", f"p{i:02d}") for i in range(0, 40, 2)], "user string, uri string")
    feed = FD.rank_feeds(users, FD.pools(posts).drop("author_did"), net, previous, cfg, seed=1)
    rows = feed.collect()
    u = [r for r in rows if r["user"] == "u"]
    assert len(u) == 10 and sum(r["is_in_network"] for r in u) == 5
    assert len([r for r in rows if r["user"] == "v"]) == 6  # all posts are old: 60 %
    assert FD.repeated_positions(feed).count() == 0
    assert FD.as_json(feed).count() == 2


def test_sampling(spark):
    df = spark.range(1000).toDF("id")
    a = {r["id"] for r in K.sample_n(df, "id", 50).collect()}
    assert len(a) == 50 and a == {r["id"] for r in K.sample_n(df.repartition(5), "id", 50).collect()}
    assert K.sample_share(df, "id", 0).count() == 0 and K.sample_share(df, "id", 1.5).count() == 1000
    assert K.resample(df, "id", 2500, 1000).count() == 2500
    j = K.jitter(K.positions(df.withColumn("g", F.lit(1)), ["g"], [F.col("id")]), ["g"], "position", "id", 2, 3)
    assert sorted(r["position"] for r in j.collect()) == list(range(1000))


def test_jitter_query_keeps_every_event(spark):
    from tests.conftest import SF
    from tidewater.plans.registry import QUERIES

    sf = SF.replace("sf0.001", "sf0.01")  # the smallest has no user of 50 or more
    rows = QUERIES["topk_jitter"](spark, sf).collect()
    places = {}
    for r in rows:
        places.setdefault(r["user_id"], []).append(r["position"])
    assert sorted(r["event_id"] for r in rows) == sorted(r["event_id"] for r in spark.read.parquet(f"{sf}/events.parquet").collect())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_pages(spark):
    f = spark.createDataFrame([(i, f"x{i}") for i in range(50)], "p int, item string")
    first = [r["item"] for r in K.page_after(f, "p", "item", None).collect()]
    cursor = f.where("p = 29").select(F.sha2("item", 256)).first()[0]
    assert len(first) == 30 and K.page_after(f, "p", "item", cursor).count() == 20 and K.page_after(f, "p", "item", "eof").count() == 0


def test_preprocess_flags(spark):
    df = spark.createDataFrame([("a", "hello world", None, "en"), ("bot", "hello world", None, "en"), ("a", "abc", None, "en"), ("a", "hello # # #", "porn", "en"), ("a", "bonjour tous", None, "fr")], "author_did string, text string, labels string, langs string")
    bots = spark.createDataFrame([("bot",)], "author_did string")
    got = sorted((r["text"], r["author_did"], r["passed_filters"], r["filtered_by_func"]) for r in FL.preprocess(df, bots).collect())
    assert got == [("hello # # #", "a", False, "has_spam"), ("hello world", "a", True, None), ("hello world", "bot", True, "author_is_bot")]


def test_sets(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "k int, v int")
    assert U.same_rows(a, a.repartition(3)) and not U.same_rows(a, a.distinct())
    assert {r["k"] for r in U.insert_if_absent(a.where("k = 3"), a, ["k"], [F.col("v")]).collect()} == {1}


def test_tf_idf_is_normal_and_mean_vector(spark):
    d = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "")], "k int, t string")
    w = TS.tf_idf(d, "k", "t")
    assert all(r[0] == pytest.approx(1) for r in w.groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("s")).select("s").collect())
    v = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "v array<double>")
    assert A.mean_vector(v, "v").first()[0] == [2.0, 4.0]
    lex = TS.valence(F.split(F.lit("good good bad"), " "), {"good": 2.0, "bad": -1.0})
    assert spark.range(1).select(lex).first()[0] == pytest.approx(3 / math.sqrt(24))


def test_users_weeks_and_default_feeds(spark):
    from tidewater.operators import users as US

    u = spark.createDataFrame([("a.x", "1"), ("b", "1"), ("c", "2"), (None, "1")], "handle string, wave string")
    got = [r["handle"] for r in US.repair(u, "handle", {"a.x": "a"}, ("zz",), "wave", {"b": "1", "c": "1"}).collect()]
    assert got == ["a", "c"]
    s = spark.createDataFrame([("f1", "backfill", "x"), ("f1", "30", "own"), ("f2", "backfill", "x")], "feed_id string, cursor string, feed string")
    f = spark.createDataFrame([("f1", "default", "d1"), ("f2", "u", "d2")], "feed_id string, user string, feed string")
    assert sorted((r["cursor"], r["feed"]) for r in US.impute_feeds(s, f).collect() if r["feed"]) == [("30", "own"), ("backfill", "d1")]


def test_topics_find_separate_groups(spark):
    from tidewater.operators import users as US

    rows = [(i, [float(i % 3 == k) * 5 + (i % 7) * 0.01 for k in range(3)]) for i in range(60)]
    t = US.topics(spark.createDataFrame(rows, "id int, v array<double>"), "v", 3)
    assert {r["n"] for r in t.groupBy((F.col("id") % 3).alias("g")).agg(F.countDistinct("topic").alias("n")).collect()} == {1}


def test_profile_counts_once(spark):
    from tidewater.operators.telemetry import profile

    p = profile(spark.range(123))
    assert p["rows"] == 123 and "Range" in p["plan"] and p["seconds"] >= 0


def test_metric_columns_tell_moral_from_moral_outrage():
    columns = ["feed_average_moral", "feed_average_moral_outrage", "feed_proportion_moral", "feed_average_toxic", "feed_average_severe_toxic"]
    assert L.metric_columns(columns, "average", "moral") == ["feed_average_moral"]
    assert L.metric_columns(columns, "average", "toxic") == ["feed_average_toxic"]
    assert L.metric_columns(columns, "average", "moral_outrage") == ["feed_average_moral_outrage"]


def test_engagement_metrics_in_one_pass(spark):
    df = spark.createDataFrame([("u", "like", 0.6), ("u", "like", 0.2), ("u", "post", None)], "k string, t string, prob_toxic double")
    r = df.groupBy("k").agg(*L.engagement_metrics("t", {"prob_toxic": "probability"})).first()
    assert (r["engagement_average_liked_posts_toxic"], r["engagement_proportion_liked_posts_toxic"]) == (0.4, 0.5)
    assert r["engagement_average_posted_posts_toxic"] is None


def test_ranks_over_ranges(spark):
    values = [float(x) for x in (3, 1, 3, 2, 5, 5, 5, 0)]
    got = {r["x"]: r["r"] for r in ST.average_ranks(spark.createDataFrame([(v,) for v in values], "x double"), "x", "r", buckets=4).collect()}
    assert got == {0.0: 1.0, 1.0: 2.0, 2.0: 3.0, 3.0: 4.5, 5.0: 7.0}


def test_top_share_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(k,) for k in "aaabbbccd"], "k string")
    assert [(r["k"], r["place"]) for r in W.top_share(df, "k", 0.5).orderBy("place").collect()] == [("a", 1), ("b", 2)]
    assert W.top_share(df, "k", 0.1).count() == 0


def test_draws_repeat_also_from_many_rows(spark, tmp_path):
    """As many draws as the SQL's, and its rows, where there are more suppliers than draws."""
    from tidewater.plans.registry import ORACLES, QUERIES

    spark.range(6000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = {(r["s_suppkey"], r["drawn"]) for r in QUERIES["topk_resample"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == set(c.execute(ORACLES["topk_resample"]).fetchall()) and sum(n for _, n in got) == 5000


def test_in_network_counts(spark):
    """Posts of two authors count once, null ones not at all."""
    edges = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b"), ("v", "b"), ("w", "c"), ("x", "none"), ("y", None)], "user string, other string")
    posts = spark.createDataFrame([("p", "a", "firehose"), ("p", "b", "firehose"), ("p", "b", "firehose"), ("q", "a", "firehose"), ("r", "b", "firehose"), ("s", "b", "other"), (None, "c", "firehose"), ("t", None, "firehose")], "uri string, author_did string, source string")
    assert {tuple(r) for r in FD.in_network_counts(edges, posts).collect()} == {("u", 3), ("v", 2), ("w", 0)}


def test_keys_are_told_apart_in_tasks_of_bounded_size(spark, monkeypatch):
    assert U.dealt(spark.range(1000), "id", rows=100).rdd.getNumPartitions() == 10 and U.dealt(spark.range(0), "id").count() == 0
    feeds = spark.createDataFrame([("c", 1, "p", True), ("c", 1, "p", None), ("c", None, None, False), ("c", 2, "q", False), (None, 1, "p", None)], "condition string, user long, uri string, is_in_network boolean")
    assert {tuple(r) for r in FD.session_analytics(feeds).collect()} == {("c", 2, 4, 2, 0.333), (None, 1, 1, 1, None)}
