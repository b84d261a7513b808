"""Scoring, ranking and assembling of personal feeds, as one plan over users and posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import score as S
from tidewater.operators import topk
from tidewater.operators.sets import dealt
from tidewater.operators.windows import first_n, running_cap
from tidewater.sources.scratch import materialize


def score_posts(posts: DataFrame, superposters: DataFrame, now: Column, config: S.FeedConfig = S.FeedConfig()) -> DataFrame:
    """posts with engagement_score and treatment_score.

    Columns used: author_did, posted_at, like_count, similarity, prob_toxic, prob_constructive,
    prob_reasoning, is_sociopolitical. superposters has one row an author.
    """
    marked = posts.join(superposters.select("author_did").withColumn("__super", F.lit(True)), "author_did", "left")
    fresh = S.linear_freshness(S.age_hours(now, F.col("posted_at"), config), config)
    like = S.likeability(F.col("like_count"), F.col("similarity"), config)
    times = S.treatment_multiplier(F.col("prob_toxic"), F.col("prob_constructive"), F.col("prob_reasoning"), F.coalesce("is_sociopolitical", F.lit(False)), F.coalesce("__super", F.lit(False)), config)
    return marked.select("*", *S.scores(like, fresh, times)).drop("__super")


def capped_per_author(posts: DataFrame, order: list[Column], config: S.FeedConfig = S.FeedConfig()) -> DataFrame:
    return first_n(posts, ["author_did"], order, config.max_per_author)


def pools(posts: DataFrame) -> DataFrame:
    """(condition, uri, author_did, source, pool_rank) of the three candidate pools."""
    def pool(condition: str, by: str) -> DataFrame:
        return posts.select(F.lit(condition).alias("condition"), "uri", "author_did", "source", F.col(by).cast("double").alias("order_value"))

    return pool("reverse_chronological", "posted_unix").union(pool("engagement", "engagement_score")).union(pool("representative_diversification", "treatment_score"))


def in_network(users: DataFrame, edges: DataFrame, posts: DataFrame) -> DataFrame:
    """(user, uri): firehose posts by authors whom the user follows."""
    own = posts.where("source = 'firehose'").select("uri", "author_did")
    return users.select("user").join(edges, "user").join(own, F.col("other") == F.col("author_did")).select("user", "uri").distinct()


def in_network_counts(edges: DataFrame, posts: DataFrame) -> DataFrame:
    """(user, n): how many firehose posts (different uris, null not counted) the user's followed authors have.

    Posts are counted by author before they meet the edges; only uris that more than one author has meet them one by one.
    """
    own = posts.where("source = 'firehose'").select("uri", "author_did")
    shared = own.groupBy("uri").agg(F.min("author_did").alias("a"), F.max("author_did").alias("b")).where("uri is not null and a <> b").select("uri")
    counts = own.join(shared, "uri", "left_anti").groupBy("author_did").agg(F.countDistinct("uri").alias("n")).withColumn("uri", F.lit(None).cast(own.schema["uri"].dataType))
    several = own.join(shared, "uri", "left_semi").select("author_did", F.lit(0).cast("long").alias("n"), "uri").distinct()
    met = edges.select("user", "other").distinct().join(counts.unionByName(several), F.col("other") == F.col("author_did"))
    return met.groupBy("user", "uri").agg(F.sum("n").alias("n")).groupBy("user").agg((F.sum("n") + F.count("uri")).alias("n"))


def rank_feeds(users: DataFrame, pool: DataFrame, network: DataFrame, previous: DataFrame | None = None, config: S.FeedConfig = S.FeedConfig(), seed: int | None = None) -> DataFrame:
    """(user, condition, position, uri, is_in_network) of every user's feed.

    In-network posts come first, up to their share of the feed; then others from the source of
    the condition (most_liked, but firehose for the chronological one). Then: cut to twice the
    length, cap posts of earlier feeds, cut to the length, jitter. The pool of a condition is
    cut to what a feed can reach before it meets the users, so users times posts stays bounded
    by users times feed length; in-network posts join by key.
    """
    n = config.max_feed_length
    own_cap = int(n * config.max_in_network_share)
    order = [F.desc("order_value"), F.col("uri")]
    own = users.join(network, "user").join(pool, ["condition", "uri"]).select("user", "condition", "uri", "order_value", F.lit(True).alias("is_in_network"))
    own = first_n(own, ["user"], order, own_cap)
    # a user may have up to own_cap of these in their network: take as many more
    wanted = F.when(F.col("condition") == "reverse_chronological", "firehose").otherwise("most_liked")
    best = first_n(pool.where(F.col("source") == wanted), ["condition"], order, 2 * n + own_cap)  # at most that many rows a condition
    rest = users.join(F.broadcast(best), "condition").select("user", "condition", "uri", "order_value", F.lit(False).alias("is_in_network")).join(network.select("user", "uri"), ["user", "uri"], "left_anti").select("user", "condition", "uri", "order_value", "is_in_network")
    feed = topk.positions(own.union(rest), ["user"], [F.desc("is_in_network"), *order]).where(F.col("position") < 2 * n)
    if previous is not None:
        old = previous.select("user", "uri").distinct().withColumn("__old", F.lit(True))
        feed = feed.join(old, ["user", "uri"], "left")
        feed = running_cap(feed, ["user"], [F.col("position")], F.coalesce("__old", F.lit(False)), int(n * config.max_old_share)).drop("__old")
    feed = topk.positions(feed, ["user"], [F.col("position")], "place").where(F.col("place") < n)
    if seed is not None and config.jitter:
        feed = topk.jitter(feed.withColumn("__key", F.concat_ws("|", "user", "uri")), ["user"], "place", "__key", config.jitter, seed).drop("__key")
    return feed.select("user", "condition", F.col("place").alias("position"), "uri", "is_in_network")


def as_json(feeds: DataFrame) -> DataFrame:
    """One row a user: the feed as a JSON list, and its statistics."""
    item = F.struct("position", F.col("uri").alias("item"), "is_in_network")
    out = feeds.groupBy("user", "condition").agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: F.struct(i["item"].alias("item"), i["is_in_network"].alias("is_in_network"))).alias("items"))
    from tidewater.functions.nested import feed_statistics

    return out.select("user", "condition", F.to_json("items").alias("feed"), feed_statistics(F.col("items")).alias("feed_statistics"))


def session_analytics(feeds: DataFrame) -> DataFrame:
    """Feeds, posts, distinct posts and in-network share by condition.

    Users and posts are told apart in tasks of a bounded number of rows, whatever their number.
    """
    feeds = materialize(feeds.select("condition", "user", "uri", F.col("is_in_network").cast("int").alias("own")), "feeds")
    users = dealt(feeds, "condition", "user").groupBy("condition", "user").agg(F.count("*").alias("n"), F.sum("own").alias("own"), F.count("own").alias("known"))
    users = users.groupBy("condition").agg(F.count("user").alias("n_feeds"), F.sum("n").alias("n_posts"), F.round(F.try_divide(F.sum("own").cast("double"), F.sum("known")), 3).alias("prop_in_network"))
    posts = dealt(feeds, "condition", "uri").select("condition", "uri").distinct().groupBy("condition").agg(F.count("uri").alias("n_unique"))
    both = users.join(posts.withColumnRenamed("condition", "__c"), F.col("condition").eqNullSafe(F.col("__c")))
    return both.select("condition", "n_feeds", "n_posts", "n_unique", "prop_in_network")


def in_network_share(feeds: DataFrame, day: str = "day") -> DataFrame:
    """Mean, by user and day, of feeds' in-network shares."""
    per_feed = feeds.groupBy("user", day, "feed_id").agg(F.avg(F.col("is_in_network").cast("double")).alias("p"))
    return per_feed.groupBy("user", day).agg(F.round(F.avg("p"), 3).alias("prop_in_network"))


def repeated_positions(feeds: DataFrame) -> DataFrame:
    """Users with two posts at one position; empty if all is well."""
    return feeds.groupBy("user", "position").agg(F.count("*").alias("n")).where("n > 1")


def cap_ratio(feeds: DataFrame, length: int, share: float) -> DataFrame:
    w = Window.partitionBy("user").orderBy("position")
    return feeds.where("is_in_network").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= int(length * share)).drop("__n")
