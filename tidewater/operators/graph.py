"""Follow graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.sets import dealt
from tidewater.sources.scratch import discard, materialize


def follow_edges(rows: DataFrame) -> DataFrame:
    """(user, other): whom a study user follows or is followed by, from rows relative to the user."""
    is_follower = F.col("relationship_to_study_user") == "follower"
    return rows.select(F.when(is_follower, F.col("follow_did")).otherwise(F.col("follower_did")).alias("user"), F.when(is_follower, F.col("follower_did")).otherwise(F.col("follow_did")).alias("other")).distinct()


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    return dealt(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")), "a", "b").distinct()


def restricted(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...], start: str, end: str) -> DataFrame:
    """Edges (a, b, day) from start to end, both included, of which both ends are nodes (node, kind) of the kinds."""
    may = nodes.where(F.col("kind").isin(*kinds)).select("node").distinct()
    inside = edges.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.join(may.withColumnRenamed("node", "a"), "a", "left_semi").join(may.withColumnRenamed("node", "b"), "b", "left_semi").select(edges.columns)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree and centrality (degree over nodes less one) of undirected edges."""
    d = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", F.try_divide(F.col("degree"), F.col("n") - 1).alias("centrality"))


def assortativity(edges: DataFrame) -> DataFrame:
    d = degrees(edges).select("node", "degree")
    ends = both_ways(edges)
    with_a = ends.join(d.withColumnsRenamed({"node": "a", "degree": "da"}), "a")
    return with_a.join(d.withColumnsRenamed({"node": "b", "degree": "db"}), "b").agg(F.corr("da", "db").alias("assortativity"))


def connected_components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for every node of links (a long, b long); component is the least node.

    Each round joins every node's larger neighbours to its least neighbour, then its smaller ones
    (large star and small star), and is written out; all aggregates combine before the shuffle, and
    a hub with many neighbours is never gathered in one row, and no side is broadcast, which would
    send it through the driver every round. Long paths shrink by half a round.
    Self-links and repeated links do no harm; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "cc")
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down.hint("merge"), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, materialize(small, "cc")
        discard(last)
        state = edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state[:3] == before and state[0] == state[3]:
            break
        before = state[:3]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component), the least node reachable, of undirected edges (a, b)."""
    return connected_components(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), rounds)
