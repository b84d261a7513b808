"""Sharding by balanced label propagation.

Documents that share a hub are linked; here a hub is a text, so equal texts are neighbours.
A hub that is larger than a shard is split into parts that fit one. In each round every hub
part counts its documents by shard (a join and a combining aggregate, so a hub with a third
of all rows is no burden), prefers the shard where most of them are among those with room for all,
and its other documents ask to move there. A shard grants requests, in an order by hash, up
to its quota. Documents without links take no part: at the end they fill the room that is
left, and surplus over a quota goes there too, so that shards differ by one row at most
(law ``rows``).

Null texts count as empty ones (size 1). Rows that repeat a doc_id are placed row by row. An
empty table gives no rows. Nothing but totals by shard and tables of fixed size (BUCKETS
rows a shard) is gathered; ranks are sums over buckets plus a rank within a bucket, of which there
are as many, also for a single large hub, as keep a bucket at about BUCKET_ROWS rows. ``quality``
reports sizes and cut edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import common as C

SHARDS, ROUNDS, BUCKETS, BUCKET_ROWS = 16, 8, 1024, 20_000
#: Documents for which one task may write the sums by text and by hub; fewer than the cores are not taken.
SUMS_ROWS = 1 << 18


def _by_shard(values: dict[int, int], shard: Column) -> Column:
    """The value of a shard, from one number a shard."""
    pairs = [F.lit(x) for k in sorted(values) for x in (k, values[k])]
    return F.element_at(F.create_map(*pairs), shard)


def ranked(df: DataFrame, group: list[str], bucket: Column) -> DataFrame:
    """df with __rank, gapless from 0 in each group: no task gets more than a bucket of a group."""
    df = df.withColumn("__bucket", bucket)
    total = df.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy("rid")) - 1
    return df.withColumn("__place", place).join(total, [*group, "__bucket"]).withColumn("__rank", F.col("__before") + F.col("__place")).drop("__bucket", "__before", "__place")


def propagate(hubs: DataFrame, quota: dict[int, int], rounds: int = ROUNDS) -> DataFrame:
    """hubs (hub, all, held, to) after some rounds of moves: ``to`` is the shard of all of a hub's documents, null while they are apart.

    ``held`` has the documents by shard from before the first round. A hub moves as a whole or not
    at all, so it needs no more, and a round is one narrow pass over the hubs: no shuffle but of
    totals, and as few files as the hubs fill."""
    apart = F.col("to").isNull()
    loose, given = None, hubs
    for _ in range(rounds):
        lies = F.explode(F.when(apart, F.col("held")).otherwise(F.array(F.struct(F.col("to").alias("shard"), F.col("all").alias("n")))))
        totals = hubs.select(apart.alias("apart"), lies.alias("x")).groupBy("x.shard", "apart").agg(F.sum("x.n").alias("n")).collect()
        before, loose = loose, sum(r["n"] for r in totals if r["apart"])
        if loose in (0, before):  # all are together, or the last round moved none and the next would not either
            break
        now = {s: sum(r["n"] for r in totals if r["shard"] == s) for s in quota}
        room = {s: max(0, quota[s] - now[s]) for s in quota}
        fits = lambda x: (_by_shard(room, x["shard"]) + x["n"] >= F.col("all")).cast("int")
        best = F.array_max(F.transform("held", lambda x: F.struct(fits(x).alias("fits"), x["n"].alias("n"), F.negative(x["shard"]).alias("s"))))
        aimed = hubs.withColumn("best", F.when(apart, best)).withColumn("aim", F.negative(F.col("best.s"))).withColumn("bucket", F.pmod(F.xxhash64("hub"), F.lit(BUCKETS)))
        asks = aimed.where(apart)
        leaving = {r["shard"]: r["n"] for r in asks.select("aim", F.explode("held").alias("x")).where("x.shard <> aim").groupBy("x.shard").agg(F.sum("x.n").alias("n")).collect()}
        grant = {s: max(0, quota[s] - now[s] + leaving.get(s, 0)) for s in quota}
        upto = Window.partitionBy("aim").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        asked = asks.groupBy("aim", "bucket").agg(F.sum(F.col("all") - F.col("best.n")).alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_by_shard(grant, F.col("aim")) - F.col("before")) / F.col("sum")))
        granted = asked.select("aim", "bucket", share.alias("share")).where("share > 0")  # BUCKETS rows a shard at most
        lot = F.pmod(F.xxhash64("hub", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
        moved = aimed.join(F.broadcast(granted), ["aim", "bucket"], "left").withColumn("to", F.coalesce("to", F.when(lot < F.col("share"), F.col("aim"))))
        last, hubs = hubs, C.materialize(moved.select("hub", "all", "held", "to"), "votes")
        if last is not given:
            C.discard(last)
    return hubs


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("text_hash"))
    base = C.materialize(base, "sizes")
    n = base.count()
    quota = {s: n // shards + (s < n % shards) for s in range(shards)}
    copies = base.groupBy("text_hash").agg(F.count("*").alias("copies")).where("copies > 1")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // SUMS_ROWS))
    copies = C.materialize(copies.coalesce(tasks), "copies")  # apart from the join, so that Spark can split what is skewed there
    parts = F.ceil(F.col("copies") / F.lit(max(1, n // shards * 9 // 10)))
    rows = base.join(copies, "text_hash", "left")
    rows = rows.withColumn("hub", F.when(F.col("copies") > 1, F.xxhash64("text_hash", F.pmod(F.xxhash64("rid"), parts)))).withColumn("shard", F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(shards)).cast("int"))
    rows = C.materialize(rows.select("rid", "doc_id", "size", "text_crc32", "hub", "shard"), "hubs")
    C.discard(base, copies)

    held = rows.where("hub is not null").groupBy("hub", "shard").agg(F.count("*").alias("n")).groupBy("hub").agg(F.sum("n").alias("all"), F.collect_list(F.struct("shard", "n")).alias("held"))  # a row a shard at most
    voted = C.materialize(held.withColumn("to", F.when(F.size("held") == 1, F.col("held")[0]["shard"])).coalesce(tasks), "votes")
    hubs = propagate(voted, quota)

    buckets = max(BUCKETS, -(-n // BUCKET_ROWS))
    # documents with links lie in their shard's group, hub by hub, a large hub over several buckets; the others in groups from -1 down
    linked = rows.where("hub is not null").join(hubs.select("hub", "all", "to"), "hub").withColumn("group", F.coalesce("to", "shard"))
    pieces = F.ceil(F.col("all") / F.lit(max(1, n // buckets)))
    linked = linked.withColumn("bucket", F.pmod(F.xxhash64("hub", F.lit(1)), F.lit(buckets)) * F.lit(1 << 32) + F.pmod(F.xxhash64("rid", F.lit(2)), pieces)).drop("all", "to")
    single = rows.where("hub is null").withColumn("group", (-1 - F.pmod(F.xxhash64("rid", F.lit(6)), F.lit(shards))).cast("int"))
    single = single.withColumn("bucket", F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(-(-4 * buckets // shards))))
    grouped = C.materialize(linked.unionByName(single).drop("hub", "shard"), "groups")
    C.discard(rows, voted, hubs)

    total = {r["group"]: r["n"] for r in grouped.groupBy("group").agg(F.count("*").alias("n")).collect()}
    kept = {s: min(quota[s], total.get(s, 0)) for s in quota}
    # what goes where room is left: the surplus over the quotas first, hub by hub, so that it stays together there
    start, at = {}, 0
    for g in [*quota, *sorted(total.keys() - quota.keys(), reverse=True)]:
        start[g] = at
        at += total.get(g, 0) - kept.get(g, 0)
    begins, at = {}, 0
    for s in quota:
        begins[s] = at
        at += quota[s] - kept[s]
    out = ranked(grouped, ["group"], F.col("bucket"))
    beyond = F.col("__rank") - F.coalesce(_by_shard(kept, F.col("group")), F.lit(0))
    place = _by_shard(start, F.col("group")) + beyond
    shard_of = F.lit(0)
    for s in range(1, shards):
        shard_of = F.when(place >= begins[s], F.lit(s)).otherwise(shard_of) if quota[s] > kept[s] else shard_of
    out = out.withColumn("shard", F.when(beyond < 0, F.col("group")).otherwise(shard_of).cast("int"))
    slot = F.when(beyond < 0, F.col("__rank")).otherwise(place - _by_shard(begins, F.col("shard")) + _by_shard(kept, F.col("shard")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def quality(sharded: DataFrame) -> DataFrame:
    """One row: shards, fewest and most rows of a shard, groups of equal texts, groups in more than
    one shard, and cut edges: pairs of a group's documents, in a row by shard, that two shards part.

    Equal texts are told by (size, text_crc32), so unlike texts of one size may pass as a group.
    """
    rows = sharded.groupBy("shard").agg(F.count("*").alias("n")).agg(F.count("*").cast("int").alias("shards"), F.min("n").alias("fewest"), F.max("n").alias("most"))
    parts = sharded.groupBy("size", "text_crc32", "shard").agg(F.count("*").alias("n")).groupBy("size", "text_crc32").agg(F.count("*").alias("parts"), F.sum("n").alias("n")).where("n > 1")
    cut = parts.agg(F.count("*").alias("groups"), F.count(F.when(F.col("parts") > 1, 1)).alias("groups_cut"), F.coalesce(F.sum(F.col("parts") - 1), F.lit(0)).alias("edges_cut"))
    return rows.join(cut, how="cross")  # one row each
