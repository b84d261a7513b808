"""Streaming ingest: parse messages, route records, keep state, land files.

A message is a JSON line with did, time_us, kind (commit, identity, account) and, for commits,
an operation and a record. Sources are anything that gives a string column ``value``: files,
Kafka, sockets. Progress is the stream's checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

KINDS = ("commit", "identity", "account")
RECORD_TYPES = ("post", "like", "repost", "follow", "block", "reply")
MESSAGE = """did string, time_us bigint, kind string, commit struct<operation:string,collection:string,rkey:string,
 record:struct<uri:string,text:string,created_at:string,subject_uri:string,subject_did:string,parent_uri:string,root_uri:string>>"""


def read_lines(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def judged(lines: DataFrame) -> DataFrame:
    """Messages, flattened, with the raw line and the reason for which it is rejected (null if it is not).

    A line that is no JSON of the expected types is malformed; others lack what every message, or every
    created record, must have. Nothing is lost: a rejected line keeps its text.
    """
    m = lines.select(F.col("value").alias("raw"), F.from_json("value", f"{MESSAGE}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("m")).select("raw", "m.*")
    created = (F.col("kind") == "commit") & (F.col("commit.operation") == "create")
    reason = (
        F.when(F.col("_corrupt").isNotNull() | (F.trim("raw") == ""), "malformed")
        .when(F.col("did").isNull(), "no_author")
        .when(F.col("time_us").isNull(), "no_time")
        .when(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS), "unknown_kind")
        .when((F.col("kind") == "commit") & (F.col("commit.operation").isNull() | F.col("commit.collection").isNull()), "no_operation")
        .when(created & F.col("commit.record.uri").isNull(), "no_address")
    )
    return m.withColumn("reason", reason).drop("_corrupt").withColumn("at", F.timestamp_micros("time_us"))


def parse(lines: DataFrame, collections: tuple[str, ...] | None = None, dids: DataFrame | None = None) -> DataFrame:
    """Messages that nothing speaks against, flattened: required fields there, a known kind, wanted collections and authors."""
    m = judged(lines).where(F.col("reason").isNull()).drop("reason", "raw")
    if collections is not None:
        m = m.where(F.col("commit.collection").isin(*collections))
    if dids is not None:
        m = m.join(dids.select("did").distinct(), "did", "left_semi")
    return m


def operations(messages: DataFrame) -> DataFrame:
    """Creates and deletes of known record types, and rejected lines where messages have them; updates are ignored."""
    kind = F.element_at(F.split("commit.collection", r"\."), -1)
    known = (F.col("kind") == "commit") & F.col("commit.operation").isin("create", "delete") & kind.isin(*RECORD_TYPES)
    rejected = [c for c in ("reason", "raw") if c in messages.columns]
    ops = messages.where(known | F.col("reason").isNotNull() if rejected else known)
    return ops.select("did", "time_us", "at", kind.alias("record_type"), F.col("commit.operation").alias("operation"), "commit.record.*", *rejected)


def flagged(records: DataFrame, study_users: DataFrame, in_network: DataFrame) -> DataFrame:
    """Created records with is_study, is_near and on_study (the subject is a study user), and the address they aim at.

    Static sides: study_users (did) and in_network (did). All are equi-joins that enrich the stream; records
    without a subject are dealt by author, so that they do not meet in one task.
    """
    r = records.where("operation = 'create' or reason is not null" if "reason" in records.columns else "operation = 'create'")
    flag = lambda df, key, name: df.select(F.col("did").alias(key)).distinct().withColumn(name, F.lit(True))
    r = r.join(flag(study_users, "did", "is_study"), "did", "left").join(flag(in_network, "did", "is_near"), "did", "left")
    r = r.withColumn("subject_key", F.coalesce("subject_did", F.concat(F.lit(" "), "did"))).join(flag(study_users, "subject_key", "on_subject"), "subject_key", "left")
    r = r.withColumn("on_study", F.when(F.col("subject_did").isNotNull(), F.col("on_subject"))).drop("subject_key", "on_subject")
    return r.withColumn("target_uri", F.when(F.col("record_type") == "like", F.col("subject_uri")).otherwise(F.col("parent_uri")))


#: What is kept of a record that aims at a post.
AIMED = "did string, time_us bigint, record_type string, uri string, text string, subject_uri string, subject_did string, parent_uri string"
_AIMED = [f.split()[0] for f in AIMED.split(", ")]
_MET = Row(*_AIMED, "owner")
#: By how much a clock may go back between batches, of a restart on another machine say, without loss.
CLOCKS = timedelta(days=1)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StudyPostAudience(StatefulProcessor):
    """State by post address, where owners lapse (see ``on_study_posts``): its owner once a study user's post came, and until then what aims at the address.

    A record meets its post whichever comes first, however late, in one batch or another, before a restart
    or after it. Owners are kept without limit, or ``keep_ms`` after they came; records whose post has
    not come within ``wait_ms`` of processing time are given up by a timer. Only the address is held in
    memory, and a fixed number of records: lists stay in the state store.
    """

    CHUNK = 500

    def __init__(self, wait_ms: int, keep_ms: int | None = None) -> None:
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owner = handle.getValueState("owner", "owner string", self.keep_ms)
        self.waiting = handle.getListState("waiting", f"{AIMED}, arrived bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.owner.update((initialState.owner,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, held = timerValues.getCurrentProcessingTimeInMs(), []
        owner = self.owner.get()
        for r in rows:
            if r.is_own:
                if owner is None:
                    owner = (r.did,)
                    self.owner.update(owner)
                    for x in self.waiting.get():
                        yield _MET(*x[:-1], owner[0])
                    self.waiting.clear()
                    for x in held:
                        yield _MET(*x[:-1], owner[0])
                    held = []
            elif owner is not None:
                yield _MET(*(r[c] for c in _AIMED), owner[0])
            else:
                held.append((*(r[c] for c in _AIMED), now))
                if len(held) == self.CHUNK:
                    self.hold(held, now)
                    held = []
        if held:
            self.hold(held, now)

    def hold(self, records: list[tuple], now: int) -> None:
        if not self.waiting.exists():
            self.handle.registerTimer(now + self.wait_ms)
        self.waiting.appendList(records)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Gives up what has waited its time; what came later gets its own time, chunk by chunk."""
        now = timerValues.getCurrentProcessingTimeInMs()
        left, first = [], None
        for x in self.waiting.get():
            if x[-1] + self.wait_ms > now:
                left.append(tuple(x))
                first = x[-1] if first is None else min(first, x[-1])
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(first + self.wait_ms)
        else:
            self.waiting.clear()
        return iter(())

    def close(self) -> None:
        pass


def on_study_posts(records: DataFrame, wait: timedelta = timedelta(days=7), keep: timedelta | None = None, known: DataFrame | None = None) -> DataFrame:
    """Flagged records that aim at a study user's post, with its owner; state lies in RocksDB and need not fit in memory.

    ``known`` are posts (uri, owner) from before the stream. Of several owners of an address the first stays. A record
    meets its post whichever comes first, however late, in one batch or another, before a restart or after it;
    what waits for a post is given up ``wait`` after it arrived. Both sides are state of a stream-stream join, which
    passes once a batch over what waits. Only where owners lapse (``keep``) is the state a Python processor's, at the
    cost of some calls for every address.
    """
    rows = records.where("uri is not null or target_uri is not null")
    is_own = F.col("is_study") & F.col("record_type").isin("post", "reply")
    first = known.select(F.col("uri").alias("key"), "owner").where("key is not null and owner is not null").dropDuplicates(["key"]) if known is not None else None
    met = _met_by_join(rows, is_own, wait, first) if keep is None else _met_by_timers(rows, is_own, wait, keep, first)
    return met.withColumn("at", F.timestamp_micros("time_us"))


def _met_by_join(rows: DataFrame, is_own: Column, wait: timedelta, known: DataFrame | None) -> DataFrame:
    came = rows.withColumn("came", F.current_timestamp()).withWatermark("came", f"{int(CLOCKS.total_seconds())} seconds")
    posts = came.where(is_own & F.col("uri").isNotNull()).select(F.col("uri").alias("key"), F.col("did").alias("owner"), F.col("came").alias("posted"))
    aimed = came.where("target_uri is not null").select(F.col("target_uri").alias("key"), *_AIMED, "came")
    out = [*_AIMED, "owner"]
    before = None
    if known is not None:
        posts = posts.join(known.select("key"), "key", "left_anti")
        aimed = aimed.join(known, "key", "left")
        before, aimed = aimed.where("owner is not null").select(*out), aimed.where("owner is null").drop("owner")
    posts = posts.dropDuplicates(["key"]).withColumnRenamed("key", "address")
    in_time = F.col("posted") <= F.col("came") + F.make_dt_interval(secs=F.lit(wait.total_seconds()))
    met = aimed.join(posts, (F.col("key") == F.col("address")) & in_time).select(*out)
    return met if before is None else met.union(before)


def _met_by_timers(rows: DataFrame, is_own: Column, wait: timedelta, keep: timedelta, known: DataFrame | None) -> DataFrame:
    both = F.array_compact(F.array(F.when(is_own & F.col("uri").isNotNull(), F.struct(F.col("uri").alias("key"), F.lit(True).alias("is_own"))), F.when(F.col("target_uri").isNotNull(), F.struct(F.col("target_uri").alias("key"), F.lit(False).alias("is_own")))))
    keyed = rows.select(F.explode(both).alias("k"), *_AIMED).select("k.key", "k.is_own", *_AIMED)
    ms = lambda t: int(t.total_seconds() * 1000)
    return keyed.groupBy("key").transformWithState(StudyPostAudience(ms(wait), ms(keep)), f"{AIMED}, owner string", "append", "processingTime", known.groupBy("key") if known is not None else None)


_ROUTED = ("did", "time_us", "at", "record_type", "uri", "text", "subject_uri", "subject_did", "parent_uri", "owner", "route", "reason", "raw")
REJECTED = "rejected"


def routes(records: DataFrame, on_posts: DataFrame) -> DataFrame:
    """One row for each route of flagged records and of those on study users' posts; a follow may have two.
    Rejected lines, where the records have them, have the route ``REJECTED``."""
    is_post = F.col("record_type").isin("post", "reply")
    judged = "reason" in records.columns
    reason, raw = (F.col(c) if judged else F.lit(None).cast("string") for c in ("reason", "raw"))
    to = F.array_compact(
        F.array(
            F.when(F.col("is_study") & (F.col("record_type") != "follow"), F.concat(F.lit("study_user_"), "record_type")),
            F.when(F.col("is_near") & is_post & F.col("is_study").isNull(), "in_network_post"),
            F.when((F.col("record_type") == "follow") & F.col("is_study"), "study_user_follows"),
            F.when((F.col("record_type") == "follow") & F.col("on_study"), "study_user_followed"),
        )
    )
    to = F.when(reason.isNotNull(), F.array(F.lit(REJECTED))).otherwise(to)
    own = records.withColumns({"owner": F.lit(None).cast("string"), "route": F.explode(to), "reason": reason, "raw": raw})
    on = F.when(F.col("record_type") == "like", "like_on_study_user_post").when(is_post, "reply_to_study_user_post")
    none = F.lit(None).cast("string")
    return own.select(*_ROUTED).union(on_posts.withColumns({"route": on, "reason": none, "raw": none}).where("route is not null").select(*_ROUTED))


def route_stream(lines: DataFrame, study_users: DataFrame, in_network: DataFrame, posts_path: str, out_path: str, checkpoint: str, available_now: bool = True, rejected_path: str | None = None, known_posts: DataFrame | None = None) -> StreamingQuery:
    """Routes every micro-batch and lands it by route and day, study users' posts at posts_path, and
    rejected lines with their reasons at rejected_path.

    The posts of study users are state of the stream (see ``on_study_posts``) and survive restarts
    with its checkpoint. All of a batch's files go to folders of its number and replace what an earlier try
    of the same batch left: a retry changes nothing.
    """
    records = flagged(operations(judged(lines)), study_users, in_network)
    routed = routes(records, on_study_posts(records.where("reason is null"), known=known_posts))

    def land(batch: DataFrame, number: int) -> None:
        batch.persist()
        out = batch.where(F.col("route") != REJECTED).drop("reason", "raw").withColumn("partition_date", F.date_format("at", "yyyy-MM-dd"))
        out.hint("rebalance", "route", "partition_date").write.mode("overwrite").partitionBy("route", "partition_date").parquet(f"{out_path}/batch={number}")
        posts = batch.where("route in ('study_user_post', 'study_user_reply')").select("uri", F.col("did").alias("owner"))
        posts.hint("rebalance").write.mode("overwrite").parquet(f"{posts_path}/batch={number}")
        if rejected_path is not None:
            batch.where(F.col("route") == REJECTED).select("reason", "raw").hint("rebalance").write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        batch.unpersist()

    writer = routed.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    # a run that ends when the data do must not wait for timers: they go off with the next run's data
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.join.stateFormatVersion": "3", "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"} | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if available_now else {})
    conf = lines.sparkSession.conf
    before = {k: conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)  # a stream keeps the settings that hold when it starts
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def to_queue(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Valid messages appended as a table of JSON rows, partitioned by kind."""
    rows = parse(lines).select("kind", "did", "time_us", F.to_json(F.struct("did", "time_us", "kind", "commit")).alias("payload"))
    return rows.writeStream.format("parquet").partitionBy("kind").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str, by: list[str], value: str, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Event-time counts and sums over tumbling or sliding windows, with a watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def incremental(source: DataFrame, land: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is new since the last run, once."""
    return source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newer(df: DataFrame, ts: str, since: Column | str | None) -> DataFrame:
    return df if since is None else df.where(F.col(ts) > since)
