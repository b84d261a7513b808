"""Storage, queues and streams."""

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest
from pyspark.sql import GroupedData, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF
from tidewater.plans import registry, storage as P  # noqa: F401 - the registry loads the plans
from tidewater.sources import catalog as CT
from tidewater.sources import queue as Q
from tidewater.sources import storage as ST
from tidewater.streaming import ingest as I  # noqa: E741

D = CT.Dataset("things", "uri string, n bigint, at string", "uri", "at")


def test_every_dataset_has_a_schema(spark):
    for d in CT.DATASETS.values():
        assert "partition_date" in d.with_partition.names
        assert d.key is None or d.key in d.columns.names


def test_coerce(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    want = T.StructType.fromDDL("a bigint, c double")
    assert tuple(CT.coerce(df, want).first()) == (1, None)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        CT.coerce(df, T.StructType.fromDDL("b bigint")).collect()
    assert CT.coerce(df, T.StructType.fromDDL("b bigint"), strict=False).first()[0] is None


def test_write_read_compact(spark, tmp_path):
    rows = [("a", 1, "2024-05-01-00:00:00"), ("a", 2, "2024-05-03-00:00:00"), ("b", 3, "1999-01-01-00:00:00"), ("c", 4, None)]
    df = spark.createDataFrame(rows, "uri string, n long, at string")
    root = str(tmp_path / "r")
    ST.write(df, root, D, "2024-05-04")
    got = ST.read(spark, root, D)
    assert sorted((r["n"], r["tier"], r["partition_date"]) for r in got.collect()) == [(1, "cache", "2024-05-01"), (2, "active", "2024-05-03"), (3, "cache", "2016-01-01"), (4, "cache", "2016-01-01")]
    assert ST.read(spark, root, D, day="2024-05-01").count() == 1
    assert ST.read(spark, root, D, tiers=("active",)).count() == 1
    assert ST.read(spark, root, D, start="2024-01-01", end="2024-12-31", since="2024-05-02").count() == 1
    with pytest.raises(ValueError):
        ST.read(spark, root, D, day="x", start="y", end="z")
    ST.compact(spark, root, D, str(tmp_path / "c"), "2024-05-04")
    assert sorted(r["n"] for r in ST.read(spark, str(tmp_path / "c"), D).collect()) == [2, 3, 4]
    assert ST.repartition_by(spark, root, D, "at", str(tmp_path / "p"), "2024-05-04")
    ST.delete(spark, root, D, str(tmp_path / "d"), "2016-01-01")
    assert ST.read(spark, str(tmp_path / "d"), D).count() == 2
    plan = ST.read(spark, root, D, day="2024-05-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "partition_date" in plan.split("PartitionFilters")[1][:300]


def test_files_and_results(spark, tmp_path):
    df = spark.range(10).repartition(4)
    df.write.parquet(str(tmp_path / "f"))
    tiers = ST.newest_files(spark.read.parquet(str(tmp_path / "f")).select("*", "_metadata"), 3)
    assert sorted(r["tier"] for r in tiers.collect()) == ["active"] * 3 + ["cache"] * (tiers.count() - 3)
    (tmp_path / "x.csv").write_text("a,b\n1,N/A\nnan,y\n")
    got = ST.read_results(spark, str(tmp_path / "x.csv"), T.StructType.fromDDL("a bigint, b string"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, None), (None, "y")]
    parts = spark.createDataFrame([(2024, 1, 2, 3, 4), (2024, 1, 2, 3, 5), (2025, 0, 0, 0, 0)], "year int, month int, day int, hour int, minute int")
    assert ST.after(parts, 2024, 1, 2, 3, 4).count() == 2


def test_views_and_queries(spark):
    CT.register_views(spark, {"numbers": (spark.range(5), ["id"])})
    assert CT.query(spark, "select count(*) from numbers where id > :x", x=2).first()[0] == 2
    with pytest.raises(ValueError):
        CT.query(spark, "drop table numbers")
    assert CT.quoted("a`b") == "`a``b`"


def test_queue(spark, tmp_path):
    path = str(tmp_path / "q")
    items = spark.createDataFrame([(i, f"u{i // 2}") for i in range(25)], "i long, uri string")
    Q.enqueue(Q.chunks(items, "i", 10, created_at="t1"), path)
    assert Q.load(spark, path).count() == 3
    Q.mark(spark, Q.load(spark, path, limit=1), "processing", "1", path)
    Q.mark(spark, Q.load(spark, path, status="processing"), "completed", "2", path)
    assert {r["status"] for r in Q.load(spark, path).collect()} == {"completed", "pending"}
    assert Q.items(Q.load(spark, path, status="pending"), "uri string").count() == 8  # repeats within a batch are one
    assert Q.load(spark, path, min_id=1).count() == 1 and Q.load(spark, path, since="t1").count() == 0
    ok, bad = Q.split_labels(spark.createDataFrame([(True,), (False,), (None,)], "was_successfully_labeled boolean"))
    assert (ok.count(), bad.count()) == (1, 2)


def test_claims(spark, tmp_path):
    path = str(tmp_path / "q")
    items = spark.createDataFrame([(i, f"u{i}") for i in range(40)], "i long, uri string")
    Q.enqueue(Q.chunks(items, "i", 4, created_at="t1"), path)
    with ThreadPoolExecutor(4) as pool:
        taken = list(pool.map(lambda t: Q.claim(spark, path, t, limit=10, lease=100, now=1000.0), "abcd"))
    assert sorted(i for t in taken for i in t) == list(range(10))  # each once
    holder = {i: name for name, ids in zip("abcd", taken, strict=True) for i in ids}
    assert Q.claim(spark, path, "e", now=1050.0) == []
    assert Q.finish(spark, path, holder[0], [0], "t2", now=1050.0) == [0] and Q.finish(spark, path, "e", [1], "t2", now=1050.0) == []
    assert Q.claim(spark, path, "e", limit=2, lease=100, now=1101.0) == [1, 2]  # the crashed takers' batches return, the finished one does not
    assert Q.finish(spark, path, holder[1], [1], "t3", now=1102.0) == []  # too late: another holds it
    assert Q.finish(spark, path, "e", [1, 2], "t3", now=1102.0) == [1, 2]
    (tmp_path / "q/claims/3/000002").write_text("")  # a taker that died between creating and writing
    assert 3 not in Q.claim(spark, path, "f", limit=10, lease=100, now=1200.0)


def message(did, kind, op="create", **record):
    return json.dumps({"did": did, "time_us": 1_700_000_000_000_000, "kind": "commit", "commit": {"operation": op, "collection": f"app.{kind}", "rkey": "k", "record": record}})


def test_routes_state_and_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join([message("s1", "post", uri="p1"), message("n1", "post", uri="p2"), message("x", "post", uri="p3"), message("s1", "post", "delete", uri="p0"), "junk", '{"did":"x"}']))
    study, near = spark.createDataFrame([("s1",)], "did string"), spark.createDataFrame([("n1",)], "did string")

    def run():
        I.route_stream(I.read_lines(spark, str(src)), study, near, str(tmp_path / "posts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r["route"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["in_network_post", "study_user_post"]
    (src / "2.json").write_text("\n".join([message("x", "like", uri="l1", subject_uri="p1"), message("s1", "follow", uri="f1", subject_did="s1"), message("y", "reply", uri="r1", parent_uri="p1"), message("y", "reply", uri="r2", parent_uri="p3"), message("s1", "post", "update", uri="p1")]))
    assert run() == sorted(["in_network_post", "study_user_post", "like_on_study_user_post", "reply_to_study_user_post", "study_user_follows", "study_user_followed"])


class Store:
    """A state store of one key, for the processor alone."""

    def __init__(self):
        self.owner, self.rows, self.timers = None, [], []

    def getValueState(self, name, schema, ttl=None):  # noqa: N802
        return self

    def getListState(self, name, schema, ttl=None):  # noqa: N802
        return Held(self)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def get(self):
        return self.owner

    def update(self, value):
        self.owner = value


class Held:
    def __init__(self, store):
        self.store = store

    def get(self):
        return iter(list(self.store.rows))

    def exists(self):
        return bool(self.store.rows)

    def put(self, rows):
        self.store.rows = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.store.rows += rows

    def clear(self):
        self.store.rows = []


def test_what_waits_for_its_post(spark):
    now = type("Now", (), {"getCurrentProcessingTimeInMs": lambda self: self.at})()
    fields = I._AIMED
    row = lambda name, is_own=False: Row(**dict.fromkeys(fields), is_own=is_own).asDict() | {"did": name, "is_own": is_own}
    rows = lambda *names: [Row(**row(n)) for n in names]
    store, p = Store(), I.StudyPostAudience(wait_ms=100)
    p.CHUNK = 2
    p.init(store)
    now.at = 10
    assert not list(p.handleInputRows(("k",), iter(rows("a", "b", "c")), now)) and len(store.rows) == 3
    now.at = 60
    assert not list(p.handleInputRows(("k",), iter(rows("d")), now)) and store.timers == [110]
    now.at = 115
    assert not list(p.handleExpiredTimer(("k",), now, None))
    assert [r[0] for r in store.rows] == ["d"] and store.timers[-1] == 160
    got = list(p.handleInputRows(("k",), iter([*rows("e"), Row(**row("owner", True)), *rows("f")]), now))
    assert [(r["did"], r["owner"]) for r in got] == [("d", "owner"), ("e", "owner"), ("f", "owner")] and not store.rows
    assert [r["owner"] for r in p.handleInputRows(("k",), iter([Row(**row("other", True)), *rows("g")]), now)] == ["owner"]  # the first owner stays


def test_likes_before_posts_and_rejects(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    study, near = spark.createDataFrame([("s1",)], "did string"), spark.createDataFrame([], "did string")
    known = spark.createDataFrame([("old", "s1")], "uri string, owner string")

    def run(n, *lines):
        (src / f"{n}.json").write_text("\n".join(lines))
        I.route_stream(I.read_lines(spark, str(src)), study, near, str(tmp_path / "posts"), str(tmp_path / "out"), str(tmp_path / "cp"), rejected_path=str(tmp_path / "bad"), known_posts=known).awaitTermination()
        return sorted((r["uri"], r["owner"]) for r in spark.read.parquet(str(tmp_path / "out")).where("owner is not null").collect())

    assert run(1, message("x", "like", uri="l1", subject_uri="p1"), message("x", "like", uri="l2", subject_uri="never"), message("y", "like", uri="l3", subject_uri="old"), "junk", "") == [("l3", "s1")]
    assert run(2, message("z", "like", uri="l4", subject_uri="p1"), message("s1", "post", uri="p1")) == [("l1", "s1"), ("l3", "s1"), ("l4", "s1")]
    bad = spark.read.parquet(str(tmp_path / "bad")).select("reason", "raw").collect()
    assert ("malformed", "junk") in set(map(tuple, bad)) and {r["reason"] for r in bad} == {"malformed"}


def test_audience_without_python_state(spark, tmp_path, monkeypatch):
    """Addresses cost no Python calls, each has one owner, and what has waited its time meets nothing."""
    src, study = tmp_path / "in", spark.createDataFrame([("s1",), ("s2",)], "did string")
    src.mkdir()
    monkeypatch.setattr(GroupedData, "transformWithState", None)

    def run(name, wait, *batches):
        for n, lines in enumerate(batches):
            (src / f"{name}{n}.json").write_text("\n".join(lines))
            records = I.flagged(I.operations(I.parse(I.read_lines(spark, f"{src}/{name}*"))), study, study.where("false"))
            met = I.on_study_posts(records, wait).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out"))
            met.option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["uri"], r["owner"]) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect())

    first = [message("x", "like", uri="l0", subject_uri="p2"), message("x", "like", uri="l1", subject_uri="p1"), message("s1", "post", uri="p1"), message("s1", "post", uri="p1"), message("s1", "reply", uri="r1", parent_uri="p1")]
    second = [message("s2", "post", uri="p1"), message("y", "like", uri="l2", subject_uri="p1"), message("y", "like", uri="l3", subject_uri="r1"), message("s2", "post", uri="p2")]
    assert run("a", timedelta(days=7), first, second) == [("l0", "s2"), ("l1", "s1"), ("l2", "s1"), ("l3", "s1"), ("r1", "s1")]
    assert run("b", timedelta(milliseconds=1), first, second) == [("l1", "s1"), ("l2", "s1"), ("l3", "s1"), ("r1", "s1")]


def test_parts_are_written_by_many_tasks(spark, monkeypatch):
    """However large a part of the late stream is, its messages are dealt over the cores, and it stays one micro-batch."""
    seen, cores = [], spark.sparkContext.defaultParallelism

    def routed(spark, sf, root, per_trigger=None):
        seen.append((spark.read.format("binaryFile").load(f"{root}/in").count(), per_trigger))
        spark.createDataFrame([("x",)], "route string").write.mode("overwrite").parquet(f"{root}/out")

    monkeypatch.setattr(P, "_routed", routed)
    P.stream_late_and_early(spark, SF)
    assert seen == [(2 * cores, cores), (4 * cores, cores)]


def test_queue_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(message("a", "post", uri="p") + "\nbad\n")
    I.to_queue(I.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("kind", "did").collect()[0]["did"] == "a"


def test_sessions(spark, tmp_path):
    e = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("u", "2024-01-01 02:00:00"), ("u", "2024-01-02 00:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    e.write.parquet(str(tmp_path / "e"))
    s = I.sessions(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "t", ["k"])
    s.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2]


def test_lots_read_the_queue_once(spark, tmp_path, monkeypatch):
    """One taker's lots hold all that nobody holds; a crashed taker's batch comes last, a finished one never again."""
    path, reads, load = str(tmp_path / "q"), [], Q.load
    Q.enqueue(Q.chunks(spark.range(40).select(F.col("id").alias("i"), "id"), "i", 2, created_at="t1"), path)
    assert Q.claim(spark, path, "crashed", limit=2, lease=1, now=1000.0) == [0, 1]
    assert Q.claim(spark, path, "other", limit=1) == [0] and Q.finish(spark, path, "other", [0], "t2") == [0]
    monkeypatch.setattr(Q, "load", lambda *a, **k: reads.append(1) or load(*a, **k))
    got = []
    for ids in Q.lots(spark, path, "a", limit=3):
        assert len(ids) <= 3
        got += Q.finish(spark, path, "a", ids, "t3")
    assert got == [*range(2, 20), 1] and len(reads) == 3
    assert load(spark, path, status="pending").count() == 0
