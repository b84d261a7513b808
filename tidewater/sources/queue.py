"""Work queues as append-only tables: rows are JSON batches; status lives in a second table.

A table cannot update rows in place. Batches are appended; taking or finishing a batch
appends its id to a ledger; what is pending is the anti join of the two.

Takers that work at the same time claim batches: a claim is a numbered file that only one of them can
create, with a lease. A batch whose lease ran out before it was finished can be claimed again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCHES = "id bigint, payload string, metadata string, created_at string"
LEDGER = "id bigint, status string, at string"
CHUNK = 1000


def chunks(items: DataFrame, order: str, size: int = CHUNK, metadata: str = "{}", created_at: str = "") -> DataFrame:
    """Items (order: a dense number from 0) as batches of size rows, each a JSON list."""
    row = F.to_json(F.struct(*[c for c in items.columns if c != order]), {"ignoreNullFields": "false"})
    batch = items.select(F.floor(F.col(order) / size).cast("bigint").alias("id"), F.struct(F.col(order).alias("i"), row.alias("j")).alias("r"))
    joined = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["j"]), ","), F.lit("]"))
    return batch.groupBy("id").agg(joined.alias("payload")).select("id", "payload", F.lit(metadata).alias("metadata"), F.lit(created_at).alias("created_at"))


def enqueue(batches: DataFrame, path: str) -> None:
    batches.write.mode("append").parquet(f"{path}/batches")
    batches.sparkSession.createDataFrame([], LEDGER).write.mode("append").parquet(f"{path}/ledger")  # so that it is there


def mark(spark: SparkSession, ids: DataFrame, status: str, at: str, path: str) -> None:
    """Appends to the ledger in a folder of its own, since jobs that append to one folder at once lose files."""
    ids.select("id", F.lit(status).alias("status"), F.lit(at).alias("at")).write.parquet(f"{path}/ledger/mark-{uuid.uuid4().hex}")


def load(spark: SparkSession, path: str, status: str | None = None, min_id: int | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Batches with their last status; limit counts batches, oldest first.

    Of marks made at one time the greatest status counts. Marks lock nothing: takers that work on one
    queue at the same time use ``claim``.
    """
    df = spark.read.schema(BATCHES).parquet(f"{path}/batches")
    ledger = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{path}/ledger")
    df = df.join(ledger.groupBy("id").agg(F.max(F.struct("at", "status"))["status"].alias("status")), "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    if status is not None:
        df = df.where(F.col("status") == status)
    if min_id is not None:
        df = df.where(F.col("id") > min_id)
    if since is not None:
        df = df.where(F.col("created_at") > since)
    return df.orderBy("id").limit(limit) if limit is not None else df


def items(batches: DataFrame, schema: str) -> DataFrame:
    """One row an item with its batch_id; exact duplicates within a batch are one."""
    return batches.select(F.col("id").alias("batch_id"), F.explode(F.from_json("payload", f"array<struct<{schema}>>")).alias("i")).select("batch_id", "i.*").distinct()


def without(batches: DataFrame, ids: DataFrame) -> DataFrame:
    return batches.join(ids.select("id"), "id", "left_anti")


def split_labels(labels: DataFrame, flag: str = "was_successfully_labeled") -> tuple[DataFrame, DataFrame]:
    """Labels that succeeded, and those to be queued again."""
    ok = F.coalesce(F.col(flag), F.lit(False))
    return labels.where(ok), labels.where(~ok)


class _Claims:
    """The claim files of a queue: claims/<batch>/<attempt>, each written by the taker that created it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.root = spark._jvm, f"{path}/claims"
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def last(self, batch: int) -> tuple[int, dict | None]:
        """The number of attempts and the last claim; one that is still being written holds for a minute."""
        folder = self.path(str(batch))
        if not self.fs.exists(folder):
            return 0, None
        names = sorted(f.getPath().getName() for f in self.fs.listStatus(folder) if not f.getPath().getName().startswith("."))
        if not names:
            return 0, None
        stream = self.fs.open(self.path(f"{batch}/{names[-1]}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        written = self.fs.getFileStatus(self.path(f"{batch}/{names[-1]}")).getModificationTime()
        return len(names), json.loads(text) if text.endswith("}") else {"taker": None, "until": written + 60_000}

    def create(self, batch: int, attempt: int, claim: dict) -> bool:
        """Whether this taker, and no other, created the file."""
        self.fs.mkdirs(self.path(str(batch)))
        target = self.path(f"{batch}/{attempt:06}")
        try:
            if self.fs.getScheme() == "file":  # whose create is a check and then a write; the system's own is one step
                if not self.jvm.java.io.File(target.toUri().getPath()).createNewFile():
                    return False
                out = self.fs.create(target, True)
            else:
                out = self.fs.create(target, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or self.fs.exists(target):
                return False
            raise
        try:
            out.write(json.dumps(claim).encode())
        finally:
            out.close()
        return True


def claim(spark: SparkSession, path: str, taker: str, limit: int = 1, lease: float = 3600.0, now: float | None = None) -> list[int]:
    """Ids of up to limit batches, oldest first, that are now this taker's until the lease (seconds) ends.

    Batches that are finished, or that another holds, are passed over. On a store without an atomic create
    (some object stores) two takers could both succeed; the shared file systems of clusters have one.
    """
    claims, at = _Claims(spark, path), int((time.time() if now is None else now) * 1000)
    mine: list[int] = []
    for r in load(spark, path, status="pending").select("id").orderBy("id").toLocalIterator():
        attempts, last = claims.last(r["id"])
        if (last is None or last["until"] <= at) and claims.create(r["id"], attempts + 1, {"taker": taker, "until": at + int(lease * 1000)}):
            mine.append(r["id"])
            if len(mine) == limit:
                break
    return mine


def lots(spark: SparkSession, path: str, taker: str, limit: int, lease: float = 3600.0) -> Iterator[list[int]]:
    """Lots of up to limit batches that are now this taker's, until nothing is left to claim.

    What is pending is read once, not once a lot, so the work grows with the batches. Of that list only batches that
    nobody ever claimed are taken, since others may be finished by now; those are left to fresh reads at the end.
    """
    claims, mine = _Claims(spark, path), []
    for r in load(spark, path, status="pending").select("id").orderBy("id").toLocalIterator():
        if claims.last(r["id"])[0] == 0 and claims.create(r["id"], 1, {"taker": taker, "until": int((time.time() + lease) * 1000)}):
            mine.append(r["id"])
            if len(mine) == limit:
                yield mine
                mine = []
    if mine:
        yield mine
    while mine := claim(spark, path, taker, limit, lease):
        yield mine


def finish(spark: SparkSession, path: str, taker: str, ids: list[int], at: str, status: str = "completed", now: float | None = None) -> list[int]:
    """Marks those of the batches that the taker still holds, and returns them; others may be in other hands by now."""
    claims, time_ = _Claims(spark, path), int((time.time() if now is None else now) * 1000)
    held = [i for i in ids if (c := claims.last(i)[1]) and c["taker"] == taker and c["until"] > time_]
    if held:
        mark(spark, spark.createDataFrame([(i,) for i in held], "id long").coalesce(1), status, at, path)
    return held
