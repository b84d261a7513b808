"""Line dedup by overlapping runs of lines.

Every short line starts the shortest run of two lines or more, within its text, that has MIN_WORDS
words, and ends the shortest such run that ends there; a line of LONG_WORDS words or more is a run by
itself, since it is a passage of its own. A single short line is no run and stays. Each run depends
on its own lines alone, and the runs inside a passage cover all its lines, so that a repeated
passage of MIN_WORDS words goes whole, whatever stands before and after it.
Runs whose hash occurs again anywhere are told apart by 128 bits of SHA-256 of their bytes, which
take the place of the bytes, since runs overlap and on disk would come to more than the texts;
every occurrence but the first by (doc_id, line) is removed with its line ends. Runs
overlap, so of lines that repeat one another at once only the first is left; a line that goes
always has an equal line that stays.

Null texts stay null, and empty ones empty. Rows alike in doc_id and text are one document
and get the same result; a null doc_id sorts first. A document of which every line goes
keeps a row with an empty text and n_lines = n_removed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common as C

U64 = C.U64
LONG_WORDS, MIN_WORDS = 25, 12
_NEWLINE = 10


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without the newline) and row of every line; an empty row has one empty line."""
    breaks = np.flatnonzero(data == _NEWLINE)
    rows_of_breaks = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), rows_of_breaks])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends = np.where(last, offsets[rows + 1], np.concatenate([starts[1:], [0]]) - 1)
    return starts, ends, rows


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first line, lines, start byte and end byte of every run that counts, and its hash."""
    starts, ends, rows = line_spans(data, offsets)
    w_starts, _, _ = C.word_spans(data, offsets)
    words = np.searchsorted(w_starts, ends) - np.searchsorted(w_starts, starts)
    n, at = len(starts), np.arange(len(starts))
    total = np.concatenate([[0], np.cumsum(words)])
    row_first = np.searchsorted(rows, np.arange(len(offsets)))
    long = np.flatnonzero(words >= LONG_WORDS)
    short = words < LONG_WORDS
    until = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS), at + 2)  # of the run that starts at a line
    since = np.minimum(np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1, at - 1)  # of the run that ends there
    on, back = np.flatnonzero(short & (until <= row_first[rows + 1])), np.flatnonzero(short & (since >= row_first[rows]))
    first, last = np.concatenate([long, on, since[back]]), np.concatenate([long, until[on] - 1, back])
    once = np.unique(first * (n + 1) + last)
    first, last = once // (n + 1), once % (n + 1)
    a, e = starts[first], ends[last]
    return rows[first], first - row_first[rows[first]], last - first + 1, a, e, C.span_hashes(data, a, e)


def _with_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))


def _chunk_hashes(batches):
    for b in batches:
        for _, _, data, offsets in C.text_slices(b.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(chunks(data, offsets)[5].view(np.int64))], ["h"])


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """128 bits of SHA-256 of every data[start:end], as two columns."""
    whole = b"".join(hashlib.sha256(data[a:e]).digest()[:16] for a, e in zip(starts.tolist(), ends.tolist(), strict=True))
    return [pa.array(x) for x in np.frombuffer(whole, np.int64).reshape(-1, 2).T.copy()]


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """d, th (the document), first line and number of lines of every run to be removed."""
    spark = docs.sparkSession
    again = docs.select(text).mapInArrow(_chunk_hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    again = C.materialize(again, "line-hashes")
    n = again.count()
    bits = min(26, max(16, math.ceil(math.log2(16 * n + 1))))
    some = spark.sparkContext.broadcast(C.take_bits(spark, again, "h", bits))

    def occurrences(batches):
        for b in batches:
            d, th = b.column(0), b.column(1)
            for first, _, data, offsets in C.text_slices(b.column(2)):
                row, line, lines, a, e, h = chunks(data, offsets)
                at = np.flatnonzero(C.has_bit(some.value, h, bits))
                of = pa.array(row[at] + first)
                yield pa.RecordBatch.from_arrays([d.take(of), th.take(of), pa.array(line[at].astype(np.int32)), pa.array(lines[at].astype(np.int32)), *digests(data, a[at], e[at])], ["d", "th", "line", "lines", "g1", "g2"])

    found = C.materialize(_with_key(docs, key, text).mapInArrow(occurrences, "d long, th long, line int, lines int, g1 long, g2 long"), "line-chunks")
    owner = found.groupBy("g1", "g2").agg(F.min(F.struct("d", "line", "th")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("g1", "g2", "owner")
    owner = C.materialize(owner, "line-owners")  # apart from the join, so that Spark can split what is skewed there
    out = found.join(owner, ["g1", "g2"]).where(F.struct("d", "line", "th") != F.col("owner")).select("d", "th", "line", "lines")
    out = C.materialize(out, "line-repeats")  # places only
    C.discard(again, found, owner)
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated runs taken out of text, and n_lines and n_removed added as __n_lines, __n_removed."""
    gone = repeated_chunks(docs, key, text).groupBy("d", "th").agg(F.collect_set(F.struct("line", "lines")).alias("__gone"))
    keyed = docs.withColumn("__d", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))).withColumn("__th", F.xxhash64(text))
    joined = keyed.join(gone.withColumnRenamed("d", "__d").withColumnRenamed("th", "__th"), ["__d", "__th"], "left")
    lines = F.split(F.col(text), "\n", -1)
    taken = F.flatten(F.transform("__gone", lambda g: F.sequence(g["line"], g["line"] + g["lines"] - 1)))
    flags = F.array_distinct(taken)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), flags)
    cleaned = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n"))
    out = joined.withColumn("__lines", lines).withColumn("__n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size(flags)))
    out = out.withColumn("__n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines"))).withColumn(text, cleaned)
    return out.select(*docs.columns, "__n_lines", "__n_removed")
