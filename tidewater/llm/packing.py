"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Lengths are whole numbers up to the capacity, so the range sorts of documents and gaps are
counting sorts: a run is all documents of one length, or neighbouring sequences with one gap,
and its members are told apart by rank. A round takes the longest run of documents that are
still to be placed and sweeps the gaps upwards from that length: each document gets the
successor of its length among the gaps, ranks say which document gets which sequence, the
gaps are updated, and what finds no gap opens new sequences. After at most ``capacity``
rounds every run is placed, exactly as best-fit decreasing would place its documents one by
one. Rounds work on runs alone (at most ``capacity`` lengths, whatever the input), while the
ranking and the assignment of documents are distributed and need no sort of the documents.

Null texts count as empty; every document has at least the closing token. Rows that repeat
a doc_id are packed row by row. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import common as C

CAPACITY = 2048
_FAR_SCRIPTS = re.compile("[^\x00-ӿ]")
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])


def default_paths() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@cache
def _fast(ranks_path: str):
    import public_tokenizers as P
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _exact(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def token_ids(text: str, json_path: str, ranks_path: str) -> list[int]:
    """Ids by the tokenizer file; texts of common scripts go through its faster twin, which has
    the same vocabulary and merges. A special token's string in a text gives its id."""
    if "<|endoftext|>" in text or _FAR_SCRIPTS.search(text):
        return _exact(json_path).encode(text, add_special_tokens=False).ids
    return _fast(ranks_path).encode_ordinary(text)


def token_pieces(docs: DataFrame, key: str, text: str, json_path: str, ranks_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document, with their rank among those of one length in one task."""

    def cut(batches):
        part, met = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            rows = []
            for key_, text_ in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array(token_ids(text_.as_py() or "", json_path, ranks_path) + [0], dtype="<u4")
                n = len(ids)
                at = 0
                for piece in range(-(-n // capacity)):
                    end = n - (-(-n // capacity) - 1 - piece) * capacity
                    rows.append((key_, piece, at, end - at, zlib.crc32(ids[at:end].data), part, met[end - at]))
                    met[end - at] += 1
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col(key).cast("long"), text).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def best_fit_rounds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, first sequence, documents to a sequence, offset), by length and rank.

    counts: documents of each length.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)
    sizes: list[int] = []  # the gaps there are, in order
    placed, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            successor = bisect_left(sizes, length)
            if successor == len(sizes):
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                gap = sizes[successor]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[successor]
            each = gap // length
            full = min(n, left // each)
            if full:
                placed.append((length, rank, first, each, capacity - gap))
                add(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # the last, partly filled sequence of this length
                placed.append((length, rank, first + full, left, capacity - gap))
                add(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            add(gap, first + full, n - full)
    return placed


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    known = default_paths()
    pieces = C.materialize(token_pieces(docs, key, text, json_path or known[0], ranks_path or known[1], capacity), "pieces")
    held = C.materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    placed = np.array(best_fit_rounds(counts, capacity), dtype=np.int64).reshape(-1, 5)
    table = spark.sparkContext.broadcast(placed)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("before", before).drop("n").hint("merge")  # grows with the tasks: never broadcast
    ranked = pieces.join(held, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))

    def assign(batches):
        t = table.value
        line = t[:, 0] * (1 << 48) + t[:, 1] if len(t) else t[:, 0]
        order = np.argsort(line)
        t, line = t[order], line[order]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            of = t[np.searchsorted(line, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - of[:, 1]
            each = np.maximum(of[:, 3], 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(of[:, 2] + nth // each), pa.array(of[:, 4] + nth % each * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
