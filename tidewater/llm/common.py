"""What the corpus operators share: scratch tables, Arrow text buffers, hashing kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.scratch import SHUFFLE_CLEANUP, discard, shuffles_cleaned  # noqa: F401

#: Bytes of text that a kernel handles at once; its arrays take about 40 times as much memory.
SLICE_BYTES = 1 << 20

U64 = np.uint64


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session. Where it is unset, a local temporary folder takes its
    place if Spark runs on this machine alone; on a cluster that would part the data, and is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it: cuts the lineage,
    survives lost executors, and lets several readers share one computation.

    The shuffle files of the write go with it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over runs of rows of a string column.

    A run holds at most ``limit`` bytes, or one longer row. Null counts as empty. The
    bytes are a view of Arrow's buffer; offsets has end - first + 1 entries from 0.
    """
    base = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        n = len(chunk)
        if not n:
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("")
        if pa.types.is_large_string(chunk.type):
            kind = np.int64
        else:
            chunk, kind = chunk.cast(pa.string()), np.int32
        _, offsets, data = chunk.buffers()
        off = np.frombuffer(offsets, kind)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            end = int(np.searchsorted(off, off[first] + limit, side="right")) - 1
            end = min(n, max(end, first + 1))
            yield base + first, base + end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
            first = end
        base += n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (finaliser of the splitmix64 generator)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Spans of up to this many bytes are hashed together, eight bytes a step; longer ones one by one.
SHORT_SPAN = 64
_EIGHT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every data[start:end]; equal bytes give equal hashes anywhere.

    Each step mixes eight bytes into the state by a bijection, so spans of one length that differ
    in one step only never meet; longer spans have xxh3 of their bytes.
    """
    if lower:
        data = _LOWER[data]
    size = ends - starts
    h = mix64(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= SHORT_SPAN))
    k = 0
    while len(left):
        h[left] = mix64(h[left] ^ (eights[starts[left] + k] & _EIGHT[np.minimum(8, size[left] - k)]))
        k += 8
        left = left[size[left] > k]
    for i in np.flatnonzero(size > SHORT_SPAN):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].data)
    return h


#: Bytes that part tokens where punctuation does not count: ASCII other than letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes not in gap (space and \\t..\\r)."""
    solid = ~gap[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins = solid & ~before[:-1]
    begins[first] = solid[first]
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = solid
    finishes = solid & ~after[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    finishes[last] = solid[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def words_of(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z only) words of each row, and each word's row number.

    A row longer than the slice is cut at white space, so that memory stays bounded.
    """
    if len(data) <= 2 * SLICE_BYTES:
        starts, ends, rows = word_spans(data, offsets, gap)
        return span_hashes(data, starts, ends, lower=True), rows
    assert len(offsets) == 2
    hashes, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and not gap[data[end]]:
            end += 1
        part = data[at:end]
        starts, ends, _ = word_spans(part, np.array([0, len(part)]), gap)
        hashes.append(span_hashes(part, starts, ends, lower=True))
        at = end
    h = np.concatenate(hashes)
    return h, np.zeros(len(h), np.int64)


_TURN = [U64(x) for x in (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9E6C63D0876A9A47)]


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a row, and their rows; a row with fewer
    words (but at least one) gives its whole sequence as the only shingle."""
    counts = np.bincount(rows, minlength=n_rows)
    n = len(words)
    if n >= width:
        h = np.zeros(n - width + 1, dtype=U64)
        for k in range(width):
            h += mix64(words[k : n - width + 1 + k] * _TURN[k % 8] + U64(k))
        whole = rows[: n - width + 1] == rows[width - 1 :]
        h, of = mix64(h[whole]), rows[: n - width + 1][whole]
    else:
        h, of = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
        extra = np.zeros(len(short), dtype=U64)
        for i, r in enumerate(short):
            w = words[begins[r] : begins[r] + counts[r]]
            extra[i] = mix64((mix64(w * _TURN[7] + np.arange(len(w), dtype=U64))).sum(dtype=U64) + np.array([counts[r]], dtype=U64))[0]
        h, of = np.concatenate([h, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    return h, of


def distinct_per_row(h: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order, and offsets of the rows in them; rows must be sorted."""
    h = h.copy()
    ends = np.cumsum(np.bincount(rows, minlength=n_rows))
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[keep], rows[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])


def take_bits(spark: SparkSession, keys: DataFrame, column: str, bits: int = 23) -> np.ndarray:
    """A Bloom filter with one hash over a bigint column: a boolean array of 2**bits entries.

    Its size is fixed (2**bits / 8 bytes packed), so it may be broadcast whatever the number
    of keys; more keys only mean that more other rows pass, and those meet an exact join.
    Each task marks its keys in 4096-bit blocks; blocks are united by key.
    """
    n_blocks_bits = max(0, bits - 12)

    def mark(batches):
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            v = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            seen[bit_of(v, bits)] = True
        blocks = seen.reshape(1 << n_blocks_bits, -1)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([np.packbits(blocks[i]).tobytes() for i in used], pa.binary())], ["block", "bits"])

    def unite(batches):
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(v, np.uint8)
                have[k] = have[k] | v if k in have else v
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([v.tobytes() for v in have.values()], pa.binary())], ["block", "bits"])

    marked = keys.select(column).mapInArrow(mark, "block int, bits binary").repartition("block").mapInArrow(unite, "block int, bits binary")
    out = np.zeros((1 << n_blocks_bits, (1 << (bits - n_blocks_bits)) // 8), np.uint8)
    for block, packed in marked.toLocalIterator():
        out[block] = np.frombuffer(packed, np.uint8)
    return out.reshape(-1)


def bit_of(v: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(v) >> U64(64 - bits)).astype(np.int64)


def has_bit(packed: np.ndarray, v: np.ndarray, bits: int) -> np.ndarray:
    at = bit_of(v, bits)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def identity(key: Column, text: Column) -> list[Column]:
    """Columns kn, k, t1 and t2 that tell rows of different key or text apart, null or not."""
    return [key.isNull().alias("kn"), F.coalesce(key.cast("long"), F.lit(0)).alias("k"), F.xxhash64(text, text.isNull()).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
