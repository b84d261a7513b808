"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, A-Z lower-cased. A mask looks at some positions of a
window and ignores the others, so a hit survives substituted tokens at the ignored places.
The hashes of all masks at all places of the benchmark meet those of the documents; around
every hit the item is laid along the document and the equal tokens are counted, without any
tolerance for shifts. A document holds an item if MIN_SHARE of the item's tokens stand at
their places, or if a stretch of LONG_RUN places or more has MIN_RUN_SHARE of them.

Items of up to SHORT tokens have one seed, all their tokens, and must stand whole.

A benchmark of up to BLOCK_TOKENS tokens, counted before, travels to the tasks (a broadcast join):
the documents are then never shuffled, so a passage in a third of all documents costs no more than
any other. A larger one stays distributed: its seeds are a table, a Bloom filter of fixed size
over them thins the seeds of the documents, both meet in a shuffled join that Spark splits where a
seed is hot, and what they propose is verified on the distinct texts, batch by batch. Both ways
give the same rows.

Null texts have no tokens. Rows that repeat a doc_id or item_id are handled one by one; the
result has a row for each (doc_id, item_id), the overlap with most equal tokens, of ties the
first place. Rows of null ids give rows of null ids in ``contaminated`` if they are documents, and
take no part if they are items. Long texts are searched whole. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common as C

U64 = C.U64
#: Positions of a window that a mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 6, 7), (0, 1, 4, 6, 8))
MIN_SHARE = 0.6
LONG_RUN, MIN_RUN_SHARE = 25, 0.8
#: Items of so many tokens or fewer are looked for as a whole.
SHORT = 4
#: Tokens of a benchmark that may travel to the tasks (about 100 bytes each).
BLOCK_TOKENS = 500_000
FILTER_BITS = 22
#: Pairs of places that a task looks at together.
PAIRS = 500_000


def seeds(words: np.ndarray, rows: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the mask at every place where its window lies within a row, and the places."""
    span = mask[-1] + 1
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, np.int64)
    h = np.zeros(n, dtype=U64)
    h += U64(0x632BE59BD9B4E019 * len(mask) % 2**64)
    for k, at in enumerate(mask):
        h += words[at : at + n] * U64((0x9FB21C651E98DF25 + 0x6A09E667F3BCC908 * (k + 1)) % 2**64 | 1)
    h ^= h >> U64(31)
    h *= U64(0x94D049BB133111EB)
    places = np.flatnonzero(rows[:n] == rows[span - 1 :])
    return h[places], places


#: The masks, and for items of up to SHORT tokens one of all their tokens each.
ALL_MASKS = (*MASKS, *(tuple(range(n)) for n in range(1, SHORT + 1)))


def item_seeds(words: np.ndarray, rows: np.ndarray, start: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of items and their places: those of a short mask only of items that it covers whole."""
    h, at = seeds(words, rows, mask)
    if len(mask) <= SHORT:
        whole = np.diff(start)[rows[at]] == len(mask)
        h, at = h[whole], at[whole]
    return h, at


class Block:
    """Seeds of some benchmark items, sorted for search, with their tokens."""

    def __init__(self, ids: list[int], texts: pa.Array):
        words, rows = [], []
        for first, _, data, offsets in C.text_slices(texts):
            w, r = C.words_of(data, offsets, C.MARKS)
            words.append(w)
            rows.append(r + first)
        self.ids = np.array(ids, dtype=np.int64)
        self.words = np.concatenate(words) if words else np.zeros(0, dtype=U64)
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.start = np.searchsorted(row, np.arange(len(ids) + 1))
        self.seeds = []
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        for mask in ALL_MASKS:
            h, at = item_seeds(self.words, row, self.start, mask)
            order = np.argsort(h)
            h, at = h[order], at[order]
            self.filter[(h >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.seeds.append((h, row[at], at - self.start[row[at]]))

    def overlaps(self, words: np.ndarray, rows: np.ndarray, n_rows: int):
        """row, item, equal tokens, tokens and place of every (row, item, place) held."""
        begins = np.searchsorted(rows, np.arange(n_rows + 1))
        out: list[tuple] = []
        for mask, (h, item, q) in zip(ALL_MASKS, self.seeds, strict=True):
            if not len(h):
                continue
            d, at = seeds(words, rows, mask)
            maybe = np.flatnonzero(self.filter[(d >> U64(64 - FILTER_BITS)).astype(np.int64)])
            d, at = d[maybe], at[maybe]
            lo = np.searchsorted(h, d)
            k = np.searchsorted(h, d, side="right") - lo
            at, lo, k = at[k > 0], lo[k > 0], k[k > 0]
            ends = np.cumsum(k)
            a = 0
            while a < len(k):  # a bounded number of pairs, however often a seed comes
                e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
                n = k[a:e]
                of = np.repeat(lo[a:e] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                proposed = np.unique(np.stack([rows[np.repeat(at[a:e], n)], item[of], np.repeat(at[a:e], n) - q[of]]), axis=1)
                out += self.verified(words, begins, *proposed)
                a = e
        return set(out)

    def verified(self, words, begins, row, item, begin):
        """Those of the proposed (row, item, place of the item's first token) that are held, as overlaps gives them."""
        length = self.start[item + 1] - self.start[item]
        out, a, ends = [], 0, np.cumsum(length)
        while a < len(row):
            e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
            out += self._verify(words, begins, row[a:e], item[a:e], begin[a:e], length[a:e])
            a = e
        return out

    def _verify(self, words, begins, row, item, begin, length):
        of = np.repeat(np.arange(len(row)), length)
        j = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        at = begin[of] + j
        inside = (at >= begins[row[of]]) & (at < begins[row[of] + 1])
        same = inside & (words[np.clip(at, 0, len(words) - 1)] == self.words[self.start[item[of]] + j])
        total = np.concatenate([[0], np.cumsum(same)])
        ends = np.cumsum(length)
        equal = total[ends] - total[ends - length]
        held = equal >= np.where(length > SHORT, MIN_SHARE * length, length)
        for i in np.flatnonzero(~held & (length >= LONG_RUN) & (equal >= MIN_RUN_SHARE * LONG_RUN)):
            c = total[ends[i] - length[i] : ends[i] + 1]
            held[i] = (c[LONG_RUN:] - c[:-LONG_RUN]).max() >= MIN_RUN_SHARE * LONG_RUN
        return [(int(row[i]), int(item[i]), int(equal[i]), int(length[i]), int(begin[i] - begins[row[i]])) for i in np.flatnonzero(held)]


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_equal", pa.int32()), ("n_tokens", pa.int32()), ("token", pa.int32())])
_SHAPE = "doc_id long, item_id long, n_equal int, n_tokens int, token int"


def _items(benchmark: DataFrame, item_key: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null and id is not null")


def _small(items: DataFrame):
    """A broadcast Block of the items if their tokens are within BLOCK_TOKENS, else None."""
    size = items.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0  # a token and its gap have two bytes
    if size > BLOCK_TOKENS:
        return None
    whole = items.toArrow()
    return items.sparkSession.sparkContext.broadcast(Block(whole.column(0).to_pylist(), whole.column(1)))


def _search(block):
    """Overlaps of (doc_id, text) batches with a block of the benchmark."""

    def search(batches):
        for b in batches:
            ids, found = b.column(0), []
            for first, end, data, offsets in C.text_slices(b.column(1)):
                words, rows = C.words_of(data, offsets, C.MARKS)
                found += [(ids[first + r].as_py(), int(block.value.ids[i]), e, n, p) for r, i, e, n, p in block.value.overlaps(words, rows, end - first)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return search


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """t1, t2 (of a text) and what ``contaminated`` says, by a join of seeds; docs has text, t1, t2.

    Item texts are known by number; a text that several items hold is one item until the end.
    """
    spark = docs.sparkSession
    items = C.materialize(items.groupBy("text").agg(F.min("id").alias("any")).withColumn("item", F.monotonically_increasing_id()).select("item", "text"), "items")

    def of_items(batches):
        for b in batches:
            for first, end, data, offsets in C.text_slices(b.column(1)):
                words, rows = C.words_of(data, offsets, C.MARKS)
                start = np.searchsorted(rows, np.arange(end - first + 1))
                for mask in ALL_MASKS:
                    h, at = item_seeds(words, rows, start, mask)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pa.array(rows[at] + first)), pa.array((at - start[rows[at]]).astype(np.int32))], ["h", "item", "q"])

    sown = C.materialize(items.mapInArrow(of_items, "h long, item long, q int"), "item-seeds")
    bits = min(27, max(16, int(np.ceil(np.log2(16 * sown.count() + 1)))))
    some = spark.sparkContext.broadcast([C.take_bits(spark, sown.select((F.col("h") if k == 0 else F.xxhash64("h")).alias("h")), "h", bits) for k in (0, 1)])

    def of_texts(batches):
        for b in batches:
            for first, end, data, offsets in C.text_slices(b.column(0)):
                words, rows = C.words_of(data, offsets, C.MARKS)
                start = np.searchsorted(rows, np.arange(end - first + 1))
                for mask in ALL_MASKS:
                    h, at = seeds(words, rows, mask)
                    own = np.flatnonzero(C.has_bit(some.value[0], h, bits))
                    of = pa.array(rows[at[own]] + first)
                    yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), b.column(1).take(of), b.column(2).take(of), pa.array((at[own] - start[rows[at[own]]]).astype(np.int32))], ["h", "t1", "t2", "p"])

    def thinned(batches):
        for b in batches:
            yield b.filter(pa.array(C.has_bit(some.value[1], b.column(4).to_numpy().view(U64), bits))).select(["h", "t1", "t2", "p"])

    met = docs.select("text", "t1", "t2").mapInArrow(of_texts, "h long, t1 long, t2 long, p int").withColumn("x", F.xxhash64("h")).mapInArrow(thinned, "h long, t1 long, t2 long, p int")
    met = C.materialize(met, "text-seeds")
    proposed = met.join(sown, "h").select("t1", "t2", "item", (F.col("p") - F.col("q")).alias("begin")).distinct()
    held = docs.select("t1", "t2", "text").join(met.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    both = proposed.join(items.withColumnRenamed("text", "item_text"), "item").join(held, ["t1", "t2"])

    def verify(batches):
        for b in batches:
            found = []
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                t1, t2, item, begin = (part.column(i).to_pylist() for i in range(4))
                block = Block(list(range(part.num_rows)), part.column(4))
                for first, end, data, offsets in C.text_slices(part.column(5)):
                    words, rows = C.words_of(data, offsets, C.MARKS)
                    begins = np.searchsorted(rows, np.arange(end - first + 1))
                    own = np.arange(first, end)
                    for r, i, e, n, p in block.verified(words, begins, own - first, own, begins[:-1] + np.array(begin[first:end])):
                        found.append((t1[i], t2[i], item[i], e, n, p))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 6, [pa.int64()] * 3 + [pa.int32()] * 3, strict=True)], ["t1", "t2", "item", "n_equal", "n_tokens", "token"])

    found = both.select("t1", "t2", "item", "begin", "item_text", "text").mapInArrow(verify, "t1 long, t2 long, item long, n_equal int, n_tokens int, token int")
    return C.materialize(found.join(items, "item"), "overlaps").drop("item").withColumnRenamed("text", "item_text")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_equal, n_tokens, token (place of the item in the document, may be negative)."""
    items = _items(benchmark, item_key, item_text)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    block = _small(items)
    if block is not None:
        found = docs.mapInArrow(_search(block), _SHAPE)
    else:
        docs = docs.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
        found = _joined(docs, items).join(items.select("id", F.col("text").alias("item_text")), "item_text").join(docs.drop("text"), ["t1", "t2"])
        found = found.select("doc_id", F.col("id").alias("item_id"), "n_equal", "n_tokens", "token")
    best = F.max(F.struct("n_equal", F.negative("token").alias("t"), "n_tokens"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_equal", "b.n_tokens", F.negative("b.t").alias("token"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item; needs no key, and with a small benchmark no shuffle."""
    at = docs.columns.index(text)
    items = _items(benchmark, item_key, item_text)
    block = _small(items)
    if block is None:
        known = docs.withColumn("__t1", F.xxhash64(text)).withColumn("__t2", F.xxhash64(F.lit(1), text))
        found = _joined(known.select(F.col(text).alias("text"), F.col("__t1").alias("t1"), F.col("__t2").alias("t2")), items)
        return known.join(found.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct(), ["__t1", "__t2"], "left_anti").select(docs.columns)

    def keep(batches):
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for first, end, data, offsets in C.text_slices(b.column(at)):
                words, rows = C.words_of(data, offsets, C.MARKS)
                for hit in block.value.overlaps(words, rows, end - first):
                    clean[first + hit[0]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
