"""N-gram Jaccard join: documents whose word-shingle sets are alike, joined exactly.

A document's set holds the 64-bit hashes of its distinct shingles. Sets of equal content
form one class, so copies are handled once, however many there are. If J(A, B) >= t and
|A| <= |B|, then under any one order of all shingles A's first |A| - ceil(2t/(1+t)|A|) + 1
entries and B's first |B| - ceil(t|B|) + 1 entries meet. The order used here is by hash,
with shingles that are frequent in the corpus moved to the end, so that a passage which
many documents share does not bring them all together. Each meeting shingle names a group
of classes; groups with the same members are united into one tile. Within a tile, classes
are sorted by size and compared only inside the size band that t allows; parity bitmaps of
hashed shingles bound the overlap from above (the sets differ in at least as many shingles
as their bitmaps do in bits). The connected parts of what is left are the final tiles; each
set travels to one tile, where only pairs that pass the bound meet as sorted arrays, exactly.

Classes are told apart by 128 bits of their sets and then numbered, so no two classes share a
number. Null and empty texts have an empty set and no links. Rows that repeat a doc_id keep a row
each. A row with a null doc_id links like any other, but cannot name a component: one that holds
only such rows has a null component_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import common as C
from tidewater.llm.components import connected_components

U64 = C.U64
_IDENTITY = ("kn", "k", "t1", "t2")
#: Classes, and entries of their sets, of a tile that one task compares; a larger tile is dealt
#: out as pairs of blocks.
TILE_ROWS, TILE_ITEMS = 1024, 1 << 21
#: Frequent shingles known to every task: 8 MB at most; past that only the most frequent.
#: They only set the order of shingles, so any choice of them gives the same links.
MAX_FREQUENT = 1 << 20


def overlap_needed(a: int, b: int, t: Fraction) -> int:
    """Least overlap of sets of sizes a and b with overlap / union >= t."""
    return -((-(a + b) * t.numerator) // (t.numerator + t.denominator))


def prefix_sizes(n: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a set of size n that must be looked at as the larger, as the smaller set."""
    p, q = t.numerator, t.denominator
    larger = n - (n * p + q - 1) // q + 1
    smaller = n - (2 * n * p + p + q - 1) // (p + q) + 1
    return larger, smaller


def _sets(column, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, sorted shingle hashes and row offsets for each run of rows."""
    for first, end, data, offsets in C.text_slices(column):
        words, rows = C.words_of(data, offsets)
        h, of = C.shingles(words, rows, end - first, width)
        h, off = C.distinct_per_row(h, of, end - first)
        yield first, h, off


def _class_ids(sets: list[np.ndarray]) -> list[pa.Array]:
    """The 128 bits of every set's class, as two columns."""
    whole = b"".join(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16) for s in sets)
    return [pa.array(x) for x in np.frombuffer(whole, np.int64).reshape(-1, 2).T.copy()]


def frequent_shingles(docs: DataFrame, text: str, width: int, t: Fraction, at_least: int) -> np.ndarray:
    """Shingles that stand near the front of many sets: sorted hashes, MAX_FREQUENT at most.

    Every task counts, over the distinct sets it sees, the shingles in the zone of hashes
    that prefixes reach, and passes on those it met three times; sums are made by key.
    """
    zone = U64(int(min(Fraction(1), 3 * (1 - t)) * (2**64 - 1)))

    def count(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            for _, h, off in _sets(b.column(0), width):
                for a, e in zip(off[:-1], off[1:], strict=True):
                    s = h[a : a + np.searchsorted(h[a:e], zone)]
                    if len(s) and (k := hash(s.tobytes())) not in seen:
                        if len(seen) < 1 << 18:
                            seen.add(k)
                        held.append(s)
                        n += len(s)
                if n > 2_000_000:
                    yield top(held)
                    held, n = [], 0
        if held:
            yield top(held)

    def top(held):
        v, c = np.unique(np.concatenate(held), return_counts=True)
        v, c = v[c >= 3], c[c >= 3]
        return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "n"])

    counted = docs.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)
    found = counted.orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(found.view(U64))


def signed_rows(docs: DataFrame, width: int, t: Fraction, frequent) -> DataFrame:
    """Identity, set size and class of each row of docs (kn, k, t1, t2, text), with the packed
    prefix and parity bitmap of the set where a task first meets it."""

    def sign(batches):
        hot, met = frequent.value, set()
        for b in batches:
            for first, h, off in _sets(b.column(4), width):
                n = np.diff(off)
                larger, _ = prefix_sizes(n, t)
                is_hot = np.zeros(len(h), bool)
                if len(hot) and len(h):
                    at = np.searchsorted(hot, h)
                    at[at == len(hot)] = 0
                    is_hot = hot[at] == h
                ids = _class_ids([h[a:e] for a, e in zip(off[:-1], off[1:], strict=True)])
                prefixes, maps = [None] * len(n), [None] * len(n)
                for i, (a, e, c) in enumerate(zip(off[:-1], off[1:], ids[0].to_pylist(), strict=True)):
                    if e == a or (c, n[i]) in met:
                        continue
                    if len(met) < 1 << 17:
                        met.add((c, n[i]))
                    s, f = h[a:e], is_hot[a:e]
                    cold = s[~f][: larger[i]]
                    if len(cold) < larger[i]:
                        cold = np.concatenate([cold, s[f][: larger[i] - len(cold)]])
                    prefixes[i], maps[i] = cold.tobytes(), parity_bitmap(s).tobytes()
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(n)) for c in b.columns[:4]), pa.array(n.astype(np.int64)), *ids, pa.array(prefixes, pa.binary()), pa.array(maps, pa.binary())], [*_IDENTITY, "n", "c1", "c2", "prefix", "bitmap"])

    return docs.mapInArrow(sign, "kn boolean, k long, t1 long, t2 long, n long, c1 long, c2 long, prefix binary, bitmap binary")


def shared_groups(classes: DataFrame, t: Fraction) -> DataFrame:
    """(tile, cls, n) for every group of two or more classes that meet in a shingle of their prefixes.

    The shingles arrive sorted, so a task holds the classes of one shingle at a time (ids and sizes).
    """

    def post(batches):
        for b in batches:
            cls, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            packed = b.column(2).to_pylist()
            for at in range(0, len(cls), 512):
                size = np.array([len(x) // 8 for x in packed[at : at + 512]])
                h = np.frombuffer(b"".join(packed[at : at + 512]), np.int64)
                place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                _, smaller = prefix_sizes(n[at : at + 512], t)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(cls[at : at + 512], size)), pa.array(np.repeat(n[at : at + 512], size)), pa.array(place < np.repeat(smaller, size))], ["h", "cls", "n", "small"])

    def whole_groups(batches):
        """Columns of runs of rows that hold all rows of their shingles."""
        held: list[list[np.ndarray]] = []
        for b in batches:
            if b.num_rows:
                new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                last = int(np.searchsorted(new[0], new[0][-1]))
                if held and (last or held[-1][0][-1] != new[0][0]):
                    yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in new], strict=True)]
                    held = []
                elif last:
                    yield [c[:last] for c in new]
                held.append([c[last:] for c in new])
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def gather(batches):
        done: set[int] = set()
        for h, cls, n, small in whole_groups(batches):
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            several = np.flatnonzero(np.diff(cut) > 1)
            tiles, members, sizes = [], [], []
            for a, e in zip(cut[several], cut[several + 1], strict=True):
                if not small[a:e].any():
                    continue
                c, m = cls[a:e], n[a:e]
                # runs of the size order in which each next set is in reach of the last
                apart = np.flatnonzero(m[:-1] * t.denominator < m[1:] * t.numerator)
                for x, y in zip(np.concatenate([[0], apart + 1]), np.concatenate([apart + 1, [len(c)]]), strict=True):
                    if y - x < 2:
                        continue
                    tile = xxhash.xxh3_64_intdigest(np.sort(c[x:y]).tobytes()) - (1 << 63)
                    if tile in done:
                        continue
                    if len(done) >= 1 << 18:  # what comes twice then is dropped after the shuffle
                        done.clear()
                    done.add(tile)
                    tiles.append(np.full(y - x, tile))
                    members.append(c[x:y])
                    sizes.append(m[x:y])
            if tiles:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tiles, members, sizes)], ["tile", "cls", "n"])

    posted = classes.select("cls", "n", "prefix").mapInArrow(post, "h long, cls long, n long, small boolean")
    return posted.repartition("h").sortWithinPartitions("h", "n", "cls").mapInArrow(gather, "tile long, cls long, n long").dropDuplicates(["tile", "cls"])


def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """Bit k says whether an odd number of shingles hash to k; half to one bit a shingle, 64 at least."""
    bits = max(64, 1 << (max(len(s) - 1, 1).bit_length() - 1))
    odd = np.bincount((C.mix64(s) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(U64)


class Band:
    """Sets in size order, with the bit counts that bound their overlaps from above.

    Bitmaps of two lengths meet at the shorter one: the longer is folded by xor, which
    again gives parities.
    """

    def __init__(self, sizes: np.ndarray, bitmaps: list[np.ndarray], t: Fraction):
        self.order = np.argsort(sizes, kind="stable")
        self.size, self.t = sizes[self.order], t
        self.width = np.array([len(bitmaps[i]) for i in self.order])
        self.maps: dict[int, tuple[int, np.ndarray]] = {}
        for w in np.unique(self.width):
            a, e = np.searchsorted(self.width, w), np.searchsorted(self.width, 2 * w, side="right")
            rows = [bitmaps[i] for i in self.order[a:e]]
            self.maps[int(w)] = int(a), np.stack([r if len(r) == w else np.bitwise_xor.reduce(r.reshape(-1, w), axis=0) for r in rows])

    def partners(self, x: int, apart: np.ndarray) -> np.ndarray:
        """Places after x whose sets may have the overlap that t asks for, among those marked in apart."""
        p, q = self.t.numerator, self.t.denominator
        end = int(np.searchsorted(self.size * p, self.size[x] * q, side="right"))
        ys = x + 1 + np.flatnonzero(apart[x + 1 : end])
        if len(ys):
            first, rows = self.maps[int(self.width[x])]
            differ = np.bitwise_count(rows[ys - first] ^ rows[x - first]).sum(axis=1, dtype=np.int64)
            total = self.size[ys] + self.size[x]
            ys = ys[(total - differ) // 2 >= -(-(total * p) // (p + q))]
        return ys


def candidate_stars(ids: np.ndarray, sizes: np.ndarray, bitmaps: list[np.ndarray], t: Fraction) -> list[tuple[int, int]]:
    """What the bit counts leave of a tile: each connected part, as a star around its least id."""
    band = Band(sizes, bitmaps, t)
    root = np.arange(len(ids))
    for x in range(len(ids)):
        for y in band.partners(x, root != root[x]):
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
    ids, found = ids[band.order], []
    for r in np.unique(root):
        part = ids[root == r]
        found += [(int(i), int(part.min())) for i in part if i != part.min()]
    return found


def linked_pairs(ids: np.ndarray, sets: list[np.ndarray], t: Fraction, left: int | None = None) -> list[tuple[int, int]]:
    """Links of a tile that connect what its exact links connect (a forest of them).

    Sets are visited in size order; those outside the band are never compared. With
    ``left``, only pairs of one of the first ``left`` sets with one of the rest count.
    """
    band = Band(np.array([len(s) for s in sets]), [parity_bitmap(s) for s in sets], t)
    side = band.order < (left if left is not None else 0)
    root, found = np.arange(len(sets)), []
    for x in range(len(sets)):
        for y in band.partners(x, (root != root[x]) & (side != side[x] if left is not None else True)):
            if root[y] == root[x]:
                continue
            a, b = sets[band.order[x]], sets[band.order[y]]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum())
            if both * t.denominator >= (len(a) + len(b) - both) * t.numerator:
                found.append((int(ids[band.order[x]]), int(ids[band.order[y]])))
                root[root == root[y]] = root[x]
    return found


def _by_tile(batches, n_keys: int, compare):
    """Run compare(key, columns) over runs of rows with equal first n_keys columns; yield its pairs."""
    key, held = None, []

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    for b in batches:
        found = []
        columns = [c.to_pylist() for c in b.columns]
        for row in zip(*columns, strict=True):
            if row[:n_keys] != key:
                if len(held) > 1:
                    found += compare(key, held)
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
        if found:
            yield batch(found)
    if len(held) > 1 and (found := compare(key, held)):
        yield batch(found)


def dealt_in_blocks(tiles: DataFrame) -> DataFrame:
    """tile, lo, hi, is_lo, cls: tiles of over TILE_ROWS rows or TILE_ITEMS entries become pairs of blocks, others one pair (0, 0)."""
    counted = tiles.groupBy("tile").agg((F.count("*") / (TILE_ROWS // 2)).alias("rows"), (F.sum("n") / (TILE_ITEMS // 2)).alias("items"))
    large = counted.where("rows > 2 or items > 2").select("tile", F.ceil(F.greatest("rows", "items")).cast("int").alias("blocks"))
    large = C.materialize(large, "large-tiles")  # apart from its join, so that Spark can split what is skewed there
    placed = tiles.join(large, "tile", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("cls"), F.col("blocks")), F.lit(0)).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumn("other", other).select("tile", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") <= F.col("other")).alias("is_lo"), "cls")


def candidate_parts(tiles: DataFrame, bitmaps: DataFrame, t: Fraction) -> DataFrame:
    """(tile, cls, n): connected parts of what the bit counts leave of all tiles; every class at most once."""

    def compare(_, rows):
        ids = np.array([r[0] for r in rows])
        return candidate_stars(ids, np.array([r[1] for r in rows]), [np.frombuffer(r[2], U64) for r in rows], t)

    joined = dealt_in_blocks(tiles).join(bitmaps, "cls").select("tile", "lo", "hi", "cls", "n", "bitmap")
    spread = joined.repartition("tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi", "cls")
    stars = spread.mapInArrow(lambda it: _by_tile(it, 3, compare), "a long, b long")
    parts = C.materialize(connected_components(stars), "jaccard-parts")
    return parts.select(F.col("component").alias("tile"), F.col("node").alias("cls")).join(bitmaps.select("cls", "n"), "cls")


def tile_links(tiles: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """(a, b): links between classes, found tile by tile from (tile, cls, n) and (cls, items)."""

    def compare(key, rows):
        if key[1] != key[2]:
            rows = sorted(rows, key=lambda r: not r[0])
        items = [np.frombuffer(r[2], U64) for r in rows]
        return linked_pairs(np.array([r[1] for r in rows]), items, t, None if key[1] == key[2] else sum(r[0] for r in rows))

    joined = dealt_in_blocks(tiles).join(sets, "cls").select("tile", "lo", "hi", "is_lo", "cls", "items")
    spread = joined.repartition("tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi", "cls")
    return spread.mapInArrow(lambda it: _by_tile(it, 3, compare), "a long, b long").dropDuplicates()


def classified(docs: DataFrame, key: str, text: str, width: int, threshold: tuple[int, int], frequent_from: int) -> tuple[DataFrame, DataFrame]:
    """Rows (identity, n, c1, c2), and of each class (c1, c2) its group and the group's least key."""
    spark: SparkSession = docs.sparkSession
    t = Fraction(*threshold)
    docs = docs.select(*C.identity(F.col(key), F.col(text)), F.col(text).alias("_text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, "_text", width, t, frequent_from))
    signed = C.materialize(signed_rows(docs, width, t, frequent), "jaccard-sets")
    # one row a class, combined before the shuffle however many copies there are
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    classes = signed.where("n > 0").groupBy("c1", "c2").agg(F.min(F.when(~F.col("kn"), F.col("k"))).alias("key"), F.min(F.struct(*_IDENTITY)).alias("row"), first("n"), first("prefix"), first("bitmap"))
    whole = C.materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "jaccard-classes")
    # prefixes and bitmaps are most of both tables: what is needed later is kept without them
    rows = C.materialize(signed.select(*_IDENTITY, "n", "c1", "c2"), "jaccard-rows")
    C.discard(signed)
    groups = C.materialize(shared_groups(whole, t), "jaccard-groups")
    tiles = C.materialize(candidate_parts(groups.select("tile", "cls", "n"), whole.select("cls", "n", "bitmap"), t), "jaccard-tiles")
    classes = C.materialize(whole.drop("n", "prefix", "bitmap"), "jaccard-numbers")
    C.discard(whole, groups)

    # of each class in a tile, the row whose text gives its set
    owners = C.materialize(classes.join(tiles, "cls", "left_semi").select("cls", "c1", "c2", F.xxhash64(*(f"row.{c}" for c in _IDENTITY)).alias("row")), "jaccard-owners")
    some = spark.sparkContext.broadcast(C.take_bits(spark, owners, "row"))

    def items(batches):
        for b in batches:
            at = np.flatnonzero(C.has_bit(some.value, b.column(0).to_numpy().view(U64), 23))
            if not len(at):
                continue
            rows = pa.array(at)
            for first, h, off in _sets(b.column(1).take(rows), width):
                s = [h[a:e] for a, e in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows.slice(first, len(s))), *_class_ids(s), pa.array([x.tobytes() for x in s], pa.binary())], ["row", "c1", "c2", "items"])

    full = docs.select(F.xxhash64(*_IDENTITY).alias("row"), "_text").mapInArrow(items, "row long, c1 long, c2 long, items binary")
    full = full.join(owners, ["row", "c1", "c2"]).dropDuplicates(["cls"]).select("cls", "items")
    links = C.materialize(tile_links(tiles, full, t), "jaccard-links")
    linked = C.materialize(connected_components(links), "jaccard-linked")

    # smallest document of each class, then of each group of classes
    least = classes.select("c1", "c2", "cls", "key").join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("grp", F.coalesce("component", "cls"))
    least = C.materialize(least.select("c1", "c2", "grp", "key"), "jaccard-least")
    in_group = C.materialize(least.groupBy("grp").agg(F.min("key").alias("component_id")), "jaccard-components")
    by_class = C.materialize(least.drop("key").join(in_group, "grp"), "jaccard-by-class")
    C.discard(classes, tiles, owners, links, linked, least, in_group)
    return rows, by_class


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, threshold: tuple[int, int] = (85, 100), frequent_from: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest key reachable by links) of each document."""
    rows, by_class = classified(docs, key, text, width, threshold, frequent_from)
    out = rows.withColumn("doc_id", F.when(~F.col("kn"), F.col("k"))).join(by_class, ["c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100), frequent_from: int = 64) -> DataFrame:
    """The rows of docs without all but one of each group: of the smallest key, nulls last, and of the
    rows with that key one text. Rows without words stay."""
    rows, by_class = classified(docs, key, text, width, threshold, frequent_from)
    merged = C.materialize(rows.where("n > 0").groupBy(*_IDENTITY).agg(F.first("c1").alias("c1"), F.first("c2").alias("c2"), F.count("*").alias("m")), "jaccard-alike")
    alike = C.materialize(merged.join(by_class.select("c1", "c2", "grp"), ["c1", "c2"]).select(*_IDENTITY, "m", "grp"), "jaccard-in-group")
    C.discard(rows, merged, by_class)
    kept = C.materialize(alike.groupBy("grp").agg(F.min(F.struct(*_IDENTITY)).alias("kept"), F.sum("m").alias("all")).where("all > 1"), "jaccard-kept")
    marks = alike.join(kept, "grp").select(*_IDENTITY, (F.struct(*_IDENTITY) == F.col("kept")).alias("stays"), "m").where("m > 1 or not stays")
    marks = C.materialize(marks, "jaccard-marks")
    C.discard(alike, kept)
    own = [f"__{c}" for c in _IDENTITY]
    wide = docs.withColumns({o: c for o, c in zip(own, C.identity(F.col(key), F.col(text)), strict=True)})
    named = marks.select(*(F.col(c).alias(o) for c, o in zip(_IDENTITY, own, strict=True)), "stays")
    out = wide.join(named, own, "left_anti")
    if not marks.where("stays").isEmpty():  # rows alike in key and text, of which one is kept
        out = out.union(wide.join(named.where("stays"), own, "left_semi").dropDuplicates(own))
    return out.select(docs.columns)
