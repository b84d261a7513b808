"""Density clusters of vectors: core distances, a minimum spanning tree, and the most stable clusters.

Two rows are as far apart as the largest of their distance and their core distances (that to the
``min_samples``-th nearest other row). A minimum spanning tree of all rows under that measure holds every
level of density: without its edges over some weight it falls into the clusters of that level. A group counts
as a cluster while it has ``min_cluster_size`` rows; of nested clusters those that last longest are
chosen, and rows of none are outliers (-1).

All is exact, and no table of all pairs is made. Vectors are dealt to blocks around pivots; a block is
compared only with blocks that the triangle inequality lets hold something near enough, in matrices
inside a task. The tree grows by Boruvka rounds: every component takes its shortest way out, which is
read off its rows' neighbour lists where these prove it, and searched for in blocks for the other rows. The
levels at which each row's group reaches ``min_cluster_size`` come from rounds over the tree's edges. The
driver sees pivots (``PIVOTS`` at most, with their pairs) and the tree of clusters, which has fewer nodes than
2 n / min_cluster_size. Tables of nodes meet by sorting on both sides, however small they are: a broadcast would send
each of them through the driver, in every round.

Equal vectors are one node with a number of copies. Vectors that are null, empty, hold null or non-finite
components or have another length than most have a null cluster. Without a split into two clusters all rows
are outliers; an empty table gives no rows. Keys may repeat or be null; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.graph import connected_components
from tidewater.sources.scratch import materialize

PIVOTS, CELLS_AT_A_TIME = 1024, 1 << 21
#: Blocks are as many whatever the number of rows, so that what meets them grows with the rows alone, up to the
#: largest block; the rows that visit a block are dealt over SLICES tasks.
BLOCKS, SMALLEST_BLOCK, LARGEST_BLOCK, SLICES = 12, 1024, 65536, 2
#: Shorter distances count as this, so that copies have a finite density.
LEAST = 1e-10


class Blocks:
    """The pivots, and how far their vectors reach."""

    def __init__(self, nodes: DataFrame, n: int, dim: int, block: int | None) -> None:
        self.dim = dim
        block = block or min(LARGEST_BLOCK, max(SMALLEST_BLOCK, -(-n // BLOCKS)))
        count = min(PIVOTS, max(1, -(-n // block)))
        rows = nodes.orderBy(F.xxhash64("id"), "id").limit(count).select("x").collect()
        self.pivots = np.array([r["x"] for r in rows], float).reshape(-1, dim)
        pivots = self.pivots

        def assign(batches):
            for b in batches:
                x = matrix(b.column(1), dim)
                d = np.sqrt(squares(x, pivots))
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], names=[*b.schema.names, "pivot", "away"])

        placed = materialize(nodes.mapInArrow(assign, "id bigint, x array<double>, copies bigint, pivot int, away double"), "placed")
        found = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.max("away").alias("reach"), F.count("*").alias("n")).collect()}
        self.reach = np.array([found[p]["reach"] if p in found else -1.0 for p in range(len(pivots))])
        self.parts = [max(1, -(-found[p]["n"] // block)) if p in found else 0 for p in range(len(pivots))]
        parts = F.array(*[F.lit(p) for p in self.parts])
        self.nodes = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.element_at(parts, F.col("pivot") + 1)).cast("int"))
        self.apart = np.sqrt(squares(pivots, pivots))

    def partners(self, limits: dict[int, float], own: bool) -> list[list[int]]:
        """For each pivot the pivots whose vectors may lie within the limit of one of its own (only itself if own)."""
        out = []
        for p in range(len(self.pivots)):
            if p not in limits:
                out.append([])
            elif own:
                out.append([p])
            else:
                near = self.apart[p] - self.reach[p] - self.reach <= limits[p] * (1 + 1e-9) + 1e-9
                out.append([int(q) for q in np.flatnonzero(near & (self.reach >= 0))])
        return out

    def meet(self, queries: DataFrame, base: DataFrame, partners: list[list[int]], task, schema: str, names: list[str]) -> DataFrame:
        """Runs task(base columns, query columns) for every block and the queries that visit it.

        queries and base have id, x, pivot, part, comp, core, copies and limit; blocks come first in their task.
        """
        parts = self.parts
        visits = F.array(*[F.array(*[F.struct(F.lit(q).alias("p"), F.lit(k).alias("k")) for q in qs for k in range(parts[q])]) if qs else F.array().cast("array<struct<p:int,k:int>>") for qs in partners])
        columns = ["id", "x", "comp", "core", "copies", "limit"]
        visiting = queries.select(*columns, F.explode(F.element_at(visits, F.col("pivot") + 1)).alias("to")).select(F.col("to.p").alias("p"), F.col("to.k").alias("k"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SLICES)).cast("int").alias("s"), F.lit(1).alias("kind"), *columns)
        visited = sorted({q for qs in partners for q in qs})
        standing = base.where(F.col("pivot").isin(visited)).select(F.col("pivot").alias("p"), F.col("part").alias("k"), F.explode(F.array(*[F.lit(i) for i in range(SLICES)])).alias("s"), F.lit(0).alias("kind"), *columns)
        tasks = min(1000, max(1, 2 * SLICES * sum(parts[q] for q in visited)))
        rows = standing.union(visiting).repartition(tasks, "p", "k", "s").sortWithinPartitions("p", "k", "s", "kind")
        dim = self.dim

        def run(batches):
            key, held, block, beside = None, [], None, None
            for b in batches:
                p, k, s, kind = (b.column(i).to_numpy() for i in range(4))
                cuts = [0, *(np.flatnonzero((np.diff(p) != 0) | (np.diff(k) != 0) | (np.diff(s) != 0) | (np.diff(kind) != 0)) + 1), len(p)]
                for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == e:
                        continue
                    if (p[a], k[a], s[a]) != key:
                        key, held, block = (p[a], k[a], s[a]), [], None
                    part = [b.column(i).slice(a, e - a) for i in range(4, 10)]
                    mine = (part[0].to_numpy(), matrix(part[1], dim), *(c.to_numpy(zero_copy_only=False) for c in part[2:]))
                    if kind[a] == 0:
                        held.append(mine)
                    elif held:
                        if block is None:
                            block = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                            held, beside = [()], widened(block[1])
                        step = max(16, CELLS_AT_A_TIME // len(block[0]))
                        for at in range(0, e - a, step):
                            found = task(block, tuple(c[at : at + step] for c in mine), beside)
                            if len(found[0]):
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)

        return rows.mapInArrow(run, schema)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, by differences where the short form would lose its digits."""
    d = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T
    scale = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None]
    i, j = np.nonzero(d < 1e-4 * scale)
    for at in range(0, len(i), 100_000):
        s = slice(at, at + 100_000)
        d[i[s], j[s]] = ((a[i[s]] - b[j[s]]) ** 2).sum(axis=1)
    return np.maximum(d, 0)


def widened(b: np.ndarray) -> tuple[np.ndarray, float]:
    """b as the right side of one product that gives squared distances, and its largest squared length."""
    long = (b**2).sum(axis=1)
    return np.ascontiguousarray(np.column_stack([b, long, np.ones(len(b))]).T), float(long.max())


def rough_squares(a: np.ndarray, beside: tuple[np.ndarray, float]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one product, and for each row of a more than they can be off."""
    long = (a**2).sum(axis=1)
    return np.column_stack([-2 * a, np.ones(len(a)), long]) @ beside[0], 1e-11 * (long + beside[1]) + 1e-300


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of a and b side by side, by differences: the same from both sides and in every block."""
    d = np.empty(len(a))
    for at in range(0, len(a), 100_000):
        d[at : at + 100_000] = np.sqrt(((a[at : at + 100_000] - b[at : at + 100_000]) ** 2).sum(axis=1))
    return d


def _nearest_task(k: int):
    def task(block, mine, beside):
        """The k nearest other vectors of the block under each query's limit, of equal distances those of least ids."""
        d, off = rough_squares(mine[1], beside)
        most = mine[5] ** 2
        wide = np.flatnonzero(np.isinf(most))
        if len(wide) and d.shape[1] > k + 1:  # one more, since a query may be in the block
            most[wide] = np.partition(d[wide], k, axis=1)[:, k]
        rows, at = np.nonzero(d <= (most * (1 + 1e-11) + 2 * off)[:, None])
        other = mine[0][rows] != block[0][at]
        rows, at = rows[other], at[other]
        d = distances(mine[1][rows], block[1][at])
        near = d <= mine[5][rows]
        rows, at, d = rows[near], at[near], d[near]
        order = np.lexsort((block[0][at], d, rows))
        rows, at, d = rows[order], at[order], d[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        rows, at, d = rows[first], at[first], d[first]
        return mine[0][rows], block[0][at], d, block[4][at]

    return task


def neighbour_lists(blocks: Blocks, k: int) -> DataFrame:
    """(id, b, d, copies): the k nearest other nodes of each node, or more where distances tie at the end."""
    schema, names = "id bigint, b bigint, d double, copies bigint", ["id", "b", "d", "copies"]
    plain = lambda limit: blocks.nodes.withColumns({"comp": F.lit(0).cast("long"), "core": F.lit(0.0), "limit": limit})
    base = plain(F.lit(math.inf))
    some = dict.fromkeys(range(len(blocks.pivots)), math.inf)
    first = materialize(blocks.meet(base, base, blocks.partners(some, True), _nearest_task(k), schema, names), "near")
    order = Window.partitionBy("id").orderBy("d", "b")
    kth = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("id", F.col("d").alias("limit"))
    asking = materialize(plain(F.lit(0.0)).drop("limit").join(kth.hint("merge"), "id", "left").na.fill({"limit": math.inf}), "asking")
    limits = {r["pivot"]: r["limit"] for r in asking.groupBy("pivot").agg(F.max("limit").alias("limit")).collect()}
    rest = materialize(blocks.meet(asking, base, blocks.partners(limits, False), _nearest_task(k), schema, names), "near")
    return materialize(rest.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"), "neighbours")


def _way_out(block, mine, beside):
    """The least (weight, ends) from each query to another component, within its limit."""
    w, off = rough_squares(mine[1], beside)
    np.maximum(w, (block[3] ** 2)[None], out=w)
    w[mine[2][:, None] == block[2][None]] = np.inf
    most = np.minimum(np.maximum(w.min(axis=1), mine[3] ** 2), mine[5] ** 2)
    rows, at = np.nonzero(w <= np.where(np.isfinite(most), most * (1 + 1e-11) + 2 * off, -1.0)[:, None])
    w = np.maximum(np.maximum(distances(mine[1][rows], block[1][at]), mine[3][rows]), block[3][at])
    a, b = mine[0][rows], block[0][at]
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo, w, rows))
    order = order[np.concatenate([[True], np.diff(rows[order]) != 0])] if len(order) else order
    order = order[w[order] <= mine[5][rows[order]]]
    return [pa.array(c[order]) for c in (mine[2][rows], w, lo, hi, block[2][at])]


def united(ways: DataFrame) -> DataFrame:
    """(comp, root) where every component goes one way (comp, to) and only pairs go in a circle: their lesser is
    the root, and each round follows what was found sixteen steps further."""
    back = ways.select(F.col("comp").alias("c2"), F.col("to").alias("t2"))
    roots = materialize(ways.join(back.hint("merge"), F.col("to") == F.col("c2")).select("comp", F.when((F.col("t2") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root")), "roots")
    while True:
        out = roots
        for _ in range(4):
            out = out.join(out.select(F.col("comp").alias("c2"), F.col("root").alias("r2")).hint("merge"), F.col("root") == F.col("c2")).select("comp", F.col("r2").alias("root"))
        roots = materialize(out, "roots")
        further = roots.join(roots.select(F.col("comp").alias("c2"), F.col("root").alias("r2")).hint("merge"), F.col("root") == F.col("c2"))
        if further.where("root <> r2").isEmpty():
            return roots


def spanning_tree(blocks: Blocks, near: DataFrame, cores: DataFrame) -> DataFrame:
    """(lo, hi, w): the minimum spanning tree under mutual reachability, ties in order of (w, lo, hi).

    cores has id, core and sure: nodes not in a node's list are at least that far.
    """
    c = lambda name: cores.select(F.col("id").alias(name), F.col("core").alias(f"core_{name}"))
    listed = near.select(F.col("id").alias("a"), "b", "d").join(c("a").hint("merge"), "a").join(c("b").hint("merge"), "b")
    listed = listed.select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))
    listed = materialize(listed.union(listed.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).distinct(), "listed")
    comps = cores.select("id", F.col("id").alias("comp"))
    tree: list[DataFrame] = []
    while True:
        of = lambda name, comps=comps: comps.select(F.col("id").alias(name), F.col("comp").alias(f"c{name}"))
        listed = materialize(listed.drop("ca", "cb").join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where("ca <> cb"), "listed")
        edge = F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("cb").alias("other"))
        known = listed.groupBy(F.col("ca").alias("comp")).agg(F.min(edge).alias("e"))
        nodes = blocks.nodes.join(comps.hint("merge"), "id").join(cores.hint("merge"), "id").join(known.select("comp", F.col("e.w").alias("limit")).hint("merge"), "comp", "left").na.fill({"limit": math.inf})
        nodes = materialize(nodes, "open")
        asking = nodes.where("sure <= limit")
        limits = {r["pivot"]: r["limit"] for r in asking.groupBy("pivot").agg(F.max("limit").alias("limit")).collect()}
        best = known
        if limits:
            found = blocks.meet(asking, nodes, blocks.partners(limits, False), _way_out, "comp bigint, w double, lo bigint, hi bigint, other bigint", ["comp", "w", "lo", "hi", "other"])
            found = found.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e"))
            best = known.union(found).groupBy("comp").agg(F.min("e").alias("e"))
        best = materialize(best, "ways")
        if best.isEmpty():
            break
        tree.append(best.select("e.lo", "e.hi", "e.w").distinct())
        joined = united(best.select("comp", F.col("e.other").alias("to")))
        comps = materialize(comps.join(joined.hint("merge"), "comp").select("id", F.col("root").alias("comp")), "comps")
    if not tree:
        return cores.sparkSession.createDataFrame([], "lo long, hi long, w double")
    out = tree[0]
    for t in tree[1:]:
        out = out.union(t)
    return materialize(out, "tree")


def levels(tree: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(id, w, lo, hi): the edge at which each node's group reaches the size; nodes of none are left out.

    Components that are each other's nearest unite, and those whose nearest has reached the size, or hangs by
    ever nearer ones on such a one, reach it by their own edge. Every round halves such chains at least.
    """
    at = lambda w, lo, hi: F.struct(w.alias("w"), lo.alias("lo"), hi.alias("hi"))
    none = F.lit(-1).cast("long")
    own = nodes.select("id", F.col("id").alias("comp"), "copies", F.when(F.col("copies") >= size, at(F.col("core"), none, none)).alias("level"))
    state = materialize(own, "levels")
    both = materialize(tree.select(F.col("lo").alias("a"), F.col("hi").alias("b"), at(F.col("w"), F.col("lo"), F.col("hi")).alias("e")).union(tree.select(F.col("hi").alias("a"), F.col("lo").alias("b"), at(F.col("w"), F.col("lo"), F.col("hi")).alias("e"))), "ends")
    while True:
        open_ = state.where("level is null")
        sizes = open_.groupBy("comp").agg(F.sum("copies").alias("n"))
        ends = both.join(open_.select(F.col("id").alias("a"), F.col("comp").alias("ca")).hint("merge"), "a").join(state.select(F.col("id").alias("b"), F.when(F.col("level").isNull(), F.col("comp")).alias("cb")).hint("merge"), "b")
        out = ends.where("cb is null or ca <> cb").groupBy(F.col("ca").alias("comp")).agg(F.min(F.struct("e", "cb")).alias("m")).select("comp", "m.e", F.col("m.cb").alias("to"))
        out = materialize(out.join(sizes.hint("merge"), "comp"), "nearest")
        if out.isEmpty():
            break
        # two components that are each other's nearest share the edge; roots are these and what has reached the size
        mutual = out.join(out.select(F.col("comp").alias("c2"), F.col("to").alias("t2"), F.col("n").alias("n2")).hint("merge"), (F.col("to") == F.col("c2")) & (F.col("comp") == F.col("t2")), "left")
        step = mutual.select("comp", "e", "n", F.when(F.col("to").isNull(), F.lit(1)).when(F.col("c2").isNull(), F.lit(0)).when(F.col("n") + F.col("n2") >= size, F.lit(1)).otherwise(F.lit(2)).alias("kind"), "to")
        step = materialize(step, "steps")  # kind 1: reaches the size now; 2: unites with its mate, still small; 0: hangs on another; 3: waits for the next round
        kinds = step.select("comp", "kind", "to")
        for _ in range(4):
            other = kinds.select(F.col("comp").alias("c2"), F.col("kind").alias("k2"), F.col("to").alias("t2"))
            waits = F.col("kind") == 0
            kind = F.when(waits & (F.col("k2") == 1), 1).when(waits & (F.col("k2") > 1), 3).otherwise(F.col("kind"))
            kinds = kinds.join(other.hint("merge"), F.col("to") == F.col("c2"), "left").select("comp", kind.alias("kind"), F.when(waits & (F.col("k2") == 0), F.col("t2")).otherwise(F.col("to")).alias("to"))
        done = step.drop("kind").join(kinds.select("comp", "kind").hint("merge"), "comp").select("comp", F.when(F.col("kind") == 1, F.col("e")).alias("reached"), F.when(F.col("kind") == 2, F.least("comp", "to")).alias("united"))
        state = state.join(done.hint("merge"), "comp", "left").select("id", F.coalesce("united", "comp").alias("comp"), "copies", F.coalesce("level", "reached").alias("level"))
        state = materialize(state, "levels")
    return state.where("level is not null").select("id", "level.w", "level.lo", "level.hi")


class ClusterTree:
    """Clusters from the edges at which two groups of full size meet: leaves are cells, the root is all.

    ``top`` is the edge at which a cluster meets its sibling, ``low`` the one at which it falls into its children.
    """

    def __init__(self, cells: list[int], merges: list[tuple[tuple[float, int, int], int, int]]) -> None:
        self.leaf = {c: i for i, c in enumerate(sorted(cells))}
        n = len(self.leaf)
        self.parent, self.children = [-1] * n, [[] for _ in range(n)]
        self.low: list[tuple | None] = [None] * n
        self.top: list[tuple | None] = [None] * n
        root = list(range(n))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for edge, a, b in sorted(merges):
            x, y = find(self.leaf[a]), find(self.leaf[b])
            new = len(self.parent)
            self.parent.append(-1)
            self.children.append([x, y])
            self.low.append(edge)
            self.top.append(None)
            root.append(new)
            for k in (x, y):
                self.parent[k], self.top[k], root[k] = new, edge, new

    def entered(self, cell: int, edge: tuple[float, int, int]) -> int:
        """The cluster that a row of the cell joins when its group reaches the size by the edge."""
        k = self.leaf[cell]
        while self.top[k] is not None and self.top[k] < edge:
            k = self.parent[k]
        return k

    def choose(self, rows: dict[int, int], density: dict[int, float]) -> tuple[list[int], list[float]]:
        """For every cluster the chosen one that holds it (-1: none), and stabilities; rows and density: of those that enter it."""
        n = len(self.parent)
        size, stability, best = [0] * n, [0.0] * n, [0.0] * n
        chosen = [False] * n
        for k in range(n):  # children come before parents
            below = sum(size[c] for c in self.children[k])
            size[k] = below + rows.get(k, 0)
            if self.top[k] is None:
                continue
            born = density_of(self.top[k][0])
            stability[k] = density.get(k, 0.0) - rows.get(k, 0) * born + (below * (density_of(self.low[k][0]) - born) if below else 0.0)
            inside = sum(best[c] for c in self.children[k])
            chosen[k] = not self.children[k] or stability[k] >= inside
            best[k] = max(stability[k], inside) if self.children[k] else stability[k]
        label = [-1] * n
        for k in reversed(range(n)):
            above = label[self.parent[k]] if self.parent[k] >= 0 else -1
            label[k] = above if above >= 0 else k if chosen[k] else -1
        return label, stability


def density_of(w: float) -> float:
    return 1 / max(w, LEAST)


def density_clusters(df: DataFrame, key: str, vector: str, min_samples: int = 5, min_cluster_size: int = 15, neighbours: int | None = None, block: int | None = None) -> DataFrame:
    """key, cluster, w: the cluster of each row (from 0, in order of their smallest nodes; -1 for outliers) and the
    weight at which the row's group reaches ``min_cluster_size`` (null if never)."""
    k = max(neighbours or 2 * min_samples, min_samples)
    spark = df.sparkSession
    x = F.col("x")
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    fine = x.isNotNull() & (F.size("x") > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf))
    common = rows.where(fine).groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    none = F.lit(None)
    if common is None:
        return rows.select("key", none.cast("int").alias("cluster"), none.cast("double").alias("w")).withColumnRenamed("key", key)
    fine = fine & (F.size("x") == common["dim"])
    rows = rows.withColumn("x", F.when(fine, F.transform(x, lambda v: v + F.lit(0.0))))  # -0.0 is 0.0
    nodes = rows.where("x is not null").groupBy("x").agg(F.count("*").alias("copies"))
    nodes = materialize(nodes.select(F.xxhash64("x").alias("id"), "x", "copies"), "nodes")
    n, ids = nodes.agg(F.count("*"), F.count_distinct("id")).first()
    if n != ids:
        raise ValueError("two different vectors have one 64-bit hash")
    blocks = Blocks(nodes.select("id", "x", "copies"), n, int(common["dim"]), block)
    near = neighbour_lists(blocks, k)
    order = Window.partitionBy("id").orderBy("d", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heard = near.withColumn("upto", F.sum("copies").over(order)).groupBy("id").agg(F.count("*").alias("listed"), F.max("d").alias("last"), F.collect_list(F.struct("d", "upto")).alias("l"))
    enough = lambda c: F.array_min(F.transform(F.filter("l", lambda e: e["upto"] + c - 1 >= min_samples), lambda e: e["d"]))
    cores = nodes.select("id", "copies").join(heard.hint("merge"), "id", "left")
    cores = cores.select("id", F.when(F.col("copies") > min_samples, 0.0).otherwise(F.coalesce(enough(F.col("copies")), "last", F.lit(0.0))).alias("core"), F.when(F.coalesce("listed", F.lit(0)) < k, F.lit(math.inf)).otherwise(F.col("last")).alias("sure"))
    cores = materialize(cores, "cores")
    tree = spanning_tree(blocks, near, cores)
    level = levels(tree, nodes.select("id", "copies").join(cores.select("id", "core").hint("merge"), "id"), min_cluster_size)
    edge = F.struct("w", "lo", "hi")
    side = lambda name: level.select(F.col("id").alias(name), F.struct("w", "lo", "hi").alias(f"at_{name}"))
    judged = tree.join(side("lo").hint("merge"), "lo", "left").join(side("hi").hint("merge"), "hi", "left").withColumn("full", F.coalesce((F.col("at_lo") < edge) & (F.col("at_hi") < edge), F.lit(False)))
    judged = materialize(judged.select("lo", "hi", "w", "full"), "judged")
    joined = connected_components(judged.where("not full").select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    cells = materialize(nodes.select("id", "copies").join(joined.hint("merge"), F.col("id") == F.col("node"), "left").select("id", "copies", F.coalesce("component", "id").alias("cell")).join(level.hint("merge"), "id", "left"), "cells")
    of = lambda name: cells.select(F.col("id").alias(name), F.col("cell").alias(f"c_{name}"))
    merges = [((r["w"], r["lo"], r["hi"]), r["c_lo"], r["c_hi"]) for r in judged.where("full").join(of("lo").hint("merge"), "lo").join(of("hi").hint("merge"), "hi").collect()]
    found = sorted({c for _, a, b in merges for c in (a, b)})
    if not merges:
        labelled = cells.select("id", F.lit(-1).alias("cluster"), "w")
    else:
        clusters = ClusterTree(found, merges)

        def enter(batches):
            for b in batches:
                rows = zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns[:2], b.column(3), pa.array([-1 if w is None else clusters.entered(cell, (w, lo, hi)) for cell, w, lo, hi in rows], pa.int32())], names=["id", "copies", "w", "entered"])

        inside = materialize(cells.select("id", "copies", "cell", "w", "lo", "hi").mapInArrow(enter, "id bigint, copies bigint, w double, entered int"), "entered")
        sums = inside.where("entered >= 0").groupBy("entered").agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") / F.greatest("w", F.lit(LEAST))).alias("density"), F.min("id").alias("least")).collect()
        label, _ = clusters.choose({r["entered"]: r["rows"] for r in sums}, {r["entered"]: r["density"] for r in sums})
        least: dict[int, int] = {}
        for r in sums:
            c = label[r["entered"]]
            if c >= 0:
                least[c] = min(least.get(c, r["least"]), r["least"])
        number = {c: i for i, c in enumerate(sorted(least, key=least.get))}
        names = spark.createDataFrame([(k, number[c]) for k, c in enumerate(label) if c >= 0 and c in number], "entered int, cluster int")
        labelled = inside.join(names.hint("merge"), "entered", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "w")
    out = rows.withColumn("id", F.when(F.col("x").isNotNull(), F.xxhash64("x"))).join(labelled.hint("merge"), "id", "left")
    return out.select(F.col("key").alias(key), "cluster", "w")
