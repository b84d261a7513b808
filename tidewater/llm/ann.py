"""Approximate nearest neighbours by largest inner product, on robust-pruned directed graphs.

Equal vectors form one node that keeps the smallest ids of its copies, as many as a result
can show; so copies neither crowd a node's edges nor one task. Nodes are parted into bands of about
equal length (a factor of LENGTH_RATIO), since a graph over lengths that differ much loses its way to the
largest products; each band is dealt over shards by hash. Neighbouring bands of fewer than MIXED_ROWS rows
together are one shard, which is searched whole: it is no larger than that. In a band's shard, inserted points search greedily for candidates, and robust pruning keeps a
candidate only if no kept one is ALPHA times nearer to it than the point is; links also go
back, and are pruned again where they overflow. An extra coordinate makes all vectors equally
long, so that nearest by distance means largest inner product. Every query runs a beam search
in every shard; found nodes are scored again in double precision on the original vectors,
and the best of all shards are kept, nearest first, ties to the smaller id.

Bands are counted first; there are at most some 30,000, as many as powers of LENGTH_RATIO among doubles.
A shard's vectors arrive sorted before the queries, which stream through in batches, so a
task holds one shard (SHARD_ROWS nodes at most, in the mean) however many queries there are.
Vectors of doubles keep their precision: graphs are built on 32-bit copies scaled to length 1 at
most, scores come from the vectors as they are. Vectors that are null, zero, or hold null or
non-finite components take no part; neither do those with another number of components than most,
since no inner product with most queries exists. Rows that repeat a vec_id count singly, rows
without one take no part, and an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, LEAST_SHARDS = 20_000, 8
LENGTH_RATIO, MIXED_ROWS = 1.05, 2_048
DEGREE, BEAM, SEARCH_BEAM, ALPHA, BATCH = 24, 64, 128, 1.2, 512


def _distances(vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances (up to a query's own norm) of vectors[ids] (b, k) to queries (b, d)."""
    return norms[ids] - 2 * np.matmul(vectors[ids], queries[:, :, None])[:, :, 0]


def beam_search(vectors: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest found nodes (b, beam), nearest first and -1 where none, and their distances."""
    b, n = len(queries), len(vectors)
    ids = np.full((b, beam), -1)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = _distances(vectors, norms, np.full((b, 1), start), queries)[:, 0]
    seen = np.zeros((b, n), bool)
    seen[:, start] = True
    live = np.arange(b)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        at = open_.argmin(axis=1)
        some = np.isfinite(open_[np.arange(len(live)), at])
        live, at = live[some], at[some]
        if not len(live):
            break
        node = ids[live, at]
        done[live, at] = True
        near = graph[node]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        near = np.where(fresh, near, 0)
        rows, cols = np.nonzero(fresh)
        seen[live[rows], near[rows, cols]] = True
        d = np.where(fresh, _distances(vectors, norms, near, queries[live]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], axis=1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        dist[live] = np.take_along_axis(all_d, order, axis=1)
        ids[live] = np.take_along_axis(all_ids, order, axis=1)
        done[live] = np.take_along_axis(all_done, order, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def robust_prune(vectors: np.ndarray, points: np.ndarray, cands: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to degree diverse candidates (-1: none) for every point, from cands (b, c)."""
    b = len(points)
    here = vectors[np.maximum(cands, 0)]
    d = ((here - vectors[points][:, None]) ** 2).sum(axis=2)
    d[(cands < 0) | (cands == points[:, None])] = np.inf
    kept = np.full((b, degree), -1, np.int32)
    rows = np.arange(b)
    for k in range(degree):
        at = d.argmin(axis=1)
        ok = np.isfinite(d[rows, at])
        if not ok.any():
            break
        kept[ok, k] = cands[rows, at][ok]
        between = ((here - here[rows, at][:, None]) ** 2).sum(axis=2)
        d[(alpha * alpha * between <= d) & ok[:, None]] = np.inf
        d[rows, at] = np.inf
    return kept


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Out-edges (n, degree) of a pruned graph over the vectors, -1 where none, and the entry node."""
    n = len(vectors)
    norms = (vectors**2).sum(axis=1)
    mean = vectors.mean(axis=0)
    start = int(((vectors - mean) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.Generator(np.random.PCG64(11)).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        found, _ = beam_search(vectors, norms, graph, start, vectors[batch], beam)
        peers = np.broadcast_to(batch[:32], (len(batch), len(batch[:32])))  # a batch does not see itself else
        graph[batch] = robust_prune(vectors, batch, np.concatenate([found, peers], axis=1), degree, alpha)
        source, target = np.repeat(batch, degree), graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for a in range(0, len(nodes), BATCH):
            part, k = nodes[a : a + BATCH], count[a : a + BATCH]
            cands = np.full((len(part), degree + int(k.max())), -1)
            cands[:, :degree] = graph[part]
            for i, (f, c) in enumerate(zip(first[a : a + BATCH], k, strict=True)):
                new = source[f : f + c]
                cands[i, degree : degree + c] = np.where(np.isin(new, graph[part[i]]), -1, new)
            full = (cands >= 0).sum(axis=1) > degree
            fits = np.take_along_axis(cands, np.argsort(cands < 0, axis=1, kind="stable")[:, :degree], axis=1)
            graph[part] = fits
            if full.any():
                graph[part[full]] = robust_prune(vectors, part[full], cands[full], degree, alpha)
        at += len(batch)
        size = min(BATCH, max(1, at))
    return graph, start


class Shard:
    """One shard's vectors, with their graph or, of mixed lengths, without; answers batches of queries."""

    def __init__(self, vectors: np.ndarray, members: list[list[int]], mixed: bool = False):
        self.vectors, self.members, self.mixed = vectors, members, mixed
        if mixed:
            return
        most = np.abs(vectors).max(axis=1, keepdims=True).astype(np.float64)
        self.scale = float((most[:, 0] * np.sqrt(((vectors / most) ** 2).sum(axis=1))).max())
        short = vectors.astype(np.float64) / self.scale
        extra = np.sqrt(np.maximum(0, 1 - (short**2).sum(axis=1)))
        self.long = np.hstack([short, extra[:, None]]).astype(np.float32)
        self.norms = (self.long**2).sum(axis=1)
        self.graph, self.start = build_graph(self.long)

    def candidates(self, q: np.ndarray, k: int) -> list[np.ndarray]:
        """For every query the nodes that may be among its k nearest."""
        if not self.mixed:
            short = (q / self.scale).astype(np.float32)
            found, _ = beam_search(self.long, self.norms, self.graph, self.start, np.hstack([short, np.zeros((len(q), 1), np.float32)]), max(SEARCH_BEAM, 2 * k))
            return [nodes[nodes >= 0] for nodes in found]
        score = q @ self.vectors.astype(np.float64).T
        if score.shape[1] <= k + 1:
            return [np.arange(score.shape[1])] * len(q)
        least = -np.partition(-score, k, axis=1)[:, k]  # the own row is one of k + 1
        return [np.flatnonzero(row >= x - abs(x) * 1e-12) for row, x in zip(score, least, strict=True)]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query, vec_id, score): the k best of the shard for every query, without its own row."""
        out = []
        for a in range(0, len(ids), BATCH):
            q = queries[a : a + BATCH].astype(np.float64)
            for own, query, nodes in zip(ids[a : a + BATCH], q, self.candidates(q, k), strict=True):
                score = self.vectors[nodes].astype(np.float64) @ query
                got = []
                for at in np.argsort(-score, kind="stable"):
                    if len(got) >= k and score[at] < got[k - 1][0]:
                        break
                    got += [(score[at], m) for m in self.members[nodes[at]] if m != own]
                    got.sort(key=lambda x: (-x[0], x[1]))
                out += [(int(own), int(m), float(s)) for s, m in got[:k]]
        return out


def plan_shards(bands: dict[int, int]) -> tuple[dict[int, tuple[int, int]], list[bool]]:
    """For every band its first shard and number of shards, and of every shard whether lengths are mixed in it."""
    place: dict[int, tuple[int, int]] = {}
    mixed: list[bool] = []
    rest: list[int] = []

    def close() -> None:
        if rest:
            place.update(dict.fromkeys(rest, (len(mixed), 1)))
            mixed.append(len(rest) > 1)
            rest.clear()

    for band in sorted(bands):
        n = bands[band]
        if n >= MIXED_ROWS or len(bands) == 1:
            close()
            small = n < (256 if len(bands) == 1 else 2048) * LEAST_SHARDS
            shards = max(1 if small else LEAST_SHARDS, math.ceil(n / SHARD_ROWS))
            place[band] = (len(mixed), shards)
            mixed += [False] * shards
            continue
        if sum(bands[b] for b in rest) + n > MIXED_ROWS:
            close()
        rest.append(band)
    close()
    return place, mixed


def nearest(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every row whose key is divisible by every."""
    v = F.col("v")
    kind = "double" if "double" in embeddings.schema[vector].dataType.simpleString() else "float"
    real = np.float64 if kind == "double" else np.float32
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v")).where("id is not null and v is not null")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(fine)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == common["d"])
    most = F.array_max(F.transform(v, F.abs)).cast("double")  # divided by it, no square overflows
    length = F.log(most) + 0.5 * F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / most, F.lit(2.0))))
    # half a step off, so that vectors of length 1, but for rounding, are one band
    rows = rows.withColumn("band", F.floor(length / math.log(LENGTH_RATIO) + 0.5).cast("int"))
    place, mixed = plan_shards({r["band"]: r["count"] for r in rows.groupBy("band").count().collect()})
    shards, dim = len(mixed), int(common["d"])

    def first_copies(batches):
        """Of each vector of the task, the k + 1 smallest ids, and the shards of its band."""
        have: dict[bytes, list[int]] = {}
        bands: dict[bytes, int] = {}
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(real).reshape(-1, dim) + real(0)
            for i, x, band in zip(b.column(0).to_pylist(), flat, b.column(2).to_pylist(), strict=True):
                raw = x.tobytes()
                bands[raw] = band
                ids = have.setdefault(raw, [])
                ids.append(i)
                if len(ids) > 4 * k:
                    have[raw] = sorted(ids)[: k + 1]
            if len(have) > 100_000:
                yield from out(have, bands)
                have, bands = {}, {}
        yield from out(have, bands)

    def out(have, bands):
        found = [(i, x, *place[bands[x]]) for x, ids in have.items() for i in sorted(ids)[: k + 1]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["id", "x", "first", "parts"])

    copies = rows.select("id", "v", "band").mapInArrow(first_copies, "id long, x binary, first int, parts int").withColumn("h", F.xxhash64("x"))
    kept = copies.withColumn("r", F.row_number().over(Window.partitionBy("h", "x").orderBy("id"))).where(F.col("r") <= k + 1)
    nodes = kept.groupBy("h", "x", "first", "parts").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = nodes.select((F.col("first") + F.pmod("h", F.col("parts"))).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "ids", "x")

    def packed(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(real).reshape(-1, dim) + real(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], ["id", "x"])

    asked = rows.select("id", "v").where(F.col("id") % every == 0).mapInArrow(packed, "id long, x binary")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", F.lit(None).cast("array<bigint>").alias("ids"), "x")

    def search(batches):
        current, held, members, shard = None, [], [], None
        for b in batches:
            which, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(which) != 0) | (np.diff(kind) != 0)) + 1), len(which)]
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                if a == e:
                    continue
                x = np.frombuffer(b"".join(b.column(4).slice(a, e - a).to_pylist()), real).reshape(-1, dim)
                if which[a] != current:
                    current, held, members, shard = which[a], [], [], None
                if kind[a] == 0:
                    held.append(x)
                    members += b.column(3).slice(a, e - a).to_pylist()
                elif held:
                    if shard is None:
                        shard = Shard(np.concatenate(held), members, mixed[current])
                    found = shard.search(b.column(2).slice(a, e - a).to_numpy(), x, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])

    dealt = nodes.union(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "id")  # one task a shard
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
